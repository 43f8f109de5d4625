"""Divergence of sources, quality rules and collocations against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weldsight.llm import collocations, divergence, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, rank int, n long, block string, item string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "b", "i") for r in rows], SCHEMA).repartition(5)


def _zipf(r, n, words=60, ends=True):
    out = []
    for _ in range(n):
        out.append(f"{'Wörd' if r.random() < 0.3 else 'w'}{chr(97 + int(words ** r.random()) % 26)}{chr(97 + int(words ** r.random()) % 26)}")
        if ends and r.random() < 0.1:
            out[-1] += r.choice([".", "!", "\n", ";\t", " , ", "\r\n"])
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    langs = ["en", "en", "en", "de", None]
    rows = [(i, _zipf(r, r.choice([0, 3, 40, 200])), langs[i % 5], f"s{i % 7 if i % 3 else 0}") for i in range(300)]
    rows += [(i, "one phrase that comes again and again" + (" X" if i % 2 else ""), "en", "s9") for i in range(300, 345)]
    rows += [(400, None, "en", "s1"), (401, "", "fr", None), (402, "rare words", "fr", "s2"), (403, " \t.. ", "xx", "s1"), (None, "no id here", "en", "s1"), (404, _zipf(r, 3000), "en", None), rows[0], rows[0]]
    return rows


# divergence


def _divergence(rows, least):
    found = {}
    langs = {r[2] or "" for r in rows}
    for lang in langs:
        groups, docs = defaultdict(Counter), Counter()
        for _, text, own, source in rows:
            if (own or "") == lang:
                terms = re.findall(divergence.TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))
                groups[source or ""].update(terms)
                docs.update(set(terms))
        kept = sorted((t for t, n in docs.items() if n >= least), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        q, p = share(whole), {s: share(c) for s, c in groups.items()}
        for s in groups:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (x[0], x[1].encode()))
            found |= {(lang, s, "pair", o): (-v, i) for i, (v, o) in enumerate(far, 1)}
            top = sorted(((q[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:50]
            found |= {(lang, s, "term", t): (-v, i) for i, (v, t) in enumerate(top, 1)}
    return found


@pytest.mark.parametrize(("least", "slice_terms", "seated"), [(30, 1 << 15, (8, 128)), (5, 7, (1, 1)), (10**9, 7, (1, 1)), (2, 40, (2, 2))])
def test_divergence_by_brute_force(spark, corpus, least, slice_terms, seated):
    rows = divergence.divergence(_frame(spark, corpus), least, slice_terms, seated).collect()
    got = {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in rows}
    assert len(rows) == len(got) and got == _divergence(corpus, least)
    assert ("fr", "", "pair", "s2") in got and ("xx", "s1") not in {k[:2] for k in got}


def test_every_pair_of_blocks_meets_once(spark):
    for blocks in (2, 4, 6, 10, 18):
        frame = spark.range(blocks).selectExpr("CAST(id AS INT) AS block", f"{blocks} AS blocks")
        met = []
        for start in range(0, blocks - 1, divergence.ROUNDS):
            rows = frame.select("block", divergence._visits(start).alias("at")).collect()
            met += [tuple(sorted((r.block, c))) for r in rows for c in r["at"] or []]
        assert sorted(met) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 10**12, 7 * 10**12 + 3])
    assert divergence._shares(counts, 9 * 10**12, 1000).tolist() == [1 + 10**9 * (int(c) + 5) // (9 * 10**12 + 5000) for c in counts]


def test_seated_vectors_are_not_shuffled_again(spark):
    from weldsight.llm.common import cut, settled_in_place

    with settled_in_place(spark):
        seats = cut(spark.range(100).selectExpr("id % 7 AS a", "id").repartition("a"))
    other = spark.range(100).selectExpr("id % 7 AS a", "id")
    plan = seats.groupBy("a").cogroup(other.groupBy("a")).applyInArrow(lambda a, b: a, "a long, id long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_divergence_of_nothing(spark):
    assert divergence.divergence(_frame(spark, []).limit(0)).count() == 0


# quality rules


def _counts(text):
    words = re.findall(quality_rules.WORD, text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(quality_rules.LINE_WITH_WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(quality_rules.SYMBOL, text or "")), len(lines) - len(set(lines)), len(covered)


def test_text_counts_by_brute_force(spark, corpus):
    more = ["a a a a a", "a b c a b c x a b", "x\nx\n \n\n x\nx", "#$ |<>*&% \x0b\x0c a b  ", "é" * 70, "w " * 100_000, "q " + " ".join(map(str, range(50_000))) + " 7 8 9", "1 2 3\r1 2 3"]
    rows = [*corpus, *[(1000 + i, t, "en", "s") for i, t in enumerate(more)]]
    got = sorted((r.doc_id or -1, *[r[c] for c in quality_rules.COUNTS]) for r in quality_rules.text_counts(_frame(spark, rows)).collect())
    assert got == sorted((i if i is not None and i else -1, *_counts(t)) for i, t, _, _ in rows)


def _allowed(n, risk, chance):
    total, k = 0.0, -1
    for i in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
        if total > chance:
            return k
        k = i
    return k


def test_exact_binomial_bounds(spark):
    from pyspark.sql import functions as F

    sizes = [0, 1, 10, 100, 367, 368, 1000, 5000, 200_000]
    for risk, chance in ((0.05, 0.05), (0.0125, 0.003125), (0.2, 1e-6)):
        rows = quality_rules.most_rejected(spark.createDataFrame([(n,) for n in sizes], "good long"), risk, F.lit(chance)).collect()
        assert {r.good: r.allowed for r in rows} == {n: _allowed(n, risk, chance) for n in sizes}


def _labelled(n=3000):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(r.randint(60, 120))]
        if bad:
            words = [w + "##" if k % 3 else w for k, w in enumerate(words)]
        elif i % 97 == 1:
            words[0] = "#" * 40
        rows.append((i, " ".join(words), "en" if i % 10 else "tiny", "s"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_rules_keep_the_risk_and_catch_the_bad(spark):
    rows, labels = _labelled()
    frame = spark.createDataFrame([*labels, (1, 1), (2, None), (3, 7), (None, 0), (99_999, 0)], "doc_id long, quality int")
    docs = _frame(spark, [*rows, (5000, "few words", "en", "s"), (5001, None, "en", "s"), (5002, "a b c " * 40, "en", "s"), (None, rows[1][1], "en", "s"), (5003, rows[5][1], "none", "s"), rows[7]])
    got = defaultdict(list)
    for r in quality_rules.quality_rules(docs, frame).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows) + 6 and len(got[7]) == 2
    assert all(r.base_failed and not r.kept for i in (5000, 5001, 5002) for r in got[i])
    assert got[None][0].kept and got[5003][0].kept  # a stratum without labels has the base rules alone
    good = [i for i, q in labels if q and i % 10]
    assert sum(not got[i][0].kept for i in good) <= 0.05 * len(good)
    bad = [i for i, q in labels if not q and i % 10]
    assert not any(got[i][0].kept for i in bad)
    assert quality_rules.quality_rules(_frame(spark, []).limit(0), frame).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(docs, frame.limit(0)).collect())


def test_cutoffs_need_enough_labels(spark):
    rows, labels = _labelled(300)
    docs = _frame(spark, rows)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.kept for r in quality_rules.quality_rules(docs, frame).collect()} == {True}
    wide = quality_rules.quality_rules(docs, frame, risk=0.6, chance=0.5).filter("NOT kept").select("doc_id").collect()
    assert len(wide) >= 25


def test_quality_rules_stay_in_the_jvm(spark):
    rows, labels = _labelled(50)
    plan = quality_rules.text_counts(_frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


# collocations


def _collocations(rows, least, top):
    grams, sizes = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                grams[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in grams.items():
        held = {g: n for g, n in counts.items() if n >= least}
        around = defaultdict(int)
        for g, n in held.items():
            for m in range(2, len(g)):
                for s in range(len(g) - m + 1):
                    around[g[s : s + m]] = max(around[g[s : s + m]], n)
        found = []
        for g, a in held.items():
            if len(g) > 1 and not 100 * around[g] >= 80 * a:
                score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "block"), [(30, 2000, 1 << 22), (3, 25, 50), (2, 2000, 7), (1, 40, 1)])
def test_collocations_by_brute_force(spark, corpus, least, top, block):
    got = [tuple(r) for r in collocations.collocations(_frame(spark, corpus), least, top, block).collect()]
    want = _collocations(corpus, least, top)
    assert sorted(got) == want and len(want) >= 4


def test_collocations_of_nothing(spark):
    assert collocations.collocations(_frame(spark, []).limit(0)).count() == 0
    assert collocations.collocations(_frame(spark, [(1, None, None, None), (2, "a b", "en", "s")])).count() == 0


def test_packed_ids_take_little_more_than_their_low_bytes():
    from weldsight.llm import collocations

    r = np.random.default_rng(2)
    local, ids = np.sort(r.choice(60_000, 3000, replace=False)).astype("<i4"), (r.integers(0, 64, 3000) << 32 | r.integers(0, 9000, 3000)).astype("<i8")
    packed = collocations._pack(local, ids, ids[::-1])
    back = collocations._unpack(packed, 3000, "<i4", "<i8", "<i8")
    assert all(np.array_equal(a, b) for a, b in zip(back, (local, ids, ids[::-1]), strict=True))
    assert len(packed) < 3000 * (1.5 + 3 + 3)
    assert [len(x) for x in collocations._unpack(collocations._pack(local[:0], ids[:0]), 0, "<i4", "<i8")] == [0, 0]
