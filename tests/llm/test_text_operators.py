"""Small cases of the text operators: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import random
import re
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from weldsight.llm import ann, byte_bpe, exact_dedup, html_content, langid, mixing, near_dedup, sharding, substring_dedup, toxicity
from weldsight.llm.grouping_sort import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, label string"


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = _words(1, 300)
    edited = base.split()
    edited[150] = "CHANGED"
    return {1: base, 2: base, 3: base.upper(), 4: " ".join(edited), 5: None, 6: "", 7: "one two", 8: "one two", 9: _words(2, 20_000), 10: _words(3, 50), 11: " \n\t ", 12: "ÄÖ äö", 13: "äö äö"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i == 7 else "en", None if i == 8 else f"s{i % 2}", 0, None, None, None) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "en", "s0", 0, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_by_brute_force():
    r = random.Random(4)
    for _ in range(400):
        s = [r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 25))]
        order = suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for k, n in enumerate(common_prefixes(s, order)):
            if k:
                a, b = s[order[k - 1] :], s[order[k] :]
                assert a[:n] == b[:n] and (a[n : n + 1] != b[n : n + 1] or len(a) == n or len(b) == n)


def test_exact_dedup(docs, empty):
    rows = exact_dedup.content_sort_dedup(docs).collect()
    assert len(rows) == docs.count()
    keep = {r.doc_id: r.keep_id for r in rows}
    assert [keep[i] for i in (1, 2, 3, 5, 6, 7, 8, 12, 13)] == [3, 3, 3, 6, 6, 8, 8, 12, 13]
    assert all(sum(r.kept for r in rows if r.text_sha256 == h) == 1 for h in {r.text_sha256 for r in rows})
    assert {r.group_size for r in rows if r.keep_id == 3} == {4}
    assert exact_dedup.content_sort_dedup(empty).count() == 0
    assert exact_dedup.without_copies(docs).count() == len({r.text_sha256 for r in rows})


def test_near_dedup_by_brute_force(docs, texts, empty):
    rows = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert rows[1] == rows[2] == rows[3] == rows[4] == 1
    assert rows[5] == rows[6] == rows[11] == 5 and rows[7] == rows[8] == 7
    assert rows[9] == 9 and rows[10] == 10 and rows[12] == rows[12]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    a = Counter({i: 1 + i % 4 for i in range(400)})
    b = Counter({i: 1 + (i % 4 if i % 5 else 0) for i in range(40, 400)})
    want = sum((a & b).values()) / sum((a | b).values())
    flat = lambda c: np.sort(near_dedup.mix64(np.array([i for i, n in c.items() for _ in range(n)], np.uint64) + np.uint64(1)))
    x, y = flat(a), flat(b)
    got = near_dedup.bag_minhash(np.concatenate([x, y]), np.array([len(x), len(y)]), 4000)
    assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_substring_dedup_by_brute_force(spark, empty):
    r = random.Random(6)
    passage, other = _words(7, 90)[:480], _words(8, 200)
    cases = [f"{_words(20 + i, 40)} {passage} {_words(40 + i, r.randint(0, 60))}" for i in range(6)] + [other, other, None, "", "short", "ab" * 700, passage[:399], other + "é" * 300]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, key string")
    raw = [(t or "").encode() for t in cases]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    for hot in (substring_dedup.HOT, 1):
        for row in substring_dedup.remove_repeats(docs, hot=hot).collect():
            t = raw[row.doc_id]
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - 399):
                if seen[t[i : i + 400]] > 1:
                    gone[i : i + 400] = True
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            kept = hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()
            assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(t), int(gone.sum()), spans, kept)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_byte_bpe_as_the_library(docs, texts, empty):
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.bpe_encode(docs)
    for r in byte_bpe.bpe_decode(coded).collect():
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert list(r.ids) == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert byte_bpe.bpe_round_trip(empty).count() == 0
    codec = byte_bpe._codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    hard = ["a" * 3000, "thein" * 500, "  \n x\u0085y ''re's 12²3 ٣٤ 日本語 ​", "x" * 257, " " * 70 + "z", "😀" * 100]
    ids, sizes = codec.encode(hard)
    at = np.cumsum(sizes) - sizes
    assert [ids[a : a + n].tolist() for a, n in zip(at, sizes, strict=True)] == [library.encode_ordinary(t) for t in hard]


_WORKER = """
import random, re
import public_tokenizers
import pyarrow as pa
from weldsight.llm import byte_bpe

def mb(what):
    with open("/proc/self/status") as f:
        return int(re.search(what + r":\\s+(\\d+)", f.read())[1]) // 1024

rng = random.Random(3)
texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=7)) for _ in range(250)) for _ in range(4000)]
batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
codec = byte_bpe._codec(None, public_tokenizers.PATTERN)
byte_bpe.trim()
before, rows = mb("VmRSS"), 0
for out in byte_bpe._digests(byte_bpe._decoded(byte_bpe._encoded(iter([batch]), None, public_tokenizers.PATTERN), None, public_tokenizers.PATTERN)):
    rows += out.num_rows
print(rows, mb("VmHWM") - before, flush=True)
"""


def test_byte_bpe_worker_stays_small():
    found = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True)
    rows, grown = map(int, found.stdout.split()[:2])
    assert rows == 4000 and grown < 190


def test_shards(docs, empty):
    rows = sharding.shard(docs, shards=4).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sharding.shard(empty).count() == 0


def test_linked_rows_come_together(spark):
    docs = spark.createDataFrame([(i, f"text {i // 3}") for i in range(600)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=4).collect()
    split = sum(len({r.shard for r in rows if r.doc_id // 3 == g}) > 1 for g in range(200))
    assert split <= 10 and set(Counter(r.shard for r in rows).values()) == {150}


def test_mixture(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.prob <= 1 for r in rows)
    assert max(r.prob for r in rows) == 1.0 and {r.prob for r in rows if r.tokens == 0} == {0.0}
    assert {r.source for r in rows if r.doc_id == 8} == {"?"}
    taken = sorted(r.doc_id or 0 for r in rows if r.taken)
    assert sorted(r.doc_id or 0 for r in mixing.take(docs).collect()) == taken
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).columns == empty.columns


def test_raked_margins_are_the_targets(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 300), ("b", "x", "u", 50), ("b", "y", "t", 25)], "source string, lang string, topic string, base long")
    wanted = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"t": 0.8, "u": 0.2}}
    rows = mixing.rake(cells, 20, wanted).collect()
    total = sum(r.weight for r in rows)
    for m, shares in wanted.items():
        for v, s in shares.items():
            assert sum(r.weight for r in rows if r[m] == v) / total == pytest.approx(s, abs=1e-3)


def test_mixture_of_a_share_keeps_it_whatever_the_smallest_cell(spark):
    import corpus_pipeline

    rows = [(i, _words(i, 150), "de" if i % 5 == 0 else "en", f"s{i % 3 if i % 4 else 0}") for i in range(2000)]
    for stray in ([], [(5000, _words(1, 50), "en", "stray")]):
        docs = spark.createDataFrame([*rows, *stray], "doc_id long, text string, lang string, source string")
        mixed = mixing.mix(docs, share=0.5).collect()
        tokens = sum(r.tokens for r in mixed)
        assert sum(r.tokens * r.prob for r in mixed) == pytest.approx(0.5 * tokens, rel=1e-3)
        assert all(0 < r.prob <= 1 for r in mixed) and all(r.prob == 1 for r in mixed if r.source == "stray")
        words = sum(len(r.text.split()) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
        assert 0.44 < words / tokens < 0.56
        within = {s: sum(r.tokens for r in mixed if r.source == s) for s in ("s0", "s1", "s2", "stray")}
        power = {s: n**0.7 for s, n in within.items() if s != "stray"}
        rest = 0.5 * tokens - within["stray"]
        for s, p in power.items():
            assert sum(r.tokens * r.prob for r in mixed if r.source == s) == pytest.approx(rest * p / sum(power.values()), rel=0.02)


def test_toxicity(spark, docs, empty):
    assert toxicity.fold("An 1D10T, сlown!") == " an idiot clown "
    r = random.Random(2)
    rows = [(i, f"{_words(i, 40)} {'you moron' if i % 4 == 0 else 'moronic acid' if i % 4 == 1 else ''} {_words(-i, r.randint(1, 40))}", int(i % 4 == 0)) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_toxicity(train.drop("toxic"), train.select("doc_id", "toxic"))
    scored = {x.doc_id: x for x in toxicity.score_toxicity(train, lexicon).collect()}
    assert sum(scored[i].predicted == t for i, _, t in rows) >= 396
    assert all(0 <= x.score <= 1 for x in toxicity.score_toxicity(docs, lexicon).collect())
    assert toxicity.score_toxicity(empty, lexicon).count() == 0
    none = toxicity.learn_toxicity(docs, train.select("doc_id", "toxic").limit(0))
    assert {x.predicted for x in toxicity.score_toxicity(docs, none).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body>
<div class="cookie-banner"><p>We use cookies here.</p></div><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<article class="post"><h1>A  fine
 day &amp; night</h1><p>First paragraph of the story, with <b>bold</b>&nbsp;words and more text.<p>Second one.<br>Line two, still here.
<div class="ad">Buy now</div></article><div id="comments"><p>Great article, thank you.</p></div><form><p>Your mail</p></form><footer>&copy; me</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "<p"), (5, "u", "plain text without any markup, but long enough to be read."), (6, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_content.extract(pages).collect()}
    assert got[1].text == "A fine day & night\nFirst paragraph of the story, with bold words and more text.\nSecond one. Line two, still here."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[4].text == ""
    assert got[5].text == rows[4][2] and got[6].text == "deep"
    assert html_content.extract(pages.limit(0)).count() == 0


def test_main_text_of_unnamed_pages_and_odd_end_tags(spark):
    first, second = "First paragraph of the story, with many words and more text, as stories have.", "Second paragraph of it, a little longer, so that it reads like one."
    story = f"<h1>A fine day</h1><p>{first}</p><p>{second}</p>"
    links = "<div class=k1><a href=/>Home</a> <a href=/b>News</a></div>"
    rows = [(1, f"<body><div class=b9>{story}</div>"), (2, f"<body>{links}<div class=k7>{story}</div>{links}"), (3, f"<body><div>{story}</div>")]
    odd = ("<style>x</style foo>", "<script>a</scripts>leak</SCRIPT >", "<script>a</script\n>")
    rows += [(10 + i, f"<p>{cafe} one, with a few words.</p>{odd[i % 3]}<p>{second}</p>") for i, cafe in enumerate(["Cafe"] * 3 + ["Café"] * 3)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_content.extract(pages).collect()}
    assert all(got[i] == f"A fine day\n{first}\n{second}" for i in (1, 2, 3))
    assert all(got[i] == f"{h[3:7]} one, with a few words.\n{second}" for i, h in rows[3:])


def test_main_text_of_unseen_generated_pages():
    weights, edges = html_content.train(html_content.labelled_pages(html_content.TRAIN_PAGES))
    unseen = html_content.labelled_pages(200, seed=5)
    want = ["\n".join(text for i, text in t.blocks.items() if t.label[i]) for t in map(html_content.Tree, unseen)]
    got = html_content.main_texts([p.replace(" data-label", "") for p in unseen], weights, edges)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 185


_STORY = "<p>The harbour opened in spring, and the town grew around it quickly. Ships came from the north, loaded with timber and with grain.</p><p>By autumn the first market was held, and people travelled for days to see it. Records from the time are few, but letters survive.</p>"
_LINKS = "".join(f"<li><a href=/b{i}>Book number {i} by a good author</a></li>" for i in range(8))
_ASKED = "".join(f"<div><h3>How does part {i} work?</h3><p>It turns slowly, and then it stops. After a while it starts again, in the other direction.</p></div>" for i in range(5))
_PARTS = "".join(f"<section><h2>Part {i}</h2><p>It turns slowly, and then it stops. After a while it starts again, in the other direction.</p><p>More of it, at length, follows here.</p></section>" for i in range(4))
#: Pages by hand, none from the grammar: what must be there, and what must not.
BY_HAND = {
    "comments without names": (f"<div><a href=/>Home</a> <a href=/a>About</a></div><div><h1>The harbour</h1>{_STORY}</div><div><h3>3 answers</h3><div class=c1><span>Ann</span><p>Nice post, thank you very much.</p></div><div class=c1><span>Bob</span><p>I do not agree, the harbour is older.</p></div><div class=c1><span>Cy</span><p>Great read!</p></div></div>", ["The harbour", "letters survive"], ["Home", "Nice post", "agree", "Great read", "answers"]),
    "comments in another language": (f"<h1>The harbour</h1>{_STORY}<div id=kommentare><h3>Kommentare</h3><ul><li><b>Ann</b><p>Nice post, thanks.</p></li><li><b>Bob</b><p>I do not agree at all.</p></li></ul></div>", ["The harbour", "letters survive"], ["Nice post", "agree", "Kommentare"]),
    "comments in a list": (f"<div class=x9><ul><li><a href=/>Start</a></li><li><a href=/a>Info</a></li></ul></div><div class=k2><h2>Der Hafen</h2>{_STORY}</div><section><h4>Antworten</h4><ol><li><b>Ann</b><p>Sehr gut, danke.</p></li><li><b>Bob</b><p>Das stimmt nicht.</p></li><li><b>Eva</b><p>Toll!</p></li></ol></section>", ["Der Hafen", "letters survive"], ["Sehr gut", "stimmt", "Toll", "Antworten", "Start"]),
    "long comments": (f"<main><h1>The harbour</h1>{_STORY}</main><div><div><a href=/u/1>ann</a><p>I grew up there, and I remember the old cranes very well. They were taken down in the nineties, sadly.</p></div><div><a href=/u/2>bob</a><p>My father worked there for twenty years, and he always told us about the storms.</p></div></div>", ["The harbour", "letters survive"], ["grew up", "My father"]),
    "article of links": (f"<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><article><h1>Ten good books</h1><p>These are the books of the year:</p><ul>{_LINKS}</ul></article><footer>&copy; 2020 X</footer>", ["Ten good books", "These are", "Book number 0", "Book number 7"], ["Home", "About us", "2020"]),
    "article of links alone": (f"<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><main><h1>Ten good books</h1><ul>{_LINKS}</ul></main><footer>&copy; 2020 X</footer>", ["Ten good books", "Book number 0", "Book number 7"], ["Home", "About us", "2020"]),
    "table of two columns": (f"<table><tr><td><a href=/1>One</a><br><a href=/2>Two</a></td><td><h1>The harbour</h1>{_STORY}</td></tr></table>", ["The harbour", "letters survive"], ["One", "Two"]),
    "table of a page": (f"<table width=100%><tr><td colspan=2>My site name</td></tr><tr><td><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></td><td><h1>The harbour</h1>{_STORY}</td></tr><tr><td colspan=2>Copyright 2003 me</td></tr></table>", ["The harbour", "letters survive"], ["One", "Two", "2003", "My site"]),
    "table of figures": (f"<article><h1>The harbour</h1>{_STORY}<table><tr><th>Year</th><th>Ships</th></tr><tr><td>1900</td><td>12</td></tr><tr><td>1901</td><td>17</td></tr></table><p>The figures are from the port, as far as they are known.</p></article>", ["Year", "1901", "17", "figures"], []),
    "parts alike": (f"<article><h1>Questions</h1>{_ASKED}</article>", ["How does part 0", "How does part 4", "It turns"], []),
    "parts alike without names": (f"<div><a href=/>Home</a></div><div><h1>Questions</h1>{_ASKED}</div>", ["How does part 0", "How does part 4", "It turns"], ["Home"]),
    "sections": (f"<nav><a href=/>Home</a></nav><main>{_PARTS}</main><footer>&copy; me</footer>", ["Part 0", "Part 3", "More of it"], ["Home", "me"]),
    "a short part at the end": (f"<div class=a1><h1>The harbour</h1><div>{_STORY}{_STORY}</div><div><p>It closed in 1950, for good.</p></div></div>", ["The harbour", "It closed"], []),
    "related pages": (f"<article><h1>The harbour</h1>{_STORY}</article><div class=q7><h3>More</h3><ul><li><a href=/1>The ten most beautiful harbours of the north</a></li><li><a href=/2>Why the cranes were taken down in the end</a></li><li><a href=/3>A short history of the grain trade</a></li></ul></div>", ["letters survive"], ["ten most", "cranes were", "grain trade", "\nMore"]),
}


@pytest.fixture(scope="module")
def content_model():
    return html_content.train(html_content.labelled_pages(html_content.TRAIN_PAGES, varied=True))


@pytest.mark.parametrize(("varied", "least"), [(False, 185), (True, 175)])
def test_main_text_of_unseen_pages_by_the_model_in_use(content_model, varied, least):
    unseen = html_content.labelled_pages(200, 5, varied)
    want = ["\n".join(text for i, text in t.blocks.items() if t.label[i]) for t in map(html_content.Tree, unseen)]
    got = html_content.main_texts([p.replace(" data-label", "") for p in unseen], *content_model)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= least


@pytest.mark.parametrize("name", BY_HAND)
def test_main_text_of_pages_by_hand(content_model, name):
    page, there, gone = BY_HAND[name]
    text = html_content.main_texts([f"<html><body>{page}</body></html>"], *content_model)[0]
    assert [x for x in there if x not in text] == [] and [x for x in gone if x in text] == []


def test_a_page_of_very_many_short_paragraphs_stays_whole(content_model):
    page = "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy it. Now.</div><article><h1>Rain.</h1>" + "<p>It rains.</p>" * 1500 + "</article><footer>&copy; me</footer>"
    assert html_content.main_texts([page], *content_model)[0] == "\n".join(["Rain.", *["It rains."] * 1500])


def test_open_scripts_take_one_pass():
    began = time.time()
    html_content.Tree("<p>a</p>" + "<script></script " * 60_000)
    assert time.time() - began < 20


def test_main_text_around_controls_and_formulas(spark):
    story = "<article class=post><h1>A fine day</h1><p>First paragraph of the story, with many words and more text, as stories have.</p><p>Second paragraph of it, a little longer, so that it reads like one.</p></article>"
    want = "A fine day\nFirst paragraph of the story, with many words and more text, as stories have.\nSecond paragraph of it, a little longer, so that it reads like one."
    broken = ["<button>Menu", "<select><option>One<option>Two", "<svg><g>", "<object data=x>", "<button class=share>Share</button>", "<select><option>One</select>", "<noscript>"]
    rows = [(i, "u", f"<body><nav><ul><li><a href=/>Home</a></ul></nav>{b}{story}<footer>&copy; me</footer>") for i, b in enumerate(broken)]
    rows.append((99, "u", f"<body>{story.replace('many words', '<math><mi>x</mi><mo>+</mo><mn>2</mn></math>')}"))
    got = {r.page_id: r.text for r in html_content.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want for i in range(len(broken))} | {99: want.replace("many words", "x+2")}


def test_marginals_by_brute_force():
    tree = html_content.Tree("<div class=ad><p>a, b.<a>c</a></p></div><p>text here")
    forest = html_content.Forest.of([tree])
    rng = np.random.default_rng(1)
    weights, edges = rng.normal(size=len(html_content._FEATURES)), rng.normal(size=(html_content.EDGES, 2, 2))
    n = len(forest.parent)
    own = np.bincount(forest.node, weights[forest.feature], n)
    mass = np.zeros(n)
    total = 0.0
    for bits in range(2**n):
        y = [(bits >> i) & 1 for i in range(n)]
        p = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(edges[forest.edge[i], y[forest.parent[i]], y[i]] for i in range(1, n)))
        total += p
        mass += p * np.array(y)
    assert np.allclose(html_content.marginals(forest, weights, edges)[0], mass / total)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(400)] + [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [1.0, None] * 4, 1), (404, [1.0], 1)]
    rows += [(410, rows[3][1], 1), (411, rows[3][1], 1), rows[5]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(vectors, vectors.filter("vec_id % 100 = 0 OR vec_id = 3"))
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(out) == [0, 3, 100, 200, 300] and [v for v, _ in out[3][:2]] == [410, 411] and out[3][0][1] == 0.0
    good = {i: np.array(v) for i, v, _ in rows if i < 400 or i in (410, 411)}
    hit = sum(len({v for v, _ in out[q]} & {i for i, _ in sorted(((i, float(np.sqrt(((v - good[q]) ** 2).sum()))) for i, v in good.items() if i != q), key=lambda x: (x[1], x[0]))[:10]}) for q in out)
    assert hit >= 45
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("enough", [5, 0])
def test_nearest_gives_all_rows_to_tight_groups(spark, monkeypatch, enough):
    monkeypatch.setattr(ann, "PER_CENTROID", 10)
    monkeypatch.setattr(ann, "ENOUGH", enough, raising=False)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(np.repeat(rng.normal(size=(120, 8)) * 100, 5, axis=0) + rng.normal(size=(600, 8)) * 1e-3)]
    vectors = spark.createDataFrame([*rows, rows[7]], "vec_id long, embedding array<double>").coalesce(2)
    got = {}
    for r in ann.nearest(vectors, vectors.filter("vec_id % 5 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 120 and all(len(set(x)) == len(x) == 10 for x in got.values())
    assert all({q + 1, q + 2, q + 3, q + 4} <= set(x) for q, x in got.items())
    few = ann.nearest(vectors.filter("vec_id < 7"), vectors.filter("vec_id IN (0, 100)")).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in few} == {0: 6, 100: 7}


def test_language(spark, empty):
    train = spark.createDataFrame([(i, _words(i, 30) + (" the and of to" if i % 2 else " der und die zu") * 20, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://x.de/a", "<html lang=de><p>der und die zu der und"), (2, "http://x.de/b", None), (3, None, "the and of to the and"), (4, "http://y.com/en/1", ""), (5, "http://x.de/c", "der und die zu und der")], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, train).collect()}
    assert [got[i].lang for i in (1, 2, 3, 5)] == ["de", "de", "en", "de"] and all(0 <= r.prob <= 1 for r in got.values())
    assert langid.identify(pages.limit(0), train).count() == 0
    assert {r.lang for r in langid.identify(pages, empty).collect()} == {None}


def test_rare_languages_are_learned_beside_large_ones(spark):
    names = [f"l{i:02d}" for i in range(52)]
    letters = lambda i, n: " ".join(f"{chr(0x4E00 + 40 * i + j % 17)}{chr(0x4E00 + 40 * i + j % 7)}ab" for j in range(n))
    rare = [(i, letters(i, 30), names[i]) for i in range(52)]
    many = [(1000 + i, letters(60, 2), "zz") for i in range(10_000)]
    docs = spark.createDataFrame([*rare, *many], "doc_id long, text string, lang string")
    languages, model = langid.learn_languages(docs)
    assert languages == [*names, "zz"]
    assert all(model[:, langid._trigrams(letters(i, 20))].sum(1).argmax() == i for i in range(52))


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns and after.count() <= now.count()
        now = after
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "n_tokens"]


def _classes_by_brute_force(texts: dict[int, str]) -> dict[int, int]:
    bags = {i: Counter(tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = sum((bags[a] & bags[b]).values())
            if shared >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup_of_a_large_group_by_brute_force(spark):
    r = random.Random(9)
    base = _words(3, 150).split()
    texts = {}
    for i in range(500):  # two to five edits put most pairs close to the threshold, on either side
        words = list(base)
        for _ in range(r.randint(2, 5)):
            words[r.randrange(len(words))] = f"w{r.randrange(40)}"
        texts[i] = " ".join(words)
    texts |= {500 + i: _words(100 + i, 60) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs).collect()}
    assert got == _classes_by_brute_force(texts) and len(set(got.values())) > 21


def test_near_dedup_of_a_document_with_two_texts(spark):
    one, two = _words(1, 60), _words(2, 60)
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two), (4, two + " more"), (5, _words(5, 60)), (None, one)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.class_id) for x in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]


def test_large_groups_are_sharded(spark):
    docs = spark.createDataFrame([(i, "one text" if i < 1000 else f"text {i // 2}") for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard(docs)
    assert sorted({n for _, n in Counter(x.shard for x in rows.collect()).items()}) in ([187, 188], [187], [188])
    assert sharding.cut_share(rows.withColumnRenamed("text_crc32", "hub").filter("doc_id >= 1000")) < 0.2


def test_anchors_of_long_texts_in_windows():
    text = (_words(8, 4000) + " " + _words(9, 4000)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode(), "short"])], ["text"])
    starts = []
    for window in (1 << 20, 3000):
        rows = pa.Table.from_batches(list(substring_dedup._anchor_rows(iter([batch]), window))).to_pylist()
        starts.append({(x["pos"], x["h"], s) for x in rows for s in range(x["pos"] - x["left"], x["pos"] + x["right"] - 399)})
    assert starts[0] == starts[1] and len(starts[0]) == len(text) - 399


def test_open_comments_are_read_once():
    assert langid._visible("<!--x>" * 100_000).strip() == ""
    assert langid._visible("a<!-- x > y -->b<script>c</script >d<!--e>f<style>g").split() == ["a", "b", "d", "f"]


def test_columns_may_be_named_as_the_pipeline_names_its_own(spark):
    docs = spark.createDataFrame([(1, "A b", 1, 1, 1, 1), (2, "a B", 2, 2, 2, 2)], "doc_id long, text string, keep int, digest int, sha int, other int")
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and [tuple(x) for x in kept.collect()] == [(2, "a B", 2, 2, 2, 2)]


def test_exception_phrases_spare_each_of_their_words():
    lexicon = toxicity.Lexicon({" scum": 2.0, " loser ": 1.5, " pond scum ": 0.0, " sore loser board ": 0.0})
    automaton = lexicon.automaton()
    hits = {t: lexicon.features(t, automaton)[4] for t in ("P0nd scum!", "scum pond", "a sore loser board", "sore loser", "pond scum scum", "")}
    assert hits == {"P0nd scum!": 0.0, "scum pond": 1.0, "a sore loser board": 0.0, "sore loser": 1.0, "pond scum scum": 1.0, "": 0.0}
    assert toxicity._phrases("old pond scum floats", lexicon, automaton) == {" pond scum ", " scum floats "}


def test_phrases_of_clean_documents_are_learned_and_odd_labels_are_defined(spark):
    rows = [(i, f"you are such a blargh today {i}") if i % 2 else (i, f"the blargh festival opens {i}" if i % 6 == 0 else f"quiet words {i}") for i in range(600)]
    docs = spark.createDataFrame([*rows, (0, "the blargh festival opens, once more"), (None, "x"), (601, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(1, 0), (1, 1), (None, 1), (2, None), (9999, 1)], "doc_id long, toxic int")
    learned = toxicity.learn_toxicity(docs, labels)
    assert learned.weights[" blargh festival "] == 0.0 and learned.weights[" blargh "] > 0
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, learned).collect()}
    assert all(got[i] == i % 2 for i in range(1, 600)) and got[601] == 0


def _timed(limit, run, *args):
    began = time.time()
    out = run(*args)
    assert time.time() - began < limit
    return out


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a_" * 500_000, "1" * 1_000_000, "ab1" * 300_000, "@" * 1_000_000, "é" * 1_000_000, "a@_" * 300_000, "$ " * 500_000])
def test_long_words_are_folded_in_one_pass(text):
    _timed(2, toxicity.fold, text)


def test_folding_starts_after_the_last_underscore():
    plain = re.compile(r"[^\W_]*[0134578@$][\w@$]*")  # the same words, found from every letter
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("ab1@_ é$9-") for _ in range(r.randint(0, 14)))
        assert toxicity._MIXED.sub(toxicity._spelled, text) == plain.sub(toxicity._spelled, text)
    assert toxicity.fold("foo_b4r") == " foo bar " and toxicity.fold("foo_123") == " foo 123 "


@pytest.mark.parametrize("page", ["<html " * 170_000, "<html lang" * 100_000, "<html lang=" + " " * 1_000_000, "<html lang  " * 90_000 + ">", '<html "' * 140_000])
def test_declared_languages_are_read_in_one_pass(page):
    assert _timed(2, langid._declared, page) == ""
    _timed(5, langid._visible, page)


def test_declared_language_is_that_of_the_first_html_tag():
    pages = ["<HTML dir=ltr LANG = 'de-AT'>", "<html>x<html lang=fr>", "<html xml:lang=en>", "x", "<html lang=\"\">"]
    assert [langid._declared(p) for p in pages] == ["de", "", "en", "", ""]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</span2>" * 100_000, "<div>" * 100_000 + "<li>x</li>" * 50_000, "<li><ul>" + "<div>" * 100_000 + "<li>x</li>" * 50_000, "<table><tr>" + "<div>" * 100_000 + "<td>x</td>" * 50_000, "<p>x</div>" * 100_000, "<option>" * 100_000, "<a href='" * 100_000])
def test_broken_pages_are_parsed_in_one_pass(page):
    _timed(20, html_content.Tree, page)


def test_only_drawings_end_with_their_own_tag():
    tree = html_content.Tree("<script src=/js/>alert(1);</script><div class=a/><p>one</p></div><svg><path d=x/><g/></svg><p>two<style type=a/>p{}</style> three")
    assert list(tree.blocks.values()) == ["one", "two three"] and "path" not in tree.tags
    rows = html_content.Tree("<table><tr><td>a<table><tr><td>b<tr><td>c</table><td>d<tr><td>e</table><ul><li>f<li>g<ul><li>h</ul><li>i</ul>")
    assert list(rows.blocks.values()) == list("abcdefghi") and [rows.tags[rows.parent[i]] for i in rows.blocks] == ["td"] * 5 + ["li"] * 4


def test_language_of_pages_that_mostly_share_a_host(spark, monkeypatch):
    train = spark.createDataFrame([(i, (" the and of to" if i % 2 else " der und die zu") * 20, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    rows = [(i, f"http://{'big' if i % 3 else f'h{i}'}.com/x", "der und die zu" if i % 5 else "the and of") for i in range(400)] + [(1000, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(map(str, langid.identify(pages, train).collect()))
    monkeypatch.setattr(langid, "BROADCAST_NUMBERS", 0)
    assert sorted(map(str, langid.identify(pages, train).collect())) == first and len(first) == 401


@pytest.mark.parametrize("pairs", [1 << 21, 500])
def test_nearest_of_many_queries_by_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(ann, "PAIRS", pairs)
    monkeypatch.setattr(ann, "LIST_ROWS", 60)  # several parts a list
    monkeypatch.setattr(ann, "PER_CENTROID", 100)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 6)), rng.normal(size=(30, 1, 6)).repeat(20, 1).reshape(-1, 6) + rng.normal(size=(600, 6)) * 0.05])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(vectors, vectors.filter("vec_id % 4 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    far = np.sqrt(((x[::4, None] - x[None]) ** 2).sum(2))
    hits = 0
    for n, q in enumerate(range(0, 1500, 4)):
        far[n, q] = np.inf
        want = np.lexsort((np.arange(1500), far[n]))[:10]
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        assert all(s == pytest.approx(far[n, v], rel=1e-12) for v, s in got[q])
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
    assert len(got) == 375 and hits >= 0.95 * 3750


def test_pipeline_drops_what_each_stage_is_for(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, f"{_words(i, 60)} {'you worthless moron' if bad else 'a quiet day'} {_words(-i - 1, r.randint(40, 80))}", "de" if i % 7 == 0 else "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    base = rows[601 - 600][1]  # a clean text
    edited = base.split()
    edited[30] = "CHANGED"
    rows += [(700, base.upper(), "en", "s0", 0), (701, " ".join(edited), "en", "s0", 0), (702, base + " and more", "en", "s1", 0), (703, None, "en", "s0", 0), (704, f"{_words(99_999, 50)} you worthless moron {_words(99_998, 50)}", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).checkpoint()
        left[name] = {x.doc_id for x in now.select("doc_id").collect()}
    toxic = {i for i in range(600) if i % 6 == 0} | {704}
    everything = {x[0] for x in rows}
    assert left["toxicity"] == everything - toxic
    assert left["exact_dedup"] == everything - toxic - {1}  # 700 has the same text and the larger id
    texts = {i: t or "" for i, t, *_ in rows if i in left["exact_dedup"]}
    classes = _classes_by_brute_force({i: t for i, t in texts.items() if i in (700, 701, 702) or i % 50 == 1})
    assert classes[701] == classes[700] == classes[702]
    assert left["near_dedup"] == left["exact_dedup"] - {701, 702}
    assert left["mixing"] <= left["near_dedup"] and 0.35 * len(left["near_dedup"]) < len(left["mixing"]) < 0.65 * len(left["near_dedup"])
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == left["mixing"]
    sha = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows}
    assert all(out[i].decoded_sha256 == sha[i] for i in out)
