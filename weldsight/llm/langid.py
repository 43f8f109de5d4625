"""Language of web pages: text likelihood, declared language, address and host priors fused by Bayes' rule."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import cut, lookup, table

#: Labelled documents of each language for the text model, about and at most; cells of its hashed trigrams.
TRAIN_DOCS, CELLS = 1_500, 1 << 16
#: Trigrams that a text counts for at most, and the pseudo-counts of hints, domains and hosts.
EVIDENCE, SMOOTH_HINT, SMOOTH_HOST = 40.0, 2.0, 5.0

#: Sums up to which the table of a key is broadcast (8 bytes each); beyond it keys are looked up.
BROADCAST_NUMBERS = 500_000

_OPEN = re.compile(r"<(?:!--|(script|style)\b)?", re.I)
_CLOSE = {"script": re.compile(r"</script\b[^>]*>?", re.I), "style": re.compile(r"</style\b[^>]*>?", re.I)}
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?\s*+([A-Za-z]{2,3})", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
_PATH = re.compile(r"^[a-z][a-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", re.I)


def _trigrams(text: str) -> np.ndarray:
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)
    return ((h ^ (h >> np.uint64(17))) * np.uint64(0x27D4EB2F) >> np.uint64(20)).astype(np.int64) % CELLS


def _visible(page: str) -> str:
    """The text between tags, in one pass: what opens a comment that nothing ends counts as a tag, and a script or
    style that nothing ends goes up to the end of the page."""
    out, at, comments, tags = [], 0, True, True
    while found := _OPEN.search(page, at):
        out.append(page[at : found.start()])
        at = -1
        if found[0] == "<!--" and comments:
            at = page.find("-->", found.end() - 2) + 3
            comments = at > 2  # one search without a result is enough for the page
            at = at if comments else -1
        elif found[1]:
            end = _CLOSE[found[1].lower()].search(page, found.end())
            at = end.end() if end else len(page)
        if at < 0:
            at = page.find(">", found.start()) + 1 if tags else 0
            tags = at > 0
            at = at if tags else len(page)
    out.append(page[at:])
    return html.unescape(" ".join(out))


def _declared(page: str) -> str:
    """The language of the page's first html tag."""
    tag = _HTML.search(page)
    lang = _LANG.search(tag[1]) if tag else None
    return lang[1].lower() if lang else ""


def _train(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: i for i, lang in enumerate(languages)}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            keys = [_trigrams(text) + index[lang] * CELLS for text, lang in zip(texts, langs, strict=True)]
            key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // CELLS, pa.int32()), pa.array(key % CELLS, pa.int32()), pa.array(n, pa.int64())], ["l", "cell", "n"])

    return run


def learn_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the cells) from about ``train_docs`` labelled documents of each at most.

    Rows without a language or text are left out; every language with a row is kept. A language with more rows gives
    those whose hash is below a threshold from its own count.
    """
    own = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = own.groupBy("lang").count()
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # a row a language
    if not languages:
        return [], np.zeros((0, CELLS))
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40)) < F.lit(float(train_docs << 40)) / F.col("count")
    chosen = own.join(F.broadcast(sizes), "lang").filter((F.col("count") <= train_docs) | drawn)
    found = chosen.select("text", "lang").mapInArrow(_train(languages), "l int, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), CELLS))
    counts[found["l"], found["cell"]] = found["n"]
    smooth = counts + 0.5
    return languages, np.log(smooth / smooth.sum(1, keepdims=True))


def _read(languages: list[str], model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                url, page = url or "", page or ""
                cells = _trigrams(_visible(page))
                score = np.zeros(len(languages))
                if len(cells):
                    score = model[:, cells].sum(1) * (min(len(cells), EVIDENCE) / len(cells))
                p = np.exp(score - score.max())
                host = m[1].lower() if (m := _HOST.match(url)) else ""
                path = m[1].lower() if (m := _PATH.match(url)) else ""
                hint = path if path in languages else host.rpartition(".")[2]
                declared = _declared(page)
                rows.append((host, ".".join(host.split(".")[-2:]), hint, declared, (p / p.sum()).tolist()))
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *columns, pa.array([r[4] for r in rows], pa.list_(pa.float64()))], ["page_id", "url", "host", "domain", "hint", "declared", "p"])

    return run


def identify(pages: DataFrame, docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """page_id, url, lang, prob, text_lang, declared, hint and host of every page.

    The text model is trained on labelled documents. How often each declared language, address hint (a language code
    that begins the path, else the last label of the host) and host goes with a language is counted over all pages, by
    grouped sums of the text posteriors without the page's own; host shares are smoothed by their domain's, and these
    by all pages'. Null or empty pages and addresses have no evidence of that kind; ties go to the first language in
    alphabetical order; repeated rows are pages of their own; an empty table gives no rows; without any labelled
    document lang and prob are null; other columns are not read.
    """
    languages, model = learn_languages(docs, train_docs)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not languages:
        empty = ["lang", "text_lang", "declared", "hint", "host"]
        return source.select("page_id", "url", *[F.lit(None).cast("string").alias(c) for c in empty], F.lit(None).cast("double").alias("prob"))
    k = len(languages)
    read = cut(source.mapInArrow(_read(languages, model), "page_id long, url string, host string, domain string, hint string, declared string, p array<double>"))

    def sums(keys: list[str], name: str) -> DataFrame:
        parts = F.array(*[F.sum(F.col("p")[i]) for i in range(k)])
        return read.groupBy(*keys).agg(parts.alias(name))

    rows = read.join(F.broadcast(sums([], "_all")))  # one row
    for key in ("declared", "hint", "domain", "host"):
        found = cut(sums([key], f"_{key}"))
        # most pages share a few of these values
        rows = rows.join(F.broadcast(found), key) if found.count() * k <= BROADCAST_NUMBERS else lookup(cut(rows), found, key)

    def log_hint(key: str, i: int) -> Column:
        own = F.greatest(F.col(f"_{key}")[i] - F.col("p")[i], F.lit(0.0))
        others = F.greatest(F.col("_all")[i] - F.col("p")[i], F.lit(0.0))
        return F.when(F.col(key) == "", 0.0).otherwise(F.log((own + SMOOTH_HINT / k) / (others + SMOOTH_HINT)))

    def less(name: str, i: int) -> Column:
        return F.greatest(F.col(name)[i] - F.col("p")[i], F.lit(0.0))

    def size(name: str) -> Column:
        return F.greatest(F.aggregate(name, F.lit(0.0), lambda a, x: a + x) - 1, F.lit(0.0))

    logs = []
    for i in range(k):
        overall = (less("_all", i) + 1) / (size("_all") + k)
        domain = (less("_domain", i) + SMOOTH_HOST * overall) / (size("_domain") + SMOOTH_HOST)
        host = F.when(F.col("host") == "", overall).otherwise((less("_host", i) + SMOOTH_HOST * domain) / (size("_host") + SMOOTH_HOST))
        logs.append(F.log(F.greatest(F.col("p")[i], F.lit(1e-300))) + F.log(host) + log_hint("declared", i) + log_hint("hint", i))
    fused = rows.withColumn("_log", F.array(*logs)).withColumn("_top", F.array_max("_log"))
    names = F.array(*[F.lit(x) for x in languages])
    prob = 1 / F.aggregate(F.transform("_log", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select("page_id", "url", pick(F.col("_log")).alias("lang"), prob.alias("prob"), pick(F.col("p")).alias("text_lang"), "declared", "hint", "host")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
