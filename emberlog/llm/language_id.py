"""Language ID by Bayesian fusion of evidence.

For every row, languages get a posterior from
* text: likelihood of its letter trigrams (hashed), the mean a trigram times at most TEXT_WEIGHT, so that long texts
  do not drown the rest; the trigram model is fitted on a sample of labelled documents, some of each language;
* the language that the markup declares, by how texts of each language declare it in the corpus;
* the address suffix, likewise;
* the host: a prior of how many other rows of the host are of each language, smoothed towards its domain's, and that
  towards the corpus's (leaving the row itself out).
All counts are grouped aggregations over all rows of the languages that the text alone suggests. Domain and suffix go with
the host, so rows are joined to one table of hosts, which grows with the corpus and is dealt; hosts with more than a
thousandth of all rows are broadcast instead, and rows without a host are not joined at all.

Null or empty texts have no text evidence, missing addresses and declarations none of theirs; a row without any gets
the corpus's most common language. Very long texts go whole. Ties go to the first language in alphabetical order. Repeated
rows, and rows of one id or without one: a row each. Extra columns are ignored, whatever their names. Empty tables give no
rows; without a labelled row the only language is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import common as C
from emberlog.llm.html_extract import main_text

#: The labelled documents that the trigram model is fitted on (smallest hash of doc_id), and those of each language that
#: are taken in any case, so every language of the labels is known.
SAMPLE, OF_EACH, PARTS = 4000, 50, 64
BITS, TEXT_WEIGHT, KAPPA, SMOOTH = 16, 60.0, 4.0, 0.5
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DECLARED = re.compile(r"<(?:html|body)\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})|<meta[^>]+content-language[\"']?[^>]*content\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)
#: Labels that stand below a suffix shared by many owners.
SECOND = frozenset("co com org net ac gov edu".split())


def trigrams(text: str | None) -> np.ndarray:
    raw = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split())
    if not raw:
        return np.empty(0, np.int64)
    a = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF) + a[1:-1] * np.uint32(65599) + a[2:]) * np.uint32(2654435769)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages) log-likelihoods

    def text(self, text: str | None) -> list[float] | None:
        g = trigrams(text)
        return (self.table[g].mean(axis=0, dtype=np.float64) * min(len(g), TEXT_WEIGHT)).tolist() if len(g) else None


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From (doc_id, text, lang) rows."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    some = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rank = lambda *by: F.dense_rank().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    # the first of each part of a language, and then of those: a language may have most rows
    parts = ids.withColumn("part__", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))).withColumn("rank__", rank("lang", "part__")).where(F.col("rank__") <= OF_EACH)
    each = parts.withColumn("rank__", rank("lang")).where(F.col("rank__") <= OF_EACH)
    chosen = some.union(each.select("doc_id")).distinct()

    @C.frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[lang] = by.get(lang, 0) + np.bincount(trigrams(text), minlength=1 << BITS)
        for lang, v in by.items():
            yield pa.record_batch([pa.array([lang], pa.string()), pa.array([v.astype("<i8").tobytes()], pa.binary())], names=["lang", "counts"])

    C.small_batches(labelled.sparkSession)
    few = C.cut(rows.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "doc_id").select("lang", "text"), "labelled")
    counts: dict[str, np.ndarray] = {}
    for r in few.coalesce(2).mapInArrow(count, "lang string, counts binary").toLocalIterator():  # a row for each task and language
        counts[r.lang] = counts.get(r.lang, 0) + np.frombuffer(r.counts, "<i8")
    C.drop_cut(few) if counts else None
    langs = sorted(counts) or ["und"]
    table = np.array([counts[x] if x in counts else np.zeros(1 << BITS) for x in langs], float).T + SMOOTH
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix) of an address or a bare host name."""
    if not url:
        return None, None, None
    host = re.split(r"[/?#]", url.split("://", 1)[-1], maxsplit=1)[0].rsplit("@", 1)[-1].split(":")[0].lower().strip(".")
    labels = [x for x in host.split(".") if x]
    if not labels:
        return None, None, None
    n = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else 2
    return host, ".".join(labels[-n:]), labels[-1] if len(labels) > 1 else None


EVIDENCE = "id long, likelihood array<double>, declared string, host string, domain string, suffix string"


def evidence(rows: DataFrame, model: Model, html: bool) -> DataFrame:
    """Compact rows of what speaks for a language, from (id, content, address); content is html or plain text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            content, places = b.column(1).to_pylist(), [address(u) for u in b.column(2).to_pylist()]
            found = [DECLARED.search(c or "") for c in content] if html else [None] * len(content)
            declared = [(m[1] or m[2]).lower() if m else None for m in found]
            likely = [model.text(main_text(c) if html else c) for c in content]
            yield pa.record_batch(
                [b.column(0), pa.array(likely, pa.list_(pa.float64())), pa.array(declared, pa.string()), *(pa.array([p[k] for p in places], pa.string()) for k in range(3))],
                names=["id", "likelihood", "declared", "host", "domain", "suffix"],
            )

    C.small_batches(rows.sparkSession)
    return rows.select(F.col("id").cast("long"), F.col("content").cast("string"), F.col("address").cast("string")).mapInArrow(run, EVIDENCE)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def fuse(rows: DataFrame, languages: list[str], kappa: float = KAPPA) -> DataFrame:
    """lang, confidence and text_lang of evidence rows; `rows` is written to the shared folder before."""
    n = len(languages)
    rows = rows.withColumn("own", argmax(F.col("likelihood")))
    tally = F.array(*(F.count_if(F.col("own") == k) for k in range(n)))
    nil = F.array(*(F.lit(0).cast("long") for _ in range(n)))
    total, n_rows = rows.agg(tally.alias("t"), F.count("*")).first()
    base = [(t + 1) / (sum(total) + n) for t in total]
    lang_of = {x: k for k, x in enumerate(languages)}
    # how texts of each language declare themselves: one row for each known language and one for others
    code = F.coalesce(F.create_map(*(F.lit(x) for pair in lang_of.items() for x in pair))[F.col("declared")], F.lit(n))
    said = {r.code: r.t for r in rows.where(F.col("declared").isNotNull()).groupBy(code.alias("code")).agg(tally.alias("t")).collect()}
    per = [sum(t[k] for t in said.values()) for k in range(n)]
    speaks = [[float(np.log((said.get(c, [0] * n)[k] + SMOOTH) / (per[k] + SMOOTH * (n + 1)))) for k in range(n)] for c in range(n + 1)]
    table = F.array(*(F.array(*map(F.lit, x)) for x in speaks))
    named = rows.where(F.col("host").isNotNull())
    hosts = named.groupBy("host", "domain", "suffix").agg(tally.alias("host_n"), F.count("*").alias("n_rows"))
    add_up = lambda by, name: hosts.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*(F.sum(F.get("host_n", F.lit(k))) for k in range(n))).alias(name))
    hosts = hosts.join(add_up("domain", "domain_n"), "domain", "left").join(add_up("suffix", "suffix_n"), "suffix", "left").select("host", "n_rows", "host_n", "domain_n", "suffix_n")
    found = C.joined_by_hot(named, hosts, "host", "n_rows", n_rows)
    rows = rows.where(F.col("host").isNull()).unionByName(found, allowMissingColumns=True)
    own = F.array(*(F.coalesce((F.col("own") == k).cast("long"), F.lit(0).cast("long")) for k in range(n)))
    less = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(F.coalesce(F.col(c), nil), k) - F.when(F.col(c).isNotNull(), F.get(own, k)).otherwise(0))
    rows = rows.withColumn("host_n", less("host_n")).withColumn("domain_n", less("domain_n")).withColumn("suffix_n", less("suffix_n"))
    add = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("host_s", add("host_n")).withColumn("domain_s", add("domain_n"))
    prior = F.array(*map(F.lit, base))
    counts = F.array(*map(F.lit, total))

    def weight(k: Column) -> Column:
        domain = (F.get("domain_n", k) + F.lit(kappa) * F.get(prior, k)) / (F.col("domain_s") + kappa)
        host = (F.get("host_n", k) + F.lit(kappa) * domain) / (F.col("host_s") + kappa)
        # P(suffix | language), against the other languages' share of the suffix; a suffix nobody else has says nothing
        suffix = F.log((F.get("suffix_n", k) + F.lit(1.0)) / (F.get(counts, k) + F.lit(float(n))))
        return F.log(host) + F.coalesce(F.get("likelihood", k), F.lit(0.0)) + F.when(F.col("declared").isNotNull(), F.get(F.get(table, code), k)).otherwise(0.0) + F.when(F.col("suffix").isNotNull(), suffix).otherwise(0.0)

    rows = rows.withColumn("post", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), weight))
    top = F.array_max("post")
    names = F.array(*map(F.lit, languages))
    share = F.lit(1.0) / F.aggregate(F.transform("post", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("kind", "id", F.get(names, argmax(F.col("post"))).alias("lang"), share.alias("confidence"), F.get(names, "own").alias("text_lang"), "declared", "host")


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """kind (page or document), doc_id, page_id, lang, confidence, text_lang, declared, host of every page and document."""
    model = fit(docs, sample)
    of_pages = evidence(pages.select(F.col("page_id").alias("id"), F.col("html").alias("content"), F.col("url").alias("address")), model, True).withColumn("kind", F.lit("page"))
    of_docs = evidence(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("address")), model, False).withColumn("kind", F.lit("document"))
    rows = fuse(C.cut(of_pages.unionByName(of_docs), "evidence"), model.languages)
    ids = [F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id")]
    return rows.select(*ids, "lang", "confidence", "text_lang", "declared", "host")
