"""Language identification by Bayesian fusion of several kinds of evidence.

- Text: the log-likelihood of byte trigrams under each language, fitted on a bounded sample of labelled rows. As
  neighbouring trigrams aren't independent, a text counts as EVIDENCE trigrams at most, of its mean.
- Declared language (markup or metadata) and the suffix of the address: each right with a given chance.
- Host: how often each language was found by text on the host, smoothed towards its domain, that towards its suffix, and
  that towards all rows. The counts come from grouped aggregation over all rows.

Beside the languages stands noise, a text whose trigrams are all equally likely. A document is rejected if no language
reaches MIN_POSTERIOR against the others and noise. As a language's trigrams share its probability with whatever noise was
among the labelled rows, noise is hardly ever likelier under it than under noise itself; the model is fitted again without
labelled rows that are noise by the first fit.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import blocks
from .common import free_name, held, offsets, ship, written
from .url_filters import host_and_path

BITS = 16
#: Labelled rows that the model is fitted on at most; it tells as many languages apart as these name.
TRAIN_ROWS = 2000
EVIDENCE = 40.0
DECLARED_RIGHT, SUFFIX_RIGHT = 0.85, 0.75
#: Weight of the wider level in a host's prior, in documents.
SMOOTH = 20.0
#: Least posterior of an accepted document, and the prior of noise.
MIN_POSTERIOR, NOISE = 0.5, 0.01
#: Log-likelihoods are whole multiples of 1 / UNIT, so that sums don't depend on their order.
UNIT = 4096
#: Bytes of hosts' priors that are broadcast; with more, only hosts with many documents are, the rest is shuffled.
BROADCAST_BYTES = 16_000_000
#: Languages of country suffixes. Fixed values.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "ie": "en", "it": "it", "pt": "pt", "nl": "nl"}

#: Markup, and what it holds that isn't text.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.DOTALL | re.IGNORECASE)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # whole log-likelihoods: language, bucket


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of the lower-cased texts, a space at either end; where each text's begin."""
    held("language", dict)  # another operator's tables go
    raw = [f" {t.lower()} ".encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    at = offsets(np.fromiter(map(len, raw), np.int64, len(raw)))
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) if len(b) > 2 else np.zeros(0, np.uint32)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    inner = np.ones(len(h), bool)
    for cut in at[1:-1]:
        inner[max(cut - 2, 0) : cut] = False
    sizes = np.maximum(np.diff(at) - 2, 0)
    return h[inner], offsets(sizes)


def score(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log-likelihoods in units for each text and language, and the number of trigrams of each text."""
    out, n = np.zeros((len(texts), len(model.languages)), np.int64), np.zeros(len(texts), np.int64)
    for a, b in blocks(texts):
        h, at = trigrams(texts[a:b])
        n[a:b] = np.diff(at)
        for i, row in enumerate(model.table):
            out[a:b, i] = np.diff(offsets(row[h])[at])
    n[[i for i, t in enumerate(texts) if not t.strip()]] = 0
    return out, n


def sample(df: DataFrame, text: str, label: str, key: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, label, text) of at most so many labelled rows, those with the least hash of key and text, whatever the plan is.

    A share of the hash's range that holds somewhat more is cut out first, so that no task sorts more than that.
    """
    d = df.select(F.lower(F.regexp_extract(label, r"^([A-Za-z]*)", 1)).alias("label"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    d = d.where("label <> '' and text is not null")
    n = d.count()
    if n > 2 * rows:
        d = d.where(F.col("h") < int(-(2**63) + 2**64 * (1.5 * rows / n)))
    # rows that are the same count once
    d = d.groupBy("h").agg(F.min(F.struct("label", "text")).alias("r")).orderBy("h").limit(rows)
    return written(d.select(F.col("h").alias("id"), "r.*").repartition(16, "id"), "sample")


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str], list[str]]]:
    for batch in batches:
        ids, labels, texts = (c.to_pylist() for c in batch.columns)
        for a, b in blocks(texts):
            yield ids[a:b], labels[a:b], texts[a:b]


def counted(rows: DataFrame) -> dict[str, np.ndarray]:
    """How often each label's texts (id, label, text) have a trigram of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, labels, texts in _in_parts(batches):
            h, at = trigrams(texts)
            names, which = np.unique(np.array(labels, object).astype(str), return_inverse=True)
            pair, n = np.unique(np.repeat(which, np.diff(at)).astype(np.int64) << BITS | h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[pair >> BITS].tolist(), pa.string()), pa.array((pair & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n, pa.int64())], ["label", "bucket", "n"])

    got = rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for name, mine in got.groupby("label"):
        out[name] = np.zeros(1 << BITS, np.int64)
        out[name][mine["bucket"].to_numpy()] = mine["n"]
    return out


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Whole log-likelihoods of the buckets from the counts of each language."""
    smooth = 0.05
    p = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * (1 << BITS))
    return np.rint(np.log(p) * UNIT).astype(np.int32)


def without_noise(rows: DataFrame, model: Model) -> DataFrame:
    """The texts (id, label, text) that are likelier in some language than as noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = score(batch.column(2).to_pylist(), model)
            fine = s.max(axis=1) > -n * BITS * math.log(2) * UNIT
            yield batch.filter(pa.array(fine))

    return rows.mapInArrow(run, "id long, label string, text string")


def fit(df: DataFrame, text: str, label: str, key: str, rows: int = TRAIN_ROWS) -> Model:
    """Fitted on a bounded sample of labelled rows, each over its whole text, and again on those of them that aren't noise.
    Without labelled rows it knows no language."""
    ship(df.sparkSession)
    d, model = sample(df, text, label, key, rows), Model([], np.zeros((0, 1 << BITS), np.int32))
    for again in (False, True):
        counts = counted(without_noise(d, model) if again else d)
        if not counts:
            break
        model = Model(sorted(counts), likelihoods(np.stack([counts[x] for x in sorted(counts)])))
    return model


def _text_language(model: Model):
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            part = [t or "" for t in texts.slice(at, 256).to_pylist()]
            s, n = score(part, model)
            out += [model.languages[i] if m else None for i, m in zip(s.argmax(axis=1).tolist(), n.tolist())] if model.languages else [None] * len(part)
        return pa.array(out, pa.string())

    return of


def priors(df: DataFrame, model: Model, text: str, host: Column) -> tuple[DataFrame, list[float]]:
    """(host, prior: chance of each language, n: its rows) of every host, and the chances over all rows."""
    found = df.select(host.alias("host"), _text_language(model)(F.col(text)).alias("lang")).where("lang is not null")
    tally = lambda: [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, x in enumerate(model.languages)]
    names = [f"n{i}" for i in range(len(model.languages))]
    by_host = found.groupBy("host", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(*tally())
    by_host = written(by_host.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)}), "hosts")
    total = by_host.agg(*[F.sum(x) for x in names]).first()
    total = [x or 0.0 for x in total]
    wide = [(x + 1) / (sum(total) + len(total)) for x in total]
    smoothed = lambda own, wider: F.transform(F.arrays_zip(own.alias("c"), wider.alias("p")), lambda x: (x["c"] + SMOOTH * x["p"]) / (F.aggregate(own, F.lit(0.0), lambda a, b: a + b) + SMOOTH))
    level = lambda col: by_host.groupBy(col).agg(F.array(*[F.sum(x) for x in names]).alias(f"{col}_n"))
    p = level("suffix").select("suffix", smoothed(F.col("suffix_n"), F.array(*map(F.lit, wide))).alias("suffix_p"))
    p = by_host.select("domain", "suffix").distinct().join(level("domain"), "domain").join(p, "suffix").select("domain", smoothed(F.col("domain_n"), F.col("suffix_p")).alias("domain_p"))
    return by_host.join(p, "domain").select("host", smoothed(F.array(*names), F.col("domain_p")).alias("prior"), sum(map(F.col, names)).alias("n")), wide


def fused(score_: np.ndarray, n: np.ndarray, prior: np.ndarray, said: list, suffix: list, model: Model) -> list[dict]:
    """The language of each text from its scores, its host's prior, and what is declared."""
    size, code = len(model.languages), {x: i for i, x in enumerate(model.languages)}
    used = np.minimum(n, EVIDENCE)
    log = score_ / np.maximum(n, 1)[:, None] / UNIT * used[:, None] + np.log(prior * (1 - NOISE))
    noise = -used * BITS * math.log(2) + math.log(NOISE)
    for column, right in ((said, DECLARED_RIGHT), (suffix, SUFFIX_RIGHT)):
        i = np.array([code.get(x, -1) for x in column], np.int64)
        told = np.flatnonzero(i >= 0)
        wrong = math.log((1 - right) / max(size - 1, 1))
        log[told] += wrong
        log[told, i[told]] += math.log(right) - wrong
        noise[told] -= math.log(size)  # noise declares any language
    every = np.column_stack([log, noise])
    every -= every.max(axis=1, keepdims=True)
    post = np.exp(every) / np.exp(every).sum(axis=1, keepdims=True)
    top = log.argmax(axis=1)
    best = post[np.arange(len(top)), top]
    fine, own = (n > 0) & (best >= MIN_POSTERIOR), score_.argmax(axis=1)
    return [{"lang": model.languages[i], "posterior": round(float(p), 6), "text_lang": model.languages[j] if m else None, "accepted": bool(a)} for i, p, j, m, a in zip(top, best, own, n, fine)]


def identify(df: DataFrame, model: Model, text: str = "text", declared: Column | None = None, url: Column | None = None, host: Column | None = None, into: str = "language") -> DataFrame:
    """df with one more column, language: struct of lang, posterior, text_lang and accepted. Where that name is taken,
    underscores are added to it until it is free.

    Evidence that is null or names no language of the model says nothing. Without any evidence a document has the prior
    of its host; a null or empty text isn't accepted. Repeated rows have equal results. With no labelled row to fit on,
    lang is null and nothing is accepted. All columns, whatever they are called, and rows are kept; an empty table stays
    empty.
    """
    ship(df.sparkSession)
    into = free_name(df, into)
    nothing = F.lit(None).cast("string")
    if url is not None and host is None:
        host = host_and_path(url)[0]
    host = F.coalesce(host.cast("string"), F.lit("")) if host is not None else F.lit("")
    mapped = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    suffix = F.element_at(mapped, F.substring_index(host, ".", -1)) if url is not None else nothing
    said = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1)) if declared is not None else nothing
    if not model.languages:
        return df.withColumn(into, F.struct(nothing.alias("lang"), F.lit(None).cast("double").alias("posterior"), nothing.alias("text_lang"), F.lit(False).alias("accepted")))

    @F.arrow_udf("struct<lang:string,posterior:double,text_lang:string,accepted:boolean>")
    def fuse(texts: pa.Array, said: pa.Array, suffix: pa.Array, prior: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            t = [x or "" for x in texts.slice(at, 256).to_pylist()]
            out += fused(*score(t, model), np.array(prior.slice(at, 256).to_pylist()), said.slice(at, 256).to_pylist(), suffix.slice(at, 256).to_pylist(), model)
        return pa.array(out, pa.struct([("lang", pa.string()), ("posterior", pa.float64()), ("text_lang", pa.string()), ("accepted", pa.bool_())]))

    # all of df's columns travel as one, so that none of their names can be met
    d = df.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), host.alias("at"), said.alias("said"), suffix.alias("suffix"))
    table, wide = priors(d, model, "text", F.col("at"))
    d = with_priors(d, table, len(model.languages))
    prior = F.coalesce("prior", F.array(*map(F.lit, wide)))
    return d.select("row.*", fuse(F.col("text"), F.col("said"), F.col("suffix"), prior).alias(into))


def with_priors(d: DataFrame, table: DataFrame, languages: int) -> DataFrame:
    """d, which has a host in the column at, with its prior.

    All hosts are broadcast if they are few. Else those that have so many rows that there can't be many of them are, and
    only rows of the others are dealt out by host, none of which can be hot then.
    """
    table = written(table, "priors")
    most = max(1, BROADCAST_BYTES // (8 * languages + 100))
    if table.count() <= most:
        return d.join(F.broadcast(table.select("host", "prior")), d["at"] == F.col("host"), "left").drop("host")
    total = table.agg(F.sum("n")).first()[0]
    hot = table.where(F.col("n") * most >= total).select("host", F.col("prior").alias("hot"))  # at most so many
    d = d.join(F.broadcast(hot), d["at"] == hot["host"], "left").drop("host")
    # rows that have their prior are dealt out by their texts, under a name that no host has
    d = d.withColumn("by", F.when(F.col("hot").isNull(), F.col("at")).otherwise(F.concat(F.lit("\0"), F.coalesce(F.xxhash64("text"), F.lit(0)).cast("string"))))
    rest = table.where(F.col("n") * most < total).select("host", "prior")
    d = d.join(rest, d["by"] == rest["host"], "left")
    return d.withColumn("prior", F.coalesce("hot", "prior")).drop("host", "hot", "by")


def documents(docs: DataFrame, into: str = "language") -> DataFrame:
    """identify() for documents (doc_id, text, lang, source): lang is the label to fit on and no evidence, source is the
    host. Documents declare nothing and have no address; pages() has both. Null, empty and repeated rows, extra columns and
    empty tables as there."""
    return identify(docs, fit(docs, "text", "lang", "doc_id"), host=F.col("source"), into=into)


def pages(df: DataFrame, docs: DataFrame) -> DataFrame:
    """identify() for pages (page_id, url, html), fitted on documents: the html tag's lang is what a page declares, its url
    gives suffix and host. A null page has no text and isn't accepted; columns beyond the three are left out."""

    @F.arrow_udf("string")
    def text(found: pa.Array) -> pa.Array:
        return pa.array([None if p is None else html.unescape(MARKUP.sub(" ", p)) for p in found.to_pylist()], pa.string())

    ship(df.sparkSession)
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", 1)
    d = df.select("page_id", "url", "html", text(F.col("html")).alias("text"))
    return identify(d, fit(docs, "text", "lang", "doc_id"), declared=declared, url=F.col("url"))
