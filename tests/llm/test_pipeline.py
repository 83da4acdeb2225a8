import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from velotrace.llm import packing, secrets

from .test_search_and_joins import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.written(stage(spark, d, SF), "stage")
        assert d.columns == docs.columns and d.dtypes == docs.dtypes
        kept[name] = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    assert len(kept["language ID"]) == docs.count()  # all are prose of known languages
    parts = plain_components(kept["language ID"], words=5, num=80)
    assert set(kept["n-gram Jaccard join"]) == {i for i, (_, c) in parts.items() if i == c}
    assert set(kept["secret scans"]) == set(kept["n-gram Jaccard join"])
    assert secrets.report(d).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
    assert d.where("n_chars <> length(text)").count() == 0
    whole = packing.pack(d).groupBy("doc_id").agg(F.sum("length"))
    assert whole.count() == len(kept["secret scans"])
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == whole.count()


CLASHES = ["language", "spans", "_at", "_host", "_prior", "_rules", "_key", "_low", "row", "key", "body", "rules", "doc", "node", "digest", "prefix", "_group", "_stays", "host", "prior", "said"]


def test_odd_rows_go_through(spark, docs, empty):
    """Rows of every odd kind, and columns whose names the operators use themselves, with their values."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    extra = [F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES]
    for d in (docs.select(*names, *extra), docs, empty.select(*names, *extra), empty):
        begin = d
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = corpus_pipeline.written(stage(spark, d, SF), "stage")
            assert d.columns == begin.columns
            if "node" in d.columns:
                assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in d.collect() for c in CLASHES)
        packed = corpus_pipeline.written(corpus_pipeline.best_fit_packing(spark, d, SF), "stage")
        assert packed.where("piece = 0").count() == d.count()


def test_rows_that_share_an_id_or_have_none(spark):
    """Only a row that another one stands for goes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (None, b), (None, c), (3, c + " tail"), (None, "alone here"), (8, None), (8, ""), (2, a.upper())]
    d = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(corpus_pipeline.ngram_jaccard(spark, d, SF).select("doc_id", "text").collect(), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(2, a.upper()), (5, b), (3, c + " tail"), (None, "alone here"), (8, None), (8, "")], key=str)


def test_each_operator_has_its_query():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_near_duplicates_of_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(100)]
    changed = [*base[:30], "x", *base[31:70], "y", *base[71:]]  # 3 words: 92 of 104 shingles; 5 words: 86 of 106
    texts = {1: base, 2: base + [f"a{i}" for i in range(20)], 3: changed, 4: base + [f"b{i}" for i in range(30)]}
    d = spark.createDataFrame([(i, " ".join(w), "en", "src0", 0) for i, w in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.ngram_jaccard(spark, d, SF)
    assert {r.doc_id for r in got.collect()} == {1, 4}


def test_near_duplicate_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = [x for x in re.split("[ \t\n\v\f\r]+", r.text.lower()) if x]
        sets[r.doc_id] = set(zip(*[w[j:] for j in range(5)])) if len(w) > 4 else {tuple(w)}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {x: a if y == b else y for x, y in root.items()}
    got = {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs, SF).select("doc_id").collect()}
    assert got == {i for i, r in root.items() if i == r}
