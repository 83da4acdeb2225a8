import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from velotrace.llm import sharding, url_filters


def plain_rule(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest
    for sign in "/?#":
        host = host.split(sign)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fit = [(len(h), len(p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None, key=lambda r: (len(r[3]), r[0]))
    return host, path, best and best[3], best[2] if best else url_filters.DEFAULT


URLS = [
    "http://x.net/a/long/path/q", "http://x.net/a", None, "", "example.net/en/", "http://", "http://example.net", "HTTP://EXAMPLE.NET/en/x", "https://m.example.net/de/#t", "http://example.net?x=/en/", "a://b://example.com/de/", "http://notexample.com/de/1",
    "http://x.org/fr/", "http://org/fr", "http://org/fr/?q", "http://.net/", "http://a..net/x", "http://net", "http://net/", "http://u@example.com:80/de/", "http://é.org/fr/é", "http://Ä.net/",
]


def test_rules_against_a_loop(spark):
    rng = random.Random(5)
    hosts = ["net", "a.net", "b.a.net", "xa.net", "org", "c.org", "com"]
    paths = ["/", "/en/", "/en/x", "/de", "", "/en/x/long/path/"]
    rules = [(rng.choice(["block", "allow"]), h, p) for h in hosts[:5] for p in paths if rng.random() < 0.5]
    rules += [("block", "net", "/a/long/path/"), ("allow", "x.net", "/")]  # the longest rule isn't the deepest host's
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a', '#b', 'tail'])}" for _ in range(400)] + ["http://hot.a.net/en/same"] * 300
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)] + [(None, "http://a.net/", "h"), (5, URLS[5], "h")], "page_id long, url string, host string")
    for ranges in (1, 7):
        got = url_filters.judge(pages, url_filters.rule_table(spark, rules), ranges=ranges).collect()
        assert len(got) == pages.count()
        assert next(r.rule for r in got if r.page_id == 0) == "net/a/long/path/"
        for r in got:
            url = urls[r.page_id] if r.page_id is not None else "http://a.net/"
            assert (r.host, r.path, r.rule, r.verdict) == plain_rule(url, rules), url


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(pages, url_filters.rule_table(spark)).count() == 0


def plain_jump(key, shards):
    """One key at a time, as the paper has it."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_against_a_loop():
    keys = np.concatenate([np.random.default_rng(9).integers(0, 2**63, 300), [0, 1, 2**63 - 1]]).astype(np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    low = np.array([-1, -(2**63)], np.int64).view(np.uint64)
    assert sharding.jump(low, 40).tolist() == [plain_jump(2**64 - 1, 40), plain_jump(2**63, 40)]


def test_rows_that_are_there_very_often(spark, monkeypatch):
    """Runs of slots: rows without an id, one text under one id, and many ids."""
    from velotrace.llm import common

    monkeypatch.setattr(common, "RUN", 7)
    rows = [(None, "t")] * 50 + [(4, "same")] * 30 + [(4, "other")] + [(i, f"text {i}") for i in range(60)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in got) == sorted((i is None, i or 0, zlib.crc32(t.encode())) for i, t in rows)
    assert all(r.shard == plain_jump(r.doc_id or 0, 5) and r.grown_shard == plain_jump(r.doc_id or 0, 6) for r in got)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    was = sharding.jump(keys, 1)
    assert not was.any()
    for n in range(2, 45):
        now = sharding.jump(keys, n)
        assert ((now == was) | (now == n - 1)).all()
        assert abs((now != was).mean() - 1 / n) < 0.02
        was = now
    assert np.bincount(was).std() / np.bincount(was).mean() < 0.1


def test_slots_and_sizes(docs, empty, odd_texts):
    got = sharding.assign(docs, 5).collect()
    assert len(got) == docs.count()
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_id = {1000 - 7 * i: (t or "").encode() for i, t in enumerate(odd_texts)}
    for r in got:
        if r.doc_id is not None:
            text = by_id[r.doc_id]
            assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "key")
            assert r.shard == sharding.jump(np.array([r.doc_id], np.int64).view(np.uint64), 5)[0]
            assert r.grown_shard in (r.shard, 5)
    assert sharding.assign(empty, 5).count() == 0


def test_text_keys(spark):
    d = spark.createDataFrame([("a", "t"), ("b", None), ("a", "t")], "name string, text string")
    got = sharding.assign(d, 3, key="name").collect()
    assert len(got) == 3 and len({r.shard for r in got if r.name == "a"}) == 1


def test_written_shards(spark, tmp_path):
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    sharding.write_shards(d, sharding.assign(d, 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
