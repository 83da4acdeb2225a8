"""Block and allow rules for urls by a sort-merge range join.

A host is turned round, label by label, each label closed by a dot: m.example.net gives net.example.m. so that a host
and its subdomains are one interval of keys, and intervals of rules are nested or apart. Pages and rules are brought
into key order; one sweep keeps the rules whose interval is open on a stack, and a page meets only those.

Pages are dealt to ranges of (turned host, path, page), so a host with a third of all pages is split over ranges. A
rule goes to each range that its interval touches: once, plus once a range boundary inside it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: (action, host, path) of the rules in force. Fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Verdict where no rule fits.
DEFAULT = "allow"
#: Keys drawn for each range when the boundaries are set; the driver holds ranges * SAMPLE of them at most.
SAMPLE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above every character that a key can hold.
LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def turned(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


def turned_column(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Pages and rules in key order: which rule each page meets."""
    stack: list[tuple[str, str, list[tuple[str, str, str]]]] = []  # key, host, its (path, action, rule)
    part = None
    for b in batches:
        out = []
        for pid, key, kind, page, host, path, action in zip(b["pid"], b["tkey"], b["kind"], b["page_id"], b["host"], b["path"], b["action"]):
            if pid != part:
                part, stack = pid, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, []))
                stack[-1][2].append((path, action, host + path))
                continue
            # the longest rule as a whole, wherever on the stack it lies; of equal ones the deepest host's
            fit = (r for _, _, rules in stack for r in rules if path.startswith(r[0]))
            hit = min(fit, key=lambda r: (-len(r[2]), len(r[0]), r), default=None)
            out.append((page, host, path, hit[2] if hit else None, hit[1] if hit else default))
        if out:
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def boundaries(p: DataFrame, n: int) -> list[str]:
    """Where to cut the keys skey into n ranges: a uniform draw of bounded size by a hash, each key weighed by its rows.

    A share of the hash's range is cut out in every task, so no task hands on more than its part. Boundaries change
    no result.
    """
    if n < 2:
        return []
    rows = p.count()
    d = p.select("skey", F.xxhash64("skey", F.lit(11)).alias("h"))
    if rows > 2 * n * SAMPLE:
        d = d.where(F.col("h") < int(-(2**63) + 2**64 * (n * SAMPLE / rows)))
    drawn = d.groupBy("skey").agg(F.count(F.lit(1)).alias("c")).limit(4 * n * SAMPLE).collect()
    keys = sorted((r[0], r[1]) for r in drawn)
    total, before, out = sum(c for _, c in keys), 0, set()
    for key, c in keys:
        # a key starts a range where the rows before it have filled one
        if before * n // max(total, 1) != (before + c) * n // max(total, 1):
            out.add(key)
        before += c
    return sorted(out)[1 - n :]


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each page.

    rules: (action, host, path); a rule fits its host and all subdomains if the page's path starts with the rule's.
    The longest rule, host and path together, wins; of equally long ones the deepest host's, then the first by action. Pages with a null or odd url have
    an empty host and path and meet only rules for the empty host. Repeated pages and null ids are kept; an empty table
    gives no rows. Columns of pages beyond the two named are left out.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = host_and_path(F.col(url))
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("tkey", turned_column(F.col("host")))
    p = p.withColumn("skey", F.concat_ws("\x00", "tkey", "path", F.coalesce(F.lpad(F.col("page_id").cast("string"), 20, "0"), F.lit(""))))
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = boundaries(p, n)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in keys], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(cuts, k), bisect_right(cuts, k + LAST) + 1)) for k in keys])

    # where cuts fall on equal keys, bisect keeps all rows of a key in one range, as for rules
    r = rules.select("action", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    r = r.withColumn("tkey", turned_column(F.col("host"))).withColumn("pid", F.explode(ranges_of("tkey")))
    r = r.select("pid", "tkey", F.lit("").alias("skey"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "action")
    p = p.select(range_of("skey").alias("pid"), "tkey", "skey", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("action"))
    events = p.unionAll(r).repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "tkey", "kind", "skey")
    return events.mapInPandas(lambda it: sweep(it, default), "page_id long, host string, path string, rule string, verdict string")


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")
