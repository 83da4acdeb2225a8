"""Secret scans with a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived (see trigrams), cut down to few trigrams a
conjunction, which every match must still have. The index holds, for every trigram that is asked for, the documents
whose lower-cased text has it; postings are intersected a conjunction at a time by grouping on the document, and only
rules that survive are verified on a document's text. Rules without a mandatory trigram are run over every text.

The index is written, and what survives the intersections comes back to the texts as numbers of documents and rules: as
long as these are few they are broadcast, and no text is dealt out.

Spans come from the texts between matches and the matches themselves, whose lengths add up to code-point positions.
Running sums and masked texts are made by blocks, so that a text with very many matches costs little more than its
length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .trigrams import Query, query


@dataclass(frozen=True)
class Rule:
    """A kind of secret. The pattern means the same in Java, Python and RE2; a match counts if the group has at least
    shortest characters."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
#: Their order is the order of kinds. access and hex are runs to their end, so their least length can stand in the pattern.
BASE = (
    Rule("assign", rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,end:int,kind:string,place:int>>"
MASK = "[SECRET]"
#: Trigrams of a conjunction that the index holds.
ASKED = 2
#: Documents and rules that are broadcast to the texts; with more, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Elements of a block of running sums, and code points of a block of a text.
SUM_BLOCK, TEXT_BLOCK = 256, 4096


def queries(rules: tuple[Rule, ...]) -> list[Query]:
    """The query of each rule, with few trigrams a conjunction: those that most conjunctions share, so that few are
    looked for, and of equal ones those that stand apart in the alphabet's order."""
    whole = [query(r.pattern) for r in rules]
    uses: dict[str, int] = {}
    for q in whole:
        for c in q or ():
            for t in c:
                uses[t] = uses.get(t, 0) + 1
    return [None if q is None else [frozenset(sorted(c, key=lambda t: (-uses[t], t))[:ASKED]) for c in q] for q in whole]


def postings(df: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """(document, trigram) of the trigrams that are asked for."""
    low = df.select(F.col(key).alias("doc"), F.lower(F.col(text)).alias("low"))
    here = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("doc", F.explode(here).alias("trigram"))


def candidates(df: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(doc, rules: the numbers of those with a query that the document may meet); None if no rule has a query.

    Rows that share a key, or have none, share their postings, so that each of them is verified.
    """
    clauses = [(r, c) for r, q in enumerate(queries(rules)) if q is not None for c in q]
    if not clauses:
        return None
    trigrams = sorted(set().union(*(c for _, c in clauses)))
    # which conjunctions a trigram belongs to: a table of constants, as long as the rules
    use = F.array(*[F.array(*[F.lit(n) for n, (_, c) in enumerate(clauses) if t in c]) for t in trigrams])
    found = postings(df, trigrams, key, text).select("doc", F.explode(F.element_at(use, F.col("trigram") + 1)).alias("clause"))
    met = found.groupBy("doc", "clause").agg(F.count(F.lit(1)).alias("n"))
    full, rule = F.array(*[F.lit(len(c)) for _, c in clauses]), F.array(*[F.lit(r) for r, _ in clauses])
    met = met.where(F.col("n") >= F.element_at(full, F.col("clause") + 1))
    return met.groupBy("doc").agg(F.collect_set(F.element_at(rule, F.col("clause") + 1)).alias("rules"))


def _let(value: Column, body) -> Column:
    """body of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ahead(values: Column, fold) -> Column:
    """For an array the fold of those before each element. fold takes an array and gives a value of its element's kind,
    itself foldable; blocks keep the work near the array's length."""
    of_block = lambda v, i: F.slice(v, (F.floor(i / SUM_BLOCK) * SUM_BLOCK + 1).cast("int"), i % SUM_BLOCK)
    count = lambda v: F.sequence(F.lit(0), F.floor(F.size(v) / SUM_BLOCK).cast("int"))
    sums = lambda v: F.transform(count(v), lambda b: fold(F.slice(v, b * SUM_BLOCK + 1, SUM_BLOCK)))
    bases = lambda s: F.transform(s, lambda _, i: fold(F.slice(s, 1, i)))
    each = lambda v, b: F.transform(v, lambda _, i: fold(F.array(F.get(b, F.floor(i / SUM_BLOCK).cast("int")), fold(of_block(v, i)))))
    return _let(values, lambda v: _let(sums(v), lambda s: _let(bases(s), lambda b: each(v, b))))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _most(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(-1))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in a text, leftmost and apart from one another."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    lengths = lambda x: F.transform(x, lambda y: F.length(y))
    found = F.struct(lengths(hits).alias("hit"), lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(kept).alias("kept"))

    def placed(w: Column) -> Column:
        sizes = F.zip_with(w["hit"], F.slice(w["gap"], 1, F.size(w["hit"])), lambda h, g: h + g)
        each = F.arrays_zip(_ahead(sizes, _sum).alias("at"), F.slice(w["gap"], 1, F.size(w["hit"])).alias("gap"), w["hit"].alias("hit"), w["kept"].alias("kept"))
        fit = F.filter(each, lambda x: x["kept"] >= rule.shortest)
        return F.transform(fit, lambda x: F.struct((x["at"] + x["gap"]).alias("start"), F.lit(place).alias("place"), (x["at"] + x["gap"] + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind")))

    return _let(found, placed)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", into: str = "spans") -> DataFrame:
    """df with one more column, spans: start, end (code points, end exclusive), kind and place of the rule, by start and
    place. Where that name is taken, underscores are added to it until it is free; all other columns stay as they are.

    A null or empty text has no spans. Rows that share a key, or have none, are each scanned on their own text. An empty
    table stays empty.
    """
    into = free_name(df, into)
    d = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = candidates(df, rules, key, text)
    if found is None:
        d = d.withColumn("rules", F.array().cast("array<int>"))
    else:
        found = written(found, "survivors")
        few = found.count() <= BROADCAST_ROWS
        d = d.join(F.broadcast(found) if few else found, F.col("key").eqNullSafe(F.col("doc")), "left")
    none, each = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>"), []
    for place, (rule, q) in enumerate(zip(rules, queries(rules))):
        asked = F.coalesce(F.array_contains("rules", F.lit(place)), F.lit(False)) if q is not None else F.lit(True)
        each.append(F.when(asked & F.col("body").rlike(rule.pattern), _spans(F.col("body"), rule, place)).otherwise(none))
    spans = F.transform(F.sort_array(F.flatten(F.array(*each))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["place"].alias("place")))
    return d.select("row.*", spans.cast(SPAN).alias(into))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; other columns are left out."""
    d = scan(df.select(key, text), RULES, key, text, "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return d.select(key, *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Spans by start, as struct(at, to), those that touch or overlap as one: a span begins anew where no earlier one
    reaches it, and ends as far as anything before the next reaches."""
    ends = F.transform(spans, lambda s: s["end"])
    ahead = F.zip_with(spans, _ahead(ends, _most), lambda s, r: F.struct(s["start"].alias("at"), r.alias("reach")))

    def made(w: Column) -> Column:
        to = F.concat(F.transform(F.slice(w["b"], 2, F.greatest(F.size(w["b"]) - 1, F.lit(0))), lambda x: x["reach"]), F.array(w["last"]))
        return F.zip_with(w["b"], to, lambda b, e: F.struct(b["at"].alias("at"), e.alias("to")))

    return _let(F.struct(F.filter(ahead, lambda x: x["at"] > x["reach"]).alias("b"), _most(ends).alias("last")), made)


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text given in blocks, touching the blocks in question alone."""
    first, last = F.floor(start / TEXT_BLOCK).cast("int"), F.floor(F.greatest(end - 1, start) / TEXT_BLOCK).cast("int")

    def part(x: Column, i: Column) -> Column:
        a = F.greatest(start - (first + i) * TEXT_BLOCK, F.lit(0))
        return F.substring(x, a + 1, F.greatest(F.least(end - (first + i) * TEXT_BLOCK, F.lit(TEXT_BLOCK)) - a, F.lit(0)))

    return F.array_join(F.transform(F.slice(blocks, first + 1, last - first + 1), part), "")


def masked(body: Column, spans: Column, mask: str) -> Column:
    """The text with each merged span replaced by the mask."""
    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def made(w: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(w["m"], lambda x: x["to"]))
        ends = F.concat(F.transform(w["m"], lambda x: x["at"]), F.array(w["n"]))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: _cut(w["t"], a, b)), mask)

    return _let(F.struct(blocks.alias("t"), _merged(spans).alias("m"), F.length(body).alias("n")), made)


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mask: str = MASK) -> DataFrame:
    """df with every span of its text replaced by the mask; spans that touch or overlap share one. Null texts stay null;
    other columns, whatever they are called, and rows that share a key or have none are kept as they are."""
    into = free_name(df, "spans")
    d = scan(df, rules, key, text, into)
    out = F.when(F.size(into) > 0, masked(F.col(text), F.col(into), mask)).otherwise(F.col(text))
    return d.withColumn(text, out).drop(into)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for report() over documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for place, r in enumerate(rules):
        parts.append(f"""
  SELECT d.rn, i.i, {place} AS place, {q(r.kind)} AS kind, length(list_aggregate(gaps[1:i.i], 'string_agg', '')) + coalesce(length(list_aggregate(hits[1:i.i - 1], 'string_agg', '')), 0) AS s, length(hits[i.i]) AS n
  FROM (SELECT rn, regexp_extract_all(text, {q(r.pattern)}) AS hits, regexp_extract_all(text, {q(r.pattern)}, {r.group}) AS kept, string_split_regex(text, {q(r.pattern)}) AS gaps FROM docs) d, LATERAL (SELECT unnest(range(1, len(d.hits) + 1)) AS i) i
  WHERE length(kept[i.i]) >= {r.shortest}""")
    unions = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(kind) FILTER (kind = {q(r.kind)}) AS n_{r.kind}" for r in BASE)
    item = "kind || ':' || s || ':' || (s + n)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({unions}
)
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce(string_agg({item}, ',' ORDER BY s, place) FILTER (place < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({item}, ',' ORDER BY s, place), '') AS spans
FROM docs LEFT JOIN found USING (rn) GROUP BY rn
"""
