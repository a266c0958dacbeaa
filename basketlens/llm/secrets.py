"""Secrets in texts, found through an inverted index of trigrams.

1. *Query.*  From each rule's regular expression a Boolean query over trigrams is derived: a text that matches must hold all
   trigrams of a literal, one of the alternatives of a branch, and so on.  Letters count in lower case.  A rule from which no
   trigram follows, such as a run of hexadecimal digits, has no query.
2. *Index.*  Postings name for each trigram that some query asks for the documents that hold it, in buckets of some
   thousand documents, so that no list grows with the corpus.  A document's name is the hash of its id and text.
3. *Intersection.*  In each bucket the queries are answered by intersecting and uniting its lists.
4. *Verification.*  Candidates run the regular expressions of their rules, and all documents those of the rules without a query.
   Postings only ever name too many documents, so hash collisions cost time and change nothing.

Everything is built from DataFrame functions.  Postings are combined in the tasks before they are exchanged, and rows with the
same id and text are one name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.shared import documents, store

DOCUMENTS_PER_BUCKET = 4096
# So many different strings a part of an expression may stand for before the query takes its parts one by one.
MOST_STRINGS = 64
MOST_IN_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` characters are asked of the group ``measured``.  Written for Java's and RE2's engines alike."""

    kind: str
    regex: str
    measured: int = 0
    least: int = 0
    base: bool = False


# The base rules are given; the others are the public formats of keys.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", measured=2, least=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,500}\.eyJ[A-Za-z0-9_-]{10,900}\.[A-Za-z0-9_-]{10,900}"),
    Rule("bearer", r"(?i:bearer)\x20{1,3}[A-Za-z0-9._~+/=-]{20,500}"),
    Rule("url_login", r"(?i:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~%-]{1,64}:[^\x20\x09-\x0D/:@]{3,128}@"),
]


# ---------------------------------------------------------------- Boolean trigram queries

# A query is True, a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple


def all_of(queries: Iterable[Query]) -> Query:
    parts: set = set()
    for q in queries:
        if q is not True:
            parts.update(q[1] if isinstance(q, tuple) and q[0] == "and" else [q])
    return True if not parts else ("and", tuple(sorted(parts, key=str))) if len(parts) > 1 else parts.pop()


def one_of(queries: Iterable[Query]) -> Query:
    """Alternatives; one that asks for all that another asks for, and more, adds nothing."""
    parts: set = set()
    for q in queries:
        if q is True:
            return True
        parts.update(q[1] if isinstance(q, tuple) and q[0] == "or" else [q])
    asked = {q: frozenset(q[1]) if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in parts}
    least = [q for q in parts if not any(asked[o] < asked[q] for o in parts)]
    return ("or", tuple(sorted(least, key=str))) if len(least) > 1 else least[0]


def of_strings(strings: Iterable[str]) -> Query:
    """That a text holds one of these strings."""
    return one_of(all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class Part:
    """What a part of an expression can be: all its strings, where they are few, or else only a query."""

    strings: frozenset[str] | None
    query: Query = True

    def asks(self) -> Query:
        return of_strings(self.strings) if self.strings is not None else self.query


ANYTHING = Part(None)
NOTHING = Part(frozenset([""]))


def in_sequence(parts: Iterable[Part]) -> Part:
    """Strings grow as long as they are few; what can't grow on is asked for by itself."""
    held, asked = frozenset([""]), []
    whole = True
    for part in parts:
        if part.strings is not None and len(held) * len(part.strings) <= MOST_STRINGS:
            held = frozenset(a + b for a in held for b in part.strings)
            continue
        asked += [of_strings(held), part.query if part.strings is None else True]
        held, whole = part.strings or frozenset([""]), False
    return Part(held) if whole else Part(None, all_of([*asked, of_strings(held)]))


def members(items: list) -> Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 4 * MOST_IN_CLASS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return ANYTHING
    return Part(frozenset(found)) if len(found) <= MOST_IN_CLASS else ANYTHING


def part_of(kind, value) -> Part:
    if kind is sre.LITERAL:
        return Part(frozenset([chr(value).lower()]))
    if kind is sre.IN:
        return members(value)
    if kind is sre.SUBPATTERN:
        return in_sequence(part_of(*x) for x in value[-1])
    if kind is sre.BRANCH:
        parts = [in_sequence(part_of(*x) for x in one) for one in value[1]]
        if all(p.strings is not None for p in parts) and sum(len(p.strings) for p in parts) <= MOST_STRINGS:
            return Part(frozenset().union(*(p.strings for p in parts)))
        return Part(None, one_of(p.asks() for p in parts))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, what = value
        one = in_sequence(part_of(*x) for x in what)
        if (least, most) == (0, 1) and one.strings is not None:
            return Part(one.strings | {""})
        if not least:
            return ANYTHING
        several = in_sequence([one] * min(least, 8))
        return several if least == most <= 8 else Part(None, several.asks())
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return NOTHING
    return ANYTHING


def trigram_query(regex: str) -> Query:
    """What a text must hold, in lower case, for ``regex`` to match somewhere in it; True where nothing is known."""
    return in_sequence(part_of(*x) for x in sre_parser.parse(regex)).asks()


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


# ---------------------------------------------------------------- index


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null is empty) and the document's name in postings."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn("name", F.xxhash64("doc_id", "text"))


def postings(texts: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """bucket, trigram, names: the inverted index of these trigrams."""
    buckets = texts.count() // DOCUMENTS_PER_BUCKET + 1
    vocabulary = F.array(*[F.lit(t) for t in sorted(trigrams)])
    held = texts.withColumn("low", F.lower("text")).select("name", F.explode(F.filter(vocabulary, lambda t: F.contains("low", t))).alias("trigram"))
    return held.groupBy(F.pmod("name", F.lit(buckets)).alias("bucket"), "trigram").agg(F.collect_set("name").alias("names"))


def answer(query: Query, lists: Column) -> Column:
    """The names that satisfy a query, from a bucket's map of trigrams to names."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.array().cast("array<bigint>"))
    meet = F.array_intersect if query[0] == "and" else F.array_union
    first, *rest = (answer(q, lists) for q in query[1])
    return F.aggregate(F.array(*rest), first, lambda found, more: meet(found, more))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """name, kinds: the documents that may match, and which rules."""
    if not queries:
        return index.sparkSession.createDataFrame([], "name long, kinds array<string>")
    lists = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "names"))).alias("lists"))
    answers = F.array(*[F.struct(F.lit(kind).alias("kind"), answer(q, F.col("lists")).alias("names")) for kind, q in queries.items()])
    by_kind = lists.select(F.explode(answers).alias("a")).select("a.kind", F.explode("a.names").alias("name"))
    return by_kind.groupBy("name").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


# ---------------------------------------------------------------- verification


def _between(kind: int) -> str:
    """SQL: where matches lie, from the matches and what stands between them; lengths are code points."""
    return f"""if(size(f{kind}) = 0, cast(array() as array<struct<start:int,kind:int,end:int>>),
  filter(aggregate(sequence(1, size(f{kind})), struct(0 as at, cast(array() as array<struct<start:int,kind:int,end:int>>) as out),
    (a, i) -> struct(a.at + length(p{kind}[i - 1]) + length(f{kind}[i - 1]) as at,
      concat(a.out, array(struct(a.at + length(p{kind}[i - 1]) as start, if(length(m{kind}[i - 1]) >= {{least}}, {kind}, -1) as kind,
        a.at + length(p{kind}[i - 1]) + length(f{kind}[i - 1]) as end))) as out),
    a -> a.out), s -> s.kind >= 0))"""


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``, the sorted matches (start, kind as its number in ``rules``, end) of every document.

    A rule's matches are leftmost and don't overlap; places are code points.  Null text is empty, empty texts have no
    matches, repeated rows are each answered, rows without an id too.  No rows give no rows.  Other columns are not read.
    """
    texts = named(docs, id_col, text_col)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not True}
    index = store(postings(texts, set().union(*map(trigrams_of, queries.values()))), "postings")
    kinds = store(candidates(index, queries), "candidates").withColumnRenamed("name", "of")
    rows = texts.join(kinds, F.col("name") == F.col("of"), "left")
    none = F.array().cast("array<string>")
    tried, columns = [], []
    for k, rule in enumerate(rules):
        here = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.col("text").rlike(rule.regex)
        tried.append(F.coalesce(here, F.lit(False)).alias(f"t{k}"))
        take = lambda group, r=rule: F.regexp_extract_all("text", F.lit(r.regex), F.lit(group))
        columns += [
            F.when(F.col(f"t{k}"), F.split("text", rule.regex, -1)).otherwise(none).alias(f"p{k}"),
            F.when(F.col(f"t{k}"), take(0)).otherwise(none).alias(f"f{k}"),
            F.when(F.col(f"t{k}"), take(rule.measured)).otherwise(none).alias(f"m{k}"),
        ]
    parts = rows.select("doc_id", "text", *tried).select("doc_id", *columns)
    found = [F.expr(_between(k).format(least=rule.least)) for k, rule in enumerate(rules)]
    return parts.select("doc_id", F.sort_array(F.concat(*found)).alias("found"))


def secret_digests(docs: DataFrame, rules: list[Rule] = RULES, **columns: str) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of their places, and all places as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(k) for k, r in enumerate(rules) if r.base])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("found", lambda s: F.array_contains(base, s["kind"]))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = {k})) as long)").alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    return scan_secrets(docs, rules, **columns).select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(documents(spark, folder))


def _sql() -> str:
    steps, kinds = [], []
    for k, r in enumerate(RULES):
        re = "'" + r.regex.replace("'", "''") + "'"
        steps.append(
            f"""select r, {k} as kind, s + 1 as i, list_sum(list_transform(p[1:s + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:s], lambda x: length(x))), 0) as start,
  length(f[s + 1]) as size, length(m[s + 1]) as measured from (select r, p, f, m, unnest(range(len(f))) as s
  from (select r, regexp_split_to_array(t, {re}) as p, regexp_extract_all(t, {re}) as f, regexp_extract_all(t, {re}, {r.measured}) as m from d where regexp_matches(t, {re})))"""
        )
        kinds.append(f"({k}, '{r.kind}', {r.least}, {r.base})")
    counts = ", ".join(f"count(*) filter (kind = {k}) as n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
k(kind, name, least, base) as (values {", ".join(kinds)}),
s as (select r, kind, base, start::bigint as start, name || ':' || start::bigint || ':' || (start + size)::bigint as x
  from ({" union all ".join(steps)}) join k using (kind) where measured >= least),
g as (select r, {counts}, string_agg(x, ',' order by start, kind) filter (base) as own, string_agg(x, ',' order by start, kind) as spans from s group by r)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)
"""


SQL = _sql()
