"""Quality rules whose limits follow the data: fences from mergeable quantile sketches per language and source.

Every document gets a few whole-number measures.  A sketch counts documents per measure and bin; bins are exact up
to 63 and then 32 to each doubling, so a quantile read from it is at most 1/32 too low.  Sketches of the same measure
merge by adding counts: per-partition counts into those of a (language, source), these into a language's and
these into one of all.

The limits of a group of n documents are the mean of its own fences, with weight n, and those of the next larger group, with
weight ``WEIGHT``: a language's fences lean on those of all documents, and a source's on its language's, the more so the fewer documents there are.

A document is kept when it passes the fixed base rule and no measure lies beyond its group's limit.  The fences of a measure
that spreads around its middle stand ``REACH`` interquartile ranges and a slack outside the quartiles.  Of one that is zero in most
documents the quartiles say nothing; its fence stands beyond the 99th percentile by that percentile's distance to
the median, and a slack.  So ordinary documents are never near a fence.

Only DataFrame functions are used.  Documents are counted per bin before anything is exchanged, so a source with a
third of all rows is a bounded number of rows; the limits join the documents, whose skewed side may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.shared import documents, store

# Documents that a wider group's fences count for.
WEIGHT = 100
REACH = 3
# measure: (slack above, slack below or None where small values are good); these without a lower fence are mostly zero
MEASURES = {
    "word_length": (100, 100),  # hundredths of a character per word
    "symbols": (40, None),  # per 1000 words
    "dup_lines": (100, None),  # per 1000 lines that hold a word
    "repeat_words": (100, None),  # per 1000 words
}
LEAST_WORDS = 50


def _without(text: str, characters: list[str]) -> str:
    """SQL: ``text`` without these characters; a chain of plain replacements is far cheaper than a pattern."""
    for c in characters:
        text = f"replace({text}, {c}, '')"
    return text


_SPACES = ["' '", "'\\t'", "'\\n'", "'\\u000B'", "'\\u000C'", "'\\r'"]
_SYMBOLS = [f"'{c}'" for c in "#*$%&|<>"]


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: bool) -> DataFrame:
    """doc_id, lang, source and the measures of each document; with ``carry`` the whole row too, as ``row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), text.alias("t"), *row
    )
    kept = ["doc_id", "lang", "source", *(["row"] if carry else [])]
    parts = base.select(
        *kept,
        "t",
        F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x != '')").alias("w"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("l"),
    )
    windows = parts.select(
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.expr(f"cast(length({_without('t', _SPACES)}) as long)").alias("word_chars"),
        F.expr(f"cast(length(t) - length({_without('t', _SYMBOLS)}) as long)").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        F.expr("cast(size(l) - size(array_distinct(l)) as long)").alias("n_dup_lines"),
        F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("h"),
    )
    # positions of windows that another one equals, then the words under them: each adds 3 or the way from the last
    ordered = windows.withColumn(
        "s", F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<struct<h:bigint,p:int>>), sort_array(transform(h, (x, i) -> struct(x as h, i as p))))")
    )
    at = ordered.withColumn("at", F.expr("sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h or x.h = get(s, i + 1).h), x -> x.p))"))
    covered = "aggregate(at, struct(0L as n, -3 as last), (a, x) -> struct(a.n + least(3, x - a.last) as n, x as last), a -> a.n)"
    return at.select(*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def per_mille(df: DataFrame) -> DataFrame:
    share = lambda part, whole, times: F.expr(f"if({whole} = 0, 0L, ({times} * {part}) div {whole})")
    return df.withColumns(
        {
            "base_failed": F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words"),
            "word_length": share("word_chars", "n_words", 100),
            "symbols": share("n_symbols", "n_words", 1000),
            "dup_lines": share("n_dup_lines", "n_lines", 1000),
            "repeat_words": share("n_repeat_words", "n_words", 1000),
        }
    )


def bin_of(v: str) -> str:
    """SQL: the sketch bin of a whole number."""
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"cast({shift} * 32 + shiftright({v}, {shift}) as int)"


def value_of(b: str) -> str:
    """SQL: the least number in a bin."""
    shift = f"greatest({b} div 32 - 1, 0)"
    return f"shiftleft(cast({b} - {shift} * 32 as bigint), cast({shift} as int))"


def sketch(df: DataFrame, *keys: str) -> DataFrame:
    """Counts per key, measure and bin, over the documents that pass the base rule."""
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(bin_of(m)).alias("bin")) for m in MEASURES])).alias("x")
    return df.where("not base_failed").select(*keys, bins).groupBy(*keys, "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """One row per key: how many documents, and below and above what each measure is out."""
    by = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("docs", F.sum("n").over(by))
    at = {q: F.expr(value_of(f"min(case when 100 * upto >= {q} * docs then bin end)")).alias(f"q{q}") for q in (25, 50, 75, 99)}
    limits = ranked.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), *at.values())
    spread = REACH * (F.col("q75") - F.col("q25"))
    columns = []
    for name, (above, below) in MEASURES.items():
        here = F.col("measure") == name
        high = F.col("q75") + spread if below is not None else 2 * F.col("q99") - F.col("q50")
        columns.append(F.max(F.when(here, high + above)).alias(f"{name}_most"))
        if below is not None:
            columns.append(F.max(F.when(here, F.col("q25") - spread - below)).alias(f"{name}_least"))
    return limits.groupBy(*keys).agg(F.max("docs").alias("docs"), *columns)


def limit_names() -> list[str]:
    return [f"{m}_{side}" for m, (_, below) in MEASURES.items() for side in (["most", "least"] if below is not None else ["most"])]


def leaning(own: str, wider: str, docs: str) -> str:
    """SQL: the limit of a group of so many documents, from its own fence and the limit of the wider group."""
    return f"cast(floor(({docs} * {own} + {WEIGHT} * {wider}) / ({docs} + {WEIGHT})) as bigint)"


def adaptive_fences(df: DataFrame) -> DataFrame:
    """The limits that hold for each (lang, source)."""
    group = sketch(df, "lang", "source")
    lang = merge(group, "lang")
    overall = fences(merge(lang)).select(F.struct(*limit_names()).alias("a")).scalar()
    wider = fences(lang, "lang").withColumn("a", overall)
    wider = wider.select("lang", *[F.expr(leaning(c, f"a.{c}", "docs")).alias(c) for c in limit_names()]).alias("l")
    own = fences(group, "lang", "source").alias("g")
    return own.join(wider, F.col("g.lang").eqNullSafe(F.col("l.lang"))).select("g.lang", "g.source", *[F.expr(leaning(f"g.{c}", f"l.{c}", "g.docs")).alias(c) for c in limit_names()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """The measures with ``reason`` and ``kept``; with ``carry`` the whole row as well.

    The limits are stored before the join, so that their size is known and texts are not exchanged for a small table.
    Texts are not stored: with ``carry`` they are measured again where they are read.
    """
    columns = (docs, id_col, text_col, lang_col, source_col)
    rows = per_mille(store(measured(*columns, carry=False), "measures"))
    limits = store(adaptive_fences(rows), "fences").alias("f")
    if carry:
        rows = per_mille(measured(*columns, carry=True))
    joined = rows.alias("d").join(limits, F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    out = []
    for name, (_, below) in MEASURES.items():
        out.append(F.when(F.col(f"d.{name}") > F.col(f"f.{name}_most"), F.lit(name)))
        if below is not None:
            out.append(F.when(F.col(f"d.{name}") < F.col(f"f.{name}_least"), F.lit(name)))
    reason = F.when(F.col("d.base_failed"), F.lit("base")).otherwise(F.coalesce(*out))
    return joined.select("d.*", reason.alias("reason")).withColumn("kept", F.col("reason").isNull())


def quality_decisions(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the first failed rule (``reason``) for every document.

    Null and empty texts have no words and fail the base rule.  A null language or source is a value of its
    own.  Repeated ids are judged row by row, equal rows alike.  No rows give no rows.  Other columns are not read.
    """
    return judge(docs, **columns).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason"
    )


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns as they are."""
    return judge(docs, carry=True, **columns).where("kept").select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return quality_decisions(documents(spark, folder))


def _sql() -> str:
    def bin_sql(v: str) -> str:
        return f"(greatest(length(bin({v})) - 6, 0) * 32 + ({v} >> greatest(length(bin({v})) - 6, 0)::bigint))"

    def value_sql(b: str) -> str:
        return f"((({b} - greatest({b} // 32 - 1, 0) * 32)::bigint) << greatest({b} // 32 - 1, 0)::bigint)"

    space = "translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
    picks, tests = [], []
    for name, (_, below) in MEASURES.items():
        for side, sign in (("most", ">"), ("least", "<")) if below is not None else (("most", ">"),):
            where = f"measure = '{name}'"
            picks.append(f"max({side}) filter ({where}) as {name}_{side}")
            tests.append(f"when {name} {sign} {name}_{side} then '{name}'")
    slack = " ".join(f"when '{m}' then {a}" for m, (a, _) in MEASURES.items())
    slack_low = " ".join(f"when '{m}' then {b}" for m, (_, b) in MEASURES.items() if b is not None)
    middle = ", ".join(f"'{m}'" for m, (_, b) in MEASURES.items() if b is not None)
    names = limit_names()

    def level(n: str, keys: str) -> str:
        by = f"partition by {keys}, measure" if keys else "partition by measure"
        group = f"{keys}, measure" if keys else "measure"
        quantiles = ", ".join(f"{value_sql(f'min(bin) filter (100 * upto >= {q} * docs)')} as q{q}" for q in (25, 50, 75, 99))
        return f"""
{n}_s as (select {group}, bin, count(*) as n from bins group by {group}, bin),
{n}_r as (select *, sum(n) over ({by} order by bin) as upto, sum(n) over ({by}) as docs from {n}_s),
{n}_q as (select {group}, max(docs) as docs, {quantiles} from {n}_r group by {group}),
{n}_l as (select *, case when measure in ({middle}) then q75 + {REACH} * (q75 - q25) else 2 * q99 - q50 end + case measure {slack} end as most,
  q25 - {REACH} * (q75 - q25) - case measure {slack_low} end as least from {n}_q),
{n}_f as (select {keys + ", " if keys else ""}max(docs) as docs, {", ".join(picks)} from {n}_l {"group by " + keys if keys else ""}),"""

    leant = ", ".join(f"{leaning(f'l.{c}', f'a.{c}', 'l.docs')} as {c}" for c in names)
    chosen = ", ".join(f"{leaning(f'g.{c}', f'w.{c}', 'g.docs')} as {c}" for c in names)
    bins = " union all ".join(f"select lang, source, '{m}' as measure, {bin_sql(m)} as bin from m where not base_failed" for m in MEASURES)
    return f"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
p as (select *, [x for x in regexp_split_to_array(t, '[ \\t-\\r]+') if x <> ''] as w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^ \\t-\\r]')] as l from d),
g3 as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from p)),
c3 as (select r, i, count(*) over (partition by r, g) as c from g3),
rep as (select r, sum(least(3, coalesce(nxt - i, 3))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from c3 where c > 1) group by r),
m0 as (select p.r, doc_id, lang, source, len(w) as n_words, length({space}) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
  len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from p left join rep on rep.r = p.r),
m as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  case when n_words = 0 then 0 else 100 * word_chars // n_words end as word_length, case when n_words = 0 then 0 else 1000 * n_symbols // n_words end as symbols,
  case when n_lines = 0 then 0 else 1000 * n_dup_lines // n_lines end as dup_lines, case when n_words = 0 then 0 else 1000 * n_repeat_words // n_words end as repeat_words from m0),
bins as ({bins}),
{level("g", "lang, source")}
{level("l", "lang")}
{level("a", "")}
w as (select l.lang, {leant} from l_f l, a_f a),
f as (select g.lang, g.source, {chosen} from g_f g join w on g.lang is not distinct from w.lang),
j as (select m.*, case when base_failed then 'base' {" ".join(tests)} end as reason from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason is null as kept, reason from j
"""


SQL = _sql()
