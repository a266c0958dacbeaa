"""Spelling variants: words one edit apart, found among the sorted permuterm rotations of all words.

A word is marked with a terminator and turned round: all rotations of ``word$`` name the same word, and each edit stands at
the end of one of them.  Words that differ in one character, replaced, inserted or deleted, share what precedes it:

- ``a c b`` and ``a d b`` are ``b$a c`` and ``b$a d`` in the rotation that ends with the edited character: the same prefix
  ``b$a``, with another last character;
- ``a b`` is ``b$a`` as a whole rotation, which is the prefix of ``b$a c``, that of ``a c b``.

So every word gives its whole rotations and, for each of its characters, the rotation without that character at its end.  These
prefixes are sorted, and equal ones are a group: at most one word with the whole rotation, and one word for each
skipped character.  A group is never larger than the alphabet, however frequent its words are.  In a scan of a group every
member gets the number of its neighbours there and the most frequent of them (the first or the second of the group), so no pairs are
made.  A neighbour by replacement is met in one group only.  A character inserted into a run of the same character is met once for each
place in the run; only the first of the run counts.

Words carry numbers in code-point order, so that ties between frequencies are decided by the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.shared import documents, store

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPOIL = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
TERMINATOR = "$"
# Longer prefixes are sorted by their digests, since a word has as many rotations as characters.
LONG_PREFIX = 64


def spoilt_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = SPOIL) -> DataFrame:
    """word, n: the letter runs of all texts with their occurrences, some with one character less.

    Runs are lower-cased (A-Z only).  Where ``spoil`` divides the CRC-32 of ``<id>:<run>``, the run loses the character that the CRC points
    at; in rows without an id none does.
    """
    runs = docs.select(F.col(f"`{id_col}`").cast("string").alias("of"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    lowered = runs.select("of", F.translate("run", UPPER, LOWER).alias("run"))
    coded = lowered.select("run", F.crc32(F.concat("of", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return coded.select(F.when(F.col("h") % spoil == 0, less).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """id, word, n with ids in code-point order: stored at once, since ids follow the partitions of the sort."""
    return store(words.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def rotations(vocabulary: DataFrame) -> DataFrame:
    """prefix, id, n, role: whole rotations (role 0) and those that skip their last character (2, or 1 inside a run of it)."""
    at = vocabulary.select("id", "word", "n", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))

    def turned(begin: Column) -> Column:
        text = F.concat(F.substring(F.col("word"), begin, F.length("word")), F.lit(TERMINATOR), F.substring(F.col("word"), F.lit(1), F.col("i") - 1))
        return F.when(F.length(text) > LONG_PREFIX, F.concat(F.length(text).cast("string"), F.sha2(text.cast("binary"), 256))).otherwise(text)

    here = F.substring(F.col("word"), F.col("i"), F.lit(1))
    before = F.substring(F.col("word"), F.col("i") - 1, F.lit(1))
    role = F.when((F.col("i") > 1) & (here == before), 1).otherwise(2)
    whole = at.select(turned(F.col("i")).alias("prefix"), "id", "n", F.lit(0).alias("role"))
    skipping = at.where(F.col("i") <= F.length("word")).select(turned(F.col("i") + 1).alias("prefix"), "id", "n", role.alias("role"))
    return whole.union(skipping)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, nearest (minus its count, its id): for every word that has a neighbour, how many and the most frequent one."""
    rows = rotations(vocabulary).select("prefix", "id", "role", F.struct((-F.col("n")).alias("less"), "id").alias("me"))
    group = Window.partitionBy("prefix")
    sort = group.orderBy((F.col("role") == 0).cast("int"), "me")
    every = sort.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skips, first_of_run = F.col("role") > 0, F.col("role") == 2
    scanned = rows.select(
        "id",
        "role",
        F.row_number().over(sort).alias("rank"),
        F.first("me").over(every).alias("first"),
        F.nth_value("me", 2).over(every).alias("second"),
        F.sum(skips.cast("int")).over(group).alias("skipping"),
        F.sum(first_of_run.cast("int")).over(group).alias("longer"),
        F.min(F.when(first_of_run, F.col("me"))).over(group).alias("best_longer"),
        F.max(F.when(F.col("role") == 0, F.col("me"))).over(group).alias("shorter"),
    )
    near = F.when(F.col("role") == 0, F.col("longer")).otherwise(F.col("skipping") - 1 + (first_of_run & F.col("shorter").isNotNull()).cast("int"))
    other = F.when(F.col("rank") > 1, F.col("first")).when(F.col("skipping") > 1, F.col("second"))
    best = F.when(F.col("role") == 0, F.col("best_longer")).otherwise(F.least(other, F.when(first_of_run, F.col("shorter"))))
    return scanned.select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("nearest"))


def followed(forms: DataFrame) -> DataFrame:
    """id, root: where the forms (id, form) of a word lead in the end.  Every form is TIMES as frequent, so paths are short and have no rings."""
    at = store(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = store(at.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word with at least ``least_length`` code points and ``least_count`` occurrences.

    ``words`` has a word and its number ``n``; several rows of a word add up.  ``n_near`` counts the words that differ by exactly one inserted,
    deleted or replaced code point.  The most frequent of them (ties: the first in code-point order) is the ``form`` if it is at
    least ``times`` as frequent; ``root`` is the end of the path over forms, the word itself if it has none.  Words are letters: none may hold
    the terminator.  Null words are left out, no rows give no rows.
    """
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    vocabulary = numbered(counted)
    near = store(neighbours(vocabulary), "near")
    judged = vocabulary.select("id", "n").join(near, "id").select("id", "n_near", F.when(-F.col("nearest.less") >= times * F.col("n"), F.col("nearest.id")).alias("form"))
    roots = followed(judged.where("form is not null"))
    named = lambda column: vocabulary.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word"), F.col("n").alias(f"{column}_n"))
    told = judged.join(roots, "id", "left").join(named("form"), "form", "left").join(named("root"), "root", "left").drop("root_n")
    return vocabulary.join(told, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def document_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of whole texts.  Null and empty texts have no words, rows with the same id are separate texts of that id, and other columns are not read."""
    return spelling_variants(spoilt_words(docs, id_col, text_col))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return document_variants(documents(spark, folder))


SQL = f"""
with recursive t as materialized (select list(c order by i) as t from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c
  from (select unnest(range(256)) as i))),
r as (select doc_id, translate(x, '{UPPER}', '{LOWER}') as run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as x from documents) group by 1, 2),
b as (select run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)) as b from r),
h as (select run, k, case when b is null then 1 else xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) end as h from b, t),
w as materialized (select case when h % {SPOIL} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(k)::bigint as n
  from h group by 1 having length(word) >= {LEAST_LENGTH} and sum(k) >= {LEAST_COUNT}),
p as (select word, i, substr(word, 1, i - 1) as l, substr(word, i + 1) as r from (select word, unnest(range(1, length(word) + 1)) as i from w)),
e as materialized (select a.word, b.word as other from p a join p b on a.i = b.i and a.l = b.l and a.r = b.r and a.word <> b.word
  union select p.word, w.word from p join w on w.word = p.l || p.r union select w.word, p.word from p join w on w.word = p.l || p.r),
f as materialized (select e.word, count(*) as n_near, arg_min(e.other, (-o.n, e.other)) as best, max(o.n) as best_n, any_value(m.n) as n
  from e join w o on o.word = e.other join w m on m.word = e.word group by e.word),
g as materialized (select word, n_near, case when best_n >= {TIMES} * n then best end as form, case when best_n >= {TIMES} * n then best_n end as form_n from f),
x as (select word, form as root from g where form is not null union all select x.word, g.form from x join g on g.word = x.root where g.form is not null),
z as (select word, arg_max(root, w2.n) as root from (select x.word, x.root, w.n from x join w on w.word = x.root) w2 group by word)
select w.word, g.form, coalesce(z.root, w.word) as root, w.n, coalesce(g.n_near, 0) as n_near, g.form_n from w left join g using (word) left join z using (word)
"""
