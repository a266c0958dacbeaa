"""Review sentiment, keywords and question routing.

Tokens are never moved: they are taken where the text is, and only counts or scores
per review or category are exchanged.  A text itself moves at most to its product's category.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators import valence
from basketlens.operators.valence import sentiment_label  # noqa: F401
from basketlens.plans.stage import write_stage

# Parts in which phrases are counted one after the other, so that the exchanges of one part are on disk at a time.
PASSES = 3

_KEYWORD = r"([\p{L}\p{N}_][\p{L}\p{N}_']+)"


def review_sentiment(
    reviews: DataFrame,
    lexicon: DataFrame,
    *,
    id_col: str = "review_id",
    text_col: str = "review_text",
    keep: tuple[str, ...] = ("product_id",),
    negations: list[str] | None = None,
    boosters: dict[str, float] | None = None,
) -> DataFrame:
    """Valence score and label per review by boosters and negations alone; :func:`valence.valence_scores` has all rules."""
    rules = valence.Rules(K.NEGATIONS if negations is None else negations, K.BOOSTERS if boosters is None else boosters)
    return valence.valence_scores(reviews, lexicon, rules, id_col=id_col, text_col=text_col, keep=keep)


def with_sentiment(reviews: DataFrame, scored: DataFrame, id_col: str = "review_id") -> DataFrame:
    """The full review rows with their label."""
    return reviews.join(scored.select(id_col, "compound", "sentiment"), id_col, "left")


def wordlist_sentiment(
    reviews: DataFrame,
    *,
    text_col: str = "review_text",
    positive: list[str] | None = None,
    negative: list[str] | None = None,
) -> DataFrame:
    """Label by listed words found as substrings; each word counts once per text."""
    text = F.lower(F.coalesce(text_col, F.lit("")))

    def hits(words: list[str]) -> Column:
        return sum((text.contains(w).cast("int") for w in words), F.lit(0))

    score = hits(positive or K.POSITIVE_WORDS) - hits(negative or K.NEGATIVE_WORDS)
    label = S.first_match([(F.col("score") > 0, "Positive"), (F.col("score") < 0, "Negative")], "Neutral")
    return reviews.withColumn("score", score).withColumn("sentiment", label)


def _clean_word(raw: Column) -> Column:
    """Without a possessive ending; null for a number or for nothing."""
    word = F.when(raw.endswith("'s"), F.left(raw, F.length(raw) - 2)).otherwise(raw)
    # a first letter a-z settles most words without a pattern
    return F.when(F.ascii(word).between(97, 122) | ~word.rlike(r"^\p{N}*$"), word)


def _clean_again(word: Column) -> Column:
    """``_clean_word`` of a word that is clean already: only a second possessive ending is left to see."""
    return F.when(word.endswith("'s"), _clean_word(word)).otherwise(word)


def _category_words(reviews: DataFrame, products: DataFrame, text_col: str) -> DataFrame:
    """category, w: the words of each text as they stand in it.

    The category comes to the text before its words are taken, so each task counts within the few categories and sends an entry
    once for each, not once per product.
    """
    category = products.select("product_id", "category").dropna().hint("shuffle_hash")
    texts = reviews.select("product_id", text_col).join(category, "product_id")
    return texts.select("category", F.regexp_extract_all(F.lower(text_col), F.lit(_KEYWORD)).alias("w"))


def _without(counts: DataFrame, stopwords: DataFrame, column: str) -> DataFrame:
    return counts.join(stopwords.select(F.col("token").alias(column)), column, "left_anti")


def _word_counts(reviews: DataFrame, products: DataFrame, stopwords: DataFrame, text_col: str) -> DataFrame:
    """category, token, n."""
    words = _category_words(reviews, products, text_col)
    # the outer form of explode, whose nulls dropna leaves out: the plain one has the words taken once more, as a filter where the texts are read
    entries = words.select("category", F.explode_outer("w").alias("raw")).select("category", _clean_word(F.col("raw")).alias("token"))
    return _without(entries.dropna().groupBy("category", "token").agg(F.count("*").alias("n")), stopwords, "token")


def _pack_followers(most: int = 1 << 21):
    """category, w to category, word, entries, counted in pieces of about ``most`` words, as numbers of the piece's own vocabulary.

    Entries are the word's count and the words that follow it, each with its count if above one: ``"=4 life=2 pack"``.  Words hold no
    blank or equals sign.
    """

    def lists(piece: pa.RecordBatch, lengths: np.ndarray) -> pa.RecordBatch:
        words = piece.column("w").flatten().dictionary_encode()
        categories = piece.column("category").dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        size = len(words.dictionary) + 1
        follower = np.append(code[1:] + 1, 0)  # 0 where a text ends
        follower[np.cumsum(lengths)[lengths > 0] - 1] = 0
        home = np.repeat(categories.indices.to_numpy().astype(np.int64), lengths) * size + code
        found, n = np.unique(home * size + follower, return_counts=True)
        home, follower = np.divmod(found, size)
        starts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        pairs = np.flatnonzero(follower > 0)
        times = n[pairs]
        many = np.flatnonzero(times > 1)
        nexts = words.dictionary.take(pa.array(follower[pairs] - 1))
        repeated = pc.binary_join_element_wise(nexts.take(pa.array(many)), pa.array(times[many]).cast(pa.string()), "=")
        own = pc.binary_join_element_wise("", pa.array(np.add.reduceat(n, starts)).cast(pa.string()), "=")
        # each list begins with the word's own count
        at = np.searchsorted(pairs, starts)
        order = np.arange(len(pairs)) + len(own)
        order[many] = np.arange(len(many)) + len(own) + len(pairs)
        order = pa.array(np.insert(order, at, np.arange(len(own))))
        offsets = pa.array(np.append(at, len(pairs)) + np.arange(len(starts) + 1), pa.int32())
        entries = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays([own, nexts, repeated]).take(order)), " ")
        category, word = np.divmod(home[starts], size)
        return pa.RecordBatch.from_arrays(
            [categories.dictionary.take(pa.array(category)), words.dictionary.take(pa.array(word)), entries], ["category", "word", "entries"]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy().astype(np.int64)
            ends = np.cumsum(lengths)
            begin, before = 0, 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
                if ends[end - 1] > before:
                    yield lists(batch.slice(begin, end - begin), lengths[begin:end])
                begin, before = end, ends[end - 1]

    return pack


def _followers(reviews: DataFrame, products: DataFrame, stopwords: DataFrame, text_col: str) -> DataFrame:
    """category, word, entries (see ``_pack_followers``), in one pass over the texts: a word has a row per batch of texts."""
    words = _category_words(reviews, products, text_col)
    # numbers are dropped before neighbours are looked at
    kept = words.select("category", F.filter(F.transform("w", _clean_word), lambda w: w.isNotNull()).alias("w"))
    kind = kept.schema["category"].dataType.simpleString()
    lists = kept.mapInArrow(_pack_followers(), f"category {kind}, word string, entries string")
    # a second possessive ending falls from words of pairs alone, so their pairs have another home than their count
    own = F.substring_index("entries", " ", 1)
    rest = F.concat(F.lit("=0"), F.substring(F.col("entries"), F.length(own) + 1, F.length("entries")))
    turned = F.array(F.struct("word", own.alias("entries")), F.struct(_clean_again(F.col("word")).alias("word"), rest.alias("entries")))
    parts = F.when(F.col("word").endswith("'s"), turned).otherwise(F.array(F.struct("word", "entries")))
    homes = lists.select("category", F.explode_outer(parts).alias("e")).select("category", "e.*")
    # not dropna, whose filter a join doesn't see: it adds its own, and then the exchange below is not shared
    return _without(homes.where(F.col("category").isNotNull() & F.col("word").isNotNull()), stopwords, "word").select("category", "word", "entries")


def _counted_pairs(followers: DataFrame, stopwords: DataFrame) -> DataFrame:
    """category, word0, word1, n, first: pairs of neighbouring words with the count of the first one; and each word's count as n, with word1 null.

    A word goes to its home with all that follow it in one text, so the exchange holds little more than each pair's second word;
    there the pairs are counted and meet the count of their first word unsent.
    """
    homes = followers.repartition("category", "word")
    own = F.substring_index("entries", " ", 1)
    counts = homes.groupBy("category", "word").agg(F.sum(F.substring(own, 2, 20).cast("long")).alias("first")).where(F.col("first") > 0)
    entry = F.explode_outer(F.split("entries", " ")).alias("e")
    entries = homes.join(counts, ["category", "word"]).select("category", F.col("word").alias("word0"), "first", entry)
    several = F.col("e").contains("=")
    raw = F.when(several, F.substring_index("e", "=", 1)).otherwise(F.col("e"))
    times = F.when(several, F.substring_index("e", "=", -1).cast("long")).otherwise(1)
    pairs = entries.select("category", "word0", raw.alias("raw"), "first", times.alias("n")).where(F.col("n") > 0)
    # the word's own count has no second word; a number is none
    word1 = F.when(F.col("raw") != "", _clean_again(F.col("raw")))
    pairs = pairs.select("category", "word0", word1.alias("word1"), "first", "n").where((F.col("raw") == "") | word1.isNotNull())
    pairs = pairs.groupBy("category", "word0", "word1", "first").agg(F.sum("n").alias("n"))
    return _without(pairs, stopwords, "word1").select("category", "word0", "word1", "n", "first")


def keyword_counts(
    reviews: DataFrame,
    products: DataFrame,
    stopwords: DataFrame,
    text_col: str = "review_text",
    phrases: DataFrame | None = None,
) -> DataFrame:
    """Word counts per category: lower case, no numbers, no stopwords, plurals merged.

    With ``phrases`` (see ``category_phrases``) these pairs are entries too, and their
    words count only where they stand outside a pair.
    """
    counts = _word_counts(reviews, products, stopwords, text_col)
    if phrases is not None:
        inside = phrases.select("category", F.explode(F.split("token", " ")).alias("token"), (-F.col("n")).alias("n"))
        counts = counts.unionByName(inside).groupBy("category", "token").agg(F.sum("n").alias("n"))
    # "rings" counts as "ring" where the category also has "ring": look at both
    # forms in one group instead of joining the counts with themselves
    plural = F.col("token").endswith("s") & ~F.col("token").endswith("ss") & (F.length("token") > 1)
    stem = F.when(plural, F.left(F.col("token"), F.length("token") - 1)).otherwise(F.col("token"))
    merged = (
        counts.withColumn("stem", stem)
        .groupBy("category", "stem")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("token") == F.col("stem"), F.col("n"))).alias("singular"),
        )
        .select(
            "category",
            F.when(F.col("singular").isNull(), F.concat("stem", F.lit("s"))).otherwise(F.col("stem")).alias("token"),
            "n",
        )
    )
    if phrases is None:
        return merged
    return merged.filter(F.col("n") > 0).unionByName(phrases.select("category", "token", "n"))


def _log_likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's ratio: how much likelier the pair is than two independent words."""

    def fit(k: Column, n: Column, p: Column) -> Column:
        return k * F.log(F.greatest(p, F.lit(1e-10))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-10)))

    elsewhere, rest = second - both, total - first
    apart = fit(both, first, second / total) + fit(elsewhere, rest, second / total)
    together = fit(both, first, both / first) + fit(elsewhere, rest, elsewhere / rest)
    return F.when((total > first) & (total > second), -2 * (apart - together)).otherwise(0.0)


def category_phrases(
    reviews: DataFrame,
    products: DataFrame,
    stopwords: DataFrame,
    *,
    text_col: str = "review_text",
    cutoff: float = K.COLLOCATION_CUTOFF,
) -> DataFrame:
    """Pairs of neighbouring words that belong together, per category.

    A pair counts when its log-likelihood ratio is above ``cutoff``.  Pairs are
    taken within one review, from the words left after numbers are dropped; a pair
    with a stopword is left out.
    """
    # what the texts were exchanged in is gone before the pairs are, and each part's exchange before the next part's
    followers = write_stage(_followers(reviews, products, stopwords, text_col), "followers", clean_up=True, compression="zstd")

    def part(df: DataFrame, column: str, i: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(column), F.lit(PASSES)) == i)

    halves = [write_stage(_counted_pairs(part(followers, "word", i), stopwords), "counted-pairs", clean_up=True, compression="zstd") for i in range(PASSES)]
    counted = reduce(DataFrame.unionAll, halves)
    words = counted.where(F.col("word1").isNull())
    # one row per category comes to the pairs, which would else be gathered by category
    totals = F.broadcast(words.groupBy("category").agg(F.sum("n").alias("total")))
    # one row per distinct word
    second = words.select("category", F.col("word0").alias("word1"), F.col("n").alias("second"))
    score = _log_likelihood(*[F.col(c).cast("double") for c in ("n", "first", "second", "total")])

    def scored(i: int) -> DataFrame:
        return (
            part(counted.where(F.col("word1").isNotNull()), "word1", i)
            .join(part(second, "word1", i), ["category", "word1"])
            .join(totals, "category")
            .withColumn("score", score)
            .filter(F.col("score") > cutoff)
            .select("category", F.concat_ws(" ", "word0", "word1").alias("token"), "n", "score")
        )

    # the last part is left to whoever reads the result
    return reduce(DataFrame.unionAll, [*[write_stage(scored(i), "phrases", clean_up=True) for i in range(PASSES - 1)], scored(PASSES - 1)])


def category_keywords(
    reviews: DataFrame,
    products: DataFrame,
    stopwords: DataFrame,
    *,
    text_col: str = "review_text",
    n: int = K.KEYWORDS_PER_CATEGORY,
    phrases: DataFrame | None = None,
) -> DataFrame:
    """The n most frequent words of each category, weighted by the most frequent one.

    With ``phrases`` the pairs that belong together are ranked among the words.

    The rank limit is applied before the exchange as well, so a category with a
    huge vocabulary sends n rows per task.
    """
    counts = keyword_counts(reviews, products, stopwords, text_col, phrases)
    best_first = W.partitionBy("category").orderBy(F.desc("n"), "token")
    top = counts.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= n)
    most = F.max("n").over(W.partitionBy("category"))
    return top.withColumn("weight", F.col("n") / most).select("category", "rank", "token", "n", "weight")


def question_intent(text: Column, rules=K.INTENTS) -> Column:
    """First keyword family with a substring match; "help" without one."""
    lowered = F.lower(text)
    return S.first_match([(S.contains_any(lowered, words), name) for name, words in rules], K.INTENT_HELP)


def route_questions(questions: DataFrame, text_col: str, rules=K.INTENTS) -> DataFrame:
    return questions.withColumn("intent", F.coalesce(question_intent(F.col(text_col), rules), F.lit(K.INTENT_HELP)))


def answer_questions(questions: DataFrame, text_col: str, answers: DataFrame, rules=K.INTENTS) -> DataFrame:
    """Every question with its intent and the answer text, which has one row per intent."""
    return route_questions(questions, text_col, rules).join(answers, "intent", "left")
