"""Valence of texts by word rules: an ordered reading of each text around the words of a lexicon.

Words are taken where the text is read, each with the three words before it and the two after it; only the few that the lexicon
holds go on, so the rules look at the neighbours of those alone.  In this order, a word's valence

1. grows with capitals, if the word is written in them and the text as a whole is not;
2. is strengthened or weakened by boosters among the three words before it, the less the farther, and flipped by negations there;
   an intensified negation ("never so") strengthens instead, and an affirmed one ("without doubt") changes nothing;
3. is flipped by a superlative of little ("least"), unless that is itself turned ("at least");
4. is replaced by that of the longest idiom which holds the word;
5. is damped before the first contrast word of the text and amplified after it.

The sum over a text moves away from zero with its exclamation and question marks and is then brought between -1 and 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S

# ASCII punctuation at either end; a run is only looked at from its beginning
_AROUND = r"^\p{Punct}++|(?<!\p{Punct})\p{Punct}++\z"
BEFORE, AFTER = 3, 2


@dataclass(frozen=True)
class Rules:
    """The words and factors of the rules; an empty list or a zero leaves a rule out."""

    negations: Sequence[str] = field(default_factory=lambda: K.NEGATIONS)
    boosters: Mapping[str, float] = field(default_factory=lambda: K.BOOSTERS)
    damping: Sequence[float] = field(default_factory=lambda: K.BOOST_DAMPING)
    negation: float = K.NEGATION_FACTOR
    # words that hold this are negations as well
    negation_ending: str = ""
    capitals: float = 0.0
    intensified: tuple[str, Sequence[str], float] | None = None
    affirmed: tuple[str, Sequence[str]] | None = None
    least: tuple[str, Sequence[str]] | None = None
    contrast: Sequence[str] = ()
    contrast_factors: tuple[float, float] = (0.5, 1.5)
    # per exclamation mark, and so many at most; per question mark from two on, and the value beyond three
    exclamation: tuple[float, int] = (0.0, 0)
    question: tuple[float, float] = (0.0, 0.0)


SIMPLE = Rules()
# The amounts of the common rule set for short English texts.
FULL = Rules(
    negation_ending="n't",
    capitals=0.733,
    intensified=("never", ("so", "this"), 1.5),
    affirmed=("without", ("doubt",)),
    least=("least", ("at", "very")),
    contrast=("but",),
    exclamation=(0.292, 4),
    question=(0.18, 0.96),
)


def _is_punctuation(character: Column) -> Column:
    code = F.ascii(character)
    return code.between(33, 47) | code.between(58, 64) | code.between(91, 96) | code.between(123, 126)


def bare(word: Column) -> Column:
    """Without punctuation around it, unless next to nothing would be left: ":)" stays a word."""
    stripped = F.regexp_replace(word, _AROUND, "")
    return F.when(F.length(stripped) > 2, stripped).otherwise(word)


def bare_seldom(word: Column) -> Column:
    """The same for a column of all words: a pattern costs more than a look at both ends, so only words that begin or end with punctuation are trimmed."""
    return F.when(_is_punctuation(word) | _is_punctuation(F.substring(word, -1, 1)), bare(word)).otherwise(word)


def _in_capitals(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _loud(word: Column) -> Column:
    """``_in_capitals`` for a column of all words: a first letter a-z settles most of them."""
    return ~F.ascii(word).between(97, 122) & _in_capitals(word)


def _neighbours(words: Column, after: int) -> Column:
    """Each word with those around it, null beyond the ends; ``w`` is the word, ``b1`` the one before it, ``n1`` the next."""
    nothing = F.lit(None).cast("string")
    columns = {"w": words}
    columns |= {f"b{n}": F.concat(F.array(*[nothing] * n), words) for n in range(1, BEFORE + 1)}
    columns |= {f"n{n}": F.concat(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), F.array(nothing)) for n in range(1, after + 1)}
    return F.arrays_zip(*[c.alias(name) for name, c in columns.items()])


def _hits(reviews: DataFrame, lexicon: DataFrame, keys: list[str], text: Column, rules: Rules, idioms: DataFrame | None) -> DataFrame:
    """The words of the lexicon, with their neighbours and what the rules ask of the whole text."""
    words = reviews.select(*keys, F.split(text if rules.capitals else F.lower(text), r"\s+").alias("words"))
    shape: list[str] = []
    if rules.capitals:
        words = words.withColumn("mixed", ~F.forall("words", _loud) & F.exists("words", _loud))
        shape.append("mixed")
    if rules.contrast:

        def turns(word: Column) -> Column:
            held = S.contains_any(word, list(rules.contrast))  # settles most words
            return held & bare_seldom(word).isin(list(rules.contrast))

        words = words.withColumn("turn", F.array_position(F.transform("words", lambda w: turns(F.lower(w))), True))
        shape.append("turn")
    around = _neighbours(F.col("words"), AFTER if idioms is not None else 0)
    # never empty; the outer form keeps the words from being taken once more for a filter on that
    found = F.posexplode_outer(around).alias("at", "e") if rules.contrast else F.explode_outer(around).alias("e")
    entries = words.select(*keys, *shape, found)
    columns = [c for c in entries.columns if c != "e"]
    entries = entries.select(*columns, "e.*")
    # never null, so that the join asks for no second look at every word
    key = F.coalesce(bare_seldom(F.lower("w") if rules.capitals else F.col("w")), F.lit(""))
    held = entries.withColumn("key", key).join(lexicon.select(F.col("token").alias("key"), "valence"), "key")
    near = [c for c in held.columns if c[0] in "bn" and c[1:].isdigit()]
    return held.withColumns({f"low_{c}": bare_seldom(F.lower(c)) for c in near})


def _value(rules: Rules, idioms: DataFrame | None) -> Column:
    """A hit's valence after all rules of its neighbourhood."""
    before = [F.col(f"low_b{n}") for n in range(1, BEFORE + 1)]
    valence = F.col("valence")
    sign = F.when(valence < 0, -1.0).otherwise(1.0)
    mixed = F.col("mixed") if rules.capitals else F.lit(False)
    value = valence

    def capital(word: Column) -> Column:
        return mixed & _in_capitals(word)  # punctuation around it has no case

    if rules.capitals:
        value = value + F.when(capital(F.col("w")), sign * rules.capitals).otherwise(0.0)

    def negates(word: Column) -> Column:
        listed = word.isin(list(rules.negations)) if rules.negations else F.lit(False)
        return F.coalesce(listed | (word.contains(rules.negation_ending) if rules.negation_ending else F.lit(False)), F.lit(False))

    for n, word in enumerate(before, start=1):
        if rules.boosters:
            step = S.first_match([(word == b, amount) for b, amount in rules.boosters.items()], 0.0)
            if rules.capitals:
                step = step + F.when((step != 0) & capital(F.col(f"b{n}")), rules.capitals).otherwise(0.0)
            value = value + sign * step * rules.damping[n - 1]
        between = before[: n - 1]

        def followed(what, between=between, word=word) -> Column:
            hit = F.lit(False)
            for other in between:
                hit = hit | F.coalesce(other.isin(list(what[1])), F.lit(False))
            return F.coalesce(word == what[0], F.lit(False)) & hit

        flips = [(negates(word), rules.negation)]
        if rules.affirmed and between:
            flips.insert(0, (followed(rules.affirmed), 1.0))
        if rules.intensified and between:
            flips.insert(0, (followed(rules.intensified), rules.intensified[2]))
        value = value * S.first_match(flips, 1.0)
    if rules.least:
        turned = F.coalesce(before[1].isin(list(rules.least[1])), F.lit(False))
        value = value * F.when((before[0] == rules.least[0]) & ~turned, rules.negation).otherwise(1.0)
    if idioms is not None:
        known = idioms.agg(F.map_from_entries(F.collect_list(F.struct("phrase", "valence"))).alias("m")).scalar()
        row = [*reversed(before), F.col("key"), *[F.col(f"low_n{n}") for n in range(1, AFTER + 1)]]
        spans = [(i, j) for i in range(BEFORE + 1) for j in range(BEFORE, len(row)) if 2 <= j - i + 1 <= 4]
        found = []
        for i, j in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            phrase = F.concat(row[i], *[x for w in row[i + 1 : j + 1] for x in (F.lit(" "), w)])  # null beyond the ends
            found.append(F.try_element_at(known, phrase))
        value = F.coalesce(*found, value)
    if rules.contrast:
        place = F.col("at") + 1
        damped, amplified = rules.contrast_factors
        value = value * F.when((F.col("turn") > 0) & (place < F.col("turn")), damped).when((F.col("turn") > 0) & (place > F.col("turn")), amplified).otherwise(1.0)
    return value


def _marks(text: Column, rules: Rules) -> Column:
    """What exclamation and question marks add to the size of a sum."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    each, most = rules.exclamation
    step, beyond = rules.question
    asked = count("?")
    return F.least(count("!"), F.lit(most)) * each + F.when(asked > 3, beyond).when(asked > 1, asked * step).otherwise(0.0)


def sentiment_label(compound: Column) -> Column:
    return S.first_match([(compound >= K.COMPOUND_CUTOFF, "Positive"), (compound <= -K.COMPOUND_CUTOFF, "Negative")], "Neutral")


def valence_scores(
    reviews: DataFrame,
    lexicon: DataFrame,
    rules: Rules = FULL,
    idioms: DataFrame | None = None,
    *,
    id_col: str = "review_id",
    text_col: str = "review_text",
    keep: tuple[str, ...] = ("product_id",),
) -> DataFrame:
    """id, kept columns, compound and sentiment of each review.

    ``lexicon`` is (token, valence) in lower case; tokens that are boosters or negations as well count as both.  ``idioms`` is (phrase,
    valence), phrases of two to four words, some hundred of them at most.  The sum s becomes s / sqrt(s*s + 15), rounded to
    four digits.  Reviews without any hit, or without text, are Neutral.
    """
    keys = [id_col, *keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = _hits(reviews, lexicon, keys, text, rules, idioms).select(*keys, _value(rules, idioms).alias("value"), F.lit(0.0).alias("marks"))
    loud = rules.exclamation[0] or rules.question[0]
    # every review once more, so that those without a hit stay
    each = reviews.select(*keys, F.lit(0.0).alias("value"), (_marks(text, rules) if loud else F.lit(0.0)).cast("double").alias("marks"))
    sums = hits.union(each).groupBy(*keys).agg(F.sum("value").alias("s"), F.max("marks").alias("marks"))
    s = F.col("s") + F.signum("s") * F.col("marks")
    compound = F.round(s / F.sqrt(s * s + K.COMPOUND_ALPHA), 4)
    return sums.select(*keys, compound.alias("compound")).withColumn("sentiment", sentiment_label(F.col("compound")))
