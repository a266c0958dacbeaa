import random

import pytest
from pyspark.sql import functions as F

from basketlens.llm.shared import ship

SCHEMA = "doc_id long, text string, lang string, source string"
# names that operators use themselves, or a careless join would confuse
CLASHES = ["row", "t", "w", "h", "n", "a", "b", "marks", "text_key", "run", "digest", "label", "class_id", "component", "kept", "gone", "length", "count"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or full rows."""
    ship(spark)

    def build(rows):
        return spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(3)
    long_text = " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(5000)) for _ in range(30_000))
    return [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, "word", None, "a"),
        (3, "word", None, "a"),
        (4, long_text, "en", "a"),
        (5, long_text.upper(), "en", "a"),
        (6, "  \n\n \t\r\n", "en", "a"),
        (7, "ein Wort é \U0001f600 <|endoftext|> 12", "de", "a"),
        (None, "some text without an id at all", "en", "b"),
        (8, "x" * 100_000, "en", "b"),
    ]


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows)


@pytest.fixture(scope="session")
def clashing(odd):
    return odd.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def copies():
    """Texts of few words that share many passages: originals, edited copies, and parts of others."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(70):
        kind = rng.random()
        if texts and kind < 0.25:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif texts and kind < 0.5:
            other = rng.choice(texts).split(" ")
            at = rng.randrange(max(1, len(other) - 15))
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(20))] + other[at : at + rng.randrange(10, 30)] + [rng.choice(vocabulary) for _ in range(rng.randrange(20))]
        elif texts and kind < 0.6:
            words = rng.choice(texts).split(" ")
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        texts.append(" ".join(words))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))
