"""Every valence rule on texts made for it."""

import math

import pytest
from pyspark.sql import functions as F

from basketlens.operators import valence

LEXICON = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("shit", -2.6), (":)", 2.0), ("yeah", 1.2)]
IDIOMS = [("the shit", 3.0), ("yeah right", -2.0), ("not the shit at", 0.5)]
B, C, N = 0.293, 0.733, -0.74

GOLDEN = {
    "good": 1.9,
    "this is GOOD": 1.9 + C,
    "THIS IS GOOD": 1.9,
    "this is BAD": -2.5 - C,
    "very good": 1.9 + B,
    "VERY good": 1.9 + B + C,
    "very bad": -2.5 - B,
    "very, very good": 1.9 + B + 0.95 * B,
    "slightly good": 1.9 - B,
    "not good": 1.9 * N,
    "isn't good": 1.9 * N,
    "wouldn't be good": 1.9 * N,
    "not a very good thing": (1.9 + B) * N,
    "not one two three good": 1.9,
    "never so good": (1.9 + B) * 1.5,
    "never been so good": (1.9 + B) * 1.5,
    "never good": 1.9 * N,
    "without doubt good": 1.9,
    "without a good": 1.9 * N,
    "the least good": 1.9 * N,
    "at least good": 1.9,
    "very least good": 1.9 + 0.95 * B,
    "it is the shit": 3.0,
    "shit": -2.6,
    "Yeah, right!": -2.0 - 0.292,
    "it is not the shit at all": 0.5,
    "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
    "but good": 1.9 * 1.5,
    "good!!!": 1.9 + 3 * 0.292,
    "good!!!!!!": 1.9 + 4 * 0.292,
    "bad!": -2.5 - 0.292,
    "good?": 1.9,
    "good??": 1.9 + 2 * 0.18,
    "good????": 1.9 + 0.96,
    "bad :)": -0.5,
    "nothing here!": 0.0,
    "": 0.0,
}


def compound(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_golden_rows(frame):
    reviews = frame([(i, t, "x") for i, t in enumerate(GOLDEN)] + [(99, None, "x")], "review_id int, review_text string, product_id string")
    found = {r.review_id: r for r in valence.valence_scores(reviews, frame(LEXICON, "token string, valence double"), idioms=frame(IDIOMS, "phrase string, valence double")).collect()}
    assert {t: found[i].compound for i, t in enumerate(GOLDEN)} == {t: compound(s) for t, s in GOLDEN.items()}
    assert found[99].compound == 0 and found[99].sentiment == "Neutral"


def test_rules_can_be_left_out(frame):
    reviews = frame([(1, "good but GOOD!!"), (2, "never so good")], "review_id int, review_text string")
    found = {r.review_id: r.compound for r in valence.valence_scores(reviews, frame(LEXICON, "token string, valence double"), valence.SIMPLE, keep=()).collect()}
    assert found == {1: compound(3.8), 2: compound((1.9 + B) * N)}


@pytest.mark.parametrize("rows", [[], [(1, None), (1, "good"), (None, "good")]])
def test_empty_and_repeated(frame, rows):
    reviews = frame(rows, "review_id int, review_text string")
    found = valence.valence_scores(reviews, frame(LEXICON, "token string, valence double"), keep=()).collect()
    assert {r.review_id: r.compound for r in found} == ({1: compound(1.9), None: compound(1.9)} if rows else {})


def test_only_hits_are_joined_and_no_python(frame):
    reviews = frame([(1, "good")], "review_id int, review_text string")
    df = valence.valence_scores(reviews, frame(LEXICON, "token string, valence double"), keep=())
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Inner" in plan
    assert df.select(F.sum("compound")).first()[0] > 0
