"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from basketlens.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least_length=7, least_count=2, times=10):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "aÀÿß"])
def test_variants_against_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    counts = Counter()
    for _ in range(250):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 7)))
        counts[w] += rng.choice([1, 1, 2, 3, 20, 200, 2000])
    rows = [(w, n) for w, n in counts.items()] + [(None, 5)]
    rows += [(w, 1) for w in list(counts)[:50]]  # several rows of a word add up
    counts.update(list(counts)[:50])
    df = spark.createDataFrame(rows, "word string, n long").repartition(5)
    got = collected(spelling.spelling_variants(df, least_length=4, times=4))
    expected = brute(counts, least_length=4, times=4)
    assert got == expected
    assert any(r != f and f for f, r, *_ in expected.values())


def test_long_words_runs_and_ties(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(300))
    rows = [(long, 100), (long[:150] + "z" + long[150:], 2), (long[:-1], 3), (long[:200] + "y" + long[201:], 100), ("a" * 64, 50), ("a" * 65, 3), ("a" * 66, 2), ("aaaaaaab", 50), ("aaaaaaac", 50), ("aaaaaaa", 4), ("aaaaaaad", 5)]
    got = collected(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert got == brute(dict(rows))
    assert got["aaaaaaa"][0] == "aaaaaaab" and got["aaaaaaad"][:2] == ("aaaaaaab", "aaaaaaab")


def test_chains_lead_to_their_end(spark):
    rows = [("x" * i + "a" * (20 - i), 10 ** (i + 1)) for i in range(12)]
    got = collected(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert {r for _, r, *_ in got.values()} == {"x" * 11 + "a" * 9} and got["a" * 20][0] == "x" + "a" * 19


def test_words_of_texts(make):
    rng = random.Random(2)
    vocabulary = ["Reading", "Writing", "reAding", "ÉTUDIER", "étudier", "listening", "short", "x1y2wording"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) + rng.choice(["", ".", "'s", "\n"])) for i in range(150)]
    rows += [(7, rows[7][1]), (-3, "Reading reading"), (None, "Reading listening"), (1000, None), (1001, "")]
    expected = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += 1
    docs = make(rows)
    assert {r.word: r.n for r in spelling.spoilt_words(docs).collect()} == expected
    assert collected(spelling.document_variants(docs)) == brute(expected)


def test_no_words(make, spark, odd, clashing):
    assert spelling.document_variants(make([])).collect() == []
    assert spelling.document_variants(make([(1, "a b c"), (2, None)])).collect() == []
    assert sorted(spelling.document_variants(odd).collect()) == sorted(spelling.document_variants(clashing).collect())
