"""Packing: places without gaps, few sequences, and the search against all partitions of small inputs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every piece."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in sorted(set(range(len(rooms)))):
            if rooms[k] >= lengths[i]:
                place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_search_finds_the_least(lengths):
    plan = packing.fillings(dict(Counter(lengths)), 20)
    held = Counter()
    for filling, repeats in plan:
        assert sum(x * n for x, n in filling) <= 20
        for x, n in filling:
            held[x] += n * repeats
    assert held == Counter(lengths)
    assert sum(r for _, r in plan) == fewest(sorted(lengths, reverse=True), 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=300))
def test_near_the_bound_on_larger_inputs(lengths):
    counts = dict(Counter(lengths))
    plan = packing.fillings(counts, 100)
    assert sum(r for _, r in plan) <= packing.least_sequences(counts, 100) + 1


def test_search_does_not_depend_on_the_number_of_sequences():
    for many in (10, 1000, 1_000_000):
        counts = {1025: many, 614: many, 409: many, 512: many, 511: many, 717: 2 * many}
        plan = packing.fillings(counts, 2048)
        held = Counter()
        for filling, repeats in plan:
            assert sum(x * n for x, n in filling) <= 2048
            for x, n in filling:
                held[x] += n * repeats
        assert held == counts
        assert sum(r for _, r in packing.best_fit(counts, 2048)) > sum(r for _, r in plan) == 11 * many // 5
        assert many > 1000 or packing.least_sequences(counts, 2048) == 11 * many // 5


def test_search_over_many_lengths_ends_with_a_whole_plan():
    counts = {x: 1 + x * 7 % 50 for x in range(700, 2048)}
    plan = packing.fillings(counts, 2048, most=3000)
    held = Counter()
    for filling, repeats in plan:
        assert sum(x * n for x, n in filling) <= 2048
        for x, n in filling:
            held[x] += n * repeats
    assert held == counts
    assert sum(r for _, r in plan) <= sum(r for _, r in packing.best_fit(counts, 2048))


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


def test_ids_are_those_of_the_tokenizers_library():
    tokenizer = Tokenizer.from_file(PATH)
    assert packing.Encoder(PATH).ranks
    texts = ["", " ", "a  b", " a b ", "one two\nthree", "x \n y", "can't  stop\t now ", "é ü　ß   z", "12 345! ?? <|endoftext|>", "a\x1c b \x85 c", "\r\n q"]
    texts += ["a b <|endoftext|> c", "<|endoftext|><|endoftext|>x", "<|endoftext|", "x" * 200_000, "é1" * 50_000, " " * 200_000 + "x", "word " * 40_000, "a\n" * 70_000 + "<|endoftext|> z"]
    rng = random.Random(6)
    bits = ["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "a", "B", "é", "'s", "'ll", "1", "٣", "。", "\u00a0", "\u200b", "-", "😀", "\x00", "ñandú", "word"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 15))) for _ in range(5000)]
    for text, ids in zip(texts, packing.token_ids(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:100]


def test_ids_around_every_kind_of_character():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [f"a{x}b {x}{x} 1{x}2 .{x}. {x}  {x}\n{x}'s '{x}" for x in map(chr, [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 101)])]
    for text, ids, e in zip(texts, packing.token_ids(texts, PATH), tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text


def test_other_tokenizer_files():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    assert packing.ranked(path) is None
    for text, ids in zip(texts := ["Some words, and more.", "", "é 12"], packing.token_ids(texts, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, make, copies):
    rows = copies + [(900, "word " * 5000), (901, None), (902, "")] + [(1000 + i, "the same text again") for i in range(300)]
    got = packing.pack_documents(make(rows), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) == packing.least_sequences(dict(Counter(r.length for r in got)), 2048)
