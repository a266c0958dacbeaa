"""Removal of repeats, near and exact duplicates against plain Python over the same texts."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import exact_dedup, line_dedup, ngram_join, substring_dedup
from basketlens.llm.components import component_labels
from basketlens.llm.shared import window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_against_brute_force(make, copies):
    first = {}
    for i, text in copies:
        w = WORD.findall(text)
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, i), i)
    expected = {}
    for i, text in copies:
        w = WORD.findall(text)
        out = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                out |= set(range(p, p + 13))
        expected[i] = (len(w), len(out), " ".join(x for k, x in enumerate(w) if k not in out))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.without_repeats(make(copies)).collect()}
    assert got == expected
    assert sum(n for _, n, _ in expected.values()) > 100


def test_words_cut_in_place(make):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = make([(1, f"one\n{passage} two"), (2, f"three  four\n{passage}\nfive\tsix"), (3, passage)])
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: f"one\n{passage} two", 2: "three  four\nfive\tsix"}


def brute_lines(rows):
    units = {}
    for i, text in rows:
        every = text.split("\n") if text else []
        units[i] = (every, [k for k, x in enumerate(every) if WORD.search(x)])
    first = {}
    for i, (every, at) in sorted(units.items()):
        for p in range(len(at) - line_dedup.RUN + 1):
            first.setdefault(tuple(every[k] for k in at[p : p + line_dedup.RUN]), (i, p))
    gone = {}
    for i, (every, at) in units.items():
        gone[i] = set()
        for p in range(len(at) - line_dedup.RUN + 1):
            if first[tuple(every[k] for k in at[p : p + line_dedup.RUN])] != (i, p):
                gone[i] |= set(range(p, p + line_dedup.RUN))
    return {i: (len(at), len(gone[i]), [every[k] for u, k in enumerate(at) if u not in gone[i]]) for i, (every, at) in units.items()}


def test_lines_against_brute_force(make):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.4:
            other = rng.choice(rows)[1].split("\n")
            at = rng.randrange(len(other))
            part = other[at : at + rng.randrange(2, 9)]
        else:
            part = []
        lines = [f"line {rng.randrange(12)}" if rng.random() < 0.8 else "" for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join(lines + part + [f"end {rng.randrange(6)}"])))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, [x for x in r.text.split("\n") if WORD.search(x)]) for r in line_dedup.without_repeated_lines(make(rows)).collect()}
    assert got == brute_lines(rows)
    assert sum(n for _, n, _ in got.values()) > 30


def long_enough(lines):
    words = sum(max(len(WORD.findall(x)), len("".join(WORD.findall(x)).encode()) // line_dedup.WORD_BYTES) for x in lines)
    return len(lines) >= line_dedup.RUN or words >= line_dedup.LEAST_WORDS


def brute_runs(rows):
    """Like the above for runs of every length that are long enough, not only of the lengths that are compared."""
    units, first = {}, {}
    for i, text in sorted(rows):
        units[i] = [x for x in text.split("\n") if WORD.search(x)]
        for p in range(len(units[i])):
            for q in range(p + 1, len(units[i]) + 1):
                first.setdefault(tuple(units[i][p:q]), (i, p))
    kept = {}
    for i, every in units.items():
        gone = set()
        for p in range(len(every)):
            for q in range(p + 1, len(every) + 1):
                if long_enough(every[p:q]) and first[tuple(every[p:q])] != (i, p):
                    gone |= set(range(p, q))
        kept[i] = [x for k, x in enumerate(every) if k not in gone]
    return kept


def test_single_lines_and_pairs_against_brute_force(make):
    rng = random.Random(9)
    footer = "all of the rights to this page are reserved by its owner"
    pool = [footer, "Yes.", "No.", "two words", "three words here", "four words stand here", "five words stand right here", "線" * 20, "線" * 4]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(100 + i, f"something new {i}\n\n{footer}") for i in range(20)] + [(200, footer), (201, "Yes."), (202, f"{footer}\nYes.\nown 202"), (203, f"{footer}\nYes.")]
    rng.shuffle(rows)
    expected = brute_runs(rows)
    got = {r.doc_id: [x for x in r.text.split("\n") if WORD.search(x)] for r in line_dedup.without_repeated_lines(make(rows).repartition(7)).collect()}
    assert got == expected
    assert sum(footer in x for x in got.values()) == 1
    assert got[200] == [] and got[201] == ["Yes."] and got[203] == []


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in sets}


def chained_copies():
    """Chains in which only neighbours are near, and many near copies of one text."""
    rng = random.Random(8)
    rows, words = [], [f"c{i}" for i in range(90)]
    for _ in range(40):
        rows.append(" ".join(words))
        words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
    base = [f"b{i}" for i in range(60)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append(" ".join(copy))
    rows += ["one two three", "ONE two three", "one two three four", "", "five words stand right here", "five words stand right here"]
    ids = list(range(100, 100 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("which", ["copies", "chains"])
def test_near_duplicates_against_brute_force(make, copies, which):
    rows = copies if which == "copies" else chained_copies()
    sets = {i: shingles(t) for i, t in rows}
    expected = {i: (len(sets[i]), c) for i, c in components(sets).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(rows)).collect()}
    assert got == expected


def test_near_duplicates_with_a_shingle_in_a_third_of_all_documents(make):
    rng = random.Random(17)
    phrase, rows = "the very same five words", []
    for i in range(450):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            words[rng.randrange(len(words)) : 0] = phrase.split()
        if i % 5 == 4:
            words = rows[rng.randrange(len(rows))][1].split()
            words[rng.randrange(len(words))] = rng.choice(["THE", "x1"])
            words = [w.upper() for w in words] if i % 2 else words
        rows.append((i, " ".join(words)))
        rows += [(1000 + i, rows[-1][1].upper())] if i % 9 == 0 else []
    sets = {i: shingles(t) for i, t in rows}
    expected = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(rows).repartition(6)).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}
    assert len(set(expected.values())) < len(rows) - 20


def test_rows_of_members_do_not_grow_with_the_buckets(make, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(0, 300, 3):  # near copies: a word changed at the end
        text = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(i + k, " ".join([*text[:-1], f"end{k}"])) for k in range(3)]
    stored, store = {}, ngram_join.store

    def counting(df, name):
        out = store(df, name)
        stored.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "store", counting)
    monkeypatch.setattr(ngram_join, "PER_BUCKET", 400)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(make(rows)).collect()}
    assert got == {i: i // 3 * 3 for i, _ in rows}
    assert stored["met"][0] > 30  # buckets where shingles meet
    assert stored["members"][0] <= 2 * len(rows)


def test_lists_stay_whole_on_their_way_home():
    rng = np.random.default_rng(9)
    parts, expected = [], []
    for bucket in range(5):
        lists = np.sort(rng.integers(60, size=400))
        lists = np.concatenate([lists, np.full(50, 60)])
        owners = np.stack([rng.integers(-40, 40, size=450) << 40, rng.integers(5, 9, size=450)], axis=1)
        places = rng.integers(30, size=450)
        parts += ngram_join._listed(pa.array([bucket]), owners, lists, places).to_batches()
        expected += [sorted((*owners[i].tolist(), int(places[i])) for i in np.flatnonzero(lists == n)) for n in np.unique(lists)]
    sent = pa.Table.from_batches(ngram_join._send_home(7)(iter(parts)))
    got = []
    for home in set(sent.column("bucket").to_pylist()):
        row = ngram_join._at_home(sent.filter(pc.equal(sent.column("bucket"), home))).to_pylist()[0]
        owners, lists, places = ngram_join._read_lists(row)
        got += [sorted((*owners[i].tolist(), int(places[i])) for i in np.flatnonzero(lists == n)) for n in np.unique(lists)]
    assert sorted(got) == sorted(expected)


def test_entries_with_a_partner_in_their_list():
    rng = np.random.default_rng(0)
    for _ in range(500):
        k = int(rng.integers(0, 40))
        lists, n = np.sort(rng.integers(0, 5, k)), rng.integers(1, 30, k)
        place = np.array([int(rng.integers(0, max(1, x // 4 + 1))) for x in n], np.int64)
        possible = [[a != b and lists[a] == lists[b] and ngram_join._possible(n[a], n[b], place[a], place[b]) for b in range(k)] for a in range(k)]
        assert ngram_join.with_partner(lists, n, place).tolist() == [any(row) for row in possible]


def test_bitmaps_never_overstate_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 3000, 2)
        shared = rng.integers(0, min(n, m) + 1)
        pool = rng.choice(1 << 40, int(n + m), replace=False).astype(np.uint64)
        bits = []
        for own in (pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])):
            held = np.zeros(ngram_join.bits_for(len(own)), np.uint8)
            held[(ngram_join.mix(own) % np.uint64(len(held))).astype(np.int64)] = 1
            bits.append(np.packbits(held, bitorder="little").tobytes())
        assert ngram_join.least_difference(*bits) <= n + m - 2 * shared


def test_rows_of_one_id_tie_components(make):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = ngram_join.near_duplicates(make([(5, a), (9, a), (9, b), (7, b), (8, "other words that stand alone")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (7, 5), (8, 8), (9, 5), (9, 5)]


def test_exact_against_brute_force(make, copies):
    rows = copies + [(1000 + i, t.upper()) for i, t in copies[:20]] + [(2000, "É"), (2001, "é"), (2002, None), (2003, "")]
    lower = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in rows}
    groups = {}
    for i, t in lower.items():
        groups.setdefault(t, []).append(i)
    expected = {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in lower.items()}
    docs = make(rows).repartition(20)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == expected
    least = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs, keep="smallest").collect()}
    assert least == {i: min(groups[t]) for i, t in lower.items()}


def test_labels_over_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 103)], "a long, b long")
    got = {r.node: r.label for r in component_labels(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=60), st.integers(1, 8))
def test_window_hash_depends_on_the_window_only(units, k):
    values = np.array(units, np.uint64)
    alone = [window_hashes(values[i : i + k], k)[0] for i in range(len(values) - k + 1)]
    assert window_hashes(values, k).tolist() == [int(x) for x in alone]
