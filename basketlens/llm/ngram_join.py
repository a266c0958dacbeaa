"""Near-duplicate documents by a grouped prefix join on word shingles, and their components.

A document's set is its distinct 5-word shingles (64-bit hashes).  All sets are ordered by one order of shingles, rare
ones first by a sketch of how many documents have a shingle.  Sets that reach a Jaccard similarity t share a shingle among
the first ``n - ceil(t n) + 1`` of each, its prefix.

1. *Collapse.*  Equal sets are one class; classes with the same size and the same prefix are one group, with one prefix.
2. *Filter group pairs.*  A group's prefix is sent to the buckets of its shingles.  There, groups that share a shingle
   meet.  What is left are lists of groups; those with the same least group go to one home, so that the many lists of near copies
   lie together, and what a group is asked by does not grow with the number of buckets.  A pair is a candidate if the sizes, and the places of the shared
   shingle in both, still allow the similarity.
3. *Expand and verify.*  Candidates expand to the classes of both groups.  Of each class a bitmap of its shingles is kept, a bit a shingle and
   at least four times as many bits as shingles (up to ``MOST_BITS``).  Bits that differ are shingles that differ, so most pairs are seen to be too far apart by their bitmaps;
   the whole sets of the others are compared exactly.

Only components are asked for, so rounds of few pairs come first: each group is tried with one partner at a time, and what
links is merged.  The last round takes all pairs of groups that share a shingle and are still in different components, so
that no link is missed; copies that are already together are never compared with each other.  Sets of a pair meet in a
stream sorted by its first document, which is split when many documents are compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.components import component_labels
from basketlens.llm.shared import BLOCK_BYTES, Block, blocks, documents, mix, shuffle_partitions, store, window_hashes, words
from basketlens.llm.spans import SENT, TOP, Gathered, owners_of, runs, split_hashes, whole_hashes

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 20
SLICES = 64
PER_BUCKET = 1_000_000
# Entries of lists in a home; lists above LONG entries are dealt over PARTS homes, since those of a large group of near copies have one least group.
PER_HOME = 250_000
LONG, PARTS = 16, 16
PARTNERS_AT_ONCE = 200
# Rounds of few pairs before the one of all pairs, and the share of new links from which another one pays.
TRIES = 3
WORTH = 0.05

SETS = "doc_id long, n long, prefix_key long, set_a long, set_b long"
VOTES = "a long, b long, votes long"
LISTS = "bucket int, owners binary, whose binary, lists binary, places binary"
ROUND = f"{LISTS}, pairs binary, votes binary"
BITMAPS = "doc_id long, n long, bits binary"
LEAST_BITS, MOST_BITS = 1 << 8, 1 << 17


# ---------------------------------------------------------------- sets


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and where each text's begin."""
    units = words(block, lower=True)
    hashes = units.hashes()
    count = np.diff(units.first)
    of = np.repeat(np.arange(len(block)), count)
    grams = window_hashes(hashes, SHINGLE)
    left = units.first[1:][of[: len(grams)]] - np.arange(len(grams))  # words from here to the text's end
    whole = left >= SHINGLE
    parts, owners = [grams[whole]], [of[: len(grams)][whole]]
    for k in range(1, SHINGLE):  # a shorter text is one shingle of all its words
        short = np.flatnonzero(count == k)
        if len(short):
            parts.append(window_hashes(hashes, k)[units.first[short]])
            owners.append(short)
    grams, of = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    once = runs(of, grams)
    grams, of = grams[once], of[once]
    return grams, np.searchsorted(of, np.arange(len(block) + 1))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for block in blocks(batches):
        grams, _ = shingle_sets(block)
        counts += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    parts = counts.astype(np.uint32).reshape(SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])


def _add_slices(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.float64) for x in table.column("counts"))
    level = np.minimum(4 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)
    return pa.Table.from_arrays([table.column("slice").slice(0, 1).combine_chunks(), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """For each value of a shingle's first bits, how frequent it is, in quarter doublings: always a megabyte."""
    parts = texts.mapInArrow(_sketch, "slice int, counts binary").groupBy("slice").applyInArrow(_add_slices, "slice int, levels binary")
    found = {r.slice: r.levels for r in parts.collect()}
    size = (1 << SKETCH_BITS) // SLICES
    return np.frombuffer(b"".join(found.get(s, bytes(size)) for s in range(SLICES)), np.uint8)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


@dataclass
class Prefixes:
    """The sets of a block's texts, and their prefixes one after the other."""

    n: np.ndarray  # size of each set
    key: np.ndarray  # hash of each prefix
    grams: np.ndarray  # all shingles, text by text, in the order of the prefixes
    first: np.ndarray  # where each text's shingles begin
    tokens: np.ndarray
    size: np.ndarray  # length of each prefix


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes > 0, np.add.reduceat(np.append(values, np.uint64(0)), starts), np.uint64(0)).view(np.int64)


def prefixes(block: Block, levels: np.ndarray) -> Prefixes:
    grams, first = shingle_sets(block)
    n = np.diff(first)
    of = np.repeat(np.arange(len(block)), n)
    grams = grams[np.lexsort((grams, levels[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], of))]
    place = np.arange(len(grams)) - np.repeat(first[:-1], n)
    size = np.where(n > 0, prefix_length(n), 0)
    tokens = grams[place < np.repeat(size, n)]
    return Prefixes(n.astype(np.int64), _sums(mix(tokens), np.cumsum(size) - size, size), grams, first, tokens, size)


def _setter(levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            p = prefixes(block, levels)
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column("doc_id"),
                    pa.array(p.n),
                    pa.array(p.key),
                    pa.array(_sums(mix(p.grams ^ np.uint64(0x5851F42D4C957F2D)), p.first[:-1], p.n)),
                    pa.array(_sums(mix(mix(p.grams) ^ np.uint64(0x14057B7EF767814F)), p.first[:-1], p.n)),
                ],
                names=["doc_id", "n", "prefix_key", "set_a", "set_b"],
            )

    return run


# ---------------------------------------------------------------- candidates


def _send_prefixes(levels: np.ndarray, buckets: int):
    """Each group of texts, named by its prefix's hash and its size, once per task to the buckets of its shingles."""

    def flush(held: Gathered) -> Iterator[pa.RecordBatch]:
        keys, sizes, tokens, places = held.take()
        order = np.lexsort((sizes, keys, tokens))
        keys, sizes, tokens, places = (x[order] for x in (keys, sizes, tokens, places))
        once = runs(tokens, keys, sizes)
        keys, sizes, tokens, places = (x[once] for x in (keys, sizes, tokens, places))
        yield from held.rows(False, tokens >> TOP, keys, sizes, places=places, **split_hashes(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(buckets)
        for block in blocks(batches):
            p = prefixes(block, levels)
            place = np.arange(len(p.tokens)) - np.repeat(np.cumsum(p.size) - p.size, p.size)
            if held.add(np.repeat(p.key, p.size), np.repeat(p.n, p.size), p.tokens, place.astype(np.uint32)):
                yield from flush(held)
        if held.size:
            yield from flush(held)

    return run


def with_partner(lists: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries of numbered lists may link with another one of their list, by sizes and places.

    Two entries may link when each one's size is within the other's reach, see :func:`_possible`.  In a list sorted by size, the sizes
    within reach are its beginning, so an entry has a partner if the largest reach there, its own left out, gets to its size.
    """
    useful = np.zeros(len(n), bool)
    if not len(n):
        return useful
    reach = (100 * (n - place) - PERCENT * place) // PERCENT
    order = np.lexsort((n, lists))
    lists, n, reach = lists[order], n[order], reach[order]
    span = np.int64(max(n.max(), reach.max()) - min(0, reach.min()) + 2)
    base = lists * span - min(0, reach.min())  # values of a list lie above those of the lists before it
    first = np.maximum.accumulate(base + reach)
    lesser = np.minimum(base + reach, np.append(np.int64(-1), first[:-1]))
    second = np.maximum.accumulate(lesser)
    last = np.searchsorted(base + n, base + reach, side="right") - 1
    here = np.arange(len(n))
    inside = last >= here  # its own size is within its reach
    # what the beginning's largest reach is without this entry's own
    best = np.where(inside & (base + reach == first[last]), second[last], first[last])
    useful[order] = (last >= 0) & (best >= base + n)
    return useful


def _meeting(table: pa.Table) -> pa.Table:
    """Of a bucket's shingles those of several groups, as numbered lists of entries (group, place)."""
    rows = table.select(["owners", "counts", "hashes", "more", "places"]).to_pylist()
    owners = np.concatenate([owners_of(r) for r in rows])
    tokens = np.concatenate([whole_hashes(r) for r in rows])
    places = np.concatenate([np.frombuffer(r["places"], np.uint32) for r in rows])
    order = np.lexsort((owners[:, 1], owners[:, 0], tokens))
    owners, tokens, places = owners[order], tokens[order], places[order]
    once = runs(tokens, owners[:, 0], owners[:, 1])
    owners, tokens, places = owners[once], tokens[once], places[once]
    count = np.diff(np.append(runs(tokens), len(tokens)))
    useful = with_partner(np.repeat(np.arange(len(count)), count), owners[:, 1], places.astype(np.int64))
    number = np.repeat(np.arange(len(count)), count)
    return _listed(table.column("bucket").slice(0, 1), owners[useful], number[useful], places[useful])


def _listed(bucket, owners: np.ndarray, lists: np.ndarray, places: np.ndarray, **more: bytes) -> pa.Table:
    """A bucket's row: its groups once, and the entries of its lists."""
    known, whose = np.unique(owners.reshape(-1, 2), axis=0, return_inverse=True)
    parts = [known.astype(np.int64), whose.reshape(-1).astype(np.uint32), lists.astype(np.uint32), places.astype(np.uint32)]
    columns = {"owners": parts[0].tobytes(), "whose": parts[1].tobytes(), "lists": parts[2].tobytes(), "places": parts[3].tobytes(), **more}
    return pa.Table.from_arrays([pa.array(bucket.to_pylist(), pa.int32()), *(pa.array([x], pa.binary()) for x in columns.values())], names=["bucket", *columns])


def _homes_of(owners: np.ndarray, lists: np.ndarray, homes: int) -> np.ndarray:
    """For entries ordered by list, the home of each one's list: that of the list's least group."""
    start = runs(lists)
    count = np.diff(np.append(start, len(lists)))
    names = mix(owners[:, 0].view(np.uint64) ^ mix(owners[:, 1].astype(np.uint64)))
    part = np.where(count > LONG, mix(lists[start].astype(np.uint64) + np.uint64(1)) % np.uint64(PARTS), np.uint64(0))
    least = np.minimum.reduceat(names, start) if len(start) else names
    return np.repeat((mix(least + part) % np.uint64(homes)).astype(np.int64), count)


def _read_lists(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a row of lists: group (prefix's hash, size), list, place."""
    owners = np.frombuffer(row["owners"], np.int64).reshape(-1, 2)
    whose, lists, places = (np.frombuffer(row[c], np.uint32) for c in ("whose", "lists", "places"))
    return owners[whose], lists, places


def _send_home(homes: int):
    """The lists of each bucket, one row for each home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                owners, lists, places = _read_lists(row)
                home = _homes_of(owners, lists, homes)
                order = np.argsort(home, kind="stable")
                for at in np.split(order, runs(home[order])[1:]):
                    if len(at):
                        yield from _listed(pa.array([home[at[0]]]), owners[at], lists[at], places[at]).to_batches()

    return run


def _at_home(table: pa.Table) -> pa.Table:
    """The lists that several buckets have sent to a home, numbered anew."""
    owners, lists, places = zip(*(_read_lists(r) for r in table.to_pylist()), strict=True)
    after = np.cumsum([0, *(int(x.max()) + 1 for x in lists)])
    numbers = np.unique(np.concatenate([x + n for x, n in zip(lists, after)]), return_inverse=True)[1]
    return _listed(table.column("bucket").slice(0, 1), np.concatenate(owners), numbers, np.concatenate(places))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, owners in zip(batch.column("bucket").to_pylist(), batch.column("owners").to_pylist(), strict=True):
            pairs = np.frombuffer(owners, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), bucket, np.int32)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["bucket", "prefix_key", "n"])


def _entries(lists: pa.Table, roster: pa.Table, salt: int) -> tuple[np.ndarray, ...]:
    """The lists of a bucket with the groups split by component: (group, component, list, place, size, prefix's hash), ordered by list.

    Of lists whose groups are all in one component nothing is left.
    """
    if not lists.num_rows or not roster.num_rows:
        return (np.zeros(0, np.int64),) * 6
    row = lists.to_pylist()[0]
    owners = np.frombuffer(row["owners"], np.int64).reshape(-1, 2)
    named = pd.DataFrame({"prefix_key": owners[:, 0], "n": owners[:, 1], "at": np.arange(len(owners))})
    split = named.merge(roster.select(["prefix_key", "n", "component", "group_id"]).to_pandas(), on=["prefix_key", "n"]).sort_values("at", kind="stable")
    each = np.bincount(split["at"], minlength=len(owners))
    first = np.cumsum(each) - each
    whose = np.frombuffer(row["whose"], np.uint32).astype(np.int64)
    times = each[whose]
    entry = np.repeat(np.arange(len(whose)), times)
    at = np.repeat(first[whose], times) + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    group, component = split["group_id"].to_numpy()[at], split["component"].to_numpy()[at]
    token = np.frombuffer(row["lists"], np.uint32)[entry].astype(np.int64)
    place = np.frombuffer(row["places"], np.uint32)[entry].astype(np.int64)
    key, size = owners[whose[entry], 0], owners[whose[entry], 1]
    shuffled = mix(group.view(np.uint64) + np.uint64(salt)) if salt else group
    order = np.lexsort((shuffled, token))
    columns = tuple(x[order] for x in (group, component, token, place, size, key))
    start = runs(columns[2])
    if len(start):
        count = np.diff(np.append(start, len(order)))
        mixed = np.repeat(np.minimum.reduceat(columns[1], start) != np.maximum.reduceat(columns[1], start), count)
        columns = tuple(x[mixed] for x in columns)
        useful = with_partner(columns[2], columns[4], columns[3])
        columns = tuple(x[useful] for x in columns)
    return columns


def _possible(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may link when the first one they share is the i-th of one and the j-th of the other."""
    most = 1 + np.minimum(n - i - 1, m - j - 1)
    return (100 + PERCENT) * most >= PERCENT * (n + m)


def _round(lists: pa.Table, entries: tuple[np.ndarray, ...], pairs: np.ndarray) -> pa.Table:
    """What a bucket says in a round: pairs of groups with the number of lists that name them, and what is left of its lists."""
    if len(pairs):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = runs(pairs[:, 0], pairs[:, 1])
    votes = np.diff(np.append(first, len(pairs))).astype(np.int64)
    _, _, token, place, size, key = entries
    left = np.unique(np.stack([token, place, key, size], axis=1), axis=0)  # parts of a group are one entry again
    bucket = lists.column("bucket").slice(0, 1) if lists.num_rows else pa.chunked_array([pa.array([-1], pa.int32())])
    return _listed(bucket, left[:, 2:], left[:, 0], left[:, 1], pairs=pairs[first].astype(np.int64).tobytes(), votes=votes.tobytes())


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pairs, votes in zip(batch.column("pairs").to_pylist(), batch.column("votes").to_pylist(), strict=True):
            ab = np.frombuffer(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), pa.array(np.frombuffer(votes, np.int64))], names=["a", "b", "votes"])


def _few(salt: int):
    """Of the groups that share a shingle, each with the first one, or in later rounds with the next one of another component."""

    def run(lists: pa.Table, roster: pa.Table) -> pa.Table:
        entries = _entries(lists, roster, salt)
        group, component, token, place, size, _ = entries
        start = runs(token)
        count = np.diff(np.append(start, len(token)))
        here = np.arange(len(token))
        if salt:
            # the next entry of the list whose component differs: where the component changes
            change = runs(token, component)
            after = np.append(change, len(token))[np.searchsorted(change, here, side="right")]
            partner = np.minimum(after, len(token) - 1)
        else:
            partner = np.repeat(start, count)
        ok = (token[partner] == token) & (component[partner] != component)
        ok &= _possible(size, size[partner], place, place[partner])
        return _round(lists, entries, np.stack([group[partner[ok]], group[ok]], axis=1))

    return run


def _all(lists: pa.Table, roster: pa.Table) -> pa.Table:
    """All pairs of groups that share a shingle, are of different components, and may link."""
    entries = _entries(lists, roster, 0)
    group, component, token, place, size, _ = entries
    order = np.lexsort((group, size, token))
    group, component, token, place, size = (x[order] for x in (group, component, token, place, size))
    count = np.diff(np.append(runs(token), len(token)))
    end = np.repeat(np.cumsum(count), count)
    found, i, d = [], np.arange(len(group)), 1
    # pairs d apart in a list; its sizes ascend, so an entry is done once the other is too large
    while len(i):
        i = i[i + d < end[i]]
        i = i[100 * size[i] >= PERCENT * size[i + d]]
        at = i[component[i] != component[i + d]]
        at = at[_possible(size[at], size[at + d], place[at], place[at + d])]
        if len(at):
            found.append(np.unique(np.sort(np.stack([group[at], group[at + d]], axis=1), axis=1), axis=0))
        d += 1
    return _round(lists, entries, np.concatenate(found) if found else np.zeros((0, 2), np.int64))


# ---------------------------------------------------------------- verification


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, role): the text of a, and then those to compare with it."""
    current, pivots = None, []
    for block in blocks(batches, size=BLOCK_BYTES):
        grams, first = shingle_sets(block)
        a, salt, b = (block.batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "b"))
        role = block.batch.column("role").to_numpy(zero_copy_only=False)
        linked = []
        for i in range(len(a)):
            mine = grams[first[i] : first[i + 1]]
            if (a[i], salt[i]) != current:
                current, pivots = (a[i], salt[i]), []
            if role[i] == 0:
                pivots.append(mine.copy())
                continue
            for other in pivots:
                if not len(mine) or not len(other) or 100 * min(len(mine), len(other)) < PERCENT * max(len(mine), len(other)):
                    continue
                both = np.concatenate([mine, other])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= PERCENT * (len(mine) + len(other) - same):
                    linked.append((a[i], b[i]))
                    break
        if linked:
            x, y = zip(*linked, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (4 * n - 1).bit_length()))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, the size of its set and a bitmap of its shingles."""
    for block in blocks(batches):
        grams, first = shingle_sets(block)
        n = np.diff(first)
        bits = []
        for i, size in enumerate(n.tolist()):
            held = np.zeros(bits_for(size), np.uint8)
            held[(mix(grams[first[i] : first[i + 1]]) % np.uint64(len(held))).astype(np.int64)] = 1
            bits.append(np.packbits(held, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([block.batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(bits, pa.binary())], names=["doc_id", "n", "bits"])


def least_difference(one: bytes, other: bytes) -> int:
    """Shingles that are in one set only, at least: the bits that differ, the longer bitmap folded to the shorter one's length."""
    a, b = (np.frombuffer(x, np.uint8) for x in (one, other))
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and bitmaps allow the similarity: of n and m shingles, (n + m)(1 - t) / (1 + t) may differ."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        keep = [(100 + PERCENT) * least_difference(p, q) <= (100 - PERCENT) * (i + j) for p, q, i, j in zip(x, y, n.tolist(), m.tolist())]
        keep = np.flatnonzero(np.array(keep, bool) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)))
        yield batch.select(["a", "b"]).take(pa.array(keep))


def _links(texts: DataFrame, bitmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    spark = texts.sparkSession
    left = bitmaps.select(F.col("doc_id").alias("a"), "n", F.col("bits").alias("x"))
    right = bitmaps.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    near = pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_near_enough, "a long, b long")
    pairs = store(near, "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS_AT_ONCE).alias("salts"))
    partners = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(1).alias("role"), "b")
    pivots = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"))
    meeting = texts.join(partners.union(pivots).hint("shuffle_hash"), F.col("doc_id") == F.col("b")).select("a", "salt", "role", "b", "text")
    return meeting.repartition(shuffle_partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    Documents link when 100 * |intersection| >= 75 * |union| of their sets; a component holds what can be reached
    over links, and its id is its smallest document id.  A text below five words is one shingle of all its words; null, empty
    and blank texts have no set and link with nothing.  Rows with the same id are one document whose rows are each
    compared.  Rows without an id have no component.  No rows give no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    named = texts.where(F.col("doc_id").isNotNull())
    levels = frequency_levels(named)
    sets = store(texts.mapInArrow(_setter(levels), SETS), "sets")
    same, group = ["n", "prefix_key", "set_a", "set_b"], ["n", "prefix_key"]
    classes = store(sets.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("class_id")), "classes")
    of_row = store(sets.join(classes, same, "left").select("doc_id", "n", "class_id"), "rows")

    # the lists of groups that share a prefix shingle, once; later rounds read them with the components of the day
    size = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(size * (100 - PERCENT) / 100) // PER_BUCKET + 1)
    sent = named.mapInArrow(_send_prefixes(levels, buckets), SENT)
    met = store(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meeting, LISTS), "met")
    homes = max(8, (met.agg(F.sum(F.octet_length("lists"))).first()[0] or 0) // (4 * PER_HOME) + 1)
    lists = store(met.mapInArrow(_send_home(homes), LISTS).repartition(homes, "bucket").groupBy("bucket").applyInArrow(_at_home, LISTS), "lists")
    members = store(lists.select("bucket", "owners").mapInArrow(_members, "bucket int, prefix_key long, n long"), "members")
    # only texts that may be compared: of classes whose group shares a shingle or holds several classes
    crowded = classes.groupBy(*group).count().where("count > 1").select(*group)
    suspects = classes.join(members.select(*group).union(crowded).distinct(), group, "left_semi").select("class_id").distinct()
    compared = store(named.join(suspects.hint("shuffle_hash"), F.col("doc_id") == F.col("class_id"), "left_semi"), "compared")
    bitmaps = store(compared.mapInArrow(_bitmaps, BITMAPS), "bitmaps")

    # rows of one id that are in several classes tie these together
    least = of_row.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    links = store(of_row.join(least, "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b")).distinct(), "ties")
    labels = component_labels(links)
    attempt = 0
    while attempt <= TRIES:
        last = attempt == TRIES
        labelled = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("label", "class_id"))
        placed = store(labelled.select("class_id", "component", *group), "placed")
        # a group is split by component, since what is together need not meet; at first it is one
        apart = placed.groupBy(*group, "component").agg(F.min("class_id").alias("group_id"))
        if attempt == 0:
            apart = placed.groupBy(*group).agg(F.min("class_id").alias("group_id")).withColumn("component", F.col("group_id"))
        apart = store(apart, "groups")
        roster = members.join(apart, group).select("bucket", *group, "component", "group_id")
        turn = lists.repartition(homes, "bucket").groupBy("bucket").cogroup(roster.repartition(homes, "bucket").groupBy("bucket"))
        said = store(turn.applyInArrow(_all if last else _few(attempt), ROUND), "round")
        found = said.mapInArrow(_said, VOTES)
        # the next round reads only what is left: lists that still join different components
        lists = said.drop("pairs", "votes").where(F.octet_length("lists") > 0)
        members = lists.select("bucket", "owners").mapInArrow(_members, "bucket int, prefix_key long, n long")
        if last:
            of_group = placed.join(apart, [*group, "component"]).select("group_id", "class_id")
            inside = apart.alias("p").join(apart.alias("q"), group).where("p.component < q.component").select(F.col("p.group_id").alias("a"), F.col("q.group_id").alias("b"))
            pairs = store(found.select("a", "b").union(inside).distinct(), "group-pairs")
            pairs = pairs.join(of_group.selectExpr("group_id as a", "class_id as x"), "a").join(of_group.selectExpr("group_id as b", "class_id as y"), "b").selectExpr("x as a", "y as b")
        else:
            best = found.groupBy("b", "a").agg(F.sum("votes").alias("votes")).groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a"))
            pairs = best.select("a", "b")
            if attempt == 0:
                pairs = pairs.union(placed.join(apart.drop("component"), group).where("class_id <> group_id").selectExpr("group_id as a", "class_id as b"))
        new = store(_links(compared, bitmaps, pairs), "links")
        found_now = new.count()
        if found_now:
            links = links.union(new)
            labels = component_labels(links)
        if not last and found_now <= WORTH * links.count():
            attempt = TRIES - 1  # a further round of few pairs would add little
        attempt += 1
    by_class = labels.select(F.col("node").alias("class_id"), "label")
    return of_row.join(by_class, "class_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "class_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col)
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))
