"""Repeated stretches of units (words or lines) across all texts, found from selected fingerprints.

A scheme names the units, how many of them make a window (there may be several lengths), how many a gram, and which grams
are fingerprints.  It must promise that two equal windows share a fingerprint at the same place in both.  Then three passes suffice:

1. *Fingerprints.*  Each task gathers the fingerprints of some texts and sends each different one once, to the
   bucket of its hash.  A fingerprint that comes to a bucket twice, or that two texts of one task have, is shared, and the
   texts that have it are told.
2. *Extension.*  Around its shared fingerprints, each text is extended to all windows that hold one, and these are compared
   as a whole, by 96 bits of two independent hashes: a task settles its own texts first and sends only the first text of
   each window to the window's bucket, which finds the first of all.  Whatever is not first is told where it repeats.
3. *Removal.*  The places told are joined to the texts, which lose the units below them.

Whatever a passage's number of copies, a bucket gets it once per task, and no pairs of texts are made.  Only hashes move
between the passes; what a text is told is never more than it has windows.  A bucket is a bounded share of all hashes:
their number follows the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.shared import Block, Words, blocks, mix, store, window_hashes, window_starts

PER_BUCKET = 2_000_000
PER_FLUSH = 400_000
LEAST_BUCKETS = 8

SENT = "bucket int, told boolean, owners binary, counts binary, hashes binary, more binary, places binary"
SENT_NAMES = ["bucket", "told", "owners", "counts", "hashes", "more", "places"]
# What a bucket tells the texts, by group of texts, and what a text is told in the end.
ANSWERS = "dealt int, owners binary, counts binary, marks binary"
TOLD = "doc_id long, text_key long, marks binary"


@dataclass(frozen=True)
class Scheme:
    units: Callable[[Block], Words]
    # lengths of windows, ascending; the place told is its number of units times their number, and which length
    windows: tuple[int, ...]
    gram: int
    # (limits of the texts in the units, gram hashes, places) -> which grams are fingerprints; grams across texts never are
    fingerprints: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None
    # whether a window also repeats one further up in its own text
    within: bool
    # expected fingerprints or windows per byte of text, for the number of buckets
    per_byte: float
    # in place of ``fingerprints``, with grams of one unit: (units, hashes) -> for each unit the fingerprint of the least window from
    # it, or -1, and where that window ends; then the fingerprints of all least windows within a window must be shared
    winnow: Callable[[Words, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None
    # windows below the longest count from this sum of their units' weights on
    weights: Callable[[Words], np.ndarray] | None = None
    least: int = 0


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text_key, text: rows with the same id but other texts stay apart.  With ``carry``, all but the text as ``row`` too."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *rest)


def buckets_for(docs: DataFrame, scheme: Scheme) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, int(size * scheme.per_byte) // PER_BUCKET + 1)


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of ``data``, from each start to the next, as binary values."""
    size = data.dtype.itemsize
    offsets = np.append(starts, len(data)).astype(np.int64) * size
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return array.cast(pa.binary())


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(sorted_keys[0]), bool)
    changed[0] = True
    for k in sorted_keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


def by_owner(key: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """For entries sorted by (key, owner): where keys begin, their values, and the owners of each with their entries' number."""
    owner = runs(key, ids, keys)
    counts = np.diff(np.append(owner, len(ids))).astype(np.uint32)
    starts = runs(key)
    first = np.searchsorted(owner, starts)
    owners = np.stack([ids[owner], keys[owner]], axis=1).reshape(-1)
    return starts, key[starts], binaries(owners, first * 2), binaries(counts, first)


def owners_of(row: dict) -> np.ndarray:
    """(id, key) of each entry of a row that :func:`by_owner` has made."""
    return np.repeat(np.frombuffer(row["owners"], np.int64).reshape(-1, 2), np.frombuffer(row["counts"], np.uint32), axis=0)


class Gathered:
    """Entries of some texts until they are sent: owner (id and key), hash, more hash, place."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.size += len(columns[0])
        return self.size >= PER_FLUSH

    def take(self) -> tuple[np.ndarray, ...]:
        columns = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        return columns

    def rows(self, told: bool, spread: np.ndarray, ids: np.ndarray, keys: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per bucket, that of ``spread``; columns that are not given are empty."""
        if not len(ids):
            return
        bucket = (spread % self.buckets).astype(np.int32)
        order = np.lexsort((keys, ids, bucket))
        starts, buckets, owners, counts = by_owner(bucket[order], ids[order], keys[order])
        empty = pa.array([b""] * len(starts), pa.binary())
        rest = [binaries(columns[c][order], starts) if c in columns else empty for c in ("hashes", "more", "places")]
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(starts), told)), owners, counts, *rest], names=SENT_NAMES)


def _local(block: Block, scheme: Scheme) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a block, their hashes, the text of each, and its place in that text."""
    units = scheme.units(block)
    n = np.diff(units.first)
    of = np.repeat(np.arange(len(block)), n)
    return units, units.hashes(), of, np.arange(len(of)) - np.repeat(units.first[:-1], n)


def _marks(scheme: Scheme, units: Words, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where fingerprints begin, and their hashes."""
    if scheme.winnow is not None:
        chosen = np.unique(scheme.winnow(units, hashes)[0])
        chosen = chosen[chosen >= 0]
        return chosen, window_hashes(hashes, 1)[chosen]
    grams = window_hashes(hashes, scheme.gram)
    whole = window_starts(units.first, scheme.gram, len(hashes))[: len(grams)]
    chosen = np.flatnonzero(scheme.fingerprints(units.first, grams, places[: len(grams)]) & whole)
    return chosen, grams[chosen]


def _ids(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return block.batch.column("doc_id").to_numpy(zero_copy_only=False), block.batch.column("text_key").to_numpy(zero_copy_only=False)


LOW, TOP = np.uint64(0xFFFFFFFFFF), np.uint64(40)


def split_hashes(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Forty bits of a hash, enough within a bucket."""
    return {"hashes": hashes.astype(np.uint32), "more": (hashes >> np.uint64(32)).astype(np.uint8)}


def whole_hashes(row: dict) -> np.ndarray:
    low, high = np.frombuffer(row["hashes"], np.uint32), np.frombuffer(row["more"], np.uint8)
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _send_fingerprints(scheme: Scheme, buckets: int):
    def flush(held: Gathered) -> Iterator[pa.RecordBatch]:
        ids, keys, hashes = held.take()
        order = np.lexsort((keys, ids, hashes))
        ids, keys, hashes = ids[order], keys[order], hashes[order]
        once = runs(hashes, ids, keys)
        again = np.diff(np.append(once, len(hashes))) > 1  # further down in the same text
        ids, keys, hashes = ids[once], keys[once], hashes[once]
        group = runs(hashes)
        count = np.diff(np.append(group, len(hashes)))
        known = np.repeat(count > 1, count) | (again & scheme.within)
        # of a fingerprint that several texts here have, the bucket needs to know once; they know already
        yield from held.rows(False, hashes[group] >> TOP, ids[group], keys[group], places=(count > 1).astype(np.uint8), **split_hashes(hashes[group]))
        yield from held.rows(True, keys[known].view(np.uint64), ids[known], keys[known], **split_hashes(hashes[known]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(buckets)
        for block in blocks(batches):
            units, hashes, of, places = _local(block, scheme)
            at, grams = _marks(scheme, units, hashes, places)
            ids, keys = _ids(block)
            if held.add(ids[of[at]], keys[of[at]], grams):
                yield from flush(held)
        if held.size:
            yield from flush(held)

    return run


def _answers(owners: list[np.ndarray], marks: list[np.ndarray], groups: int) -> pa.Table:
    """One row per group of texts, with what each of its texts is told."""
    owners = np.concatenate(owners) if owners else np.zeros((0, 2), np.int64)
    marks = np.concatenate(marks) if marks else np.zeros(0, np.uint32)
    dealt = (mix(owners[:, 0].view(np.uint64)) % np.uint64(groups)).astype(np.int32)
    order = np.lexsort((owners[:, 1], owners[:, 0], dealt))
    owners, marks = owners[order], marks[order]
    starts, groups, owners, counts = by_owner(dealt[order], owners[:, 0], owners[:, 1])
    return pa.Table.from_arrays([pa.array(groups), owners, counts, binaries(marks, starts)], names=["dealt", "owners", "counts", "marks"])


def _gathered_answers(kind: type):
    """One row per text with all its marks, from the rows of its group."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["owners", "counts", "marks"]).to_pylist()
        owners = np.concatenate([owners_of(r) for r in rows])
        marks = np.concatenate([np.frombuffer(r["marks"], kind) for r in rows])
        order = np.lexsort((owners[:, 1], owners[:, 0]))
        owners, marks = owners[order], marks[order]
        starts = runs(owners[:, 0], owners[:, 1])
        return pa.Table.from_arrays([pa.array(owners[starts, 0]), pa.array(owners[starts, 1]), binaries(marks, starts)], names=["doc_id", "text_key", "marks"])

    return run


def _shared_fingerprints(groups: int):
    def run(table: pa.Table) -> pa.Table:
        owners, marks, sent, already, sent_owners = [], [], [], [], []
        for row in table.select(SENT_NAMES[1:]).to_pylist():
            if row["told"]:
                owners.append(owners_of(row))
                marks.append(whole_hashes(row))
            else:
                sent_owners.append(owners_of(row))
                sent.append(whole_hashes(row))
                already.append(np.frombuffer(row["places"], np.uint8) > 0)
        if sent:
            hashes = np.concatenate(sent)
            order = np.argsort(hashes, kind="stable")
            group = runs(hashes[order])
            count = np.diff(np.append(group, len(hashes)))
            tell = np.zeros(len(hashes), bool)
            tell[order] = np.repeat(count > 1, count)
            tell &= ~np.concatenate(already)
            owners.append(np.concatenate(sent_owners)[tell])
            marks.append(hashes[tell])
        return _answers(owners, marks, groups)

    return run


def _send_windows(scheme: Scheme, buckets: int):
    def flush(held: Gathered) -> Iterator[pa.RecordBatch]:
        ids, keys, hashes, more, places = held.take()
        order = np.lexsort((places, ids, more, hashes))
        ids, keys, hashes, more, places = (x[order] for x in (ids, keys, hashes, more, places))
        later = _not_first(scheme.within, ids, hashes, more, places)
        first = ~later
        yield from held.rows(False, hashes[first] >> TOP, ids[first], keys[first], hashes=hashes[first], more=more[first], places=places[first])
        yield from held.rows(True, keys[later].view(np.uint64), ids[later], keys[later], places=places[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(buckets)
        for block in blocks(batches):
            units, hashes, of, places = _local(block, scheme)
            at, grams = _marks(scheme, units, hashes, places)
            limits = np.searchsorted(of[at], np.arange(len(block) + 1))
            marks = block.batch.column("marks")
            shared = np.zeros(len(at), bool)
            for i in range(len(block)):
                lo, hi = limits[i], limits[i + 1]
                if hi > lo:
                    shared[lo:hi] = np.isin(grams[lo:hi] & LOW, np.frombuffer(marks[i].as_py(), np.uint64))
            hit = at[shared]
            if not len(hit):
                continue
            others, (ids, keys) = units.hashes(1), _ids(block)
            weight = None if scheme.weights is None else np.concatenate([[0], np.cumsum(scheme.weights(units))])
            if scheme.winnow is not None:
                found, end = scheme.winnow(units, hashes)
                missed = (found >= 0) & ~np.isin(found, hit)
            for which, n in enumerate(scheme.windows):
                reach = n - scheme.gram + 1
                windows = window_hashes(hashes, n)
                whole = window_starts(units.first, n, len(hashes))[: len(windows)]
                if weight is not None and n < scheme.windows[-1]:
                    whole &= (weight[n:] - weight[:-n])[: len(windows)] >= scheme.least
                # a window is compared when a shared fingerprint lies within it, or those of all least windows within it are shared
                if scheme.winnow is not None:
                    here = np.arange(len(windows))
                    for q in range(n):
                        whole &= ~(missed[here + q] & (end[here + q] <= here + n))
                    start = np.flatnonzero(whole)
                else:
                    near = np.zeros(len(hashes) + 1, np.int64)
                    np.add.at(near, np.maximum(hit - reach + 1, 0), 1)
                    np.add.at(near, hit + 1, -1)
                    start = np.flatnonzero((np.cumsum(near)[: len(windows)] > 0) & whole)
                if not len(start):
                    continue
                more = (window_hashes(others, n, 1)[start] >> np.uint64(32)).astype(np.uint32)
                told = (places[start] * len(scheme.windows) + which).astype(np.uint32)
                if held.add(ids[of[start]], keys[of[start]], windows[start], more, told):
                    yield from flush(held)
        if held.size:
            yield from flush(held)

    return run


def _not_first(within: bool, ids: np.ndarray, hashes: np.ndarray, more: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of entries sorted by window, id and place: those that repeat the first of their window."""
    group = runs(hashes, more)
    size = np.diff(np.append(group, len(hashes)))
    later = ids != np.repeat(ids[group], size)
    return later | (places != np.repeat(places[group], size)) if within else later


def _later_windows(within: bool, groups: int):
    def run(table: pa.Table) -> pa.Table:
        owners, marks, sent = [], [], []
        for row in table.select(SENT_NAMES[1:]).to_pylist():
            places = np.frombuffer(row["places"], np.uint32)
            if row["told"]:
                owners.append(owners_of(row))
                marks.append(places)
            else:
                sent.append((owners_of(row), np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["more"], np.uint32), places))
        if sent:
            whose, hashes, more, places = (np.concatenate(c) for c in zip(*sent, strict=True))
            order = np.lexsort((places, whose[:, 0], more, hashes))
            whose, hashes, more, places = whose[order], hashes[order], more[order], places[order]
            later = _not_first(within, whose[:, 0], hashes, more, places)
            owners.append(whose[later])
            marks.append(places[later])
        return _answers(owners, marks, groups)

    return run


def _ask(sent: DataFrame, buckets: int, reducer, kind: type, name: str) -> DataFrame:
    """What the buckets answer, one stored row per text."""
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(reducer, ANSWERS)
    return store(answers.repartition(buckets, "dealt").groupBy("dealt").applyInArrow(_gathered_answers(kind), TOLD), name)


def later_repeats(texts: DataFrame, scheme: Scheme, name: str) -> DataFrame:
    """doc_id, text_key, marks: for each text with later repeats, the places where such windows begin, as 32-bit numbers.

    ``texts`` is of :func:`keyed`.  Texts without an id take no part.
    """
    named = texts.where(F.col("doc_id").isNotNull())
    buckets = buckets_for(named, scheme)
    told = _ask(named.mapInArrow(_send_fingerprints(scheme, buckets), SENT), buckets, _shared_fingerprints(buckets), np.uint64, f"{name}-fingerprints")
    suspects = named.join(told.hint("shuffle_hash"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "marks")
    later = _ask(suspects.mapInArrow(_send_windows(scheme, buckets), SENT), buckets, _later_windows(scheme.within, buckets), np.uint32, f"{name}-later")
    return later


def marked(docs: DataFrame, scheme: Scheme, name: str, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Every text with its id and its marks, null where nothing in it repeats."""
    texts = keyed(docs, id_col, text_col)
    later = later_repeats(texts, scheme, name)
    rows = keyed(docs, id_col, text_col, carry) if carry else texts
    return rows.join(later.hint("shuffle_hash"), ["doc_id", "text_key"], "left").drop("text_key")


def rewritten(docs: DataFrame, scheme: Scheme, name: str, cut, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the texts that ``cut`` leaves, column by column as before, without rows that have no word left."""
    rows = marked(docs, scheme, name, id_col, text_col, carry=True)
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    done = rows.mapInArrow(cut, schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def covered(marks: bytes | None, units: int, *windows: int) -> np.ndarray:
    """Which of a text's units lie under a window that begins at one of ``marks``, told for these lengths of windows."""
    change = np.zeros(units + 1, np.int64)
    at, which = np.divmod(np.unique(np.frombuffer(marks or b"", np.uint32)).astype(np.int64), len(windows))
    end = at + np.array(windows, np.int64)[which]
    at, end = at[end <= units], end[end <= units]
    np.add.at(change, at, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:units] > 0
