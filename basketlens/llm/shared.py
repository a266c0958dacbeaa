"""What the operators of this folder share: tables, stored stages, texts as byte blocks, word and window hashes.

Words are the maximal runs of bytes other than space and \\t \\n \\v \\f \\r.  In UTF-8 these six are single
bytes, so a block of texts is split without decoding.  All hashes are computed for a whole block at once: a
polynomial over the bytes (or over the mixed word hashes) as differences of a running sum modulo 2**64.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.plans.stage import write_stage

# Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20

# Fixed odd multipliers: two for bytes, two for words; the pairs give independent hashes.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per session, in case it is not installed there."""
    context = spark.sparkContext
    if getattr(context, "_basketlens_archive", None):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context._basketlens_archive = held = tempfile.TemporaryDirectory()  # until the driver ends; executors fetch from it
    context.addPyFile(shutil.make_archive(os.path.join(held.name, "basketlens"), "zip", os.path.dirname(package), os.path.basename(package)))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


# Drops a query's shuffle files when it ends; otherwise they stay until the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage ends here and lost executors lose nothing."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return write_stage(df, f"llm-{name}")
    finally:
        conf.set(CLEAN_UP, before)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, whatever else the table holds; null text is empty."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Block:
    """Some rows of a batch, with the bytes of their texts."""

    batch: pa.RecordBatch
    data: np.ndarray  # uint8, of all texts
    offsets: np.ndarray  # int64, one more than rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut Arrow batches into blocks of about ``size`` bytes of text; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        array = batch.column(at).cast(pa.large_binary())
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        held = array.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield Block(batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
            begin = end


@dataclass
class Words:
    """Word limits in a block's bytes; ``first[i]`` is the number of the first word of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, which)


def words(block: Block, lower: bool = False) -> Words:
    data = LOWER[block.data] if lower else block.data
    inside = ~SEPARATOR[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(block) + 1, np.int64))
    edge = np.zeros(len(data) + 1, bool)  # a word also ends where its text ends
    edge[block.offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, block.offsets))


def lines(block: Block) -> Words:
    """As :func:`words`, for the lines of each text between line feeds, empty ones included; an empty text has none."""
    feeds = np.flatnonzero(block.data == 10)
    begin, full = block.offsets[:-1], np.diff(block.offsets) > 0
    starts = np.sort(np.concatenate([begin[full], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([block.offsets[1:][full], feeds]), kind="stable")
    # a text's line count is its feeds and one
    count = np.where(full, np.diff(np.searchsorted(feeds, block.offsets)) + 1, 0)
    return Words(block.data, starts, ends, np.concatenate([[0], np.cumsum(count)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of a base and of its inverse; a worker holds one pair of arrays per base."""

    def row(b: int, n: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    held = _POWERS.get(base)
    if held is None or len(held[0]) < size:
        n = -(-size // (1 << 18)) << 18
        held = row(base, n), row(pow(base, -1, 1 << 64), n)
        if n <= 4 * BLOCK_BYTES:  # those of a very long text are not kept
            _POWERS[base] = held
    return held


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span."""
    up, down = powers(BYTE_BASES[which], len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(units: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every k consecutive units; the one at i covers units i to i+k-1."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(WORD_BASES[which], len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + np.uint64(k))


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """True where k consecutive units from here lie within one text."""
    ok = np.ones(max(total, 0), bool)
    for back in range(1, k):
        at = first[1:] - back
        ok[at[(at >= 0)]] = False
    return ok
