"""Removing lines and runs of lines that stood before, found by winnowing.

The lines of a text that hold a word are its units.  A run of lines counts when it has ``LEAST_WORDS`` words, however few its
lines, or ``RUN`` lines, however short.  A winnowing window is the shortest run from a line on that counts: a long line is one by itself,
short lines are taken together.  Of each window the line with the least hash is a fingerprint.  Equal runs that count begin with
equal windows, which have their least hash at the same place, so they share a fingerprint.  Around shared fingerprints, runs
are extended and compared as a whole: those of one to ``RUN`` lines that count and whose windows all have shared
fingerprints; overlapping ones make longer runs.  Of equal runs the first stays, by document id and then by place.  What
stays though it stood before is a single line, or a pair, of fewer than ``LEAST_WORDS`` words ("Yes.", a bracket, a one-word
heading), as it says little about its origin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basketlens.llm.shared import SEPARATOR, Block, Words, blocks, documents, lines
from basketlens.llm.spans import Scheme, covered, marked, rewritten

RUN = 3
LENGTHS = tuple(range(1, RUN + 1))
LEAST_WORDS = 5
# A script without spaces has a word for so many bytes.
WORD_BYTES = 8

RESULT = "doc_id long, text string, n_lines long, n_removed long"


def lines_with_words(block: Block) -> Words:
    every = lines(block)
    full = np.concatenate([[0], np.cumsum(~SEPARATOR[block.data])])
    has = full[every.ends] > full[every.starts]
    kept = np.concatenate([[0], np.cumsum(has)])
    return Words(every.data, every.starts[has], every.ends[has], kept[every.first])


def words_per_line(units: Words) -> np.ndarray:
    """The words of each line, or one for ``WORD_BYTES`` bytes of them where that is more."""
    inside = ~SEPARATOR[units.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[units.starts] = inside[units.starts]  # the byte before may be of another text
    count, size = (np.concatenate([[0], np.cumsum(x)]) for x in (begins, inside))
    return np.maximum(count[units.ends] - count[units.starts], (size[units.ends] - size[units.starts]) // WORD_BYTES)


def winnow(units: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the line with the least hash in the shortest run from it that counts (-1 where none does), and where that run ends."""
    n = len(hashes)
    here = np.arange(n)
    limit = np.repeat(units.first[1:], np.diff(units.first))
    weight = words_per_line(units)
    total, least = weight.copy(), here.copy()
    chosen, end = np.full(n, -1, np.int64), here.copy()
    for size in range(1, RUN + 1):
        fits = here + size <= limit
        if size > 1:
            last = np.minimum(here + size - 1, max(n - 1, 0))
            least = np.where(fits & (hashes[last] < hashes[least]), last, least)
            total = total + weight[last]
        counts = (chosen < 0) & fits & ((total >= LEAST_WORDS) | (size == RUN))
        chosen[counts], end[counts] = least[counts], here[counts] + size
    return chosen, end


SCHEME = Scheme(units=lines_with_words, windows=LENGTHS, gram=1, fingerprints=None, within=True, per_byte=1 / 40, winnow=winnow, weights=words_per_line, least=LEAST_WORDS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        marks = block.batch.column("marks").to_pylist()
        units = lines_with_words(block)
        texts, n, gone = [], [], []
        for i in range(len(block)):
            text, lo, hi = block.text(i), units.first[i], units.first[i + 1]
            out = covered(marks[i], hi - lo, *LENGTHS)
            if out.any():
                # a line goes with the line feeds and empty lines up to the next line with a word
                begins = units.starts[lo:hi] - block.offsets[i]
                limits = np.append(begins, len(text))
                text = text[: begins[0]] + b"".join(text[limits[k] : limits[k + 1]] for k in np.flatnonzero(~out))
                if out[-1]:
                    text = text.rstrip(b"\n")
            texts.append(text)
            n.append(int(hi - lo))
            gone.append(int(out.sum()))
        rest = [c for c in block.batch.schema.names if c in ("doc_id", "row")]
        yield pa.RecordBatch.from_arrays(
            [*(block.batch.column(c) for c in rest), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
            names=[*rest, "text", "n_lines", "n_removed"],
        )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_lines (with a word), n_removed for every document.

    Lines go when they are part of a run of lines with words that an earlier document, or the same one further up, also has, and
    the run has at least ``LEAST_WORDS`` words (a single line may) or at least ``RUN`` lines; empty lines between are no part of the comparison and go with the line before them.  Null and empty texts
    have no lines.  Of equal texts the smallest id keeps its lines; rows with the same id take nothing from each other at the
    same place.  A document without an id stays as it is.  No rows give no rows.  Other columns are not read.
    """
    return marked(docs, SCHEME, "lines", id_col, text_col).mapInArrow(_cut, RESULT)


def _cut_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        yield batch.select(["row", "text"])


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that :func:`without_repeated_lines` removes; rows without a word left go."""
    return rewritten(docs, SCHEME, "lines", _cut_in_place, id_col, text_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        digests = [hashlib.sha256(t.as_py().encode("utf-8")).hexdigest() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_removed"), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return marked(documents(spark, folder), SCHEME, "lines", "doc_id", "text").mapInArrow(_digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
