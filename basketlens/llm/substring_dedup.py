"""Removing word sequences that an earlier document has, found by difference-cover anchors.

Anchors are runs of ``GRAM`` words hashed only where the word number modulo ``PERIOD`` is in the cover.  The cover's
differences give every residue, so for any two places there is a shift below the period that brings both onto
the cover: two equal stretches of ``GRAM + PERIOD - 1`` words share an anchor at the same offset, wherever they stand.  Three of
seven words begin an anchor instead of all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basketlens.llm.shared import blocks, documents, words
from basketlens.llm.spans import Scheme, covered, marked, rewritten

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
GRAM = WINDOW - PERIOD + 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))

RESULT = "doc_id long, text string, n_words long, n_removed long"


def on_cover(first: np.ndarray, grams: np.ndarray, places: np.ndarray) -> np.ndarray:
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    return in_cover[places % PERIOD]


SCHEME = Scheme(units=words, windows=(WINDOW,), gram=GRAM, fingerprints=on_cover, within=False, per_byte=len(COVER) / PERIOD / 6)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        marks = block.batch.column("marks").to_pylist()
        texts, n, gone = [], [], []
        for i in range(len(block)):
            found = WORD.findall(block.text(i))
            out = covered(marks[i], len(found), WINDOW)
            if out.any():
                found = [w for w, o in zip(found, out, strict=True) if not o]
            texts.append(b" ".join(found))
            n.append(len(out))
            gone.append(int(out.sum()))
        yield pa.RecordBatch.from_arrays(
            [block.batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
            names=["doc_id", "text", "n_words", "n_removed"],
        )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (the kept words, joined by one space), n_words, n_removed for every document.

    A word goes when a window of 13 words over it also begins in a document with a smaller id; windows are those of the input.
    Null and empty texts have no words; texts below 13 words stay.  Of equal texts the smallest id keeps its words, and
    rows with the same id take nothing from each other.  A document without an id stays as it is and takes nothing.  No rows
    give no rows.  Other columns are not read.
    """
    return marked(docs, SCHEME, "words", id_col, text_col).mapInArrow(_cut, RESULT)


def _cut_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        marks = block.batch.column("marks").to_pylist()
        texts = []
        for i in range(len(block)):
            text = block.text(i)
            if marks[i]:
                spans = [m.span() for m in WORD.finditer(text)]
                out = covered(marks[i], len(spans), WINDOW)
                limits = [s for s, _ in spans] + [len(text)]
                # a word goes with the white space after it
                text = text[: limits[0]] + b"".join(text[limits[k] : limits[k + 1]] for k in np.flatnonzero(~out))
            texts.append(text)
        yield pa.RecordBatch.from_arrays([block.batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that :func:`without_repeats` removes; white space between kept words stays, wordless rows go."""
    return rewritten(docs, SCHEME, "words", _cut_in_place, id_col, text_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        digests = [hashlib.sha256(t.as_py().encode("utf-8")).hexdigest() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return marked(documents(spark, folder), SCHEME, "words", "doc_id", "text").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = """
with d as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+') if x <> ''] as w from documents),
u as materialized (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
g as (select doc_id, i, string_agg(x, ' ') over o as g, count(*) over o as n from u window o as (partition by doc_id order by i rows between current row and 12 following)),
hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as m from g where n = 13) where m < doc_id),
gone as (select distinct doc_id, i + k as i from hit, range(0, 13) r(k)),
k as (select u.doc_id, count(*) filter (where gone.i is not null) as n_removed, string_agg(x, ' ' order by u.i) filter (where gone.i is null) as kept
  from u left join gone on gone.doc_id = u.doc_id and gone.i = u.i group by u.doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""
