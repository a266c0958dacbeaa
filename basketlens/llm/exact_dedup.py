"""Exact duplicates by a tree of merges of sorted digest runs.

Each partition of the input becomes a run of (digest, kept id, rows), sorted by digest and with one row per
digest.  Runs then meet in rounds.  Writing run numbers and a cell number taken from the digest in base 8, round
r gives every row to the run whose r-th digit is the cell's: a hypercube exchange, three binomial rounds at a time,
so that eight partners swap parts of their runs.  What meets is sorted and merged in one streaming pass that keeps
one row per digest: the wanted id and the sum of the rows.  After the last round a run holds one cell, whole.

A digest that a third of all documents share is one row per run from the start, and an eighth of that
after each round.  The answer goes back the same way: to (run, digest), at most one row per run, and from there to
the documents of that run, so that no join key gathers more than one run's rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.shared import blocks, documents, id_and_text, shuffle_partitions, store

A_TO_Z = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
RADIX_BITS = 3

DIGESTS = "doc_id long, digest binary, n_bytes long, run int"
RUNS = "run int, digest binary, n_bytes long, keep long, n long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = TaskContext.get().partitionId()
    for block in blocks(batches):
        texts = [block.text(i).translate(A_TO_Z) for i in range(len(block))]
        yield pa.RecordBatch.from_arrays(
            [
                block.batch.column("doc_id").cast(pa.int64()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(np.full(len(texts), run, np.int32)),
            ],
            names=["doc_id", "digest", "n_bytes", "run"],
        )


def _merger(smallest: bool):
    """One streaming pass over rows sorted by (run, digest, n_bytes): equal neighbours become one row."""
    better = np.minimum if smallest else np.maximum

    def fold(table: pa.RecordBatch) -> pa.RecordBatch:
        changed = np.zeros(table.num_rows, bool)
        changed[0] = True
        for name in ("run", "digest", "n_bytes"):
            c = table.column(name)
            changed[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(changed)
        keep = better.reduceat(table.column("keep").to_numpy(zero_copy_only=False), at)
        n = np.add.reduceat(table.column("n").to_numpy(zero_copy_only=False), at)
        firsts = table.select(["run", "digest", "n_bytes"]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*firsts.columns, pa.array(keep, pa.int64()), pa.array(n, pa.int64())], names=table.schema.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            folded = fold(batch)
            held = folded.slice(folded.num_rows - 1)  # its digest may go on in the next batch
            if folded.num_rows > 1:
                yield folded.slice(0, folded.num_rows - 1)
        if held is not None:
            yield held

    return merge


def _merge_runs(rows: DataFrame, smallest: bool, partitions: int) -> DataFrame:
    return (
        rows.repartition(partitions, "run")
        .sortWithinPartitions("run", "digest", "n_bytes")
        .select("run", "digest", "n_bytes", "keep", "n")
        .mapInArrow(_merger(smallest), RUNS)
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document.

    Texts are equal when they are after lower-casing A-Z only; equality is that of SHA-256 and length.  Of equal
    texts the ``largest`` (or ``smallest``) id stays.  Null text is empty, empty texts are equal to each other, rows with
    the same id are separate rows of a group, no rows give no rows, and other columns are not read.  Ids are integers; a row
    without one counts in its group and stays only where no row of the group has one.
    """
    spark = docs.sparkSession
    no_id = F.lit((1 << 63) - 1 if keep == "smallest" else -(1 << 63)).cast("long")  # loses against every id
    smallest, partitions = keep == "smallest", shuffle_partitions(spark)
    digests = store(id_and_text(docs, id_col, text_col).mapInArrow(_digests, DIGESTS), "digests")
    runs = int(digests.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0])
    rounds = math.ceil(round(math.log2(runs), 9) / RADIX_BITS)
    cells = 1 << RADIX_BITS * rounds

    start = store(_merge_runs(digests.select("run", "digest", "n_bytes", F.coalesce("doc_id", no_id).alias("keep"), F.lit(1).cast("long").alias("n")), smallest, partitions), "runs")
    level = start
    for r in range(rounds):
        bits = ((1 << RADIX_BITS) - 1) << RADIX_BITS * r
        cell = F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int")
        owner = F.col("run").bitwiseAND(F.lit(~bits)).bitwiseOR(cell.bitwiseAND(F.lit(bits)))
        level = _merge_runs(level.withColumn("run", owner), smallest, partitions)
    whole = level.select("digest", "n_bytes", F.nullif(F.col("keep"), no_id).alias("keep_id"), F.col("n").alias("group_size"))

    per_run = start.select("run", "digest", "n_bytes").join(whole, ["digest", "n_bytes"])
    return digests.join(per_run, ["run", "digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)
"""
