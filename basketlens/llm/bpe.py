"""Byte-level BPE with tiktoken: encoding of whole texts by a local rank file, and decoding to raw bytes.

The rank file is read once per Python worker.  Long texts are cut before encoding, only at spaces that stand between
two characters that are not white space: there one match of the pre-splitting pattern always ends and the next
begins, so the ids of the parts are the ids of the text.  A text without such a place is one part, and a stretch of white space
too long for the pattern's engine is cut as the pattern would match it: all but its last character are one match.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basketlens.llm.shared import blocks, documents, id_and_text

PART_CHARS = 1 << 16
SAFE = re.compile(r"(?<=\S) (?=\S)")
# White space as the pattern has it.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_WHITE = 1000
ENCODED = "doc_id long, ids binary, n_tokens long"


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """The text in parts that begin at safe places, each at least ``limit`` long but the last."""
    begin = 0
    while len(text) - begin > limit:
        cut = SAFE.search(text, begin + limit)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def around_white(text: str, enc, limit: int = LONG_WHITE) -> list[int]:
    """Ids of a text whose stretches of white space over ``limit`` are matched here: whole at the text's end, else without the last character."""
    ids, begin = [], 0
    for m in re.finditer(f"{WHITE}{{{limit},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc.encode_ordinary(text[begin : m.start()]) + enc._encode_single_piece(text[m.start() : end].encode("utf-8"))
        begin = end
    return ids + enc.encode_ordinary(text[begin:])


def _part_ids(text: str, enc) -> list[int]:
    try:
        return enc.encode_ordinary(text)
    except ValueError:  # the pattern's engine gave up
        return around_white(text, enc)


def encode(text: str, enc) -> np.ndarray:
    return np.concatenate([np.asarray(_part_ids(p, enc), "<u4") for p in parts(text)])


def _encoder(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for block in blocks(batches):
            ids = [encode(block.text(i).decode("utf-8"), enc) for i in range(len(block))]
            yield pa.RecordBatch.from_arrays(
                [block.batch.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())],
                names=["doc_id", "ids", "n_tokens"],
            )

    return run


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (unsigned little-endian 32-bit integers), n_tokens for every document.

    Null and empty texts have no ids.  Texts of any length are encoded whole; repeated ids, ties and repeated rows are
    encoded row by row; no rows give no rows; other columns are not read.  The strings of special tokens are
    ordinary text.  ``rank_file`` must be readable at this path on every executor.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_encoder(rank_file, pattern), ENCODED)


def decode_bytes(ids: bytes, enc) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _decoder(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [decode_bytes(x, enc) if x is not None else None for x in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return run


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the raw bytes of the ids, which need not be whole characters.  Null ids give null, no ids give no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(rank_file, pattern), "doc_id long, bytes binary")


def _digester(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = some.column("ids").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        some.column("n_tokens"),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(decode_bytes(x, enc)).hexdigest() for x in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def round_trip_digests(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_digester(rank_file, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return round_trip_digests(encode_texts(documents(spark, folder), path, pattern), path, pattern)
