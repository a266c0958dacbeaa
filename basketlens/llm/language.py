"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A text is lower-cased and everything but letters becomes a space.  Its subwords are the 3- and 4-byte pieces within
words, a leading or trailing space included; each is hashed to one of ``BUCKETS`` rows of an embedding table.  A text's vector
is the mean of its subwords' embeddings, and a linear softmax gives the languages.  Both are trained by
stochastic gradient descent in numpy on a sample whose size per language is a parameter.

A fifth of the sample trains nothing: on it a temperature is fitted, so that the score is a probability,
and the least score at which the accepted texts are right as often as wanted; below it a prediction is marked as rejected.

Once trained, embedding and softmax are one table of a number per bucket and language, so a whole text of any
length is scored by looking up and averaging.  The table's size depends on the languages only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.shared import blocks, documents

BUCKETS = 1 << 16
DIMENSIONS = 16
ROWS_PER_LANGUAGE = 1000
EPOCHS = 8
RATE = 40.0
WANTED_PRECISION = 0.99
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[97:123] = True
LETTER_BYTE[128:] = True


def has_letter(text: str) -> bool:
    """Some characters that are neither digits nor marks, such as a superscript two, are no letters either."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the texts in turn, and how many each text has."""
    raw = [b" " + t.lower().encode("utf-8") + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    letter = LETTER_BYTE[data]
    data = np.where(letter, data, 32).astype(np.uint32)
    found = []
    for n in (3, 4):
        if len(data) < n:
            continue
        code = data[: len(data) - n + 1].copy()
        inner = np.ones(len(code), bool)
        for k in range(1, n):
            code |= data[k : k + len(code)] << np.uint32(8 * k)
            if k < n - 1:
                inner &= letter[k : k + len(code)]
        at = np.flatnonzero(inner)
        bucket = (code[at] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(16)
        found.append((at, bucket))
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    counts = [np.diff(np.searchsorted(at, np.concatenate([[0], ends]))) for at, _ in found]
    total = sum(counts)
    out = np.empty(int(total.sum()), np.int64)
    first = np.concatenate([[0], np.cumsum(total)])[:-1]
    for (_, bucket), count in zip(found, counts, strict=True):
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        out[np.arange(len(bucket)) + np.repeat(first - begin, count)] = bucket
        first = first + count
    return out, total


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        buckets, counts = subwords([block.text(i).decode("utf-8") for i in range(len(block))])
        rows = [np.unique(x, return_counts=True) for x in np.split(buckets, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays(
            [
                *(block.batch.column(c) for c in ("doc_id", "lang")),
                pa.array([b.astype("<i4").tobytes() for b, _ in rows], pa.binary()),
                pa.array([n.astype("<i4").tobytes() for _, n in rows], pa.binary()),
            ],
            names=["doc_id", "lang", "buckets", "counts"],
        )


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # float32, buckets x languages
    bias: np.ndarray
    temperature: float
    least_score: float

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of texts whose subwords follow each other."""
        sums = np.zeros((len(counts), len(self.languages)))
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            sums[some] = np.add.reduceat(self.table[buckets], starts, axis=0, dtype=np.float64)
        return sums / np.maximum(counts, 1)[:, None] + self.bias


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, precision: float = WANTED_PRECISION, seed: int = 7) -> Model:
    """Fit on (language, buckets, counts); every fifth text only calibrates."""
    languages = sorted({x[0] for x in sample})
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    held = np.arange(len(sample)) % 5 == 4
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    shares = [(n / max(n.sum(), 1)).astype(np.float32) for _, _, n in sample]
    train_rows = np.flatnonzero(~held)
    steps, step = epochs * len(train_rows), 0
    for _ in range(epochs):
        for i in rng.permutation(train_rows):
            lang, buckets, _ = sample[i]
            now = rate * (1 - step / steps)
            step += 1
            vector = shares[i] @ embedding[buckets]
            error = softmax(vector @ weight + bias)
            error[number[lang]] -= 1
            back = weight @ error
            weight -= 0.02 * now * np.outer(vector, error)
            bias -= 0.0005 * now * error
            embedding[buckets] -= now * 0.25 * np.outer(shares[i], back)
    table = (embedding @ weight).astype(np.float32)
    model = Model(languages, table, bias.astype(np.float64), 1.0, 0.0)

    check = [x for x, h in zip(sample, held, strict=True) if h] or sample
    logits = np.array([(n / max(n.sum(), 1)) @ table[b] + bias for _, b, n in check])
    truth = np.array([number[x[0]] for x in check])
    # targets a little below 1, as if one more text had been wrong, so that no finite sample makes the score certain
    target = np.full(logits.shape, 1 / ((len(truth) + 2) * max(len(languages) - 1, 1)))
    target[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    loss = {t: -(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in np.geomspace(0.05, 20, 61)}
    model.temperature = float(min(loss, key=loss.get))
    p = softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    model.least_score = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def held_out(id_col: Column) -> Column:
    """Documents kept out of training by the contract of the registered query."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, **options) -> Model | None:
    """A model from doc_id, text and lang, or None where no row has both a text and a lang.

    About ``rows_per_language`` rows of each language are used, chosen by a hash of the id, so the driver gets as many
    subword counts at most whatever the size of the corpus; languages are as many as ``lang`` has values.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    rows = chosen.select("doc_id", "lang", "text").mapInArrow(_features, "doc_id long, lang string, buckets binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, -1 if r.doc_id is None else r.doc_id, r.buckets, r.counts))
    sample = [(r.lang, np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4")) for r in rows]
    sample = [x for x in sample if len(x[1])]
    return train(sample, **options) if sample else None


def _predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [block.text(i).decode("utf-8") for i in range(len(block))]
            known = np.array([has_letter(t) for t in texts])
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            names = [UNKNOWN]
            if model is None:
                known[:] = False
            else:
                p = softmax(model.logits(*subwords(texts)) / model.temperature)
                best, score, names = p.argmax(axis=1), np.minimum(p.max(axis=1), 1.0), model.languages
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column("doc_id").cast(pa.int64()),
                    pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(known & (score >= (model.least_score if model else 0.0))),
                ],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted for every document.

    Null, empty and letterless texts are ``und`` with score 0 and not accepted, as is everything without a model.  Other
    texts get a learned language, read whole; ``accepted`` is false where the score is too low to be trusted.  Equal
    texts get equal rows; no rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double, accepted boolean")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
