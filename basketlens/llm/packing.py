"""Packing token pieces into sequences by bin completion.

Texts become pieces of at most ``capacity`` tokens.  How many pieces there are of each length is a table of at most
``capacity`` rows, whatever the size of the corpus, and all that the search needs: it works on lengths with counts and returns
fillings with repeats.  The pieces themselves never leave the executors: each finds its place from its rank among
the pieces of its length.

Search.  The largest length left must go somewhere, so fillings are listed around it.  A filling is dominated when a
length that is left over would fit in its gap, alone or in place of a smaller one it holds; only undominated
ones matter.  The first incumbent takes, for the largest length, the filling with the least waste that uses the larger lengths
first (found by subset sums held as bits), as often as the counts allow.  Unless it is at the lower bound, branch and bound follows, on
fillings with repeats: a branch is a filling and how often, so the cost does not depend on the number of sequences.  Fillings are
listed best first, as far as a branch may go, and the search allows one step away from the best filling on a path, then two, four
and so on.  A branch ends when the sequences so far and the least number for the rest, by its tokens and by its large
pieces, cannot beat the incumbent.  The wasteful sequences of the incumbent are searched first, by themselves, and then all lengths.  Each
search stops at its lower bound, at its end, or after ``MOST_STEPS`` fillings listed, with the incumbent.
"""

from __future__ import annotations

import json
import logging
import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.bpe import parts
from basketlens.llm.shared import blocks, documents, id_and_text, shuffle_partitions, store

CAPACITY = 2048
MOST_STEPS = 20_000

# Fixed value: how byte-level tokenizers split a text before they merge.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

# A filling: ((length, how many), ...) from the largest length down, and how many sequences are filled so.
Filling = tuple[tuple[int, int], ...]


# ---------------------------------------------------------------- search on lengths with counts


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by all tokens, and for each k by the pieces too large to share a sequence with one of k."""
    lengths = np.array(sorted(x for x, n in counts.items() if n), np.int64)
    if not len(lengths):
        return 0
    number = np.array([counts[x] for x in lengths.tolist()], np.int64)
    pieces, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (number, number * lengths))
    half = np.searchsorted(lengths, capacity // 2, side="right")
    ks = np.append(lengths[:half], capacity // 2 + 1)
    alone = np.searchsorted(lengths, capacity - ks, side="right").clip(min=half)
    small = tokens[half] - tokens[np.searchsorted(lengths, ks).clip(max=half)]
    room = (pieces[alone] - pieces[half]) * capacity - (tokens[alone] - tokens[half])
    by_size = pieces[-1] - pieces[half] + np.maximum(0, -(-(small - room) // capacity))
    return int(max(-(-tokens[-1] // capacity), by_size.max()))


def reachable(counts: dict[int, int], lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """The lengths up to ``room``, ascending as ``lengths`` do, and at i the sums, as bits, of the i smallest of them."""
    mask = (1 << room + 1) - 1
    reach = [1]
    usable = lengths[: bisect_right(lengths, room)]
    for x in usable:
        bits, left, step = reach[-1], min(counts[x], room // x), 1
        while left:  # a bounded number of copies, by doubling
            step = min(step, left)
            bits |= bits << step * x & mask
            left -= step
            step *= 2
        reach.append(bits)
    return usable, reach


def fillings_of(counts: dict[int, int], usable: list[int], reach: list[int], target: int, upto: int | None = None) -> Iterator[Filling]:
    """All fillings of this sum, as many of the larger lengths first as still leave a sum of smaller ones."""
    if not target:
        yield ()
        return
    for i in range((len(usable) if upto is None else upto) - 1, -1, -1):
        x = usable[i]
        for n in range(min(counts[x], target // x), 0, -1):
            if reach[i] >> target - n * x & 1:
                for rest in fillings_of(counts, usable, reach, target - n * x, i):
                    yield ((x, n), *rest)
        if not reach[i] >> target & 1:
            return


def least_waste_filling(counts: dict[int, int], lengths: list[int], room: int) -> Filling:
    """The fullest filling of ``room``, larger lengths first; ``lengths`` ascend."""
    usable, reach = reachable(counts, lengths, room)
    return next(fillings_of(counts, usable, reach, reach[-1].bit_length() - 1))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """The first incumbent: fillings with repeats that use every piece."""
    left, out = {x: n for x, n in counts.items() if n > 0}, []
    lengths = sorted(left)
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        rest = least_waste_filling(left, lengths, capacity - top)
        left[top] += 1
        held = Counter({top: 1})
        for x, n in rest:
            held[x] += n
        repeats = min(left[x] // n for x, n in held.items())
        for x, n in held.items():
            left[x] -= n * repeats
        lengths = [x for x in lengths if left[x]]
        out.append((tuple(sorted(held.items(), reverse=True)), repeats))
    return out


@dataclass
class Node:
    """A place on the path: sequences before it, steps away that are left, what may be taken next, and what is taken."""

    done: int
    away: int
    options: list[tuple[Filling, int]]
    at: int = 0
    taken: tuple[Filling, int] | None = None


class Search:
    """Branch and bound over fillings with repeats, within a number of steps; each filling listed is one."""

    def __init__(self, counts: dict[int, int], capacity: int, limit: int, most: int):
        self.left, self.capacity, self.limit, self.steps = {x: counts[x] for x in sorted(counts) if counts[x]}, capacity, limit, most
        self.bound = least_sequences(counts, capacity)
        self.best: list[tuple[Filling, int]] | None = None
        self.seen: dict[int, tuple[int, int]] = {}
        self.cut = False

    def undominated(self, top: int, lengths: list[int]) -> Iterator[Filling]:
        """Fillings around ``top`` that no single swap or addition improves, the fullest first."""
        left, room = self.left, self.capacity - top
        left[top] -= 1
        usable, reach = reachable(left, lengths, room)

        def spare(held: dict[int, int], low: int, high: int) -> bool:
            return any(left[x] > held.get(x, 0) for x in usable[bisect_right(usable, low) : bisect_right(usable, high)])

        try:
            for target in range(reach[-1].bit_length() - 1, -1, -1):
                if reach[-1] >> target & 1:
                    gap = room - target
                    for filling in fillings_of(left, usable, reach, target):
                        self.steps -= 1
                        if self.steps < 0:
                            return
                        held = dict(filling)
                        if not gap or not (spare(held, 0, gap) or any(spare(held, y, y + gap) for y in held)):
                            yield filling
        finally:
            left[top] += 1

    def options(self) -> Iterator[tuple[Filling, int]]:
        """Fillings around the largest length left, as often as the counts allow; half as often and once come after the next filling."""
        lengths = [x for x, n in self.left.items() if n]
        top, later = lengths[-1], []
        for rest in self.undominated(top, lengths):
            held = Counter(dict(rest))
            held[top] += 1
            filling = tuple(sorted(held.items(), reverse=True))
            # the generator holds one piece of the largest length
            most = min((self.left[x] + (x == top)) // n for x, n in filling)
            yield filling, most
            yield from later
            later = [(filling, r) for r in sorted({most // 2, 1} - {0, most}, reverse=True)]
        yield from later

    def node(self, done: int, away: int) -> Node:
        found = self.options()
        options = list(islice(found, away + 2))
        found.close()
        self.cut = self.cut or len(options) > away + 1
        return Node(done, away, options[: away + 1])

    def take(self, taken: tuple[Filling, int], sign: int) -> None:
        for x, n in taken[0]:
            self.left[x] -= sign * n * taken[1]

    def dive(self, away: int) -> None:
        """All paths that leave the best options by no more than ``away`` in sum, where the next best is one away."""
        self.seen.clear()
        self.cut = False
        path = [self.node(0, away)]
        while path:
            node = path[-1]
            if node.taken:
                self.take(node.taken, -1)
                node.taken = None
            if node.at == len(node.options) or self.steps < 0 or self.limit <= self.bound:
                path.pop()
                continue
            node.taken, left = node.options[node.at], node.away - node.at
            node.at += 1
            self.take(node.taken, 1)
            done = node.done + node.taken[1]
            rest = {x: n for x, n in self.left.items() if n}
            if done + least_sequences(rest, self.capacity) >= self.limit:
                continue
            if not rest:
                self.best, self.limit = [x.taken for x in path], done
                continue
            key = hash(tuple(self.left.values()))
            before = self.seen.get(key)
            if before and before[0] <= done and before[1] >= left:
                continue
            self.seen[key] = done, left
            path.append(self.node(done, left))


def complete(counts: dict[int, int], capacity: int, limit: int, most: int) -> list[tuple[Filling, int]] | None:
    """Fillings with repeats for all pieces, fewer sequences than ``limit``, or None where the search found none."""
    search, away = Search(counts, capacity, limit, most), 1
    while search.limit > search.bound:
        search.dive(away)
        if search.steps < 0 or not search.cut:
            break
        away *= 2
    return search.best


def fillings(counts: dict[int, int], capacity: int, most: int = MOST_STEPS) -> list[tuple[Filling, int]]:
    """Fillings with repeats that hold every piece once, in as few sequences as the search finds."""
    plan = best_fit(counts, capacity)
    bound = least_sequences(counts, capacity)
    full = [(f, r) for f, r in plan if sum(x * n for x, n in f) == capacity]
    for settled in (full, []) if full else ([],):
        used = sum(r for _, r in plan)
        if used <= bound:
            break
        pieces = Counter(counts)
        for f, r in settled:
            for x, n in f:
                pieces[x] -= n * r
        found = complete(pieces, capacity, used - sum(r for _, r in settled), most)
        if found is not None:
            again: Counter = Counter()
            for f, r in settled + found:
                again[f] += r
            plan = list(again.items())
    return plan


# ---------------------------------------------------------------- token pieces


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else the next above U+00FF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def ranked(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks of tokens, and the special tokens, of a tokenizer file that is a plain byte-level BPE with merges in the order of ids."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, pre, added = held["model"], held.get("pre_tokenizer") or {}, held.get("added_tokens") or []
    plain = (
        model.get("type") == "BPE"
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        and not any(held.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    vocabulary, special = model["vocab"], {t["content"]: t["id"] for t in added}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    letters = byte_alphabet()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    singles = [ranks.get(bytes([b])) for b in range(256)]
    in_order = None not in singles and merged == sorted(set(merged)) and len(merged) + 256 == len(ranks) and max(singles) < merged[0]
    return (ranks, special) if in_order else None


class Encoder:
    """Token ids of texts as the tokenizers library gives them for a file, as little-endian 32-bit integers.

    A plain byte-level BPE is run by tiktoken, which knows the same merges by the ranks of their results and takes half the time; the strings
    of special tokens are these tokens.  Long texts are cut at safe spaces.  Any other file, and a text whose white space
    is too long for tiktoken's pattern, goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        found = ranked(path)
        self.ranks = found and tiktoken.Encoding("local", pat_str=BYTE_LEVEL, mergeable_ranks=found[0], special_tokens=found[1])

    @cached_property
    def tokenizer(self):
        """Only loaded where it is needed."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if self.ranks:
            try:
                return b"".join([self.ranks.encode_to_numpy(p, allowed_special="all").astype("<u4", copy=False).tobytes() for p in parts(text)])
            except ValueError:
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(texts: list[str], path: str) -> list[bytes]:
    encode = _encoder(path).encode
    return [encode(t) for t in texts]


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a text's pieces: whole ones, but the first of a longer text."""
    first = (tokens - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, tokens, capacity)]


def _cutter(path: str, end_id: int, capacity: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [block.text(i).decode("utf-8") for i in range(len(block))]
            ids = [x + end for x in token_ids(texts, path)]
            rows = [(i, p, s, n, zlib.crc32(x[4 * s : 4 * (s + n)])) for i, x in enumerate(ids) for p, (s, n) in enumerate(cut(len(x) // 4, capacity))]
            of, piece, start, length, crc = (np.array(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [block.batch.column("doc_id").cast(pa.int64()).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and ``end_id``; only longer ones are cut."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_cutter(tokenizer_file, end_id, capacity), PIECES)


# ---------------------------------------------------------------- places


def _placer(plan: list[tuple[Filling, int]]):
    """Where the piece of a given length and rank goes.  One entry per filling and length, at most some ten thousand."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for filling, repeats in plan:
        offset = 0
        for length, n in filling:
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * repeats
            offset += length * n
        sequence += repeats
    rows.sort()
    length, rank, each, base, offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = np.searchsorted(length, np.arange(length[-1] + 2 if len(length) else 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("length").to_numpy()
            r = batch.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                here = n == x
                lo, hi = spans[x], spans[x + 1]
                at[here] = lo + np.searchsorted(rank[lo:hi], r[here], side="right") - 1
            copy, slot = np.divmod(r - rank[at], each[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(base[at] + copy), pa.array(offset[at] + slot * n)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset; offsets of a sequence have no gaps.

    Ranks within a length are counted in small groups, by a hash of the piece, so that a length that a third of all pieces
    have is spread over as many tasks as the rest.
    """
    spark = pieces.sparkSession
    stored = store(pieces, "pieces")
    counts = {int(r[0]): int(r[1]) for r in stored.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = fillings(counts, capacity)
    logging.getLogger(__name__).info("%d sequences, at least %d are needed", sum(r for _, r in plan), least_sequences(counts, capacity))
    share = max(1, sum(counts.values()) // (4 * shuffle_partitions(spark)))
    split = spark.createDataFrame([(x, -(-n // share)) for x, n in counts.items()], "length long, salts long")
    salted = stored.join(F.broadcast(split), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("n", F.row_number().over(order)).join(before, ["length", "salt"])
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    return ranked.select(*columns, (F.col("before") + F.col("n") - 1).alias("rank")).mapInArrow(_placer(plan), PLACED)


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null and empty texts are one piece, the end id alone.  Texts of any length are tokenized whole.  Repeated ids give
    pieces with equal names, each placed once.  No rows give no rows.  Other columns are not read.
    """
    return pack(token_pieces(docs, tokenizer_file, end_id, capacity, id_col, text_col), capacity)


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
