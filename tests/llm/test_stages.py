"""The stages of the pipeline in order, and its run, against plain Python over planted copies, lines and passages."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_dedup import WORD, brute_runs, components, shingles
from tokenizers import Tokenizer

from basketlens.llm import packing, quality


def planted():
    rng = random.Random(21)
    footer, passage = "this footer stands below many of the texts here", " ".join(f"pass{i}" for i in range(20))
    rows = []
    for i in range(40):
        lines = [" ".join(f"v{rng.randrange(100_000)}" for _ in range(9)) for _ in range(10)]
        if i % 4 == 1:
            lines[3] += f" {passage} end{i}"
        if i % 5 == 2:
            lines.append(footer)
        if i % 10 == 9:
            lines[1:4] = rows[i - 3][1].split("\n")[1:4]
        rows.append((i, "\n".join(lines)))
    for i in (4, 8, 12):
        words = re.split("( |\n)", rows[i][1])
        words[60] = "changed"
        rows += [(100 + i, "".join(words).replace("\n", " ")), (200 + i, rows[i][1])]
    rows += [(300, "too short"), (301, "same words here " * 40), (302, " ".join(f"{'long' * 9}{k}" for k in range(60)))]
    rng.shuffle(rows)
    return rows


def good(rows):
    measures = {}
    for i, text in rows:
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        times = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        under = {k + d for k in range(len(w) - 2) if times[tuple(w[k : k + 3])] > 1 for d in range(3)}
        if len(w) >= quality.LEAST_WORDS and 2 * len(under) <= len(w):
            symbols = sum(text.count(c) for c in "#*$%&|<>")
            measures[i] = {
                "word_length": 100 * sum(map(len, w)) // len(w),
                "symbols": 1000 * symbols // len(w),
                "dup_lines": 1000 * (len(lines) - len(set(lines))) // len(lines),
                "repeat_words": 1000 * len(under) // len(w),
            }
    kept = set(measures)
    for name, (above, below) in quality.MEASURES.items():
        values = sorted(m[name] for m in measures.values())
        q = {k: values[-(-k * len(values) // 100) - 1] for k in (25, 50, 75, 99)}
        q = {k: v >> s << s for k, v in q.items() for s in [max(v.bit_length() - 6, 0)]}
        most = (q[75] + quality.REACH * (q[75] - q[25]) if below is not None else 2 * q[99] - q[50]) + above
        least = q[25] - quality.REACH * (q[75] - q[25]) - below if below is not None else 0
        kept -= {i for i, m in measures.items() if not least <= m[name] <= most}
    return [(i, t) for i, t in rows if i in kept]


def without_lines(rows):
    return [(i, "\n".join(lines)) for i, lines in brute_runs(rows).items() if lines]


def smallest(rows):
    label = components({i: shingles(t) for i, t in sorted(rows)})
    return [(i, t) for i, t in rows if label[i] == i]


def without_passages(rows):
    first, out = {}, []
    for i, text in sorted(rows):
        w = WORD.findall(text)
        gone = set()
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone |= set(range(p, p + 13))
        out.append((i, "".join(x for k, x in enumerate(re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)) if k not in gone)))
    return [(i, t) for i, t in out if t]


def check_pieces(pieces, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length, sequences = Counter(), defaultdict(int)
    for r in pieces:
        length[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert length == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert max(sequences.values()) <= packing.CAPACITY
    assert len(sequences) == packing.least_sequences(dict(Counter(r.length for r in pieces)), packing.CAPACITY)


def test_stages_and_run_against_plain_python(spark, make, tmp_path):
    rows = planted()
    docs = make(rows).withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, [good, without_lines, smallest, without_passages], strict=False):
        expected = plain(rows)
        assert sorted(expected) != sorted(rows), name  # something is planted for each
        got = [tuple(r) for r in stage(spark, docs, str(tmp_path)).select("doc_id", "text", "n_chars").collect()]
        assert sorted(got) == sorted((i, t, len(t)) for i, t in expected), name
        rows = expected
        docs = make(rows).withColumn("n_chars", F.length("text"))
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), rows)
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), rows)
