"""Operator 12 against a direct context tree weighting, base scores against SQL, and odd rows."""

import math
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from tickframe.llm import contexttree
from tickframe.llm.queries import op12_context_trees

SCHEMA = "doc_id long, text string, chunk string, held_out string, word long"
END = 0xFF


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()


class Direct:
    """One dictionary of nodes (context, bits so far), weighted by recursion."""

    def __init__(self, train, depth):
        self.depth, self.counts, self.longer = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in train:
            for context, byte in self.steps(text):
                for prefix, bit in self.bits(byte):
                    for d in range(depth + 1):
                        self.counts[context[:d], prefix][bit] += 1
                        if d:
                            self.longer[context[: d - 1], prefix].add(context[:d])
        self.weighted, self.stop = {}, {}
        for d in range(depth, -1, -1):
            for context, prefix in [k for k in self.counts if len(k[0]) == d]:
                zeros, ones = self.counts[context, prefix]
                own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
                if d == depth:
                    self.weighted[context, prefix] = own
                else:
                    below = sum(self.weighted[x, prefix] for x in self.longer[context, prefix])
                    top = max(own, below)
                    self.weighted[context, prefix] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
                    self.stop[context, prefix] = math.exp(own - top) / (math.exp(own - top) + math.exp(below - top))

    def steps(self, text):
        data = bytes([END] * self.depth) + text + bytes([END])
        for i in range(self.depth, len(data)):
            yield tuple(data[i - self.depth : i][::-1]), data[i]

    @staticmethod
    def bits(byte):
        return [((k, byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    def chance(self, context, prefix, bit, d=0):
        zeros, ones = self.counts[context[:d], prefix] if (context[:d], prefix) in self.counts else (0, 0)
        if zeros + ones == 0:
            return 0.5
        own = ((zeros, ones)[bit] + 0.5) / (zeros + ones + 1)
        if d == self.depth or (context[: d + 1], prefix) not in self.counts:
            return own
        stop = self.stop[context[:d], prefix]
        return stop * own + (1 - stop) * self.chance(context, prefix, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.chance(c, p, b)) for c, byte in self.steps(text) for p, b in self.bits(byte))


@pytest.mark.parametrize(("depth", "batch"), [(2, 1 << 17), (3, 1), (4, 50)])
def test_scores_equal_a_direct_tree(spark, depth, batch):
    rng = random.Random(depth)
    words = ["".join(rng.choices("abéß", k=rng.randint(1, 4))) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), "x", "y", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (102, "ABba \t\n 日本", "", "", 0), (102, "ABba \t\n 日本", "", "", 0), (None, "ab", "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    got = contexttree.score_texts(docs, contexttree.ContextTrees(depth=depth, batch_grams=batch, chunk_bytes=300, most_words=5)).collect()
    assert len(got) == len(rows)
    tree = Direct([lower(t) for i, t, *_ in rows if not held(i)], depth)
    want = sorted((i if i is not None else -1, held(i), round(tree.score(lower(t)), 5)) for i, t, *_ in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.score) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-5)
    assert all(r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes, rel=1e-4) for r in got)


def test_chances_of_all_bytes_add_up():
    tree = Direct([b"abracadabra", b"abba"], 2)
    for context in ((97, 98), (98, 97), (1, 2)):
        total = 0.0
        for byte in range(256):
            total += math.prod(tree.chance(context, p, b) for p, b in tree.bits(byte))
        assert total == pytest.approx(1)


def test_base_scores_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    texts = c.execute(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall()
    counts = defaultdict(int)
    for i, t in texts:
        if not held(i):
            for w in [*lower(t).split(), None]:
                counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in op12_context_trees(spark, folder).collect()}
    for i, t in texts:
        tokens = [*lower(t).split(), None]
        want = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts.get(w, 0) > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(want, abs=1e-4)
    outside = [r for r in got.values() if r.held_out and r.n_bytes > 200]
    assert sum(r.bits_per_byte for r in outside) / len(outside) < 3.5


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert contexttree.score_texts(empty).count() == 0
    only = next(i for i in range(100) if held(i))
    row = contexttree.score_texts(spark.createDataFrame([(only, "ab c", "", "", 0)], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(5 * 8 * math.log10(0.5), abs=1e-5)
    with pytest.raises(ValueError, match="depth"):
        contexttree.ContextTrees(depth=5)


def test_tasks_hold_a_chunks_answers_and_a_piece_of_its_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))).encode() for _ in range(5000)]
    docs = [b" ".join(rng.choices(words, k=3000)) for _ in range(400)]
    asking = pa.RecordBatch.from_pydict({"chunk": [0] * 400, "text": [d.decode() for d in docs], "train": [1] * 400})
    c = contexttree.ContextTrees()

    def peak(f):
        tracemalloc.start()
        rows = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, most

    # 8 MB of text in one chunk.
    asked, most = peak(lambda: list(contexttree._requests(c)(iter([asking]))))
    assert most < 100e6
    assert len(asked) > 2
    answers = [pa.RecordBatch.from_arrays([pa.array([0] * len(b)), b.column("gram"), b.column("word"), b.column("n").cast(pa.float64())], ["at", "number", "bytes", "value"]) for b in asked]
    own = pa.RecordBatch.from_pydict({"at": [1] * 400, "number": list(range(400)), "bytes": docs, "value": [0.0] * 400})
    scored, most = peak(lambda: list(contexttree._score(c)(iter([*answers, own]))))
    assert most < 100e6
    assert sum(len(b) for b in scored) == 400
    with pytest.raises(ValueError, match="partitions changed"):
        list(contexttree._score(c)(iter([own])))
    plan = contexttree.score_texts(spark.createDataFrame([(1, "ab", "", "", 0)], SCHEMA))._jdf.queryExecution().toString()
    assert "CoGroup" not in plan
