import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import ctw, queries


def held(doc_id):
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 10 == 0


def brute(texts, d):
    """Context-tree weighting node by node, as the recursion is written."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    for doc, text in texts:
        if not held(doc):
            b = bytes(d) + text + b"\xff"
            for i in range(d, len(b)):
                for j in range(8):
                    node, bit = 1 << j | b[i] >> (8 - j), b[i] >> (7 - j) & 1
                    for k in range(d + 1):
                        counts[b[i - k : i], node][bit] += 1
                        if k < d:
                            kids[b[i - k : i], node].add(b[i - k - 1 : i])
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            e = kt(*counts.get((c, node), (0, 0)))
            if len(c) < d:
                under = sum(weighted(k, node) for k in kids.get((c, node), ()))
                e = max(e, under) + math.log1p(math.exp(-abs(e - under))) - math.log(2)
            memo[c, node] = e
        return memo[c, node]

    def one(context, node, k=0):
        c = context[d - k :]
        n0, n1 = counts.get((c, node), (0, 0))
        p = (n1 + 0.5) / (n0 + n1 + 1)
        if k == d:
            return p
        stop = math.exp(kt(n0, n1) - math.log(2) - weighted(c, node))
        return stop * p + (1 - stop) * one(context, node, k + 1)

    out = {}
    for doc, text in texts:
        b, s = bytes(d) + text + b"\xff", 0.0
        for i in range(d, len(b)):
            for j in range(8):
                p = one(b[i - d : i], 1 << j | b[i] >> (8 - j))
                s += math.log10(p if b[i] >> (7 - j) & 1 else 1 - p)
        out[doc] = s
    return out


def base(texts):
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()
    c = Counter()
    for doc, t in texts:
        if not held(doc):
            c.update(low(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    return {doc: (len(low(t)) + 1, sum(c[w] > 0 for w in [*low(t), b""]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*low(t), b""])) for doc, t in texts}


@pytest.mark.parametrize("depth", [2, 4, ctw.DEPTH, 6])
def test_tree_equals_brute_force(spark, depth):
    texts = [(i, t) for i, t in enumerate(["abracadabra abracadabra", "the cat the hat", "", "über ßtraße", "The Cat", "zzz", "abra the", "x\x00y", "cat hat abra", "new words here", "qq cat"] * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    raw = [(i, t.encode()) for i, t in texts]
    want, plain = brute(raw, depth), base(raw)
    for r in ctw.score_texts(df, depth=depth).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-6) and r.held_out == held(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == plain[r.doc_id][:3] and r.base_score == pytest.approx(plain[r.doc_id][3])


def test_bits_sum_to_one(spark):
    grams = spark.createDataFrame([((c << 8) | b, (b * c) % 7) for c in (1, 2, 258) for b in range(256)], "gram long, n long")
    rows = ctw.log_probabilities(grams, 4).collect()
    sums = defaultdict(float)
    for r in rows:
        sums[r.gram >> 8] += 10**r.value
    assert all(s == pytest.approx(1) for s in sums.values()) and len(sums) == 3


def test_query(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").toPandas()
    plain = base([(d, t.encode()) for d, t in zip(docs.doc_id, docs.text, strict=True)])
    rows = queries.op5_ctw(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == plain[r.doc_id][:3] and r.base_score == pytest.approx(plain[r.doc_id][3]) and r.score < 0


def test_awkward_rows(docs, no_docs):
    rows = ctw.score_texts(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[3].n_tokens == by[4].n_tokens == 1 and by[3].score == by[4].score and ctw.score_texts(no_docs).count() == 0


def test_chunks_change_nothing(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    want = {r.doc_id: r for r in ctw.score_texts(docs.repartition(2)).collect()}
    for r in ctw.score_texts(docs.repartition(23)).collect():
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-9) and r.base_score == pytest.approx(want[r.doc_id].base_score, rel=1e-9) and r.n_known == want[r.doc_id].n_known


def test_parts_and_blobs_change_nothing():
    texts = ["the cat " * k for k in range(40)] + ["", None, "x" * 300, "ü"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([i % 5 == 0 for i in range(len(texts))]), pa.array(texts)], names=["doc_id", "held", "text"])
    found = []
    for size in (1, 50, 1 << 20):
        chunk, rows = ctw.Chunk(3, 5), []
        for part in ctw.in_parts(iter([batch.slice(0, 7), batch.slice(7)]), size):
            rows += ctw.unpacked(chunk.add(part).column("blob")[0].as_py()).to_pylist()
        assert [(r["doc_id"], r["held"], r["text"].decode()) for r in rows] == [(i, i % 5 == 0, t or "") for i, t in enumerate(texts)]
        found.append([r.to_pylist() for r in chunk.end()])
    assert found[0] == found[1] == found[2]
    rng = np.random.default_rng(1)
    keys, chunks, values = np.unique(rng.integers(-(1 << 62), 1 << 62, 900)), rng.integers(0, 4, 900), rng.random(900).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(chunks[i : i + 100]), pa.array(keys[i : i + 100]), pa.array(values[i : i + 100])], names=["chunk", "key", "value"]) for i in range(0, 900, 100)]
    sent = [r for b in ctw.send(iter(batches)) for r in b.to_pylist()]
    back = {(r["chunk"], k): v for r in sent for k, v in zip(*(x.tolist() for x in ctw.received([r["blob"]], np.float32)), strict=True)}
    assert back == {(int(c), int(k)): float(v) for c, k, v in zip(chunks, keys, values, strict=True)}


def test_held_out_documents_beat_the_base(spark, sf_dir):
    """On the table of ten times as many rows most held-out documents have a higher probability than the base gives them."""
    rows = [r for r in queries.op5_ctw(spark, sf_dir.replace("0.001", "0.01")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and sum(r.score > r.base_score for r in rows) > 0.5 * len(rows)
