from itertools import combinations

import numpy as np
import xxhash

from quillspark.llm import queries, simhash
from quillspark.llm.common import Scratch
from quillspark.llm.components import components


def brute_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_query_equals_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").toPandas()
    fp = {d: brute_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    want = roots(fp, [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = queries.op4_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for base in fps[:25]:
        for _ in range(4):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.append(base ^ sum(1 << int(b) for b in bits))
    fps = sorted(set(fps))
    want = roots(range(len(fps)), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    scratch = Scratch(spark)
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    every = {(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2}
    for blocks, most in ((None, 64), (4, 1), (5, 2), (6, 64)):
        links = simhash.hamming_links(df, scratch, blocks=blocks, most=most)
        said = [(r.a, r.b) for r in links.collect()]
        assert set(said) <= every and (most < 64 or sorted(said) == sorted(every))  # each once, where blocks are paired
        got = {r.node: r.component for r in components(links, scratch).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_a_crowded_block_is_linked_without_pairs(spark):
    """Half of the bits are shared by all, so one block holds every fingerprint."""
    rng = np.random.default_rng(6)
    fps = sorted({int(x) << 32 | 0x1234 for x in rng.integers(0, 1 << 11, 700)})
    want = roots(range(len(fps)), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    links = simhash.hamming_links(df, Scratch(spark))
    assert links.count() < 66 * len(fps)
    got = {r.node: r.component for r in components(links, Scratch(spark)).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 299), (299, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    want = roots({x for ab in links for x in ab} - {5}, [x for x in links if x[0] != x[1]])
    assert got == want


def test_hot_keys_are_broadcast_and_others_shuffled(spark, monkeypatch):
    from quillspark.llm import common

    rows = [(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3, 4, 5])]
    facts = [(k, sum(x == k for x, _ in rows), k * 10) for k in range(1, 6)]
    for share in (1e-4, 0.2, 1.0):
        monkeypatch.setattr(common, "HOT", share)
        got = common.join_copies(spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame(facts, "k long, copies long, v long"), "k")
        assert sorted((r.i, r.v) for r in got.collect()) == sorted((i, k * 10) for k, i in rows)


def test_awkward_rows(docs, no_docs):
    got = simhash.near_components(docs).toPandas()
    by = got[got.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id")
    assert len(got) == 10 and by.component_id[2] == 1 and by.component_id[3] == by.component_id[4] == by.component_id[5] == 3
    assert by.fingerprint[3] == "0" * 16 and simhash.near_components(no_docs).count() == 0
