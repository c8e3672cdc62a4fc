from itertools import combinations

import numpy as np
import pytest

from quillspark.llm import queries, setjoin
from quillspark.llm.common import LOWER
from tests.llm.test_simhash import roots


def brute_set(text, size=5):
    w = text.encode().translate(LOWER).split()
    return frozenset([b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else [])


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_hashes_tell_shingles_apart(spark, docs, sf_dir, monkeypatch, segment):
    """One hash for each different shingle, however the text is cut into segments and batches."""
    monkeypatch.setattr(setjoin, "SEGMENT", segment)
    monkeypatch.setattr(setjoin, "_hashes", [])
    texts = [t or "" for t in [*queries.table(spark, sf_dir, "documents").toPandas().text[:40], *(r.text for r in docs.collect())]] + ["a b c d e", "A\tb\x0bc  d e ", "a", "b a", "a b", "", " \n"]
    hashed = list(setjoin.shingle_sets([t.encode() for t in texts], 5))
    names = {}
    for text, found in zip(texts, hashed, strict=True):
        want = brute_set(text)
        assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()
        (alone,) = setjoin.shingle_sets([text.encode()], 5)
        assert alone.tolist() == found.tolist()
        names.setdefault(want, set()).add(tuple(found.tolist()))
    assert all(len(x) == 1 for x in names.values()) and len({x for v in names.values() for x in v}) == len(names)
    every = {s for t in texts for s in brute_set(t)}
    assert len({h for f in hashed for h in f.tolist()}) == len(every)


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    rows = docs.toPandas()
    sets = {d: brute_set(t) for d, t in zip(rows.doc_id, rows.text, strict=True)}
    links = [(a, b) for a, b in combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r.doc_id: r.component_id for r in setjoin.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_of_one_base(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(300):
        w = list(base)
        for at in rng.choice(200, 4, replace=False):
            w[at] = f"e{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_fingerprints_link_first(spark):
    """Long texts with few words changed are linked by SimHash, those with more by what follows, and none that are not alike."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(30):
        base = [f"b{i}x{k}" for k in range(600)]
        for changed in (0, 1, 1, 2, 2, 12, 12, 40):
            w = list(base)
            for at in rng.choice(600, changed, replace=False):
                w[at] = f"e{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(w)))
    join = setjoin.Join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8)
    join.describe()
    of = {r.node: r.doc_id for r in join.nodes.collect()}
    links = [(of[r.a], of[r.b]) for r in join.by_fingerprints().collect()]
    hashed = list(setjoin.shingle_sets([t.encode() for _, t in rows], 5))
    fp = [sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in found.tolist()) > len(found)) for found in hashed]
    sets = [brute_set(t) for _, t in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if (fp[a] ^ fp[b]).bit_count() <= 2 and alike(a, b)]
    assert links and all((fp[a] ^ fp[b]).bit_count() <= 2 and alike(a, b) for a, b in links)
    by_simhash, every = roots(range(len(rows)), near), all_pairs(rows)
    assert roots(range(len(rows)), links) == by_simhash != every
    assert {r.doc_id: r.component_id for r in setjoin.near_duplicates(join.source).collect()} == every


def test_near_duplicates_awkward(docs, no_docs):
    got = setjoin.near_duplicates(docs).toPandas()
    assert len(got) == 10 and setjoin.near_duplicates(no_docs).count() == 0


def all_pairs(rows):
    sets = {d: brute_set(t) for d, t in rows}
    return roots(sets, [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_near_duplicates_of_an_absent_base(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, (length, most) in enumerate([(100, 2)] * 700 + [(200, 4)] * 700):
        w = [f"w{length}x{k}" for k in range(length)]
        for at in rng.choice(length, rng.integers(1, most + 1), replace=False):
            w[at] = f"e{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == all_pairs(rows)


def test_near_duplicates_of_short_texts(spark):
    rows = []
    for i in range(900):
        text = " ".join(f"p{i}x{k}" for k in range(8 + i % 3))
        rows += [(2 * i, text), (2 * i + 1, f"{text} more")]
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_frequent_shingles_change_no_group(spark, monkeypatch):
    """A passage of 60 words in all documents, and near copies among them, with the lowest thresholds there are."""
    rng = np.random.default_rng(4)
    word = lambda: f"r{rng.integers(1 << 40)}"
    passage, rows = [f"p{k}" for k in range(60)], []
    for i in range(240):
        own = [word() for _ in range(rng.integers(1, 90))]
        at = rng.integers(0, len(own) + 1)
        text = own[:at] + passage + own[at:]
        rows.append((len(rows), " ".join(text)))
        if i % 6 == 0:
            text[rng.integers(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    want, df = all_pairs(rows), spark.createDataFrame(rows, "doc_id long, text string")
    for often, most, few in ((2, 1 << 20, 100_000), (100, 1 << 20, 0), (2, 3, 0)):
        monkeypatch.setattr(setjoin, "FEW", few)
        monkeypatch.setattr(setjoin, "OFTEN", often)
        monkeypatch.setattr(setjoin, "MOST_OFTEN", most)
        assert {r.doc_id: r.component_id for r in setjoin.near_duplicates(df).collect()} == want


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, rng.integers(0, 4), dtype=np.uint64)]))
        often = np.unique(rng.choice(np.concatenate([a, b]), rng.integers(0, 30)))
        similar = setjoin.similarity(a.tobytes(), b.tobytes()) >= 0.8
        assert not similar or np.intersect1d(setjoin.prefix(a, 0.8, often), setjoin.prefix(b, 0.8, often)).size
        assert setjoin.possible(len(a), len(b), setjoin.difference(setjoin.sketch(a), setjoin.sketch(b)), 0.8) or not similar


def test_template_pages_are_not_compared(spark):
    """Pages of one template share most shingles with all others and are alike in none of the rest."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        w = [f"t{k}" for k in range(200)]
        for at in rng.choice(200, 14, replace=False):
            w[at] = f"e{rng.integers(1 << 40)}"
        rows.append((i, " ".join(w)))
    join = setjoin.Join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8)
    join.describe()
    nothing = spark.createDataFrame([], "node long, component long")
    assert join.by_blocks().count() == 0 and join.apart(nothing).count() == 0
    pairs = spark.read.parquet(join.scratch.paths["pairs"][-1]).count()
    assert pairs < 40 * len(rows)
