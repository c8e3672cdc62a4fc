import numpy as np
import pytest

from quillspark.llm import cells, queries
from tests.llm.test_simhash import roots


def brute(ids, vectors, least=0.9):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    up = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)])
    return {i: (int(linked[k].sum()), up[i]) for k, i in enumerate(ids)}


def test_query_recall(spark, sf_dir):
    """The given tables have no links; see the tests of planted ones for recall."""
    rows = queries.table(spark, sf_dir, "embeddings").toPandas()
    want = brute(rows.vec_id.tolist(), rows.embedding.tolist())
    got = queries.op9_cells(spark, sf_dir).collect()
    assert len(got) == len(rows) and all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.98 * sum(n for n, _ in want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def hot_rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] for i in range(80)] + [base[0] + rng.normal(size=16) * 0.05 for _ in range(150)] + [base[k] + rng.normal(size=16) * 0.3 for k in range(40) for _ in range(3)]
    return [r.tolist() for r in rows]


@pytest.mark.parametrize("cell", [7, 40, 8192])
def test_hot_group_and_copies(spark, cell):
    """All links in the exact mode, whatever the size of cells and blocks; most with measured probes, and none that is no link."""
    rows = hot_rows()
    want = brute(list(range(len(rows))), rows)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cells.near_vectors(df, cell=cell, exact=True).collect()}
    assert got == want
    few = cells.near_vectors(df, cell=cell).collect()
    assert all(r.n_links <= want[r.vec_id][0] for r in few) and sum(r.n_links for r in few) >= 0.9 * sum(n for n, _ in want.values())


def groups_of_six(n, width=32, noise=0.054):
    """Random directions with noise: cosines within a group about 0.92, all others far below."""
    rng = np.random.default_rng(n)
    base = cells.unit(rng.normal(size=(n // 6, width)))
    return np.repeat(base, 6, axis=0) + rng.normal(size=(n // 6 * 6, width)) * noise


def test_recall_of_groups_on_the_threshold(spark):
    """Links found among 12,000 vectors in 60 cells, as many as three million vectors have at the cells' usual size."""
    x = groups_of_six(12_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    y = cells.unit(x).reshape(-1, 6, x.shape[1])
    want = int((np.einsum("gid,gjd->gij", y, y) >= 0.9).sum()) - len(x)
    got = cells.near_vectors(df, cell=200).agg({"n_links": "sum"}).first()[0]
    assert want > 20_000 and 0.9 * want <= got <= want


def test_doubles_stay_doubles(spark):
    """Cosines that single precision would put on the wrong side of the threshold, and components that it cannot hold."""
    turn = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0]), (2, turn(0.9 - 1e-10)), (3, [0.0, 1e300]), (4, [1e299, 1e300]), (5, [0.0, 0.0, 5e-324]), (6, [0.0, 0.0, -0.0, 1e-310])]
    got = {r.vec_id: r.n_links for r in cells.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0}


def test_later_components_count(spark):
    """The longest vectors are no part of a small sample; what they say beyond the others' width still counts."""
    rows = [(i, [1.0, float(i)]) for i in range(30)] + [(100, [0.0, 0.0, 1.0]), (101, [0.0, 0.0, 1.0, 0.1]), (102, [0.0, 0.0, 0.0, 1.0])]
    want = brute([i for i, _ in rows], [[*v, *[0.0] * (4 - len(v))] for _, v in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in cells.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=True).collect()}
    assert got == want


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0, 1), (2, [2.0, 0.0], 0, 1), (3, None, 0, 1), (4, [0.0, 0.0], 0, 1), (5, [nan, 1.0], 0, 1), (6, [None, 1.0], 0, 1), (7, [], 0, 1), (8, [1.0, 0.0, 0.0], None, 1), (None, [1.0, 0.0], 0, 1), (9, [0.0, 1.0], 0, 1), (9, [0.0, 1.0], 0, 1), (10, [float("inf"), 1.0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in cells.near_vectors(df).collect()}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (8, 3, 1, False), (None, 3, 1, False), (9, 1, 9, True)} | {(k, 0, k, True) for k in (3, 4, 5, 6, 7, 10)}
    assert cells.near_vectors(df.limit(0)).count() == 0
