"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Exact copies are one class. Centroids are fitted by spherical k-means in two levels on a bounded sample of classes (those
whose hashes are lowest); their number grows with the number of classes, about one for `CELL` of them, up to a tenth of the
largest sample (20,000 centroids; beyond 160 million classes cells grow instead). Every class has a home, its nearest
cell, and visits others. Two classes are compared where one of them is at home and the other is a guest or at home too.

How many cells are visited is measured: partners with a cosine of just `least` are made for sampled vectors, in random
directions, and the number of nearest cells is the least by which `recall` of these hardest pairs meet. With `exact` a
class visits every cell that can be the home of a vector it links with (its distance to the plane between the two
centroids is no more than that of two such vectors), and all links are found.

A cell's residents and guests are dealt into blocks; a pair of blocks is one group, compared in tiles of bounded size,
which sends on link counts and a spanning forest of its links, never the pairs. So a cell that holds a third of all rows
is spread over many tasks, and guests are never compared with guests. One representative, the smallest vec_id, of each
group is kept.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. All arithmetic is in double
precision on vectors scaled by their largest component. Shorter vectors are compared as if padded with zeros. Rows with
equal vectors link with each other; repeated rows are copies, and ties have no part in anything. A null vec_id gets its
group's component. An empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_copies, map_batches
from .components import components

CELL, SAMPLE, MOST_SAMPLE, RECALL, TRIALS, TILE, ROUNDS = 8192, 20_000, 200_000, 0.97, 2000, 256, 10


class Index(NamedTuple):
    centroids: np.ndarray  # unit vectors
    probes: int


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[at : at + 1024] @ centroids.T, axis=1) for at in range(0, len(x), 1024)])


def spherical_k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts from every (n/k)-th vector, keeps the old centroid of an empty cell."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        cell = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    return centroids


def two_levels(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids: where there are many, cells of cells, each with its share."""
    if k <= 256:
        return spherical_k_means(x, k)
    upper = spherical_k_means(x, int(k**0.5))
    cell = nearest(x, upper)
    parts = [x[cell == c] for c in range(len(upper))]
    return np.concatenate([spherical_k_means(p, max(1, round(k * len(p) / len(x)))) for p in parts if len(p)])


def distinct(centroids: np.ndarray, least: float) -> np.ndarray:
    """Centroids without those that would link with an earlier one: a tight group is not cut into cells."""
    kept = np.zeros_like(centroids)
    n = 0
    for c in centroids:
        if not n or (kept[:n] @ c).max() < least:
            kept[n] = c
            n += 1
    return kept[:n]


def measured_probes(x: np.ndarray, centroids: np.ndarray, least: float, recall: float) -> int:
    """Nearest cells to visit so that `recall` of partners at a cosine of `least` meet, the one at home where the other is."""
    rng = np.random.default_rng(7)
    x = x[rng.permutation(len(x))[:TRIALS]]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    y = np.where(norm > 1e-9, least * x + (1 - least**2) ** 0.5 * away / np.maximum(norm, 1e-9), x)
    near, far = x @ centroids.T, y @ centroids.T
    at = np.arange(len(x))
    rank = lambda own, home: (own > own[at, home][:, None]).sum(1)
    needed = np.sort(np.minimum(rank(far, near.argmax(1)), rank(near, far.argmax(1))))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of doubles as rows of at least `width`, shorter ones with zeros at their end."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def fit(classes: DataFrame, *, least: float = 0.9, recall: float = RECALL, cell: int = CELL) -> Index:
    """The index for as many classes as there are; of them at most MOST_SAMPLE reach the driver."""
    facts = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    k = max(1, -(-facts["n"] // cell))
    sample = min(MOST_SAMPLE, max(SAMPLE, 10 * k))
    rows = classes.orderBy("cls").limit(sample).select("vector").toArrow().column("vector")
    if not len(rows):
        return Index(np.eye(1, facts["width"]), 1)
    x = unit(matrix(rows, facts["width"]))
    centroids = distinct(two_levels(x, max(1, min(k, len(x) // 10))), least)
    return Index(centroids, measured_probes(x, centroids, least, recall))


def visited(x: np.ndarray, index: Index, least: float, exact: bool) -> list[list[int]]:
    """The cells of each vector, its home first."""
    score = x @ index.centroids.T
    if not exact:
        p = min(index.probes, score.shape[1])
        some = np.argpartition(-score, p - 1, axis=1)[:, :p] if p < score.shape[1] else np.tile(np.arange(p), (len(x), 1))
        order = np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable")
        return np.take_along_axis(some, order, 1).tolist()
    home = score.argmax(1)
    apart = np.linalg.norm(index.centroids[home][:, None, :] - index.centroids[None, :, :], axis=2)
    near = score[np.arange(len(x)), home][:, None] - score <= apart * (2 - 2 * least) ** 0.5 + 1e-9
    return [[h, *(c for c in np.flatnonzero(row).tolist() if c != h)] for h, row in zip(home.tolist(), near, strict=True)]


def deal(classes: DataFrame, index: Index, least: float, exact: bool, block: int, scratch: Scratch) -> DataFrame:
    """Rows (cell, i, j, cls, n, cells, vector, left): the classes of each pair of blocks of a cell.

    i is a block of residents. j is the same or a later block of residents, or, counted down from -1, one of guests.
    """
    width = index.centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = visited(unit(matrix(batch.column(2), width)), index, least, exact)
                times = np.array([len(c) for c in found])
                each = pa.array(np.repeat(np.arange(len(found)), times))
                home = np.zeros(len(each), bool)
                home[np.cumsum(times) - times] = True
                cells = pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([cells.flatten(), pa.array(home), *(c.take(each) for c in (batch.column(0), batch.column(1), cells, batch.column(2)))], names=["cell", "home", "cls", "n", "cells", "vector"])

    assigned = scratch.keep(map_batches(classes.select("cls", "n", "vector"), assign, "cell int, home boolean, cls long, n long, cells array<int>, vector array<double>"), "assigned")
    # one row per cell, of which there are no more than centroids
    parts = lambda home: F.ceil(F.count(F.when(F.col("home") == home, 1)) / block).cast("int")
    blocks = assigned.groupBy("cell").agg(parts(True).alias("residents"), parts(False).alias("guests")).where("residents > 0")
    at = assigned.join(F.broadcast(blocks), "cell")
    part = lambda n: F.pmod(F.xxhash64("cls", F.lit(3)), F.greatest(F.col(n), F.lit(1))).cast("int")
    each = lambda first, last: F.explode(F.sequence(first, last))
    columns = ["cls", "n", "cells", "vector"]
    home, guest = at.where("home").withColumn("part", part("residents")), at.where("NOT home").withColumn("part", part("guests"))
    among = home.withColumn("other", each(F.lit(0), F.col("residents") - 1)).select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("left"), *columns)
    hosts = home.where("guests > 0").withColumn("j", each(-F.col("guests"), F.lit(-1))).select("cell", F.col("part").alias("i"), "j", F.lit(True).alias("left"), *columns)
    visits = guest.withColumn("i", each(F.lit(0), F.col("residents") - 1)).select("cell", "i", (-1 - F.col("part")).alias("j"), F.lit(False).alias("left"), *columns)
    return among.unionByName(hosts).unionByName(visits)


def fold(label: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Labels (places of roots) after links between places a (rows) and b (columns) are added; no link is listed."""
    most = len(label)
    while True:
        low = np.minimum(label[a], np.where(linked, label[b], most).min(1, initial=most))
        back = np.minimum(label[b], np.where(linked, low[:, None], most).min(0, initial=most))
        if (low == label[a]).all() and (back == label[b]).all():
            return label
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], back)
        while (new != (label := new[new])).any():
            new = label


def compare(table: pa.Table, least: float) -> pa.Table:
    """Link counts and forest of one pair of blocks."""
    cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
    cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy().astype(float)
    left = table.column("left").combine_chunks().to_numpy(zero_copy_only=False)
    x, cells = unit(matrix(table.column("vector"))), table.column("cells").to_pylist()
    a, b = (np.arange(len(cls)),) * 2 if i == j else (np.flatnonzero(left), np.flatnonzero(~left))
    lower, twice = np.zeros(0, np.int64), np.zeros((len(a), 0), bool)
    if j < 0:  # a guest whose own cell a resident visits meets it in the lower of the two
        home = np.array([cells[k][0] for k in b.tolist()], np.int64)
        lower = np.flatnonzero(home < cell)
        names, column = np.unique(home[lower], return_inverse=True)
        place = {name: k for k, name in enumerate(names.tolist())}
        visits = np.zeros((len(a), len(names)), bool)
        for row, k in enumerate(a.tolist()):
            visits[row, [place[c] for c in cells[k] if c in place]] = True
        twice = visits[:, column]
    links, label = np.zeros(len(cls)), np.arange(len(cls))
    for at in range(0, len(a), TILE):
        part = a[at : at + TILE]
        linked = x[part] @ x[b].T >= least
        if i == j:
            linked[np.arange(len(part)), np.arange(at, at + len(part))] = False
        linked[:, lower] &= ~twice[at : at + TILE]
        if linked.any():
            links[part] += linked @ n[b]
            if i != j:
                links[b] += n[part] @ linked
            label = fold(label, part, b, linked)
    keep = links > 0
    return pa.table({"cls": cls[keep], "root": cls[label][keep], "links": links[keep].astype(np.int64)}, schema=pa.schema([("cls", pa.int64()), ("root", pa.int64()), ("links", pa.int64())]))


def near_vectors(rows: DataFrame, *, least: float = 0.9, recall: float = RECALL, exact: bool = False, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(rows.sparkSession)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    vector = F.col("embedding").cast("array<double>")
    valid = F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda v: v != 0), F.lit(False))
    # a power of two near the largest component, so that no square overflows or vanishes; zeros have no sign
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(vector, F.abs)))))
    scaled = F.transform(vector, lambda v: v / scale + F.lit(0.0))
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, vector).alias("raw"), F.when(valid, scaled).alias("vector"))
    known = scratch.keep(source.select("vec_id", "vector", F.when(F.col("raw").isNotNull(), F.xxhash64("vector")).alias("cls")), "vectors")
    classes = scratch.keep(known.where("cls is not null").groupBy("cls", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")), "classes")
    dealt = deal(classes, fit(classes, least=least, recall=recall, cell=cell), least, exact, cell, scratch)
    found = scratch.keep(dealt.groupBy("cell", "i", "j").applyInArrow(lambda t: compare(t, least), "cls long, root long, links long"), "links")
    scratch.forget("assigned")
    roots = scratch.keep(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch), "roots")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.join(roots, classes.cls == roots.node, "left").select("cls", "n", "least", F.coalesce("component", "cls").alias("component"))
    named = scratch.keep(named, "named")
    smallest = scratch.keep(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("copies")), "smallest")
    of_class = join_copies(named, smallest, "component").join(links, "cls", "left")
    of_class = scratch.keep(of_class.select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("n").alias("copies")), "of")
    joined = join_copies(known.where("cls is not null").select("vec_id", "cls"), of_class, "cls").select("vec_id", "n_links", "component_id")
    alone = known.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
