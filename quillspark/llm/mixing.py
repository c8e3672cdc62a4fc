"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source, its documents shuffled by hash, are cut into blocks of equal size. The mix is a row of
slots: slot i takes the golden-ratio point frac((i + 1/2) * phi), finds its source in the cumulative targets, and
takes the next block of that source; a source that is at its end starts over. The rank of a slot within its
source is found from counts per chunk of slots, so no source's slots or documents meet in one task: documents
get their place in the source from sums over hash ranges.

Sizes count words; null text has none. Sources sort by code point, null last. A target is a source's share of
all words by weight, at most `most` times its size, the excess shared anew by weight. Rows that nothing tells apart
(for `mix_documents` source, doc_id and size, for `mix_rows` all columns) are counted and numbered, so ties, repeated
rows and null ids spread over the shuffle like any others; reruns agree whatever the partitioning. Texts may be of any
length: a document has one row for each block it touches. Null text, source or doc_id are values like others. An empty
table gives an empty result; `mix_rows` returns all columns, whatever their names.
What the driver holds is one row per source, as the weights themselves are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_rows

BLOCK, CHUNK, RANGE_ROWS, PHI = 256, 4096, 1000, 0.6180339887498949
#: Sources that are few enough to be broadcast, and equal rows that one task numbers at a time.
FEW_SOURCES, RUN = 100_000, 10_000
WORDS = r"[^\x20\x09-\x0D]+"


class Quota(NamedTuple):
    rank: int  # of the source, by code point
    source: str | None
    size: int
    target: float
    words: int  # that the mix takes
    blocks: int

    @property
    def epochs(self) -> int:
        return self.words // self.size if self.size else 0

    @property
    def rest(self) -> int:
        return self.words - self.epochs * self.size

    def slots(self, block: int) -> int:
        return self.epochs * self.blocks + -(-self.rest // block)


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the whole by weight, at most `most` times each size; what is over is shared anew by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def units(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The counts of equal rows, and source, key, size and nth of rows (source, key, size): equal rows are counted where they lie, and numbered.

    A row that is repeated without end is numbered in runs of `RUN`, dealt over all tasks.
    """
    counted = scratch.keep(rows.groupBy("source", "key", "size").agg(F.count("*").alias("copies")), "units")
    every = lambda first, last: F.explode(F.sequence(first, last))
    few = counted.where(F.col("copies") <= RUN).select("source", "key", "size", every(F.lit(0).cast("long"), F.col("copies") - 1).alias("nth"))
    many = counted.where(F.col("copies") > RUN).select("source", "key", "size", "copies", every(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN)).alias("run"))
    if many.isEmpty():
        return counted, few
    many = many.repartition("key", "run").select("source", "key", "size", every(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1).alias("nth"))
    return counted, few.unionByName(many)


def quotas(documents: DataFrame, weights: list[float] | None = None, block: int = BLOCK, most: float = 3.0) -> list[Quota]:
    """One per source; weights, 1, 2, 3 and so on over again where none are given, go by rank."""
    rows = documents.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r.size or 0) for r in rows]
    wanted = targets(sizes, weights or [1 + i % 3 for i in range(len(rows))], most)
    return [Quota(i, r.source, n, t, min(round(t), int(most * n)), -(-n // block)) for i, (r, n, t) in enumerate(zip(rows, sizes, wanted, strict=True))]


def sources_frame(spark: SparkSession, found: list[Quota]) -> DataFrame:
    return spark.createDataFrame([(q.rank, q.source, q.size, float(q.target), q.words, q.blocks, q.epochs, q.rest) for q in found], "rank int, source string, source_size long, target double, source_words long, blocks long, epochs long, rest long")


def with_sources(rows: DataFrame, found: list[Quota]) -> DataFrame:
    """rows with the facts of their source; more than `FEW_SOURCES` of them are not broadcast."""
    facts = sources_frame(rows.sparkSession, found).withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(facts) if len(found) <= FEW_SOURCES else facts, rows.source.eqNullSafe(facts._source)).drop("_source")


def placed(units: DataFrame, scratch: Scratch) -> DataFrame:
    """Units with `start`, the words of their source before them in the shuffled order."""
    units = scratch.keep(units.withColumn("place", F.xxhash64("key", "size", "nth", F.lit("mix"))), "places")
    n = units.count()
    ranges = max(1, -(-n // max(RANGE_ROWS, int(n**0.5))))
    width = (1 << 64) // ranges + 1
    # the hash range that holds the place; each (source, range) has about a range's share of rows or fewer
    bucket = F.floor((F.col("place").cast("double") + float(1 << 63)) / float(width)).cast("long")
    keyed = units.withColumn("bucket", bucket)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(earlier, F.lit(0)).alias("before"))
    before = scratch.keep(before, "before")
    inside = Window.partitionBy("source", "bucket").orderBy("place", "key", "size", "nth").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = run.join(before.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    return joined.select("source", "key", "size", "nth", (F.col("before") + F.col("inside")).alias("start"))


def slot_sources(first: int, n: int, edges: np.ndarray) -> np.ndarray:
    """Ranks of the sources of slots first to first + n."""
    points = np.modf((np.arange(first, first + n) + 0.5) * PHI)[0]
    return np.minimum(np.searchsorted(edges, points, side="right"), len(edges) - 1)


def schedule(spark: SparkSession, found: list[Quota], block: int = BLOCK) -> DataFrame:
    """The mix, in order: slot, rank (of the source), nth (of the source's slots), block, epoch, words."""
    need = np.array([q.slots(block) for q in found], np.int64)
    total = int(need.sum())
    schema = "slot long, rank int, nth long, block long, epoch long, words long"
    if not total:
        return spark.createDataFrame([], schema)
    edges = np.cumsum(need / total)
    # golden-ratio counts stay within a few slots of their share; a few more chunks leave none short
    chunks = -(-total // CHUNK) + 2
    while True:
        counts = map_rows(spark.range(chunks), lambda rows: ((c, int(r), int(k)) for (c,) in rows for r, k in zip(*np.unique(slot_sources(c * CHUNK, CHUNK, edges), return_counts=True), strict=True)), "chunk long, rank int, n long")
        got = {r["rank"]: r["n"] for r in counts.groupBy("rank").agg(F.sum("n").alias("n")).collect()}
        if all(got.get(i, 0) >= k for i, k in enumerate(need)):
            break
        chunks += -(-chunks // 8)
    before = F.sum("n").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("chunk").agg(F.collect_list(F.struct("rank", "before")).alias("offsets"))
    plan = [(int(k), q.blocks, q.rest, q.epochs, q.size) for k, q in zip(need, found, strict=True)]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for chunk, offsets in rows:
            nth = {o["rank"]: o["before"] for o in offsets}
            for i, r in enumerate(slot_sources(chunk * CHUNK, CHUNK, edges).tolist()):
                k, (most, blocks, rest, epochs, size) = nth[r], plan[r]
                nth[r] += 1
                if k < most:
                    epoch, b = divmod(k, blocks)
                    whole = min(block, size - b * block)
                    yield chunk * CHUNK + i, r, k, b, epoch, min(whole, rest - b * block) if epoch == epochs else whole

    return map_rows(offsets, run, schema)


def mix_documents(docs: DataFrame, weights: list[float] | None = None, *, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each document that the schedule's slots take."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select("source", F.col("doc_id").cast("long").alias("key"), words_in(F.col("text")).alias("size")), "sized")
    found = quotas(rows, weights, block)
    ranked = with_sources(placed(units(rows, scratch)[1], scratch), found)
    # one row per block: how often it is taken whole, and how many words of it the source's last slot takes
    lengths = sources_frame(spark, found).select("rank", "source_size")
    used = schedule(spark, found, block).join(F.broadcast(lengths) if len(found) <= FEW_SOURCES else lengths, "rank")
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    uses = used.groupBy("rank", "block").agg(F.sum((F.col("words") == whole).cast("long")).alias("times"), F.max(F.when(F.col("words") < whole, F.col("words"))).alias("cut"))
    # a document's words, block by block; its parts come back together by the document's place in its source
    parts = ranked.where(F.col("size") > 0).select("rank", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    cut = F.greatest(F.lit(0), F.least(end, F.coalesce("cut", F.lit(0))) - begin)
    taken = parts.join(uses.hint("merge"), ["rank", "block"]).select("rank", "start", (F.col("times") * (end - begin) + cut).alias("taken")).groupBy("rank", "start").agg(F.sum("taken").alias("taken"))
    full, empty = ranked.where(F.col("size") > 0), ranked.where(F.col("size") == 0)
    columns = [F.col("key").alias("doc_id"), "source", "size", "source_size", "target"]
    return full.join(taken.hint("merge"), ["rank", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(empty.select(*columns, F.lit(0).cast("long").alias("taken")))


def row_key(rows: DataFrame) -> Column:
    """128 bits of all columns; equal for equal rows."""
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rows.schema]
    return F.struct(F.xxhash64(*values).alias("h"), F.xxhash64(F.lit(1), *values).alias("l"))


def mix_rows(docs: DataFrame, weights: list[float] | None = None, *, block: int = BLOCK) -> DataFrame:
    """The documents as the mix holds them, in the order of the schedule; same columns.

    A document stands once for each epoch that takes it, at the slot that takes its first word. The one that a
    source's last slot ends in is cut there (and its n_chars), so each source has just the words of its quota.
    Documents without words go with the block that they lie at. A partition holds `CHUNK` slots, in order.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    key, of, slot, start, size, taken = fresh(docs, "key", "of", "slot", "start", "size", "taken")
    keyed = docs.withColumn(key, row_key(docs))
    rows = scratch.keep(keyed.select("source", F.col(key).alias("key"), words_in(F.col("text")).alias("size")), "sized")
    found = quotas(rows, weights, block)
    counted, numbered = units(rows, scratch)
    ranked = with_sources(placed(numbered, scratch), found)
    copies = F.col("epochs") + (F.col("start") < F.col("rest")).cast("long")
    each = ranked.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    words = F.when(F.col("epoch") < F.col("epochs"), F.col("size")).otherwise(F.least("size", F.col("rest") - F.col("start")))
    nth = F.col("epoch") * F.col("blocks") + F.least(F.floor(F.col("start") / block), F.col("blocks") - 1)
    used = schedule(spark, found, block).select("rank", "nth", "slot")
    turns = each.select("rank", nth.alias("nth"), "key", "start", "size", words.alias("taken")).join(used.hint("merge"), ["rank", "nth"])
    turns = scratch.keep(turns.select(F.col("key").alias(of), F.col("slot").alias(slot), F.col("start").alias(start), F.col("size").alias(size), F.col("taken").alias(taken)), "turns")
    repeated = scratch.keep(counted.where("copies > 1").select("key").distinct(), "repeated")
    for name in ("sized", "units", "places", "before"):
        scratch.forget(name)
    if not repeated.isEmpty():  # one row stands for all that are equal to it, as each has its turns
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        marks = repeated.select(F.col("key").alias(of)).hint("shuffle_hash")
        one = keyed.join(marks, F.col(key) == F.col(of), "left_semi").groupBy(key).agg(F.first(whole).alias(of)).select(f"{of}.*", key)
        keyed = keyed.join(marks, F.col(key) == F.col(of), "left_anti").unionByName(one)
    out = keyed.join(turns.hint("shuffle_hash"), F.col(key) == F.col(of))
    cut, first = F.col(taken) < F.col(size), F.expr(f"slice(regexp_extract_all(text, r'({WORDS}[\\x20\\x09-\\x0D]*)', 1), 1, cast({taken} as int))")
    out = out.withColumn("text", F.when(cut, F.array_join(first, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    chunks = max(1, -(-sum(q.slots(block) for q in found) // CHUNK) + 2)
    chunk = F.floor(F.col(slot) / CHUNK).cast("int")
    return out.repartitionById(chunks, chunk).sortWithinPartitions(slot, start, size, key).select(*[F.col(f"`{c}`") for c in docs.columns])
