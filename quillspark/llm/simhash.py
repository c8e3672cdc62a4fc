"""SimHash near-dedup by pigeonhole blocks.

Fingerprints: bit i is set if it is set in over half of the XXH64 (seed 42) hashes of a document's word shingles.
Pigeonhole: a fingerprint is cut into four blocks (more where there are so many fingerprints that half of their bits
tell few apart); two that differ in at most two bits agree in all blocks but two. Distinct fingerprints (one row for any
number of exact copies) are joined on each choice of such blocks, and each pair that meets is verified by its Hamming
distance, where the first choice that it agrees in finds it. Blocks that more than `LARGE` fingerprints share, as groups
of edited copies do, are not paired: two fingerprints differ in at most two bits just if some 64-bit word differs from
both in at most one, so each sends itself to the 65 such words, and the at most 65 that meet at a word are linked to the
least. Neither step grows with the square of a group, and both are exact.

Null and empty texts have fingerprint zero and are linked like any other. Ties and repeated rows share their
fingerprint and component. A null doc_id has no order: it gets its component's smallest doc_id. Texts may be of
any length (shingles are counted in blocks). An empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_copies, map_rows, words
from .components import components

BLOCKS, LARGE = 4, 64


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def shingles(found: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words, repeats included; fewer words are one shingle; no words, none."""
    if len(found) < size:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(size)))))  # noqa: B905  the shortest is the number of shingles


def hashes(text: bytes, size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    parts = shingles(words(text), size)
    return np.fromiter((digest(s, 42) for s in parts), np.uint64, len(parts))


def fingerprint(h: np.ndarray) -> int:
    """64 bits, each the majority of the hashes' bits."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[at : at + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row: narrow."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            fp = fingerprint(hashes(text, shingle)) if text else 0
            yield doc_id, signed(fp)

    return map_rows(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), run, "doc_id long, fp long", binary=("text",))


def choices(blocks: int, differ: int = 2) -> list[int]:
    """The bits of every choice of all blocks but `differ`, as signed masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in pairwise(edges)]
    return [signed(sum(chosen)) for chosen in combinations(masks, blocks - differ)]


def blocks_for(n: int) -> int:
    """Blocks that keep chance meetings few: four have keys of 32 bits, six of 43, ten of 51."""
    return BLOCKS if n < 1 << 30 else 6 if n < 1 << 40 else 10


def hamming_links(distinct: DataFrame, scratch: Scratch, *, blocks: int | None = None, most: int = LARGE) -> DataFrame:
    """Links (a, b) between the `node`s of distinct fingerprints, enough to connect all that differ in two bits or fewer."""
    blocks = blocks or blocks_for(distinct.count())
    masks = choices(blocks)
    keys = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")) for n, mask in enumerate(masks)])
    keyed = distinct.select("node", "fp", F.explode(keys).alias("key"))
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = scratch.keep(keyed.join(shared, "key"), "met")
    small = met.where(F.col("n") <= most).select("key", "node", "fp")
    left, right = (small.select("key", F.col("node").alias(node), F.col("fp").alias(fp)) for node, fp in (("a", "x"), ("b", "y")))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(mask)) == 0, n) for n, mask in enumerate(masks)])
    near = left.join(right, "key").where((F.col("x") < F.col("y")) & (F.bit_count(differ) <= 2) & (first == F.col("key.choice")))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowd = met.where(F.col("n") > most).select("node", "fp").distinct()
    one_bit = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    words = crowd.select("node", F.explode(one_bit).alias("word")).groupBy("word").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    return near.unionByName(words.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b").distinct())


def near_components(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.keep(fingerprints(docs, shingle=shingle), "fingerprints")
    # copies fold into one row before any shuffle; its node is the smallest doc_id of them
    distinct = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "distinct")
    found = components(hamming_links(distinct.where("node is not null"), scratch), scratch)
    of_fp = scratch.keep(distinct.join(found, "node", "left").select("fp", "copies", F.coalesce("component", F.col("node")).alias("component_id")), "of")
    return join_copies(marked, of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
