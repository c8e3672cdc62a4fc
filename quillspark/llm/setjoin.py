"""Near duplicates by SimHash and shingle similarity, for groups with a Jaccard similarity of 0.8.

SimHash comes first: each different set of shingles has a fingerprint (64 bits, each the majority of its shingles' hashes),
fingerprints are joined on pigeonhole blocks and verified by their Hamming distance of at most two bits, as in `simhash`,
and what they link is verified by the similarity of the sets. No Hamming distance of 64 bits can promise all sets with a
similarity of 0.8, though: there two fingerprints differ in about ten bits.

So the pigeonhole idea is then applied to the set of shingles itself. A set is cut into blocks by hash; sets that are
close share whole blocks, are joined on them and verified, unless they are of one group by now. This finds most other
links at a low price: in a block of more than `SMALL` sets all are compared with a few hubs only, those whose blocks are
shared most, in one round.

What both leave apart is then joined exactly. In any fixed order of shingles, two sets with a similarity s share one of
the first n - ceil(s n) + 1 shingles of each (the prefix filter), so groups not linked yet meet at the shingles of their
prefixes. The order puts shingles that very many sets have last, so that a passage or template that many documents share
brings nobody together unless a document hardly says anything else. The groups are those of all pairs. The number of
steps does not depend on the size of a block or of a group.

Shingles are told apart by 64-bit hashes, made of whole batches of text at a time. Texts that are null or have no words
have the same empty set and are one group. Repeated rows and ties share a group. A null doc_id has no order: its row gets
the smallest doc_id of its group, or null if there is none. Texts may be of any length. An empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, as_bytes, join_copies, map_batches, map_rows
from .components import components
from .simhash import fingerprint, hamming_links, signed

SEGMENT, BASE = 1 << 19, 0x9E3779B97F4A7C15
PICKED, SMALL, CLASSES = 16, 8, 4
SKETCH_BITS, SPLIT = 512, 512
#: Rows of three numbers that are few enough to be broadcast.
FEW = 100_000
#: Shingles that more sets have are ordered last; of them as many as can be at most, whatever the input's size.
OFTEN, MOST_OFTEN = 100, 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """64-bit hashes of the words of a text, a segment of it at a time: sums of bytes by powers of an odd number."""

    def __init__(self) -> None:
        self.up, self.down = powers(SEGMENT + 1, BASE), powers(SEGMENT + 1, pow(BASE, -1, 1 << 64))

    def of_segment(self, segment: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes and where they begin."""
        b = np.frombuffer(segment, np.uint8)
        n = len(b)
        up, down = (self.up, self.down) if n <= SEGMENT else (powers(n + 1, BASE), powers(n + 1, pow(BASE, -1, 1 << 64)))
        edge = np.flatnonzero(np.diff(~_SPACE[b], prepend=False, append=False))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        begin, end = edge[::2], edge[1::2]
        return mixed((sums[end] - sums[begin]) * down[begin]), begin

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        text, parts, at = text.translate(LOWER), [], 0
        while len(text) - at > SEGMENT:  # cut at white space
            blank = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, SEGMENT, at)])
            size = int(blank[-1]) + 1 if len(blank) else SEGMENT
            while not len(blank) and at + size < len(text):
                more = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, min(SEGMENT, len(text) - at - size), at + size)])
                size += int(more[0]) + 1 if len(more) else min(SEGMENT, len(text) - at - size)
                blank = more
            found, begin = self.of_segment(text[at : at + size])
            parts.append((found, begin + at))
            at += size
        found, begin = self.of_segment(text[at:])
        parts.append((found, begin + at))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


_hashes: list[WordHashes] = []


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text; fewer words than `size` are one shingle, no words none."""
    if not _hashes:
        _hashes.append(WordHashes())
    words, begin = _hashes[0].of(b"\n".join(texts))
    first = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k, w in enumerate(weights):
        whole += words[k : k + len(whole)] * w
    whole = mixed(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        else:
            yield mixed(np.array([(words[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64)


def level(n: int) -> int:
    """Power of two of the number of blocks for n shingles, about four in a block."""
    return max(0, (max(n, 1) // 4).bit_length())


def set_blocks(found: np.ndarray) -> list[int]:
    """Keys of some blocks of a set of shingle hashes, at its size's level and the next lower.

    At level k a shingle belongs to block (hash mod 2^k); of the first 16 of them, those that are not empty are used.
    Two sets with a Jaccard similarity s share a block of m shingles with probability about s^m.
    """
    keys: list[np.ndarray] = []
    for k in {level(len(found)), max(0, level(len(found)) - 1)}:
        block = found & np.uint64((1 << k) - 1)
        chosen = block < PICKED
        some = block[chosen].astype(np.int64)
        sums = np.zeros(PICKED, np.uint64)
        np.add.at(sums, some, mixed(found[chosen]))
        used = np.flatnonzero(np.bincount(some, minlength=PICKED))
        keys.append(mixed(sums[used] + used.astype(np.uint64) + np.uint64((k + 1) << 32)))
    return np.concatenate(keys).view(np.int64).tolist()


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def prefix_length(n: int, least: float) -> int:
    """So many shingles, the first in any order that all sets share, of which two similar sets have one in common."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def prefix(found: np.ndarray, least: float, often: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, those that are in `often` (sorted) after all others."""
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        found = np.concatenate([found[(last := often[at] == found) ^ True], found[last]])
    return found[: prefix_length(len(found), least)]


def sketch(found: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of 512 or more classes, at least twice as many as shingles.

    Sets differ in as many shingles as their sketches in bits, or more.
    """
    bits = max(SKETCH_BITS, 1 << (2 * len(found)).bit_length())
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(wide: bytes, size: int) -> np.ndarray:
    """A sketch of `size` bytes, of fewer classes."""
    return np.bitwise_xor.reduce(np.frombuffer(wide, np.uint64).reshape(-1, size // 8), 0)


def difference(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=np.int64))


def possible(n: int, m: int, h: int, least: float) -> bool:
    """May sets of these sizes, whose sketches differ in h bits, have the similarity?"""
    return min(n, m) >= least * max(n, m) - 1e-9 and h <= (1 - least) / (1 + least) * (n + m) + 1e-9


def meetings(rows: Iterator[tuple], least: float) -> Iterator[tuple]:
    """Pairs (a, b) of rows sorted by cell: in a cell those on the left meet all others.

    Left out are pairs of one group, and those whose sizes or sketches rule out the similarity.
    """
    share = (1 - least) / (1 + least)
    for _, cell in groupby(rows, itemgetter(0, 1, 2)):
        left, right = [], []
        for row in cell:
            (left if row[3] else right).append(row[4:])
        if len(left) * len(right) <= 64:
            right_bits = [int.from_bytes(r[3]) for r in right]
            for a, ga, n, x in left:
                x = int.from_bytes(x)
                for (b, gb, m, _), y in zip(right, right_bits, strict=True):
                    if ga != gb and possible(n, m, (x ^ y).bit_count(), least):
                        yield min(a, b), max(a, b)
            continue
        if not left or not right:
            continue
        b, gb, m = (np.array(c, np.int64) for c in list(zip(*right, strict=True))[:3])
        y = np.frombuffer(b"".join(r[3] for r in right), np.uint64).reshape(len(right), -1)
        for a, ga, n, x in left:
            at = np.flatnonzero((gb != ga) & (np.minimum(m, n) >= least * np.maximum(m, n) - 1e-9))
            h = np.bitwise_count(y[at] ^ np.frombuffer(x, np.uint64)).sum(1, dtype=np.int64)
            for other in b[at[h <= share * (m[at] + n) + 1e-9]].tolist():
                yield min(a, other), max(a, other)


def map_sets(docs: DataFrame, fn, schema: str, *, shingle: int, columns: int) -> DataFrame:
    """mapInArrow over texts by the batch: fn(keys, set) of each row yields rows; the text is the column after the keys."""

    def run(batches: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0
        for row in batches:
            held.append(row)
            size += len(row[columns] or b"")
            if size >= SEGMENT:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    def flush(held: list[tuple]) -> Iterator[tuple]:
        for row, found in zip(held, shingle_sets([r[columns] or b"" for r in held], shingle), strict=True):
            yield fn(*row[:columns], found)

    return map_rows(docs, run, schema, binary=(docs.columns[columns],))


def between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of some pairs (a, b) that are of different groups."""
    group = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    return pairs.join(group("a"), "a", "left").join(group("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")


class Join:
    """The steps of one similarity join; tables that later steps read are written to the shared folder."""

    def __init__(self, docs: DataFrame, shingle: int, least: float):
        self.scratch, self.shingle, self.least = Scratch(docs.sparkSession), shingle, least
        self.spark = docs.sparkSession
        self.source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))

    def describe(self) -> None:
        """`rows`: the set of every row, named by its hash. `nodes`: each different set, with the least row that has it."""

        def row(doc_id, digest, found):
            return doc_id, digest, xxhash.xxh3_64_intdigest(found.tobytes()) >> 1, len(found), set_blocks(found), folded(sketch(found), SKETCH_BITS // 8).tobytes(), signed(fingerprint(found))

        keep = self.scratch.keep
        self.rows = keep(map_sets(self.source, row, "doc_id long, digest long, node long, n int, keys array<long>, sketch binary, fp long", shingle=self.shingle, columns=2), "sets")
        first = self.rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n", "keys", "sketch", "fp")).alias("r"), F.count("*").alias("copies"))
        self.nodes = keep(first.select("node", "r.doc_id", "r.digest", "r.n", "r.keys", "r.sketch", "r.fp", "copies"), "nodes")

    def sets_of(self, pairs: DataFrame) -> DataFrame:
        """The sets of all nodes of some pairs."""
        involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.scratch.keep(self.nodes.select("node", F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).join(involved, "node"), "wanted")
        # a few are sent to where the texts are; of more, the texts are sent to them
        wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted.hint("shuffle_hash")
        texts = self.source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest"))).select("node", "text")
        return self.scratch.keep(map_sets(texts, lambda node, found: (node, found.tobytes()), "node long, shingles binary", shingle=self.shingle, columns=1).dropDuplicates(["node"]), "shingles")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of some stored pairs that have the similarity."""
        sets, least = self.sets_of(pairs), self.least

        def run(some: Iterator[tuple]) -> Iterator[tuple]:
            for a, b, x, y in some:
                if similarity(x, y) >= least:
                    yield a, b

        left, right = (sets.select(F.col("node").alias(side), F.col("shingles").alias(of)) for side, of in (("a", "x"), ("b", "y")))
        links = self.scratch.keep(map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long"), "links")
        for name in ("shingles", "wanted"):
            self.scratch.forget(name)
        return links

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those of some pairs whose sizes and sketches allow the similarity, stored."""
        least = self.least

        def run(some: Iterator[tuple]) -> Iterator[tuple]:
            for a, b, n, m, x, y in some:
                if possible(n, m, difference(x, y), least):
                    yield a, b

        left, right = (self.nodes.select(F.col("node").alias(side), F.col("n").alias(n), F.col("sketch").alias(of)) for side, n, of in (("a", "n", "x"), ("b", "m", "y")))
        sizes = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9
        return self.scratch.keep(map_rows(pairs.join(left, "a").join(right, "b").where(sizes).select("a", "b", "n", "m", "x", "y"), run, "a long, b long"), "pairs")

    def by_fingerprints(self) -> DataFrame:
        """Links of sets whose fingerprints differ in two bits or fewer: of one fingerprint's sets each with the least, which stand for it."""
        marked = self.nodes.select("node", "fp")
        distinct = self.scratch.keep(marked.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("copies")), "fps")
        same = join_copies(marked, distinct, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
        near = hamming_links(distinct.select(F.col("least").alias("node"), "fp"), self.scratch)
        pairs = self.likely(same.unionByName(near).distinct())
        for name in ("fps", "shared", "met"):
            self.scratch.forget(name)
        return self.verified(pairs)

    def by_blocks(self, found: DataFrame | None = None) -> DataFrame:
        """Links of sets that share a block: all pairs of small blocks, and of larger ones the pairs with a hub; none within a group in `found`."""
        keep = self.scratch.keep
        keyed = self.nodes.select("node", F.explode("keys").alias("key"))
        shared = keep(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        blocks = keep(keyed.join(shared, "key"), "blocks")
        weight = keep(blocks.groupBy("node").agg(F.sum("size").alias("popular")), "popular")
        # one hub from each of some hash classes of a block, and all sets of a small one: partial maxima, whatever the block's size
        spread = F.when(F.col("size") <= SMALL, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(CLASSES)))
        hubs = keep(blocks.join(weight, "node").groupBy("key", spread.alias("class")).agg(F.max_by("node", F.struct("popular", -F.col("node"))).alias("hub")).select("key", "hub"), "hubs")
        pairs = blocks.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = self.likely(pairs if found is None else between(pairs, found))
        for name in ("shared", "blocks", "popular", "hubs"):
            self.scratch.forget(name)
        return self.verified(pairs)

    def frequent(self) -> np.ndarray:
        """Shingles that very many sets have, sorted: at most MOST_OFTEN, as the threshold rises with their number.

        Counted where they are among the first in order of hash, and where a task meets them twice. Which ones are found
        decides how fast the join is and not what it finds.
        """
        least, shingle = self.least, self.shingle

        def count(rows: Iterator[tuple]) -> Iterator[tuple]:
            held: list[np.ndarray] = []
            n = size = 0
            texts: list[bytes] = []
            for (text,) in rows:
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= SEGMENT:
                    held.append(zones(texts))
                    n += len(held[-1])
                    texts, size = [], 0
                    if n > 1 << 20:
                        yield from several(held)
                        held, n = [], 0
            yield from several([*held, zones(texts)])

        def zones(texts: list[bytes]) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.uint64), *(found[: prefix_length(len(found), least) * 3 // 2] for found in shingle_sets(texts, shingle))])

        def several(held: list[np.ndarray]) -> Iterator[tuple]:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            yield from zip(token[times > 1].view(np.int64).tolist(), times[times > 1].tolist(), strict=True)

        counted = self.scratch.keep(map_rows(self.source.select("text"), count, "token long, k long", binary=("text",)).groupBy("token").agg(F.sum("k").alias("k")).where(F.col("k") > OFTEN), "often")
        # all counts together allow so many tokens over the threshold, and no more
        total = counted.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()["k"]
        found = counted.where(F.col("k") > max(OFTEN, total // MOST_OFTEN)).select("token").collect()
        return np.sort(np.array([r.token for r in found], np.int64).view(np.uint64))

    def apart(self, found: DataFrame) -> DataFrame:
        """Pairs (a, b) of different groups that may have the similarity, with h, the difference of their sketches.

        At a shingle, all that are not of its most frequent group meet all others. Frequent shingles are split into
        cells of about `SPLIT` documents on each side, so no shingle is one task and the largest group costs its size.
        """
        keep, least = self.scratch.keep, self.least
        often = self.spark.sparkContext.broadcast(self.frequent())

        def row(doc_id, digest, found):
            return doc_id, digest, prefix(found, least, often.value).tobytes(), sketch(found)

        described = map_sets(self.source, row, "_doc long, _digest long, prefix binary, wide binary", shingle=self.shingle, columns=2)
        grouped = self.nodes.join(found, "node", "left").select("node", "doc_id", "digest", "n", "sketch", F.coalesce("component", F.col("node")).alias("component"))
        known = keep(described.join(grouped, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))).select("node", "component", "n", "sketch", "wide", "prefix").dropDuplicates(["node"]), "known")

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for first in range(0, whole.num_rows, 256):
                    batch = whole.slice(first, 256)
                    parts = as_bytes(batch.column(2))
                    times = [len(x) // 8 for x in parts]
                    node, group = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(parts), np.int64)), pa.array(node), pa.array(group)], names=["token", "node", "component"])

        postings = map_batches(known.select("node", "component", "prefix"), expand, "token long, node long, component long")
        # shingles of more than one group
        tokens = keep(postings.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "tokens")
        shared = keep(postings.join(tokens, "token"), "postings")
        counted = shared.groupBy("token", "component").agg(F.count("*").alias("k"))
        tops = counted.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("others"))
        tops = keep(tops.select("token", "top", F.ceil(F.col("others") / SPLIT).alias("rows"), F.ceil(F.col("all") / SPLIT).alias("columns")), "tops")
        met = shared.join(tops, "token").join(known.select("node", "n", "sketch"), "node")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        columns = ["node", "component", "n", "sketch"]
        left = met.where("component <> top").select("token", own("rows").alias("i"), each("columns").alias("j"), F.lit(True).alias("left"), *columns)
        right = met.select("token", each("rows").alias("i"), own("columns").alias("j"), F.lit(False).alias("left"), *columns)
        cells = left.unionByName(right).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        pairs = keep(map_rows(cells, lambda rows: meetings(rows, least), "a long, b long").distinct(), "pairs")

        def run(some: Iterator[tuple]) -> Iterator[tuple]:
            for a, b, n, m, x, y in some:
                if possible(n, m, h := difference(x, y), least):
                    yield a, b, h

        side = lambda node, n, wide: known.select(F.col("node").alias(node), F.col("n").alias(n), F.col("wide").alias(wide))
        wide = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
        found = keep(map_rows(wide, run, "a long, b long, h int"), "apart")
        for name in ("known", "tokens", "postings", "tops"):
            self.scratch.forget(name)
        often.destroy()
        return found

    def groups(self) -> DataFrame:
        """(node, component) of the nodes that have links."""
        keep = self.scratch.keep
        found = keep(components(self.by_fingerprints(), self.scratch), "groups")
        found = self.joined(found, self.by_blocks(found))
        far = self.apart(found)
        if far.isEmpty():
            return found
        # each one's nearest first: after that few pairs are of different groups
        closest = keep(far.groupBy("a").agg(F.min_by("b", F.struct("h", "b")).alias("b")).unionByName(far.groupBy("b").agg(F.min_by("a", F.struct("h", "a")).alias("a")).select("a", "b")).distinct(), "closest")
        found = self.joined(found, self.verified(closest))
        left = keep(between(far.join(closest, ["a", "b"], "left_anti"), found), "left")
        return found if left.isEmpty() else self.joined(found, self.verified(left))

    def joined(self, found: DataFrame, links: DataFrame) -> DataFrame:
        """Groups with some links more."""
        return found if links.isEmpty() else self.scratch.keep(components(found.toDF("a", "b").unionByName(links), self.scratch), "groups")


def near_groups(docs: DataFrame, *, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), group (a number) and component_id (its least doc_id) of every row."""
    join = Join(docs, shingle, least)
    join.describe()
    grouped = join.nodes.join(join.groups(), "node", "left").select("node", "copies", "doc_id", F.coalesce("component", F.col("node")).alias("group"))
    # what is kept of a group is one row, so the join by group has as many rows as there are sets
    grouped = join.scratch.keep(grouped, "grouped")
    least_ids = join.scratch.keep(grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.sum(F.lit(1)).alias("copies")), "least")
    of_set = join.scratch.keep(join_copies(grouped.select("node", "group", F.col("copies").alias("rows")), least_ids, "group").select("node", "group", "component_id", F.col("rows").alias("copies")), "of")
    for name in join.scratch.paths.keys() - {"sets", "of"}:
        join.scratch.forget(name)
    return join_copies(join.rows.select("doc_id", "digest", "node"), of_set, "node").select("doc_id", "digest", "group", "component_id")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, digest, component_id: groups linked by a Jaccard similarity of word shingles >= least."""
    return near_groups(docs, shingle=shingle, least=least).drop("group")
