"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a node in the tree of each context of 0 to `depth` bytes
before it. A node's Krichevsky-Trofimov estimate is mixed, half and half, with the product of its children's
weighted probabilities, so all depths share in each prediction by how well they have coded the corpus. The tree
is learned from the training rows and then held; the score is the sum of log10 P over a text's bytes and one end
mark, and code length per byte follows from it.

One pass cuts the documents into chunks and counts each chunk's byte n-grams and the 64-bit hashes of its words
(training counts; 0 for what only held-out rows have). The n-grams' sums, dealt by their last three context bytes, hold
all tree nodes below those contexts together; the nodes of two bytes of context are a table of sums, and of what is above
the driver mixes at most 65,280 nodes. Each chunk then gets back the probabilities of its own n-grams and the counts of its own words, so nothing that grows with the
corpus is broadcast, and no key has more rows than there are chunks. Input splits are joined while each core keeps two
tasks, as larger chunks have fewer n-grams a byte.

Null and empty texts are one end mark. Repeated rows and ties score alike (and count each in training); rows with a null
doc_id belong to the fold of the text `null`. Texts may be of any length. Empty tables give empty results; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import splits
from .common import Scratch, as_bytes, crc_mod, map_batches, tidy_after
from .setjoin import WordHashes

DEPTH, CHUNK_BYTES, PART_BYTES, END = 5, 32 << 20, 2 << 20, b"\xff"
CHUNKS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
DOCS, GRAM, TOKEN = 0, 1, 2
#: The key of the end token among those of words.
END_KEY = np.int64(-1)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (context bytes, oldest first, then the byte) of all bytes and end marks, and where each text's begin."""
    pad = bytes(depth)
    whole = np.frombuffer(b"".join(x for t in texts for x in (pad, t, END)), np.uint8)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    code = np.zeros(len(whole) - depth, np.int64)
    for i in range(depth + 1):
        code <<= 8
        code |= whole[i : len(whole) - depth + i]
    starts = np.concatenate([[0], np.cumsum(n + depth)[:-1]])
    keep = np.ones(len(code), bool)
    for i in range(depth):  # codes that end in the next text's padding
        keep[starts[1:] - i - 1] = False
    return code[keep], np.concatenate([[0], np.cumsum(n)[:-1]])


_hashes: list[WordHashes] = []


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the place of each one's text."""
    if not _hashes:
        _hashes.append(WordHashes())
    found, begin = _hashes[0].of(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return found.view(np.int64), np.searchsorted(ends, begin, side="right")


def tally(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and their counts in training rows (0 where only held-out rows have them)."""
    place, found = pd.factorize(keys)
    return found, np.bincount(place, trained, len(found)).astype(np.int64)


def merged(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in tallies)]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([np.zeros(0), *(n for _, n in tallies)]), len(keys)).astype(np.int64)


class Tallies:
    """Tallies of a chunk's parts, merged before they are many."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, tally: tuple[np.ndarray, np.ndarray]) -> None:
        self.held.append(tally)
        if len(self.held) > 1 and sum(len(k) for k, _ in self.held[1:]) > max(1 << 20, len(self.held[0][0])):
            self.held = [merged(self.held)]


def packed(batch: pa.RecordBatch) -> bytes:
    """Documents as compressed Arrow."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 1)


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


def rows_of(kind: int, length: int, number: int, **columns) -> pa.RecordBatch:
    fixed = {"chunk": pa.array(np.full(length, number)), "kind": pa.array(np.full(length, kind, np.int32))} | columns
    return pa.RecordBatch.from_arrays([fixed.get(f.name, pa.nulls(length, f.type)) for f in CHUNKS], schema=CHUNKS)


class Chunk:
    """What one chunk of documents sends on: its parts as they are added, its tallies at the end."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth, self.size, self.gram, self.token = number, depth, 0, Tallies(), Tallies()

    def add(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """Count a part (doc_id, held, text); its row."""
        trained, texts = ~part.column(1).to_numpy(zero_copy_only=False), [t or b"" for t in as_bytes(part.column(2))]
        code, starts = grams(texts, self.depth)
        self.gram.add(tally(code, np.repeat(trained, np.diff(np.append(starts, len(code))))))
        keys, place = word_keys(texts)
        self.token.add(tally(keys, trained[place]))
        self.token.add((np.array([END_KEY]), np.array([trained.sum()])))
        self.size += len(code)
        documents = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.large_binary())], names=["doc_id", "held", "text"])
        return rows_of(DOCS, 1, self.number, blob=pa.array([packed(documents)], pa.binary()))

    def end(self) -> Iterator[pa.RecordBatch]:
        for kind, found in ((GRAM, self.gram), (TOKEN, self.token)):
            keys, counts = merged(found.held)
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield rows_of(kind, len(some), self.number, key=pa.array(some), n=pa.array(counts[at : at + 100_000]))


def in_parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes, one row at least."""
    held: list[pa.RecordBatch] = []
    n = 0
    for whole in batches:
        lengths = pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, length in enumerate(lengths.tolist()):
            n += length + 1
            if n >= size:
                yield pa.concat_batches([*held, whole.slice(at, i + 1 - at)])
                held, n, at = [], 0, i + 1
        if at < whole.num_rows:
            held.append(whole.slice(at))
    if held:
        yield pa.concat_batches(held)


def cut_chunks(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(TaskContext.get().partitionId() << 24, depth)
        for part in in_parts(batches, PART_BYTES):
            yield chunk.add(part)
            if chunk.size >= CHUNK_BYTES:
                yield from chunk.end()
                chunk = Chunk(chunk.number + 1, depth)
        if chunk.size:
            yield from chunk.end()

    return run


def by_bytes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, key, value) as one row for each chunk and run of rows: sorted keys and their values, compressed."""

    def blobs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        chunk, key, value = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
        order = np.lexsort((key, chunk))
        chunk, key, value = chunk[order], key[order], value[order]
        numbers, first = np.unique(chunk, return_index=True)
        rows = [zstandard.compress(by_bytes(np.diff(k, prepend=0)) + by_bytes(v), 1) for k, v in zip(np.split(key, first[1:]), np.split(value, first[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(rows, pa.binary())], names=["chunk", "blob"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 1 << 20:
            yield from blobs(held)
            held, n = [], 0
    yield from blobs(held)


def received(blobs: Iterable[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of some blobs."""
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    for blob in blobs:
        raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
        n = len(raw) // (8 + np.dtype(kind).itemsize)
        number = lambda part, of: np.ascontiguousarray(part.reshape(-1, n).T).view(of).ravel()  # noqa: B023, E731
        keys.append(np.cumsum(number(raw[: 8 * n], np.int64)))
        values.append(number(raw[8 * n :], kind))
    return np.concatenate(keys), np.concatenate(values)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2, by Stirling's series past 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    while (low := x < 8).any():
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: keys (context << 8 | bit path), counts, weighted probability."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        kt = log_kt(n0, n1)
        self.log_w = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        self.stop = np.ones(len(key)) if below is None else np.exp(kt - np.log(2) - self.log_w)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    def parents(self, depth: int) -> np.ndarray:
        """Keys of the nodes one byte of context above, of `depth` bytes."""
        return self.key >> 8 << 8 & ((1 << 8 * (depth + 1)) - 1) | self.key & 255

    def above(self, depth: int) -> tuple["Level", np.ndarray]:
        key, place = np.unique(self.parents(depth), return_inverse=True)
        total = lambda v: np.bincount(place, v, len(key))
        return Level(key, total(self.n0), total(self.n1), total(self.log_w)), place


def leaves(gram: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level, and for each gram and bit its node's place and the bit."""
    context, byte = gram >> 8, gram & 255
    node = np.stack([context << 8 | 1 << j | byte >> (8 - j) for j in range(8)])
    bit = np.stack([byte >> (7 - j) & 1 for j in range(8)])
    key, place = np.unique(node, return_inverse=True)
    place = place.reshape(node.shape)
    weight = np.broadcast_to(n, node.shape)
    n0 = np.bincount(place.ravel(), np.where(bit, 0, weight).ravel(), len(key))
    n1 = np.bincount(place.ravel(), np.where(bit, weight, 0).ravel(), len(key))
    return Level(key, n0, n1, None), place, bit


def climb(gram: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels `depth` down to `least`, the places of each level's nodes in the next, and what leaves() says of bits."""
    level, place, bit = leaves(gram, n)
    levels, ups = [level], []
    for d in range(depth - 1, least - 1, -1):
        level, up = level.above(d)
        levels.append(level)
        ups.append(up)
    return levels, ups, place, bit


SUMS, GRAMS_TOGETHER = "key long, n0 double, n1 double, below double", 100_000


def sums_above(level: Level, depth: int) -> pa.Table:
    """What a level's nodes, of `depth` bytes of context, add to those one byte of context above."""
    key, place = np.unique(level.parents(depth - 1), return_inverse=True)
    return pa.table([pa.array(key), *(pa.array(np.bincount(place, v, len(key))) for v in (level.n0, level.n1, level.log_w))], names=["key", "n0", "n1", "below"])


def level_of(batch: pa.RecordBatch) -> Level:
    return Level(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))


def summed_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])


def log_probabilities(summed: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """(gram, value): log10 P(byte | context) under the tree of all grams' counts.

    Grams are dealt by their last three context bytes into buckets of about `GRAMS_TOGETHER`. What is above is summed to
    nodes of two bytes of context, a table, and of one byte, of which at most 65,280 reach the driver.
    """
    spark, h = summed.sparkSession, min(depth, 3)
    scratch = scratch or Scratch(spark)
    context = lambda n: F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * n) - 1))
    buckets = summed.count() // GRAMS_TOGETHER + 1
    dealt = summed.select("gram", "n", context(h - 1).alias("upper"), F.pmod(F.xxhash64(context(h)), F.lit(buckets)).alias("bucket"))

    def up(table: pa.Table) -> pa.Table:
        levels, _, _, _ = climb(table.column("gram").to_numpy(), table.column("n").to_numpy(), depth, h)
        return sums_above(levels[-1], h)

    def higher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sums_above(level_of(batch), 2).to_batches()

    nodes = scratch.keep(summed_up(dealt.groupBy("bucket").applyInArrow(lambda t: tidy_after(up, t), SUMS)), "nodes")
    rows = (summed_up(map_batches(nodes, higher, SUMS)) if h == 3 else nodes).toArrow().sort_by("key")
    one = Level(*(rows.column(c).to_numpy() for c in ("key", "n0", "n1", "below")))
    zero, place = one.above(0)
    mass, told = (1 - zero.stop)[place], (zero.stop * zero.one)[place]
    mass, told, keys = mass * (1 - one.stop), told + mass * one.stop * one.one, one.key

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = level_of(batch)
            at = np.searchsorted(keys, level.parents(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mass[at] * (1 - level.stop)), pa.array(told[at] + mass[at] * level.stop * level.one)], names=["key", "m", "t"])

    given = map_batches(nodes, share, "key long, m double, t double") if h == 3 else spark.createDataFrame(pa.table({"key": keys, "m": mass, "t": told}))
    # a bucket gets what is above its own contexts
    needed = dealt.select(F.col("upper").alias("of"), F.col("bucket").alias("to")).distinct()
    sent = given.join(needed, F.shiftright("key", 8) == F.col("of")).select("to", "key", "m", "t")

    def down(table: pa.Table, upper: pa.Table) -> pa.Table:
        gram = table.column("gram").to_numpy()
        levels, ups, place, bit = climb(gram, table.column("n").to_numpy(), depth, h)
        upper = upper.sort_by("key")
        at = np.searchsorted(upper.column("key").to_numpy(), levels[-1].parents(h - 1))
        m, t = (upper.column(c).to_numpy()[at] for c in "mt")
        for level, up_place in zip(levels[:0:-1], ups[::-1], strict=True):
            m, t = (m * (1 - level.stop))[up_place], (t + m * level.stop * level.one)[up_place]
        p = np.clip(t + m * levels[0].one, 1e-12, 1 - 1e-12)
        value = np.where(bit, np.log10(p)[place], np.log10(1 - p)[place]).sum(0)
        return pa.table({"gram": gram, "value": value})

    return dealt.groupBy("bucket").cogroup(sent.groupBy("to")).applyInArrow(lambda t, u: tidy_after(down, t, u), "gram long, value double")


class Lookup:
    """Values of keys that are all there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.index, self.values = pd.Index(keys), values

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.index.get_indexer(keys)
        if (at < 0).any():
            raise ValueError("a key of the chunk was not sent back")
        return self.values[at]


def score_texts(docs: DataFrame, *, folds: int = 10, depth: int = DEPTH) -> DataFrame:
    """The contract's columns for every document; fold 0 is held out of training. `depth` is at most 6."""
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6 bytes")
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == 0).alias("held"), "text")
    n = splits(source) or 0
    joined = n // (2 * spark.sparkContext.defaultParallelism)
    source = source.coalesce(n // joined) if joined > 1 else source
    cut = scratch.keep(map_batches(source, cut_chunks(depth), "chunk long, kind int, key long, n long, blob binary"), "chunks", "kind")
    chunk_grams, chunk_tokens = (cut.where(F.col("kind") == kind).select("chunk", "key", "n") for kind in (GRAM, TOKEN))
    summed = scratch.keep(chunk_grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    values = scratch.keep(log_probabilities(summed.withColumnRenamed("key", "gram"), depth, scratch), "values")
    for name in ("grams", "nodes"):
        scratch.forget(name)
    # a word has at most one row per chunk: its sum is found where its rows meet, in one shuffle
    same = Window.partitionBy("key")
    counts = scratch.keep(chunk_tokens.select("chunk", "key", "n", F.sum("n").over(same).alias("c"), (F.min("chunk").over(same) == F.col("chunk")).alias("head")), "tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("head") & (F.col("c") > 0), 1)).alias("v")).first()
    train_tokens, distinct = int(total["n"]), int(total["v"])
    # a byte's logarithm to seven digits
    told = chunk_grams.join(values.withColumnRenamed("gram", "key"), "key").select("chunk", "key", F.col("value").cast("float").alias("value"))
    tables = [map_batches(df, send, "chunk long, blob binary").withColumn("kind", F.lit(kind)) for kind, df in ((GRAM, told), (TOKEN, counts.select("chunk", "key", "c")))]
    sent = cut.where(F.col("kind") == DOCS).select("chunk", "blob", "kind").unionByName(tables[0]).unionByName(tables[1])
    floor = np.log10(train_tokens + 0.1 * (distinct + 1))
    scratch.sweep()

    def score(chunk: pa.Table) -> pa.Table:
        kinds, column = chunk.column("kind").to_pylist(), chunk.column("blob")
        blobs = lambda kind: (column[i].as_py() for i, k in enumerate(kinds) if k == kind)
        logs, known = Lookup(*received(blobs(GRAM), np.float32)), Lookup(*received(blobs(TOKEN), np.int64))
        end = known(np.array([END_KEY]))[0]
        out = []
        for blob in blobs(DOCS):
            rows = unpacked(blob)
            texts = rows.column("text").to_pylist()
            code, starts = grams(texts, depth)
            scores = np.add.reduceat(logs(code).astype(float), starts)
            keys, place = word_keys(texts)
            counted = known(keys)
            per = lambda x: np.bincount(place, x, len(texts))  # noqa: B023, E731
            base = per(np.log10(counted + 0.1) - floor) + np.log10(end + 0.1) - floor
            whole = lambda x: pa.array(x.astype(np.int64))
            # bits by byte, the end mark counted as one
            bits = -scores * np.log2(10) / np.diff(np.append(starts, len(code)))
            columns = {"doc_id": rows.column("doc_id"), "held_out": rows.column("held"), "n_tokens": whole(per(None) + 1), "n_known": whole(per(counted > 0) + (end > 0))}
            columns |= {"train_tokens": pa.array(np.full(len(texts), train_tokens)), "base_score": pa.array(base), "score": pa.array(scores), "bits_per_byte": pa.array(bits)}
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return sent.groupBy("chunk").applyInArrow(lambda chunk: tidy_after(score, chunk), schema)
