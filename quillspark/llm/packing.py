"""Packing by power-of-two decomposition.

Every document's ids are cut into pieces whose lengths are the binary digits of its length, whole sequences
of `max_length` first. A piece is a sequence: its length is a power of two, so it needs no padding, and equal
lengths share a bucket, so a batch of one bucket is a rectangle. No sequence holds two documents.

Null or empty text is a document of the end id alone. Repeated rows are packed each for itself; ids of null
documents stay null. Texts may be of any length: one that is longer than a chunk is encoded in parts cut at spaces.
An empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int"
#: Bytes of text that are encoded at a time, and bytes of runs of letters whose ids a worker remembers.
CHUNK_BYTES, KNOWN_BYTES = 4 << 20, 16 << 20
#: Letters that the normalizer composes and lower-cases as Arrow does, then marks: two pre-tokens at most.
SIMPLE = r"^(?P<run>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<mark>[.,;:!?*%#$&)\]}\"-]*)$"
_encoders: dict[str, "WordEncoder"] = {}


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of a pool that begin at `starts`, one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class WordEncoder:
    """Ids of many texts at once, found word by word for the distinct words of the batch.

    The vocabulary's pre-tokenizer never matches across U+0020, its normalizer maps U+000A to U+0020 and
    composes nothing with it, so the ids of a text are those of its words, one after the other. A word of
    letters and then marks is two pre-tokens; runs of letters are encoded many at a time, as one text that is
    cut again after each id that ends a pre-token. Runs stay known to later batches, in Arrow arrays of bounded
    size; the older half goes when they are full, and a run that is longer than a word should be is never kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.normalizer, self.no_normalizer = self.tokenizer.normalizer, Sequence([])
        self.known, self.pool, self.counts = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words taken for themselves, and how many each has."""
        found = [e.ids for at in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `each`, of runs of letters in lower case, which the normalizer would leave as they are."""
        pools, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        self.tokenizer.normalizer = self.no_normalizer
        for at in range(0, len(runs), 2048):
            part = runs[at : at + 2048]
            pool = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[pool]) + 1
            pool, count = (pool, np.diff(cuts, prepend=0)) if len(cuts) == len(part) else self.each(part)
            pools.append(pool)
            counts.append(count)
        self.tokenizer.normalizer = self.normalizer
        return np.concatenate(pools), np.concatenate(counts)

    def runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `encode_runs`, with those remembered that were met before."""
        at = pc.index_in(runs, value_set=self.known)
        new = runs.filter(at.is_null())
        pool, counts = self.encode_runs(new.to_pylist())
        place = at.to_numpy(zero_copy_only=False)
        lost = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
        place = np.where(lost, len(self.counts) + np.cumsum(lost) - 1, place).astype(np.int64)
        whole, every = np.concatenate([self.pool, pool]), np.concatenate([self.counts, counts])
        begin = np.cumsum(every) - every
        out = gathered(whole, begin[place], every[place]), every[place]
        short = pc.binary_length(new).to_numpy(zero_copy_only=False) <= 64
        self.known = pa.concat_arrays([self.known, new.filter(pa.array(short))])
        keep = np.append(np.ones(len(self.counts), bool), short)
        self.pool, self.counts = gathered(whole, begin[keep], every[keep]), every[keep]
        while len(self.known) and self.known.nbytes + self.pool.nbytes + self.counts.nbytes > KNOWN_BYTES:
            half = -(-len(self.known) // 2)
            self.known = pa.concat_arrays([self.known.slice(half), pa.array([], pa.string())])
            self.pool, self.counts = self.pool[self.counts[:half].sum() :].copy(), self.counts[half:].copy()
        return out

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has."""
        cut = pc.extract_regex(words, SIMPLE)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        run, mark = (pc.struct_field(cut.drop_null(), i).dictionary_encode() for i in (0, 1))
        # an upper-case letter only stands where its lower-case form may stand too, so lower case is taken once for each run
        lower = pc.utf8_lower(run.dictionary).dictionary_encode()
        tables = [self.runs(lower.dictionary), self.each(mark.dictionary.to_pylist()), self.each(words.filter(pc.invert(pa.array(simple))).to_pylist())]
        pool, counts = (np.concatenate(x) for x in zip(*tables, strict=True))
        begin = np.cumsum(counts) - counts
        n_runs, n_marks = (len(t[1]) for t in tables[:2])
        # each word is two entries of the table; those of whole words have nothing as their second
        nothing = len(counts)
        counts, begin = np.append(counts, 0), np.append(begin, 0)
        pair = np.full((len(words), 2), nothing)
        pair[simple, 0] = lower.indices.to_numpy()[run.indices.to_numpy()]
        pair[simple, 1] = n_runs + mark.indices.to_numpy()
        pair[~simple, 0] = n_runs + n_marks + np.arange(len(words) - simple.sum())
        return gathered(pool, begin[pair.ravel()], counts[pair.ravel()]), counts[pair].sum(1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each text has."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        pool, counts = self.distinct(coded.dictionary)
        begin = np.append(np.cumsum(counts) - counts, len(pool))
        pool, counts = np.append(pool, np.array([end_id], "<u4")), np.append(counts, 1)
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        words = np.insert(coded.indices.to_numpy(), ends, len(counts) - 1)
        lengths = counts[words]
        total = np.cumsum(lengths)[ends + np.arange(len(ends))] if len(ends) else np.zeros(0, np.int64)
        return gathered(pool, begin[words], lengths), np.diff(total, prepend=0)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def at_spaces(text: str, most: int) -> Iterator[str]:
    """A long text in parts of about `most` characters, cut at spaces, which stand for no id."""
    begin = 0
    while len(text) - begin > most:
        cut = text.rfind(" ", begin + 1, begin + most)
        cut = cut if cut > 0 else text.find(" ", begin + most)
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut + 1
    yield text[begin:]


def chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about `most` bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    yield from ((a, b - a) for a, b in pairwise(cuts) if b > a)


def pieces(n: int, max_length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids, longest first."""
    start = 0
    while n - start >= max_length:
        yield start, max_length
        start += max_length
    step = max_length >> 1
    while step:
        if (n - start) & step:
            yield start, step
            start += step
        step >>= 1


def pack_documents(docs: DataFrame, tokenizer_path: str, *, max_length: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit), bucket (log2 of its length) and sequence.

    A narrow job: no shuffle, and no state from one chunk of texts to the next. `sequence_id` is unique, `offset` is 0.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One text may be longer than a chunk: then its parts are encoded one by one."""
        encode = encoder(tokenizer_path).encode
        if len(texts) > 1 or not len(texts) or texts.nbytes <= 2 * chunk_bytes:
            return encode(texts, end_id)
        parts = [encode(pa.array([p]), end_id)[0] for p in at_spaces(texts[0].as_py(), chunk_bytes)]
        ids = np.concatenate([*(p[:-1] for p in parts), parts[-1][-1:]])
        return ids, np.array([len(ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for first, number in chunks(texts, chunk_bytes):
                ids, counts = encoded(texts.slice(first, number))
                cut = [(doc, *p) for doc, n in enumerate(counts.tolist()) for p in pieces(n, max_length)]
                doc, start, length = (np.array(c, np.int64) for c in zip(*cut, strict=True))
                offsets = np.append(0, np.cumsum(length * 4)).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                bucket = pa.array(np.log2(length).astype(np.int32))
                yield pa.RecordBatch.from_arrays([keys.slice(first, number).take(pa.array(doc)), pa.array(start), pa.array(length), binary, pa.array(counts[doc]), bucket], names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])

    out = map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")), run, SCHEMA)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences by bucket: a reader of one bucket gets equal lengths only."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
