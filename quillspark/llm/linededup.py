"""Line dedup: range-partitioned hashes with a secondary sort; the result is keep bitmaps, not text.

A line's key is the line without white space (U+0020, U+0009 to U+000D) at its ends and with A-Z lowered. Each
document's distinct keys become (hash, document, positions) rows. They are range-partitioned by hash and
document and sorted, so that a line of a third of all documents spans as many partitions as it needs, and a
partition is read as one stream. Within a partition at most `min_docs` - 1 rows are held. What a partition
cannot decide alone concerns its first and last key only: these few rows are settled by a sum over partitions.

mode "all" drops every line of a key found in `min_docs` documents or more; mode "later" keeps the first line of
such a key, in order of document and position, and drops the others.

Null or empty text is one empty line. Keys of fewer than `min_chars` code points are never dropped. Rows with the
same doc_id and text are one document, and get the same bitmap; a null doc_id sorts first. Line and text may
be of any length; ties have no part in anything. An empty table gives an empty result. Other columns, whatever their
names, are kept where documents are returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, fresh, map_rows, schema_of

SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE) for line in text.translate(LOWER).split(b"\n")]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def hash_rows(docs: DataFrame, min_chars: int, id_column: str, text_column: str) -> DataFrame:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, digest, text in rows:
            at: dict[bytes, list[int]] = {}
            keys = line_keys(text or b"")
            for i, key in enumerate(keys):
                if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                    at.setdefault(key, []).append(i)
            for key, positions in at.items():
                h = xxhash.xxh3_128_intdigest(key)
                yield signed(h >> 64), signed(h & (1 << 64) - 1), doc_id, digest, positions, len(keys)

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("digest"), F.col(text_column).alias("text"))
    return map_rows(source, run, "h1 long, h2 long, doc_id long, digest long, positions array<int>, n_lines int", binary=("text",))


SURE, OPEN, COUNT = 0, 1, 2


def stream(rows: Iterator[tuple], min_docs: int, later: bool) -> Iterator[tuple]:
    """Rows of one partition in order; yields (kind, h1, h2, doc_id, digest, positions, n_lines, n, first).

    SURE: positions to drop. OPEN: to drop only if the key has min_docs documents in all partitions (or, for
    "later", if an earlier partition holds the key's first line). COUNT: documents here of a key at a border.
    """
    held: list[tuple] = []
    key = doc = None
    n, first_run, own_first = 0, True, None

    def drops(row: tuple, is_first: bool) -> list[int]:
        return row[4][1:] if later and is_first else row[4]

    def end(border: bool) -> Iterator[tuple]:
        if key is None:
            return
        if border:
            for i, row in enumerate(held):
                if p := drops(row, i == 0):
                    yield OPEN, *row[:4], p, row[5], 0, False
            if later and own_first:
                yield OPEN, *own_first[:4], own_first[4][:1], own_first[5], 0, True
            yield COUNT, *key, None, None, None, None, n, False

    for row in rows:
        if row[:2] != key:
            yield from end(first_run)
            first_run = key is None
            key, doc, n, held, own_first = row[:2], None, 0, [], row
        if row[2:4] == doc:
            continue
        doc = row[2:4]
        n += 1
        if n < min_docs:
            held.append(row)
            continue
        for i, old in enumerate(held):
            if p := drops(old, i == 0):
                yield SURE, *old[:4], p, old[5], 0, False
        held = []
        if p := drops(row, n == 1):
            yield SURE, *row[:4], p, row[5], 0, False
    yield from end(True)


def dropped_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, mode: str = "all", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, positions, n_lines) of lines to drop; several rows per document."""
    if mode not in ("all", "later"):
        raise ValueError("mode is 'all' or 'later'")
    scratch, later = Scratch(docs.sparkSession), mode == "later"
    order = ["h1", "h2", "doc_id", "digest"]
    lines = scratch.keep(hash_rows(docs, min_chars, id_column, text_column), "lines")
    # the number of positions would split equal documents' rows; it is no part of the order
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = map_rows(ordered, lambda rows: stream(rows, min_docs, later), "kind int, h1 long, h2 long, doc_id long, digest long, positions array<int>, n_lines int, n long, head boolean")
    found = scratch.keep(found.withColumn("part", F.spark_partition_id()), "dropped")
    scratch.forget("lines")
    # at most two rows from each partition
    border = found.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("owner")).where(F.col("total") >= min_docs)
    settled = found.where(F.col("kind") == OPEN).join(F.broadcast(border), ["h1", "h2"]).where(~F.col("head") | (F.col("part") > F.col("owner")))
    columns = ["doc_id", "digest", "positions", "n_lines"]
    return found.where(F.col("kind") == SURE).select(*columns).unionByName(settled.select(*columns))


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), n_lines, n_dropped and the zlib-packed keep bitmap of every document that loses lines."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, digest, n_lines, positions in rows:
            bits = np.ones(n_lines, np.uint8)
            bits[positions] = 0
            yield doc_id, digest, n_lines, int(n_lines - bits.sum()), zlib.compress(np.packbits(bits).tobytes())

    gathered = dropped_lines(docs, **options).groupBy("doc_id", "digest").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("positions")).alias("positions"))
    return map_rows(gathered, run, "doc_id long, digest long, n_lines long, n_dropped long, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    return b"\n".join(line for line, bit in zip(lines, np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)], strict=True) if bit)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, keep: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with their bitmap in a column named by `keep`, null where all lines stay: one shuffle of the texts, the bitmaps are the hashed side."""
    of, text = fresh(docs, "of", "digest")
    marks = bitmaps.select(F.col("doc_id").alias(of), F.col("digest").alias(text), F.col("keep").alias(keep)).hint("shuffle_hash")
    return docs.join(marks, F.col(id_column).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text_column) == F.col(text)), "left").drop(of, text)


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The contract's columns: lines, lines dropped, and the digest of what stays."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, keep in rows:
            text = text or b""
            kept = kept_text(text, keep)
            n = text.count(b"\n") + 1
            stay = n if keep is None else int(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].sum())
            yield doc_id, n, n - stay, hashlib.sha256(kept).hexdigest()

    joined = with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bitmaps, "keep")
    return map_rows(joined, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", binary=("text",))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents without their dropped lines; a column n_chars, where there is one, follows the text."""
    names = docs.columns
    at = names.index("text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *row, keep in rows:
            if keep is not None:
                row[at] = kept_text((row[at] or b""), keep)
            yield tuple(row[:at]) + ((None if row[at] is None else row[at].decode()),) + tuple(row[at + 1 :])

    (keep,) = fresh(docs, "keep")
    out = map_rows(with_bitmaps(docs, bitmaps, keep), run, schema_of(docs), binary=("text",))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
