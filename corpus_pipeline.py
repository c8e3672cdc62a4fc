"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

toxicity drops documents that score 0.5 or more; line dedup drops lines found in ten documents or more; near-dedup keeps
one document of each group with a similarity of 0.8 or more in five-word shingles; mixing takes each source as often as
its target asks; packing cuts all of it into sequences.

Near-dedup joins SimHash fingerprints of the shingle sets on pigeonhole blocks, verifies them by Hamming distance and what
they link by the Jaccard similarity. As two documents with a similarity of 0.8 differ in about ten bits of 64, what that
leaves apart is joined on blocks and prefixes of the sets themselves, so that no pair of that similarity is lost.

Nulls in any column, empty and very long texts, ties, repeated rows and empty tables go through all stages (each says
what it makes of them), as do other columns, whatever their names: all but the last stage return the columns they got.
A stage deletes what the one before left in the shared folder, as that one's result has been written by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import linededup, mixing, packing, setjoin, toxicity
from quillspark.llm.common import Scratch, fresh, shared_dir, stage, table
from quillspark.llm.queries import tokenizer_path


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5; a text that is null or empty scores like any other. Labels go by doc_id."""
    return toxicity.scored_rows(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).where(F.col("score") < 0.5).select("row.*")


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their dropped lines; null text stays null."""
    return linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id, null last; of its repeats the least by text, then by all columns."""
    scratch = Scratch(spark)
    groups = setjoin.near_groups(docs)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("r"))
    rows = groups.groupBy("doc_id", "digest").agg(F.count("*").alias("rows"))
    kept = first.select("r.doc_id", "r.digest").withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    of, text, copies = fresh(docs, "of", "digest", "rows")
    kept = kept.join(rows, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")))
    kept = scratch.keep(kept.select(F.col("_doc").alias(of), F.col("_digest").alias(text), F.col("rows").alias(copies)), "kept")
    found = docs.join(kept.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(text)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    if kept.where(F.col(copies) > 1).isEmpty():
        return found.select(*names)
    # rows of one doc_id and text: partial minima, so a row that is repeated without end costs a task one row
    least = found.where(F.col(copies) > 1).groupBy(of, text).agg(F.min_by(F.struct(*names), mixing.row_key(docs)).alias("row"))
    return found.where(F.col(copies) == 1).select(*names).unionByName(least.select("row.*"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's rows as often as its target asks, in the order of the schedule."""
    return mixing.mix_rows(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every row's tokens."""
    return packing.digest(packing.pack_documents(docs, tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mix", mix), ("pack", pack)]
#: A learned classifier and shingle similarity are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
