"""The queries of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio, cells, chat, ctw, html, linededup, mixing, oracles, packing, simhash, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ask = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", ask), (-7, 1, "assistant", ask)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_records(chat.records_of_rows(rows.unionByName(more))))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.digest(docs, linededup.keep_bitmaps(docs))


def op9_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_audio, op3_html, op4_simhash, op5_ctw, op6_mix, op7_chat, op8_lines, op9_cells, op10_toxicity)}
ORACLES: dict[str, str] = {"op7_chat": oracles.OP7_CHAT, "op8_lines": oracles.OP8_LINES, "op9_cells": oracles.OP9_CELLS}
