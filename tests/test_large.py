"""What keeps tasks, time a row and memory bounded when tables grow."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import casing, grammar, latex
from quillspark.operators import parse
from quillspark.options import Options
from quillspark.plans import registry
from quillspark.sources import tables


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_one_row_group_of_many_splits_is_dealt_evenly(spark, tmp_path, monkeypatch):
    spark.range(0, 100_000, 1, 1).selectExpr("id o_orderkey", "cast(id as string) s").write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        monkeypatch.setattr(tables, "TASK_BYTES", 32 << 10)
        got = sizes(registry.table(spark, str(tmp_path), "orders"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) > spark.sparkContext.defaultParallelism and sum(got) == 100_000 and max(got) < 2 * min(got)


def test_a_first_letter_that_becomes_two_moves_no_other():
    assert casing.to_sentence_case("On İx Yield", guess=False) == "On i̇x yield"


def test_plain_entries_are_read_without_a_walk_over_their_braces(monkeypatch):
    text = "@article{l1.2,\n  pages = {3--4}, year = 1990, note = \"a, b\", title = {A {B {C}} \\} d},,\n}\n% tail\n"
    walked = grammar.Chunk("entry", text[:-1], "article", "l1.2", (("pages", (("brace", "3--4"),)), ("year", (("number", "1990"),)), ("note", (("quote", "a, b"),)), ("title", (("brace", "A {B {C}} \\} d"),))))
    assert grammar.chunks(text) == [walked]
    monkeypatch.setattr(grammar, "plain_body", lambda *_: None)
    assert grammar.chunks(text) == [walked]
    monkeypatch.undo()
    monkeypatch.setattr(grammar, "body_fields", None)
    monkeypatch.setattr(grammar, "group_end", None)
    assert grammar.chunks(text) == [walked]


def test_a_join_is_dealt_by_the_larger_table(spark, tmp_path, monkeypatch):
    orders = spark.range(0, 50_000, 1, 1).selectExpr("id o_orderkey", "id % 5 o_custkey", "'O' o_orderstatus")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(0, 5, 1, 1).selectExpr("id c_custkey", "'B' c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(tables, "LEAST_BYTES", 1)
    monkeypatch.setattr(tables, "TASK_BYTES", 16 << 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sizes(registry.crossref_lookup(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) > spark.sparkContext.defaultParallelism and sum(got) == 100_000 and max(got) < 2 * min(got)


@pytest.mark.parametrize("raw, want", [
    ("na{\\\"i}ve  caf{\\'e}\n-{}-{} 5\\% \\{x\\} ga{\\c c}on Stra{\\ss}e -- ``q'' a\\textbackslash{}b\\textasciitilde{}~{Kept}", "naïve café -- 5% {x} gaçon Straße – “q” a\\b~ Kept"),
])
def test_escapes_and_accents_are_read_without_pieces(monkeypatch, raw, want):
    assert "".join(p.text for p in latex.collapse(latex.decode(raw))) == want
    assert latex.to_text(raw) == want
    monkeypatch.setattr(latex, "collapse", None)
    assert latex.to_text(raw) == want
    monkeypatch.undo()
    assert latex.to_text("{ {\\em a} {\\ss}b} {") == "<i>a</i> ßb"  # a switch asks for pieces


def test_a_batch_becomes_python_values_in_small_parts(spark):
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    class Column:
        def __init__(self, column):
            self.column = column

        def to_pylist(self):
            assert len(self.column) <= 256
            return self.column.to_pylist()

    class Batch:
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows

        def slice(self, *span):
            return Batch(self.batch.slice(*span))

        def column(self, n):
            return Column(self.batch.column(n))

    whole = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(1000)], "text": ["x"] * 999 + [None]})
    run = parse._mapped(Docs(), "doc_id string, text string", lambda d, t: [(d, t)])
    out = [r for b in run(iter([Batch(whole)])) for r in b.to_pylist()]
    assert out == [{"doc_id": str(i), "text": "x" if i < 999 else ""} for i in range(1000)]


def test_a_record_has_the_columns_asked_for(spark):
    text = "@comment about 1\n@preamble{\"x\"}\n@string{a = {b}}\n@misc{k, note = {\\nosuch}, title = a # c}\n"
    docs = spark.createDataFrame([("1", text)], "doc_id string, text string")
    whole = parse.parse_bibtex(docs, Options())
    for asked in (("comments", "preamble"), ("strings", "jabref"), ("errors", "fatal"), ("entries",)):
        some = parse.parse_bibtex(docs, Options(), asked)
        assert some.columns == ["doc_id", *asked] and some.collect() == whole.select("doc_id", *asked).collect()
