import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import packing, queries, setjoin
from tests.llm.test_linededup import key
from tests.llm.test_setjoin import brute_set


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_stages(spark, sf_dir, tmp_path):
    larger = sf_dir.replace("0.001", "0.01")
    given, clean, lines, single, mixed, packed = stages(spark, queries.table(spark, larger, "documents"), larger, tmp_path)
    assert all(x.columns == given.columns for x in (clean, lines, single, mixed))
    rows = lambda df: df.toPandas().sort_values("doc_id").reset_index(drop=True)
    labels = queries.table(spark, larger, "labels").where("toxic = 0")
    assert given.join(labels, "doc_id", "left_semi").join(clean, "doc_id", "left_anti").count() <= 2
    a, b, c = rows(clean), rows(lines), rows(single)
    where = {}
    for d, t in zip(a.doc_id, a.text, strict=True):
        for line in t.split("\n"):
            where.setdefault(key(line), set()).add(d)
    assert b.text.tolist() == ["\n".join(x for x in t.split("\n") if not key(x) or len(where[key(x)]) < 10) for t in a.text]
    assert (b.n_chars == b.text.str.len()).all() and len(c) < len(b)
    sets = {d: brute_set(t) for d, t in zip(b.doc_id, b.text, strict=True)}
    kept = set(c.doc_id)
    for d in set(b.doc_id) - kept:  # what goes is near something of its group
        assert any(len(sets[d] & s) >= 0.8 * len(sets[d] | s) for k, s in sets.items() if k != d)
    m = mixed.groupBy("doc_id").count().toPandas()
    assert m["count"].max() <= 3 and set(m.doc_id) <= kept
    assert packed.select("doc_id").distinct().count() == len(m)
    # every row of the mix, token by token
    tokenizer, want = Tokenizer.from_file(queries.tokenizer_path()), []
    for r in mixed.collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want += [(r.doc_id, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), len(ids)) for a, n in packing.pieces(len(ids), 4096)]
    assert sorted(want) == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed.collect())


def test_awkward_rows(spark, docs, no_docs, sf_dir, tmp_path):
    """All columns of the fixture, and more whose names the stages use themselves."""
    more = ["score", "_id", "_n", "_keep", "keep", "of", "digest", "_digest", "size", "start", "slot", "row", "rows", "component_id", "copies", "Key2", "place", "epoch"]
    clash = lambda df: df.withColumns({c: F.lit(c) for c in more}).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    for name, df in (("plain", docs), ("clash", clash(docs)), ("none", clash(no_docs))):
        out = stages(spark, df, sf_dir, tmp_path / name)
        assert all(x.columns == df.columns and x.dtypes == df.dtypes for x in out[:-1])
        assert (out[-1].count() > 0) == (name != "none")
        if name == "clash":
            assert all(r.score == "score" and r._keep == "_keep" and r.m == {"k": r.doc_id} for x in out[:-1] for r in x.collect())
            left = {(r.doc_id, r.text) for r in out[3].collect()}
            assert len(left) == out[3].count() and {(4, ""), (None, "no id here")} & left


def test_registered(spark, sf_dir):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("n", [1, 5, 700])
def test_every_set_size_has_blocks(n):
    import numpy as np

    assert setjoin.set_blocks(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def test_one_row_of_each_group(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (3, a), (5, a), (None, a), (None, f"{a} more"), (None, b), (None, b), (2, f"{c} more"), (2, c), (9, c), (4, "else")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in got) == [(0, "b0"), (2, "c0"), (3, "a0"), (4, "el")]


def test_near_dedup_compares_fingerprints(spark, sf_dir, monkeypatch):
    """The stage joins SimHash fingerprints on their blocks and verifies them by Hamming distance."""
    given, pairing = [], setjoin.hamming_links
    monkeypatch.setattr(setjoin, "hamming_links", lambda df, scratch: given.append(df.count()) or pairing(df, scratch))
    docs = queries.table(spark, sf_dir, "documents")
    assert corpus_pipeline.drop_near_copies(spark, docs, sf_dir).count() <= docs.count()
    assert len(given) == 1 and given[0] > 1
