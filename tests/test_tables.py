from quillspark.sources import tables


def test_few_splits_are_dealt_over_the_cores(spark, tmp_path, monkeypatch):
    spark.range(0, 100_000, 1, 1).selectExpr("id", "cast(id as string) s").write.parquet(str(tmp_path / "one.parquet"))
    cores = spark.sparkContext.defaultParallelism
    plain = spark.read.parquet(str(tmp_path / "one.parquet"))
    dealt = tables.table(spark, str(tmp_path), "one")
    assert tables.splits(plain) == 1 and tables.splits(dealt) is None and dealt.rdd.getNumPartitions() == cores
    assert dealt.count() == 100_000 and "ReadSchema: struct<id:bigint>" in dealt.select("id")._jdf.queryExecution().toString()
    assert tables.spread(dealt) is dealt  # a plan with a shuffle is left alone
    assert tables.spread(many := spark.range(0, 100, 1, cores)) is many
    monkeypatch.setattr(tables, "LEAST_BYTES", 1 << 40)
    assert tables.spread(plain) is plain
