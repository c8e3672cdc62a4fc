import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, queries
from quillspark.llm.common import Scratch


def brute_targets(sizes, weights):
    capped = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = sum(sizes) - sum(capped.values())
        shares = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if shares[i] > 3 * sizes[i]]
        if not over:
            return [capped.get(i, shares.get(i)) for i in range(len(sizes))]
        capped |= {i: 3.0 * sizes[i] for i in over}


def test_targets():
    for sizes in ([100, 5, 5, 1000], [10, 10, 10], [0, 7], [1]):
        weights = [1 + i % 3 for i in range(len(sizes))]
        assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def check(df):
    got = mixing.mix_documents(df).toPandas()
    rows = df.select("doc_id", "source", "text").toPandas()
    rows["size"] = [len((t or "").encode().split()) for t in rows.text]
    assert sorted(got["size"]) == sorted(rows["size"]) and len(got) == len(rows)
    sizes = rows.groupby("source", dropna=False)["size"].sum()
    order = sorted(sizes.index, key=lambda s: (not isinstance(s, str), s.encode() if isinstance(s, str) else b""))
    want = dict(zip([s if isinstance(s, str) else None for s in order], brute_targets([int(sizes[s]) for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    for s, g in got.groupby(got.source.where(got.source.notna(), "<null>")):
        t = want[None if s == "<null>" else s]
        assert g.target.iloc[0] == pytest.approx(t) and abs(g.taken.sum() - t) <= 1
    assert (got.taken <= 3 * got["size"]).all()
    return got


def test_query(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    a, b = check(docs), mixing.mix_documents(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert a.sort_values(key)[key].values.tolist() == b.sort_values(key)[key].values.tolist()


def test_schedule_is_even(spark):
    found = [mixing.Quota(0, "a", 100_000, 300_000.0, 300_000, 391), mixing.Quota(1, "b", 700_000, 500_000.0, 500_000, 2735)]
    rows = mixing.schedule(spark, found).orderBy("slot").toPandas()
    assert rows.groupby("rank").words.sum().tolist() == [300_000, 500_000]
    share = (rows["rank"] == 0).mean()
    counts = np.cumsum(rows["rank"] == 0)
    assert np.abs(counts - share * np.arange(1, len(rows) + 1)).max() < 8
    assert all(g.nth.tolist() == list(range(len(g))) for _, g in rows.groupby("rank"))


def test_awkward_rows(docs, no_docs):
    check(docs)
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.mix_rows(no_docs).count() == 0
    assert mixing.mix_rows(docs).columns == docs.columns


def test_rows_follow_the_schedule(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(n)) + "\n", s, -1) for i, (s, n) in enumerate([(s, 256) for s in "abc" for _ in range(100)] + [("d", 3000)] + [("d", 7 + k % 90) for k in range(600)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mix_rows(df).collect()
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "abcd"}
    assert words == {q.source: q.words for q in mixing.quotas(df.select("source", mixing.words_in(F.col("text")).alias("size")))}
    whole = {r[0]: r[1] for r in rows}
    parts = [r for r in got if r.text != whole[r.doc_id]]
    assert len(parts) <= 4 and all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in parts)
    order = [r.source for r in got if r.source != "d"]
    for s in "abc":
        share = order.count(s) / len(order)
        assert np.abs(np.cumsum([x == s for x in order]) - share * np.arange(1, len(order) + 1)).max() < 8


def test_repeated_rows_are_taken_each(spark):
    rows = [(7, "one two three", "a")] * 4 + [(7, "four five six", "a")] * 2
    got = sorted(r.text for r in mixing.mix_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == sorted(r[1] for r in rows)


def test_taken_equals_brute_force(spark, docs):
    """Words of every document, taken slot by slot in plain Python from documents in the order of the shuffle."""
    rows = [(i % 70, " ".join("w" for _ in range((i * 37) % 400)), "abc"[i % 3] if i % 11 else None) for i in range(300)] + [(7, "x " * 90, "a")] * 5 + [(None, "x " * 50, "b")] * 4
    for df, block in ((spark.createDataFrame(rows, "doc_id long, text string, source string"), 64), (docs, 256)):
        placed = mixing.units(df.select("source", F.col("doc_id").alias("key"), mixing.words_in(F.col("text")).alias("size")), Scratch(spark))[1]
        order = sorted((r.source is not None, r.source or "", r.place, r.key is not None, r.key or 0, r.size, r.nth) for r in placed.withColumn("place", F.xxhash64("key", "size", "nth", F.lit("mix"))).collect())
        words = {}  # source -> the document of each of its words, in order
        for n, (known, source, *_, size, _) in enumerate(order):
            words.setdefault(source if known else None, []).extend([n] * size)
        names = sorted({(not k, s.encode()) for k, s, *_ in order})
        sources = [None if missing else s.decode() for missing, s in names]
        sizes = [len(words.get(s, [])) for s in sources]
        quota = [min(round(t), 3 * n) for t, n in zip(brute_targets(sizes, [1 + i % 3 for i in range(len(sizes))]), sizes, strict=True)]
        need = [q // n * -(-n // block) + -(-(q % n) // block) if n else 0 for q, n in zip(quota, sizes, strict=True)]
        edges, used, taken, i = np.cumsum(np.array(need) / sum(need)), [0] * len(need), [0] * len(order), 0
        given = [0] * len(need)
        while used != need:
            r = min(int(np.searchsorted(edges, np.modf((i + 0.5) * mixing.PHI)[0], side="right")), len(need) - 1)
            i += 1
            if used[r] < need[r]:
                b = used[r] % -(-sizes[r] // block)
                part = words[sources[r]][b * block : (b + 1) * block][: quota[r] - given[r]]
                used[r] += 1
                given[r] += len(part)
                for n in part:
                    taken[n] += 1
        want = sorted((k is not None, k or 0, source or "", size, t) for (_, source, _, has, k, size, _), t in zip(((a, b, c, d, e if d else None, f, g) for a, b, c, d, e, f, g in order), taken, strict=True))
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.source or "", r["size"], r.taken) for r in mixing.mix_documents(df, block=block).collect())
        assert got == want


def test_many_equal_rows_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    df = spark.range(100).selectExpr("'a' source", "1L key", "3L size").unionByName(spark.range(5).selectExpr("'a' source", "2L key", "3L size"))
    counted, numbered = mixing.units(df, Scratch(spark))
    assert sorted((r.key, r.nth) for r in numbered.collect()) == [(1, i) for i in range(100)] + [(2, i) for i in range(5)] and counted.count() == 2
