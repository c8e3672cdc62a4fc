import hashlib
from collections import defaultdict

from quillspark.llm import linededup, queries

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def brute(texts, min_docs, min_chars=1):
    where = defaultdict(set)
    for doc, text in texts:
        for line in (text or "").split("\n"):
            where[key(line)].add(doc)
    out = {}
    for doc, text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(where[key(x)]) < min_docs]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").toPandas()
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)), 10)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op8_lines(spark, sf_dir).collect()} == want


def test_hot_line_over_many_partitions(spark):
    texts = [(i, "\n".join(["Common LINE ", f"own {i}", f"pair {i // 3}", "common line" if i % 2 else ""])) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for least in (2, 3, 4, 500):
            got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.digest(df, linededup.keep_bitmaps(df, min_docs=least)).collect()}
            assert got == brute(texts, least)
        first = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df, min_docs=2, mode="later")).toPandas().sort_values("doc_id")
        seen, want = set(), []
        for _, text in texts:
            kept = []
            for line in text.split("\n"):
                if not key(line) or key(line) not in seen:
                    kept.append(line)
                seen.add(key(line))
            want.append("\n".join(kept))
        once = [t for t in first.text]
        # a key of one document only is no repetition between documents, whatever its positions
        assert [w for w, o in zip(want, once, strict=True) if w != o] == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_awkward_rows(docs, no_docs):
    got = linededup.digest(docs, linededup.keep_bitmaps(docs, min_docs=2)).toPandas()
    assert len(got) == 10 and got[got.doc_id == 1].n_dropped.iloc[0] == 3 and got[got.doc_id == 3].n_lines.iloc[0] == 1
    assert linededup.digest(no_docs, linededup.keep_bitmaps(no_docs)).count() == 0
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, min_docs=2))
    assert out.columns == docs.columns and out.where("doc_id = 7").first().text == "other" and out.where("doc_id = 3").first().text is None
