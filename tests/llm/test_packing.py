import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quillspark.llm import packing, queries


def check(rows, texts):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(part)
    for k, want in ids.items():
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == len(want)
    assert all(len(s) == 1 and s[0][0] == 0 and s[0][1] & (s[0][1] - 1) == 0 and s[0][1] <= 4096 for s in sequences.values())


def test_pieces():
    for n in (1, 2, 3, 4095, 4096, 4097, 3 * 4096 + 77):
        cut = list(packing.pieces(n, 4096))
        assert sum(x for _, x in cut) == n and [s for s, _ in cut] == list(np.cumsum([0, *[x for _, x in cut]])[:-1])
        assert len({x for _, x in cut if x < 4096}) == len([x for _, x in cut if x < 4096])


def test_query_equals_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").toPandas()
    check(queries.op1_pack(spark, sf_dir).collect(), dict(zip(docs.doc_id, docs.text, strict=True)))


def test_awkward_rows(docs, no_docs):
    path = queries.tokenizer_path()
    some = docs.where("doc_id is null or doc_id <> 4")
    check(packing.digest(packing.pack_documents(some, path)).collect(), {r.doc_id: r.text for r in some.collect()})
    assert packing.pack_documents(docs.where("doc_id = 4"), path).count() == 2
    assert packing.pack_documents(no_docs, path).count() == 0


def test_spaces_and_special_strings(spark):
    texts = {i: t for i, t in enumerate(["a b\x1cc\x85d", "x<|endoftext|>y <|startoftext|>", "é ́a it's 12 \n\n ß", "ΑΣ ΣΑΣ"])}
    check(packing.digest(packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), queries.tokenizer_path())).collect(), texts)


def test_small_chunks_and_a_small_memory(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_BYTES", 4000)
    encoder = packing.WordEncoder(queries.tokenizer_path())
    texts = [t or "" for t in queries.table(spark, sf_dir, "documents").toPandas().text[:60]] + ["", " ", "é" * 500, "ÀÉ,ü. " * 40, "Don't 12x (é)"]
    for most in (300, 20_000):
        for first, n in packing.chunks(pa.array(texts), most):
            ids, counts = encoder.encode(pa.array(texts[first : first + n]), 2)
            assert np.split(ids, np.cumsum(counts)[:-1])[0].dtype == np.uint32
            for text, got in zip(texts[first : first + n], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert got.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert encoder.known.nbytes + encoder.pool.nbytes <= 4000 and max(map(len, encoder.known.to_pylist()), default=0) <= 64


def test_a_text_longer_than_a_chunk(spark):
    text = "".join(f"Word{i}, (é{i}) don't\n " for i in range(4000)) + "x" * 9000 + " end"
    rows = packing.digest(packing.pack_documents(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), queries.tokenizer_path(), chunk_bytes=2000)).collect()
    check(rows, {1: text, 2: "short"})
