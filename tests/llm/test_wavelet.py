import struct
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from riskframe.llm import wavelet
from llm_helpers import docs, odd_texts, real_texts, vocabulary


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1500))
def test_lookup_without_unpacking(values):
    ids = np.array(values, dtype=np.uint32)
    m = wavelet.WaveletMatrix.build(ids)
    assert m.all_ids().tolist() == values
    for i in range(0, len(values), 37):
        assert m.access(i) == values[i]
    for token in {*values[:5], 3, 99}:
        at = [i for i, v in enumerate(values) if v == token]
        assert m.rank(token) == len(at)
        assert m.rank(token, len(values) // 2) == sum(i < len(values) // 2 for i in at)
        assert [m.select(token, k) for k in range(len(at))] == at


def test_files_give_back_every_id(spark, sf, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(wavelet, "SHARD_IDS", 2000)
    path, files = vocabulary("word_bpe_49k.json"), wavelet.new_path(spark)
    texts = odd_texts() + real_texts(spark, sf)
    wavelet.write(docs(spark, texts), path, files)
    got = {r["doc_id"]: r for r in wavelet.read_documents(spark, files).collect()}
    plain, start, all_ids = Tokenizer.from_file(path), 0, []
    for i, text in enumerate(texts):
        want = plain.encode(text or "", add_special_tokens=False).ids + [1]
        row = got.pop(i)
        assert (row["start"], row["n_tokens"]) == (start, len(want))
        assert row["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        start += len(want)
        all_ids += want
    assert not got
    shards = spark.read.schema(wavelet.SCHEMA).parquet(files)
    before = wavelet.starts(shards)
    token = all_ids[len(all_ids) // 2]
    found = sorted(before[r["part"]] + r["position"] for r in wavelet.occurrences(spark, files, token).collect())
    assert found == [i for i, t in enumerate(all_ids) if t == token]


def test_empty_null_and_repeated_rows(spark):
    path = vocabulary("word_bpe_49k.json")
    empty = wavelet.new_path(spark)
    wavelet.write(docs(spark, ["x"]).filter("false"), path, empty)
    assert wavelet.read_documents(spark, empty).count() == 0
    rows = spark.createDataFrame([(None, "b", 1), (5, "a", 1), (5, "a", 1), (5, None, 1)], "doc_id long, text string, part int")
    files = wavelet.new_path(spark)
    wavelet.write(rows, path, files)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in wavelet.read_documents(spark, files).collect())
    assert got[0] == (0, None, 2) and [g[1] for g in got[1:]] == [5, 5, 5] and sum(g[2] for g in got) == 7
