import zlib

import corpus_pipeline as cp
import pyarrow as pa
from pyspark.sql import functions as F

from riskframe.llm import language, packing
from riskframe.llm.common import staged
from llm_helpers import DOCS, real_texts


def stage(name):
    return dict(cp.STAGES)[name]


def test_stages_take_effect(spark, sf, tmp_path):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    real = real_texts(spark, sf, 30)
    texts = real + [real[0], real[0] + " more", None, "", "12 34 --", "intro " + items.first()["text"] + " outro", "mail me at some.one@mail.example.com please"]
    n = len(real)
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS).withColumn("extra", F.lit(1))
    ids = lambda d: {r["doc_id"] for r in d.collect()}

    clear = staged(stage("language")(spark, df, str(tmp_path)))
    assert clear.columns == df.columns and {n + 2, n + 3, n + 4}.isdisjoint(ids(clear)) and n + 6 in ids(clear)
    unique = staged(stage("near_duplicates")(spark, clear, str(tmp_path)))
    assert unique.columns == df.columns and {n, n + 1}.isdisjoint(ids(unique)) and 0 in ids(unique)
    clean = staged(stage("decontamination")(spark, unique, str(tmp_path)))
    assert clean.columns == df.columns and ids(unique) - ids(clean) == {n + 5}
    masked = staged(stage("pii")(spark, clean, str(tmp_path)))
    row = masked.filter(F.col("doc_id") == n + 6).first()
    assert masked.columns == df.columns and row["text"] == "mail me at <email> please" and row["n_chars"] == len(row["text"])
    packed = stage("packing")(spark, masked, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids(masked)
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_run_gives_the_pieces_of_what_is_kept(spark, sf):
    rows = cp.run(spark, sf).collect()
    assert rows and all(0 <= r["offset"] and r["offset"] + r["length"] <= 1024 for r in rows)
    assert len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_documents_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words", None, None, 10), (2, "123", None, None, 3)], DOCS)
    assert [r["doc_id"] for r in cp.language_stage(spark, df, str(tmp_path)).collect()] == [1]
    assert language.UNKNOWN == "und"


def test_pieces_carry_their_tokens(spark, sf, tmp_path):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(real_texts(spark, sf, 5))], DOCS)
    packed = staged(stage("packing")(spark, df, str(tmp_path)))
    rows = packed.collect()
    assert rows and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    windows = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert all(windows[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == r["ids"] for r in rows)


def test_stages_hand_over_small_batches(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    few = spark.createDataFrame([(1, "some words", "en", "s", 10)], DOCS)
    many = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    for name in ("language", "pii", "packing"):
        spark.conf.unset(key)
        try:
            stage(name)(spark, few, str(tmp_path))
            found = [r["size"] for r in many.mapInArrow(sizes, "size long").collect()]
        finally:
            spark.conf.unset(key)
        assert len(found) > 1 and max(found) < 5 << 20, name
