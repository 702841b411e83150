"""From raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the docs
of the next one; all but the last keep the columns of documents. Every stage works on all rows that its
predecessor kept:

    language         documents without a letter, or whose language is not clear, go
    near_duplicates  of documents with similar word shingles the one with the smallest doc_id stays
    decontamination  documents that hold a benchmark passage go
    pii              personal data is replaced by its kind; n_chars is counted anew
    packing          token pieces, their ids with them, and their places in windows of 1024;
                     ``packing.sequences`` joins them to windows

Every stage sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` to the size its tasks work in, unless the
session has a value already. The setting stays, because a stage's table is written after the stage has returned.

Nulls, empty tables, ties and repeated rows: see the operators' modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm import decontaminate, language, packing, pii, similar
from riskframe.llm.common import bound_batches, staged, table
from riskframe.llm.queries import vocabulary

#: Least probability of the predicted language.
CLEAR = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    model = language.fit(docs, vocabulary("piece_bpe_32k.model"))
    scored = language.predict(docs, model, "stage_")
    clear = (F.col("stage_lang_pred") != language.UNKNOWN) & (F.col("stage_score") >= CLEAR)
    # where no text has a language to learn from, only texts without letters go
    letters = F.regexp_like("text", F.lit(r"\p{L}"))
    return scored.filter(clear if model.languages else letters).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return similar.first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sums over segmentations, tokenizers and fingerprints are beyond SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None
