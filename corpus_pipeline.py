"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.byte_bpe import encode_documents
from heronry.llm.common import Workspace, fresh, table
from heronry.llm.decontamination import decontaminated
from heronry.llm.odd_sketch import near_duplicates
from heronry.llm.rule_ensemble import keep_good, train
from heronry.llm.suffix_dedup import without_repeats

#: Below the query's threshold, since a document that is dropped here cannot come back.
QUALITY_THRESHOLD = 0.5
#: Smaller than the encoder's own, since its workers also serve the other stages.
MEMO = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Null and empty texts are judged by the statistics of no words; a null id or a repeated row is judged as any other row, so repeats go or stay
    together; a tie with the threshold stays.  Without labels the classifier is a constant a half, which keeps everything.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")), QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id, and one row of those that repeat its id and text.

    Rows with null ids, and null and empty texts, are in no group and stay; rows of one id with other texts stay or go together.
    """
    name, n, gone = fresh(docs, "_near_id"), fresh(docs, "_near_rows"), fresh(docs, "_near_gone")
    marks = near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias(n), F.max(~F.col("kept")).alias(gone)).where(f"{gone} or {n} > 1")
    marks = Workspace(spark, "marks").settle(marks, "marks")
    rest = docs.join(marks, docs.doc_id == F.col(name), "left_anti")
    again = docs.join(marks.where(~F.col(gone)), docs.doc_id == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(again)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they first occur and are cut from the rest; ``n_chars`` follows where there is such a column.

    Ties go to the smallest id, then to the first place.  Null ids, null texts and texts under 50 words stay as they are; a text that is cut whole goes.  Rows that
    repeat id and text are one document.
    """
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay.  Rows of one id, or of a null id, go together.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of ids and of the decoded text, and the ids as little-endian uint32; a row in gives a row out, a null text has no ids."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, memo=MEMO)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encode),
]

#: SQL can express neither the fitted classifier nor the encoder; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of what the stages leave; an empty table goes through them all.  Interim tables stay until ``heronry.llm.common.release``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.settle(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
    return docs
