"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.

1. language ID: documents without letters, or like none of the languages, go.
2. line dedup: boilerplate lines of a source leave its documents.
3. SimHash near-dedup: one document of each near-duplicate group stays.
4. mixing: sources are sampled to their target weights; a document may come twice.
5. SentencePiece: texts become ids; ids that decode to another text raise.

Null texts: rejected by stage 1. An empty table passes through all stages. Columns other than doc_id, text,
lang and source may have any name and are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ivmspark.llm.common import scratch_path
from ivmspark.llm.langid import keep_identified
from ivmspark.llm.lines import drop_boilerplate
from ivmspark.llm.mixing import mix
from ivmspark.llm.pieces import with_ids
from ivmspark.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids in place of text: n_tokens and ids, checked by decoding them again."""
    return with_ids(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding", sentencepiece),
]

#: Cross-parsing and transducers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
