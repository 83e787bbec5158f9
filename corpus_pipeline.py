"""A corpus pipeline of five stages, each of which works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontam, line_dedup, pieces, quality, simhash
from weft.llm.common import table
from weft.operators.lineage import shared_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go; the network learns from labelled documents that are not held out.

    Null and empty texts are scored like any other; rows with null or repeated ids each count for themselves. An
    empty table stays empty.
    """
    network = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, network, threshold=0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, documents stay; n_chars follows the text. One with no other lines is left to the next stage as it is.

    A null text stays null, and n_chars with it; rows with null or repeated ids are handled as any other.
    """
    out = line_dedup.remove_spread_lines(docs, min_sites=8, keep_whole=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document with the least id stays, one of equal rows; null and empty texts are copies of each other."""
    return simhash.one_of_each_group(docs, shingle=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts overlap with none, and an empty benchmark keeps all."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the pieces and the number of them, and the sha256 of the text that the ids decode to; null and empty texts have no pieces."""
    return pieces.round_trip(docs, with_ids=True)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece", tokenize),
]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written as Parquet in the shared folder and read again, and deleted once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


#: A network, fingerprints and pieces can't be had in SQL; tests compare with a version in plain Python.
ORACLE_SQL = None
