"""A corpus pipeline: each stage works on all that its predecessor kept.

Stages take and return the columns of documents, whatever they are beside doc_id and
text; the last adds the tokens. Null and empty texts, null ids, repeated rows and empty
tables are handled as each operator's module states; a stage drops no row that its
operator's rule does not name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm import bpe, decontaminate, exact_dedup, quality, simhash
from featherloom.llm.common import shared_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay."""
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accept(docs, trees)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document with its token ids (``ids``), their number, and the text decoded from them (``decoded``)."""
    known = bpe.read_vocabulary(vocabulary or bpe.public_vocabulary())
    done = bpe.decode(bpe.encode(docs, known), known)
    return done.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("bpe_round_trip", tokenised),
]

#: The classifier, SimHash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared checkpoint folder and read again.

    A stage's table is deleted once the next one is written; the last stays, as the result
    is read from it.
    """
    shared_folder(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
