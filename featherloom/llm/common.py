"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder.

    A cluster names a shared one in spark.checkpoint.dir; a temporary folder is
    used only on one machine, as in tests. A cluster that names none is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="featherloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder, and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of an Arrow batch where the session has not chosen its own number: texts are long.
ARROW_ROWS = 1_000
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, on both sides of the socket, unless the session sets their size."""
    if spark.conf.get(ARROW_SETTING) == "10000":
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
