"""Tables in and out, by content and by path. Every path goes through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import table_hash

#: Rows of one insert into a relational database.
BATCH_ROWS = 500


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema its types are inferred in a pass of their own."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table by its suffix: csv, json, orc or (else) Parquet; only the columns asked for are read."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    df = {"csv": read_csv, "json": lambda s, p: s.read.json(p), "jsonl": lambda s, p: s.read.json(p), "orc": lambda s, p: s.read.orc(p)}.get(suffix, lambda s, p: s.read.parquet(p))(spark, path)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """As Parquet; a table that is there already stays, unless ``mode`` says otherwise."""
    df.write.mode(mode).parquet(path)


class Store:
    """Tables kept under their content: the same content has the same place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, df: DataFrame) -> str:
        name = table_hash(df)
        write(df, f"{self.root}/{name}")
        return name

    def get(self, name: str, columns: list[str] | None = None) -> DataFrame:
        return read(self.spark, f"{self.root}/{name}", columns)

    def cached(self, key, make) -> DataFrame:
        """The table made for a key before, or ``make()`` written and read; keys are nested values."""
        from ..functions.hashing import value_hash

        path = f"{self.root}/cache-{value_hash(key)}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.suffix("/_SUCCESS"))
        if not there:
            write(make(), path, "overwrite")
        return self.spark.read.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, driver: str | None = None, mode: str = "append") -> None:
    """Into a relational table in batches, NaN as NULL."""
    numbers = [c for c, k in df.dtypes if k in ("double", "float")]
    clean = df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in numbers}) if numbers else df
    writer = clean.write.format("jdbc").options(url=url, dbtable=table, batchsize=BATCH_ROWS)
    (writer.option("driver", driver) if driver else writer).mode(mode).save()


def read_jdbc(spark: SparkSession, url: str, table: str, by: str, low: int, high: int, parts: int = 8) -> DataFrame:
    """From a relational table in ranges of a key, never by offsets."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=by, lowerBound=low, upperBound=high, numPartitions=parts).load()


TRIAL_SCHEMA = (
    "trial_id long, experiment long, config string, budget double, estimator string, loss double, cost_time double, status string, "
    "started double, finished double, scores map<string,double>, info string"
)


def log_trials(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Appends trials as JSON lines."""
    spark.createDataFrame([{k.split()[0]: r.get(k.split()[0]) for k in TRIAL_SCHEMA.split(", ")} for r in rows], TRIAL_SCHEMA).write.mode("append").json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIAL_SCHEMA).json(path).withColumn("seq", F.col("trial_id"))


def log_metadata(log: DataFrame) -> DataFrame:
    """(n_runs, n_configs, min_budget, max_budget, budgets) of a log."""
    return log.agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("config").alias("n_configs"), F.min("budget").alias("min_budget"), F.max("budget").alias("max_budget"), F.array_sort(F.collect_set("budget")).alias("budgets"))
