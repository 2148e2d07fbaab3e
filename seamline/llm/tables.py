"""Reading the input tables, and joins whose broadcast side is counted first."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a key and a few numbers) is sent to every executor: some tens of MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only `doc_id` and `text` of `docs`, a null text as the empty one; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df`, marked for broadcast if it has few rows; else as it is, for a shuffled join. Give it stored, narrow tables; where rows
    hold lists, `rows` says how many narrow rows they amount to."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def fingerprint(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)
