"""A corpus made ready for training: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame; its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of their docs. The rows that come out are the pieces of the documents that
stayed, with their places in the sequences.

Cases: a null text counts as empty and empty texts are documents like any other: equal ones are copies of each other, of which one
stays. Without labels of both kinds no document is rejected. Null doc_ids are carried along. Very long texts are worked on whole. Other
columns, whatever their names, pass through all stages but the last. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import exact_dedup, near_dedup, packing, personal_data, quality
from seamline.llm.tables import table
from seamline.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: A fitted network decides what stays, and packing has many equally good results; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
