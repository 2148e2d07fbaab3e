"""Software names and logo templates."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def catalog_names(lines: DataFrame) -> DataFrame:
    """Lines of a name list (value) to names: stripped, blank lines dropped."""
    name = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(name.alias("software")).filter(F.col("software") != "")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_names(spark.read.text(path))


def available_logos(catalog: DataFrame, templates: DataFrame) -> DataFrame:
    """Catalog names for which a template is filed under the lower-cased name, with its pixels."""
    filed = templates.select(F.col("software").alias("_filed"), "pixels")
    return catalog.join(filed, F.lower("software") == F.col("_filed")).select("software", "pixels")
