"""Filling the prompt of a register."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamline import fixed_values as fixed

SCHEMA = "kind string, register string, template string"


def prompt_templates(spark: SparkSession) -> DataFrame:
    """The fixed templates (kind, register, template)."""
    rows = [("topic", r, t) for r, t in fixed.TOPIC_PROMPTS.items()]
    rows += [("analysis", r, t) for r, t in fixed.ANALYSIS_PROMPTS.items()]
    return spark.createDataFrame(rows, SCHEMA)


def with_prompts(
    requests: DataFrame, templates: DataFrame, kind: str, context: Column, transcript: Column | None = None,
    default: str = fixed.DEFAULT_REGISTER,
) -> DataFrame:
    """Add `prompt`: the template of the request's `register`, or of the default one if there is none, filled in.

    Templates are few by nature; should a table of them ever be large, Spark joins it without broadcasting.
    """
    chosen = templates.filter(F.col("kind") == kind)
    fallback = chosen.filter(F.col("register") == default).agg(F.first("template")).scalar()
    filled = F.replace(F.coalesce("template", fallback), F.lit("{context}"), context)
    if transcript is not None:
        filled = F.replace(filled, F.lit("{transcript}"), transcript)
    return requests.join(chosen.select("register", "template"), "register", "left").withColumn("prompt", filled).drop("template")
