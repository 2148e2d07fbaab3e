"""Utterances to numbered batches, their neighbours and their contexts."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamline import fixed_values as fixed
from seamline.functions.arrays import joined_in_order
from seamline.functions.text import similarity
from seamline.operators.ordered import numbered
from seamline.operators.skew import HOT_MIN_ROWS, skew_join

TID = "transcript_id"
LANE_BATCHES = 4096


def assign_batches(utterances: DataFrame, size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Chunk each transcript, in `seq` order, into batches of `size`; adds `rn`, `batch_id`, `n_batches`."""
    return (
        numbered(utterances, [TID], "seq", "rn", total="_rows")
        .withColumn("batch_id", F.expr(f"(rn - 1) div {size}"))
        .withColumn("n_batches", F.expr(f"(_rows + {size - 1}) div {size}"))
        .drop("_rows")
    )


def _collected() -> Column:
    return F.sort_array(F.collect_list(F.struct("seq", "content", "start", "end")))


def _combined(grouped: DataFrame) -> DataFrame:
    """First start, last end and contents joined by one space, from the collected utterances."""
    said = F.col("_said")
    return grouped.select(
        *[c for c in grouped.columns if c != "_said"],
        said[0]["start"].alias("start"),
        F.element_at(said, -1)["end"].alias("end"),
        F.array_join(F.transform(said, lambda u: u["content"]), " ").alias("content"),
    )


def combine_batches(assigned: DataFrame) -> DataFrame:
    """One row per batch (at most `size` utterances each): start, end, content."""
    return _combined(assigned.groupBy(TID, "batch_id").agg(F.max("n_batches").alias("n_batches"), _collected().alias("_said")))


def batches_in_lanes(assigned: DataFrame, lane: int) -> DataFrame:
    """Batches laid out in lanes of `lane` consecutive ones, each lane also holding the last batch of the lane before.

    One shuffle by (transcript, lane) serves both the combining and whatever looks at neighbours inside
    the lane. Batch ids are dense, so a lane has at most lane + 1 batches. `_guest` marks the batch of
    the lane before.
    """
    own = F.expr(f"batch_id div {lane}")
    places = F.when(F.col("batch_id") % lane == lane - 1, F.array(own, own + 1)).otherwise(F.array(own))
    spread = assigned.withColumn("lane", F.explode(places)).repartition(TID, "lane")
    grouped = spread.groupBy(TID, "lane", "batch_id").agg(F.max("n_batches").alias("n_batches"), _collected().alias("_said"))
    return _combined(grouped).withColumn("_guest", F.expr(f"batch_id div {lane} <> lane"))


def batches_with_previous(assigned: DataFrame, lane: int = LANE_BATCHES) -> DataFrame:
    """Batches with `prev_content`, the content of the batch just before (null for the first)."""
    order = W.partitionBy(TID, "lane").orderBy("batch_id")
    return (
        batches_in_lanes(assigned, lane)
        .withColumn("prev_content", F.lag("content").over(order))
        .filter(~F.col("_guest"))
        .drop("_guest", "lane")
    )


def batches_with_context(assigned: DataFrame, group: int = fixed.GROUP_SIZE) -> DataFrame:
    """Batches with `group_id` and `prev_content`, the content of the last batch of the group before (null in group 0)."""
    whole = W.partitionBy(TID, "lane")
    return (
        batches_in_lanes(assigned, group)
        .withColumn("prev_content", F.max(F.when(F.col("_guest"), F.col("content"))).over(whole))
        .filter(~F.col("_guest"))
        .drop("_guest")
        .withColumnRenamed("lane", "group_id")
    )


def request_context(prev_content: Column, content: Column) -> Column:
    """The text a batch is analysed with: the earlier context, if any, then the batch itself."""
    before, topic, gap = fixed.PREVIOUS_CONTEXT
    earlier = F.concat(F.lit(before), prev_content, F.lit(topic + fixed.UNREADABLE_TOPIC + gap))
    has_earlier = prev_content.isNotNull()
    return F.concat(F.when(has_earlier, earlier).otherwise(""), F.lit(fixed.CURRENT_CONTEXT), content)


def natural_boundaries(
    assigned: DataFrame, size: int = fixed.BATCH_SIZE, threshold: float = fixed.SIMILARITY_THRESHOLD
) -> DataFrame:
    """Similarity of each batch to the utterance after it, and whether that marks a natural boundary.

    The utterance that opens a batch is also sent to the batch before it, so one shuffle is enough.
    """
    own = F.struct(F.col("batch_id").alias("batch"), F.lit(False).alias("after"))
    before = F.struct((F.col("batch_id") - 1).alias("batch"), F.lit(True).alias("after"))
    opens = (F.col("batch_id") > 0) & ((F.col("rn") - 1) % size == 0)
    return (
        assigned.withColumn("_role", F.explode(F.when(opens, F.array(own, before)).otherwise(F.array(own))))
        .groupBy(TID, F.col("_role.batch").alias("batch_id"))
        .agg(
            F.collect_list(F.when(~F.col("_role.after"), F.struct("seq", "content"))).alias("_said"),
            F.max(F.when(F.col("_role.after"), F.col("content"))).alias("next_content"),
        )
        .filter(F.col("next_content").isNotNull())
        .withColumn("content", joined_in_order(F.col("_said"), "content", " "))
        .withColumn("sim", similarity("content", "next_content"))
        .select(TID, "batch_id", "sim", (F.col("sim") < threshold).alias("is_boundary"))
    )


def request_id(content: Column, prev_content: Column) -> Column:
    """A key for (content, previous content) that tells a missing previous content from an empty one."""
    return F.sha2(F.concat(F.length(content).cast("string"), F.lit(":"), content, F.coalesce(F.concat(F.lit("+"), prev_content), F.lit(""))), 256)


def distinct_requests(batches: DataFrame) -> DataFrame:
    """One row per distinct (content, prev_content), with how many batches share it."""
    return (
        batches.withColumn("request_id", request_id(F.col("content"), F.col("prev_content")))
        .groupBy("request_id")
        .agg(F.first("content").alias("content"), F.first("prev_content").alias("prev_content"), F.count(F.lit(1)).alias("uses"))
    )


def share_answers(batches: DataFrame, answers: DataFrame, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Give every batch the answer of its request; much-repeated requests are spread over tasks."""
    keyed = batches.select(TID, "batch_id", request_id(F.col("content"), F.col("prev_content")).alias("request_id"))
    return skew_join(keyed, answers, ["request_id"], "left", spread=[TID, "batch_id"], min_rows=min_rows)
