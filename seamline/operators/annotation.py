"""Topic annotations: read from model responses, or worked out from the text itself."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamline import fixed_values as fixed
from seamline.functions.arrays import bind
from seamline.functions.text import LONE, counted_similarity, is_term, term_counts, tokens, words
from seamline.operators.batching import LANE_BATCHES, TID, batches_in_lanes

#: Characters of text to a task that counts terms: what it sorts takes some 10 times the room and so stays in memory.
TASK_CHARS = 8_000_000
RESPONSES = "array<struct<topic:string,keywords:array<string>,relationship:string,confidence:double>>"


def parse_response(response: Column) -> Column:
    """struct<topic, keywords, relationship, confidence> from the text between the first '{' and the last '}'.

    The slice is read as the only element of a JSON array, so text after a first complete object makes
    it unreadable, as it should. Unreadable text and missing fields get the fixed defaults.
    """
    sliced = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.concat(F.lit("["), sliced, F.lit("]")), RESPONSES, {"allowSingleQuotes": "false"})
    one = F.when(F.size(parsed) == 1, parsed[0])
    return F.struct(
        F.coalesce(one["topic"], F.lit(fixed.UNREADABLE_TOPIC)).alias("topic"),
        F.coalesce(one["keywords"], F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(one["relationship"], F.lit(fixed.UNREADABLE_RELATIONSHIP)).alias("relationship"),
        F.coalesce(one["confidence"], F.lit(fixed.UNREADABLE_CONFIDENCE)).alias("confidence"),
    )


def annotations_from_responses(responses: DataFrame) -> DataFrame:
    """(transcript_id, batch_id, response) to one annotation per batch."""
    return responses.withColumn("_a", parse_response(F.col("response"))).select(TID, "batch_id", "_a.*")


def completed_annotations(batches: DataFrame, annotation: DataFrame) -> DataFrame:
    """An annotation for every batch: the fixed defaults where there is none, so that no batch is lost."""
    return batches.select(TID, "batch_id").join(annotation, [TID, "batch_id"], "left").select(
        TID,
        "batch_id",
        F.coalesce("topic", F.lit(fixed.UNREADABLE_TOPIC)).alias("topic"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("relationship", F.lit(fixed.UNREADABLE_RELATIONSHIP)).alias("relationship"),
        F.coalesce("confidence", F.lit(fixed.UNREADABLE_CONFIDENCE)).alias("confidence"),
    )


def top_terms(units: DataFrame, unit: str, count: str, k: int = 5) -> DataFrame:
    """The `k` terms of highest TF-IDF of every unit (batch or segment) within its transcript.

    `units` has transcript_id, `unit` (dense from 0 or 1), `count` (units in the transcript) and
    `terms`. Score = n * (ln((1+N)/(1+df)) + 1), rounded; ties go to the smaller term. A term's
    document frequency is counted per lane of units and totalled over the lanes, and joined back on
    the lane, so a term found everywhere in a huge transcript is still spread over many tasks.
    """
    lane = F.expr(f"{unit} div {LANE_BATCHES}").alias("lane")

    def exploded(terms):
        return units.select(TID, unit, count, lane, F.explode(terms).alias("_t")).select(
            TID, unit, "lane", count, F.col("_t.term").alias("term"), F.col("_t.n").alias("n")
        )

    found = exploded(F.col("terms"))
    # A weight lies between 1 and that of a term found once, so a term whose count cannot reach the
    # k-th highest count even with the highest weight is out before any join.
    highest = F.log((1 + F.col(count)) / 2) + 1
    kth = F.coalesce(F.get(F.sort_array(F.transform("terms", lambda t: t["n"]), False), F.lit(k - 1)), F.lit(0))
    least = (kth - 1e-5) / highest
    likely = exploded(bind(least, lambda needed: F.filter("terms", lambda t: t["n"] >= needed)))
    per_lane = found.groupBy(TID, "term", "lane").agg(F.count(F.lit(1)).alias("_df"), F.max(count).alias("_units"))
    weights = per_lane.select(
        TID,
        "term",
        "lane",
        (F.log((1 + F.col("_units")) / (1 + F.sum("_df").over(W.partitionBy(TID, "term")))) + 1).alias("idf"),
    )
    best = W.partitionBy(TID, unit).orderBy(F.desc("score"), "term")
    return (
        likely.join(weights, [TID, "term", "lane"])
        .select(TID, unit, "term", F.round(F.col("n") * F.col("idf"), 6).alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )


def keyword_lists(top: DataFrame, unit: str) -> DataFrame:
    """The ranked terms of each unit as one array (at most k entries)."""
    return top.groupBy(TID, unit).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("keywords")
    )


def batches_with_terms(assigned: DataFrame, lane: int = LANE_BATCHES) -> DataFrame:
    """Batches with their term counts (`terms`) and similarity to the batch just before (`sim`, null for the first).

    Every batch is broken into terms once; what the next batch is compared with are those counts.
    """
    order = W.partitionBy(TID, "lane").orderBy("batch_id")
    return (
        batches_in_lanes(assigned, lane)
        .withColumn("terms", term_counts("content"))
        .withColumn("_before", F.lag("terms").over(order))
        .filter(~F.col("_guest"))
        .withColumn("sim", F.when(F.col("_before").isNotNull(), counted_similarity("_before", "terms", None)))
        .drop("_before", "_guest", "lane")
    )


def _terms_of_long(batches: DataFrame) -> DataFrame:
    """(transcript_id, lane, term, total): in how many batches a term occurs, for every lane of transcripts longer than one lane."""
    lane = F.expr(f"batch_id div {LANE_BATCHES}").alias("lane")
    found = batches.filter(F.col("n_batches") > LANE_BATCHES).select(TID, lane, F.explode(F.array_distinct(tokens("content"))).alias("term"))
    counted = found.groupBy(TID, "term", "lane").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(TID, "lane", "term", F.sum("n").over(W.partitionBy(TID, "term")).alias("total"))


def _terms_by_lane(batches: DataFrame) -> DataFrame:
    """transcript_id, lane, batch_id, n_batches, term, n, total: every batch's terms, counted, and a row without term for every batch.

    Rows lie by (transcript, lane), after one shuffle of the texts. The last batch of the lane before is in a lane, too; so are the
    totals of `_terms_of_long`, as rows without batch.
    """
    own = F.expr(f"batch_id div {LANE_BATCHES}")
    ends = (F.col("batch_id") % LANE_BATCHES == LANE_BATCHES - 1) & (F.col("batch_id") < F.col("n_batches") - 1)
    places = F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))
    texts = batches.select(TID, F.explode(places).alias("lane"), "batch_id", "n_batches", "content")
    size = batches.agg(F.sum(F.length("content")).alias("n")).first()["n"] or 0
    laid = texts.unionByName(_terms_of_long(batches), True).repartition(size // TASK_CHARS + 1, TID, "lane")
    listed = F.when(F.col("total").isNull(), F.concat(words("content"), F.array(F.lit(None).cast("string")))).otherwise(F.array("term"))
    each = laid.select(TID, "lane", "batch_id", "n_batches", "total", F.explode(listed).alias("term")).filter(is_term("term") | F.col("term").isNull())
    return each.groupBy(TID, "lane", "batch_id", "n_batches", "term").agg(F.count("term").alias("n"), F.max("total").alias("total"))


def _judged(batches: DataFrame, k: int) -> DataFrame:
    """transcript_id, batch_id, sim (to the batch just before; null for the first), keywords (the top `k` terms, see `top_terms`).

    All of it is worked out where `_terms_by_lane` puts the rows. With two texts a term weighs 1 if they share it and ln(1.5)+1 if not,
    so the cosine follows from sums of whole numbers over all and over shared terms.
    """
    # The hash comes first because it decides nearly every comparison of the sort.
    by_term = W.partitionBy(F.xxhash64(TID, "lane", "term"), TID, "lane", "term").orderBy("batch_id")
    same = by_term.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.when(F.lag("batch_id").over(by_term) == F.col("batch_id") - 1, F.lag("n").over(by_term))
    is_own = F.col("n").isNotNull() & (F.expr(f"batch_id div {LANE_BATCHES}") == F.col("lane"))
    df = F.coalesce(F.max("total").over(same), F.count(F.when(is_own, 1)).over(same))
    met = _terms_by_lane(batches).withColumn("_before", before).withColumn("_df", df).filter(F.col("batch_id").isNotNull())
    n = F.col("n")
    score = F.round(n * (F.log((1 + F.col("n_batches")) / (1 + F.col("_df"))) + 1), 6)
    found = F.when(F.col("term").isNotNull(), F.struct((-score).alias("s"), "term"))
    parted = met.withColumn("_b", F.when(F.col("term").isNotNull(), F.col("_before"))).withColumn("_found", found).withColumn("_hash", F.xxhash64(TID, "lane", "batch_id"))
    # In order, so that rows are gathered as they come.
    in_order = parted.select("_hash", TID, "lane", "batch_id", "n", "_b", "_found").sortWithinPartitions("_hash", TID, "lane", "batch_id")
    summed = in_order.groupBy("_hash", TID, "lane", "batch_id").agg(
        F.sum(n * n).alias("_all"), F.sum(n * F.col("_b")).alias("_dot"), F.sum(F.when(F.col("_b").isNotNull(), n * n)).alias("_here"),
        F.sum(F.col("_b") * F.col("_b")).alias("_there"), F.slice(F.sort_array(F.collect_list("_found")), 1, k).alias("_top"),
    )
    previous = F.lag("_all").over(W.partitionBy(TID, "lane").orderBy("batch_id"))
    power = lambda both, whole: F.sqrt(F.col(both) + LONE * LONE * (whole - F.col(both)))
    cosine = F.round(F.col("_dot") / (power("_there", F.col("_previous")) * power("_here", F.col("_all"))), 6)
    sim = F.when(F.col("batch_id") > 0, F.when(F.col("_dot") > 0, cosine).otherwise(0.0))
    return summed.withColumn("_previous", previous).filter(F.expr(f"batch_id div {LANE_BATCHES} = lane")).select(
        TID, "batch_id", sim.alias("sim"), F.transform("_top", lambda t: t["term"]).alias("keywords")
    )


def native_annotation(batches: DataFrame, new_below: float = 0.1, shift_below: float = 0.3, k: int = 5) -> DataFrame:
    """Annotate batches (transcript_id, batch_id, n_batches, content) without a model.

    Keywords are the top TF-IDF terms and the topic is the first of them. The first batch is NEW with
    confidence 100; otherwise low similarity to the batch before means NEW or SHIFT.
    """
    sim = F.col("sim")
    return _judged(batches, k).select(
        TID,
        "batch_id",
        F.coalesce(F.get("keywords", F.lit(0)), F.lit(fixed.UNREADABLE_TOPIC)).alias("topic"),
        "keywords",
        F.when(sim.isNull() | (sim < new_below), "NEW").when(sim < shift_below, "SHIFT").otherwise("CONTINUATION").alias("relationship"),
        F.when(sim.isNull(), 100.0)
        .when(sim < shift_below, F.floor(100 * (1 - sim) + 0.5).cast("double"))
        .otherwise(F.floor(100 * sim + 0.5).cast("double"))
        .alias("confidence"),
    )
