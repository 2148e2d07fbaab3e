"""Level and sample tables of audio tracks: silence, retiming, down-mixing, level normalisation."""

from pyspark.sql import Column, DataFrame, functions as F

from seamline import fixed_values as fixed
from seamline.operators.ordered import SECONDS, asof_join, running_totals
from seamline.operators.skew import HOT_MIN_ROWS
from seamline.session import written

TRACK = "track_id"


def silence_intervals(
    levels: DataFrame, below: float = fixed.SILENCE_DB, at_least: float = fixed.SILENCE_SECONDS, width: float = SECONDS,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """[start, end) of every quiet stretch of at least `at_least` seconds; it ends at the next loud instant.

    A quiet row belongs to the number of loud rows before it, and the loud row that ends the stretch
    joins that number too: a running count and one grouping, however long the stretch.
    """
    instants = written(levels.groupBy(TRACK, "t").agg(F.max("level_db").alias("level_db")), "levels")
    loud = F.col("level_db") >= below
    counted = running_totals(
        instants, [TRACK], "t", {"_loud": loud.cast("long")}, width=width, split_hot=True, min_rows=min_rows
    )
    stretch = F.when(loud, F.col("_loud") - 1).otherwise(F.col("_loud"))
    return (
        counted.groupBy(TRACK, stretch.alias("_stretch"))
        .agg(
            F.min(F.when(~loud, F.col("t"))).alias("start"),
            F.coalesce(F.max(F.when(loud, F.col("t"))), F.max("t")).alias("end"),
        )
        .filter(F.col("start").isNotNull() & (F.col("end") - F.col("start") >= at_least))
        .select(TRACK, "start", "end")
    )


def _with_silent_before(silences: DataFrame, width: float, min_rows: int) -> DataFrame:
    length = F.col("end") - F.col("start")
    summed = running_totals(
        silences, [TRACK], "start", {"_through": length, "_no": F.lit(1).cast("long")}, width=width, split_hot=True,
        min_rows=min_rows,
    )
    return summed.withColumn("silent_before", F.col("_through") - length)


def _played(time: Column, silent: Column, audible_speed: float, silent_speed: float) -> Column:
    """Where `time` lands when `silent` seconds of what came before it were quiet."""
    return (time - silent) / audible_speed + silent / silent_speed


def retimed_pieces(
    silences: DataFrame, tracks: DataFrame, audible_speed: float = fixed.AUDIBLE_SPEED,
    silent_speed: float = fixed.SILENT_SPEED, width: float = SECONDS, min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """All pieces of each track (track_id, duration), audible and silent, with their place in the new timeline."""
    summed = _with_silent_before(silences, width, min_rows)
    # A silence's end opens the audible piece before the next silence: it is sent there by number.
    sent = summed.select(
        TRACK,
        F.explode(
            F.array(
                F.struct(F.col("_no").alias("no"), "start", "end", "silent_before", F.lit(None).cast("double").alias("since")),
                F.struct(
                    (F.col("_no") + 1).alias("no"), F.lit(None).cast("double").alias("start"),
                    F.lit(None).cast("double").alias("end"), F.lit(None).cast("double").alias("silent_before"),
                    F.col("end").alias("since"),
                ),
            )
        ).alias("_s"),
    )
    met = sent.groupBy(TRACK, "_s.no").agg(
        *[F.max(f"_s.{c}").alias(c) for c in ("start", "end", "silent_before")],
        F.coalesce(F.max("_s.since"), F.lit(0.0)).alias("since"),
    )
    piece = lambda start, end, silent, before: F.struct(
        start.alias("start"), end.alias("end"), F.lit(silent).alias("is_silent"), before.alias("silent_before")
    )
    inner = met.filter(F.col("start").isNotNull()).select(
        TRACK,
        F.explode(
            F.array(
                piece(F.col("since"), F.col("start"), False, F.col("silent_before")),
                piece(F.col("start"), F.col("end"), True, F.col("silent_before")),
            )
        ).alias("_p"),
    )
    closing = silences.groupBy(TRACK).agg(F.max("end").alias("_last"), F.sum(F.col("end") - F.col("start")).alias("_quiet"))
    tail = tracks.join(closing, TRACK, "left").select(
        TRACK, piece(F.coalesce("_last", F.lit(0.0)), F.col("duration"), False, F.coalesce("_quiet", F.lit(0.0))).alias("_p")
    )
    speed = F.when(F.col("is_silent"), silent_speed).otherwise(audible_speed)
    starts = _played(F.col("start"), F.col("silent_before"), audible_speed, silent_speed)
    return (
        inner.unionByName(tail)
        .select(TRACK, "_p.*")
        .filter(F.col("end") > F.col("start"))
        .select(
            TRACK, "start", "end", "is_silent",
            F.round(starts, 6).alias("new_start"),
            F.round(starts + (F.col("end") - F.col("start")) / speed, 6).alias("new_end"),
        )
    )


def retimed(
    times: DataFrame, silences: DataFrame, audible_speed: float = fixed.AUDIBLE_SPEED,
    silent_speed: float = fixed.SILENT_SPEED, width: float = SECONDS, min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Add `new_t`, where each instant (track_id, t) lands in the new timeline."""
    summed = _with_silent_before(silences, width, min_rows).select(TRACK, "start", "end", "silent_before")
    found = asof_join(
        times, summed, [TRACK], "t", "start", ["start", "end", "silent_before"], "_quiet", width=width, min_rows=min_rows
    )
    quiet = F.col("_quiet")
    silent = F.coalesce(quiet["silent_before"] + F.least(F.col("t"), quiet["end"]) - quiet["start"], F.lit(0.0))
    return found.withColumn("new_t", F.round(_played(F.col("t"), silent, audible_speed, silent_speed), 6)).drop("_quiet")


def mono_resampled(samples: DataFrame, rate: float = fixed.SAMPLE_RATE) -> DataFrame:
    """Average over channels and over each 1/rate second."""
    n = F.floor(F.col("t") * rate).cast("long").alias("n")
    return samples.groupBy(TRACK, n).agg(F.round(F.avg("x"), 6).alias("x"))


def normalized(
    samples: DataFrame, target: float, gain_db: float = fixed.GAIN_DB
) -> DataFrame:
    """Scale each track to the RMS level `target`, then apply the gain; silent tracks stay silent.

    The right side has one row per track; adaptive execution splits a hot track's samples and repeats that row.
    """
    rms = samples.groupBy(TRACK).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("_rms"))
    factor = F.when(F.col("_rms") > 0, target / F.col("_rms")).otherwise(1.0) * (10 ** (gain_db / 20))
    joined = samples.join(rms, [TRACK])
    return joined.withColumn("x", F.round(F.col("x") * factor, 6)).drop("_rms")
