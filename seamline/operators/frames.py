"""Which instants of a video to look at, the frames found there, and the texts and roll-ups made of them."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seamline import fixed_values as fixed
from seamline.functions.arrays import joined_in_order
from seamline.functions.images import grids
from seamline.functions.numbers import fixed as fixed_point, scaled_half_even
from seamline.operators.intervals import interval_join
from seamline.operators.ordered import asof_join
from seamline.operators.skew import HOT_MIN_ROWS, skew_join
from seamline.session import written

VID = "video_id"
SAMPLE = [VID, "segment_id", "ordinal"]


def sampling_plan(
    segments: DataFrame, internal: int = fixed.INTERNAL_FRAMES, longer_than: float = fixed.MIN_INTERNAL_DURATION
) -> DataFrame:
    """Instants to sample per segment: start, end, then evenly spaced ones inside if the segment is long enough."""
    start, end = F.col("start_time"), F.col("end_time")
    gap = (end - start) / (internal + 1)
    at = lambda time, kind: F.struct(time.alias("timestamp"), F.lit(kind).alias("frame_type"))
    edges = F.array(at(start, "segment_start"), at(end, "segment_end"))
    points = edges
    if internal > 0:
        inner = F.transform(F.sequence(F.lit(1), F.lit(internal)), lambda i: at(start + gap * i, "internal"))
        points = F.when(end - start > longer_than, F.concat(edges, inner)).otherwise(edges)
    return segments.select(VID, "segment_id", F.posexplode(points).alias("ordinal", "_p")).select(
        VID, "segment_id", "ordinal", "_p.timestamp", "_p.frame_type"
    )


def first_extractions(samples: DataFrame, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Replace time and type of each sample by those of the first sample of its video at the same millisecond."""
    keyed = samples.withColumn("_ms", scaled_half_even(F.col("timestamp"), 3))
    firsts = keyed.groupBy(VID, "_ms").agg(
        F.min_by(F.struct("timestamp", "frame_type"), F.struct("segment_id", "ordinal")).alias("_first")
    )
    narrow = keyed.select(*SAMPLE, "_ms")
    return skew_join(narrow, firsts, [VID, "_ms"], spread=["segment_id", "ordinal"], min_rows=min_rows).select(
        *SAMPLE, "_first.timestamp", "_first.frame_type"
    )


def fetch_frames(samples: DataFrame, frames: DataFrame, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """The last frame at or before each sample; samples before the first frame drop out.

    Only frame numbers and times take part; join pixels on (video_id, frame_no) afterwards.
    """
    found = asof_join(
        samples, frames.select(VID, "frame_no", "ts"), [VID], "timestamp", "ts", ["frame_no", "ts"], "_frame",
        ties=F.col("frame_no"), min_rows=min_rows,
    )
    return found.filter(F.col("_frame").isNotNull()).select(
        *samples.columns, "_frame.frame_no", F.col("_frame.ts").alias("frame_ts")
    )


def thumbnail_plan(
    videos: DataFrame, interval: float = fixed.THUMBNAIL_INTERVAL, most: int = fixed.MAX_THUMBNAILS
) -> DataFrame:
    """Evenly spread thumbnail instants: at least one, one per `interval` seconds, at most `most`."""
    n = F.greatest(F.lit(1), F.least(F.floor(F.col("duration") / interval), F.lit(most))).cast("int")
    return (
        videos.withColumn("_n", n)
        .withColumn("index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(VID, "index", (F.col("index") * (F.col("duration") / F.col("_n"))).alias("timestamp"))
    )


def slice_by_segments(rows: DataFrame, segments: DataFrame, time: str, width: float = 600.0, spread=None) -> DataFrame:
    """Assign timed rows to the segments of their video whose [start_time, end_time) holds them."""
    return interval_join(rows, segments, [VID], time, "start_time", "end_time", width, spread=spread)


def chain_previous(descriptions: DataFrame) -> DataFrame:
    """Add the analysis made before this one in the segment, in extraction order (a handful per segment)."""
    order = W.partitionBy(VID, "segment_id").orderBy("ordinal")
    return descriptions.withColumn("previous", F.lag(F.struct("timestamp", "analysis")).over(order))


def frame_context(has_catalog: Column) -> Column:
    """The text a frame is described with.

    Reads timestamp, frame_type, transcript, dominant_topic, top_keywords, ocr_matches, logo_matches
    and previous; match lines appear only with a catalog and when there are matches.
    """
    texts = F.transform("ocr_matches", lambda m: F.concat(m["software"], F.lit(" ("), m["detected_text"], F.lit(")")))
    logos = F.transform(
        "logo_matches",
        lambda m: F.concat(m["software"], F.lit(" (confidence: "), fixed_point(m["confidence"], 2), F.lit(")")),
    )
    before = F.col("previous")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Analyzing frame at "), fixed_point(F.col("timestamp"), 2), F.lit("s")),
        F.concat(F.lit("Frame type: "), F.col("frame_type")),
        F.concat(F.lit("\nTranscript context: "), F.col("transcript")),
        F.concat(F.lit("Topic: "), F.col("dominant_topic")),
        F.concat(F.lit("Keywords: "), F.array_join("top_keywords", ", ")),
        F.when(has_catalog, F.lit("\nSoftware Detection Results:")),
        F.when(has_catalog & (F.size("ocr_matches") > 0), F.concat(F.lit("Text detected: "), F.array_join(texts, ", "))),
        F.when(has_catalog & (F.size("logo_matches") > 0), F.concat(F.lit("Logos detected: "), F.array_join(logos, ", "))),
        F.when(
            before.isNotNull(),
            F.concat(
                F.lit("\nPrevious frame analysis ("), fixed_point(before["timestamp"], 2), F.lit("s):\n"), before["analysis"]
            ),
        ),
    )


def roll_up_segments(segments: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each segment with the array of its frame analyses in extraction order (empty if it has none)."""
    entry = F.struct(*_shown(), "analysis")
    return _rolled_up(segments, analyses.groupBy(VID, "segment_id").agg(F.sort_array(F.collect_list(entry)).alias("frame_analyses")))


def roll_up_described(segments: DataFrame, shown: DataFrame, descriptions: DataFrame) -> DataFrame:
    """`roll_up_segments` of frames joined to their descriptions (SAMPLE, analysis; null where there is none).

    Frames hold texts, so they are shuffled once, to their segment; there they meet its descriptions (a handful per segment).
    """
    frames = shown.groupBy(VID, "segment_id").agg(F.collect_list(F.struct(*_shown())).alias("_frames"))
    told = descriptions.groupBy(VID, "segment_id").agg(F.collect_list(F.struct("ordinal", F.struct("analysis").alias("said"))).alias("_told"))

    def each(frame):
        own = F.filter(F.coalesce("_told", F.array().cast(told.schema["_told"].dataType)), lambda t: t["ordinal"] == frame["ordinal"])
        entry = lambda analysis: F.struct(*[frame[c].alias(c) for c in ("ordinal", "timestamp", "frame_type", "software_analysis")], analysis.alias("analysis"))
        without = F.lit(None).cast(descriptions.schema["analysis"].dataType)
        return F.when(F.size(own) == 0, F.array(entry(without))).otherwise(F.transform(own, lambda t: entry(t["said"]["analysis"])))

    met = frames.join(told, [VID, "segment_id"], "left")
    return _rolled_up(segments, met.select(VID, "segment_id", F.sort_array(F.flatten(F.transform("_frames", each))).alias("frame_analyses")))


def _shown() -> list:
    return [F.col("ordinal"), F.col("timestamp"), F.col("frame_type"), F.struct("ocr_matches", "logo_matches").alias("software_analysis")]


def _rolled_up(segments: DataFrame, gathered: DataFrame) -> DataFrame:
    joined = segments.join(gathered, [VID, "segment_id"], "left")
    none = F.array().cast(gathered.schema["frame_analyses"].dataType)
    return joined.select(
        VID, "segment_id", "start_time", "end_time", "transcript",
        F.col("dominant_topic").alias("topic"), F.col("top_keywords").alias("keywords"),
        F.coalesce("frame_analyses", none).alias("frame_analyses"),
    )


def _differences(kind: pa.DataType):
    """Compares each frame with the one before it in the partition; a partition's first and last frame are given out whole."""
    pixels_type = kind

    def compare(batches):
        part, last, first = TaskContext.get().partitionId(), None, True

        def batch(rows):
            columns = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.string(), pixels_type]
            names = ["video_id", "frame_no", "ts", "mean", "same", "part", "edge", "pixels"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        for frames in batches:
            rows, whole = [], frames.column("pixels")
            place = zip(*[frames.column(c).to_pylist() for c in ("video_id", "frame_no", "ts")])
            for i, ((video, no, ts), image) in enumerate(zip(place, grids(whole))):
                if first:
                    rows.append((video, no, ts, None, None, part, "first", whole[i].as_py()))
                    first = False
                elif last[0] == video:
                    rows.append((video, no, ts, *_difference(last[3], image), part, None, None))
                last = video, no, ts, image, whole[i]
            yield batch(rows)
        if last is not None:
            yield batch([(*last[:3], None, None, part, "last", last[4].as_py())])

    return compare


def _difference(before, now):
    """(mean absolute difference, whether the size is the same); None is a frame that is no rectangle or empty."""
    if before is None or now is None or before.shape != now.shape:
        return None, before is None and now is None
    return float(np.abs(before - now).mean()), True


def scene_changes(frames: DataFrame, above: float) -> DataFrame:
    """Frames whose mean absolute pixel difference to the frame before exceeds `above`, or whose size differs (`difference` null).

    Frames are dealt by range in their order, once, and compared where they lie; only the last frame of each partition travels on to
    the partition after it. Frames without pixels are passed over.
    """
    kind = to_arrow_type(frames.schema["pixels"].dataType)
    order = [VID, "frame_no", "ts"]
    known = frames.filter(F.col("pixels").isNotNull()).select(F.col(VID).cast("string").alias(VID), F.col("frame_no").cast("long").alias("frame_no"), F.col("ts").cast("double").alias("ts"), "pixels")
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    pixels = frames.schema["pixels"].dataType.simpleString()
    compared = written(
        dealt.mapInArrow(_differences(kind), f"video_id string, frame_no long, ts double, mean double, same boolean, part int, edge string, pixels {pixels}"), "differences"
    )
    # Edges: two rows a partition; which partition comes before which is a matter of their numbers alone.
    edges = compared.filter("edge IS NOT NULL")
    numbers = edges.filter("edge = 'first'").select("part").withColumn("after", F.lag("part").over(W.orderBy("part")))
    firsts = edges.filter("edge = 'first'").join(F.broadcast(numbers), "part").drop("mean", "same", "part", "edge")
    lasts = edges.filter("edge = 'last'").select(F.col("part").alias("after"), F.col(VID).alias("_video"), F.col("pixels").alias("_before"))
    met = firsts.join(lasts, "after").filter(F.col(VID).eqNullSafe(F.col("_video")))

    @F.arrow_udf("struct<mean:double,same:boolean>")
    def between(before: pa.Array, now: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("mean", "same"), _difference(a, b))) for a, b in zip(grids(before), grids(now))], pa.struct([("mean", pa.float64()), ("same", pa.bool_())]))

    columns = [VID, "frame_no", "ts", "mean", "same"]
    at_edges = met.withColumn("_d", between("_before", "pixels")).select(VID, "frame_no", "ts", "_d.mean", "_d.same")
    inside = compared.filter("edge IS NULL").select(columns)
    judged = inside.unionByName(at_edges).withColumn("difference", F.when(F.col("same"), F.round("mean", 6)))
    return judged.filter(~F.col("same") | (F.col("difference") > above)).select(VID, "frame_no", "ts", "difference")


def transcript_context(
    samples: DataFrame, utterances: DataFrame, around: float, width: float = 600.0, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """Per sample, what is said within `around` seconds of it, in order (empty where nothing is)."""
    near = utterances.select(
        F.col("transcript_id").alias(VID), "seq", "content",
        (F.col("start") - around).alias("_from"), (F.col("end") + around).alias("_to"),
    )
    heard = interval_join(
        samples.select(*SAMPLE, "timestamp"), near, [VID], "timestamp", "_from", "_to", width, closed=True,
        spread=["segment_id", "ordinal"], min_rows=min_rows,
    ).select(*SAMPLE, "timestamp", F.struct("seq", "content").alias("_said"))
    # Every sample joins the grouping itself too, so those without speech stay without a second join.
    silent = samples.select(*SAMPLE, "timestamp", F.lit(None).cast("struct<seq:bigint,content:string>").alias("_said"))
    return (
        heard.unionByName(silent)
        .groupBy(*SAMPLE, "timestamp")
        .agg(F.collect_list("_said").alias("_all"))
        .select(*SAMPLE, "timestamp", joined_in_order(F.col("_all"), "content", " ").alias("context"))
    )
