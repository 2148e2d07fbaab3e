"""Boundary decisions, merged segments, and the documents and reports made of them."""

from pyspark.sql import DataFrame, functions as F

from seamline import fixed_values as fixed
from seamline.functions.numbers import fixed as fixed_point
from seamline.functions.text import term_counts
from seamline.operators.annotation import top_terms
from seamline.operators.batching import TID
from seamline.operators.ordered import running_totals
from seamline.operators.skew import HOT_MIN_ROWS, skew_join



def decide_segments(
    annotation: DataFrame, new_above: float = fixed.NEW_CONFIDENCE, shift_above: float = fixed.SHIFT_CONFIDENCE
) -> DataFrame:
    """Add the 1-based `segment_id`: batch 0 opens, later ones open on a confident NEW or SHIFT."""
    opens = (
        (F.col("batch_id") == 0)
        | ((F.col("relationship") == "NEW") & (F.col("confidence") > new_above))
        | ((F.col("relationship") == "SHIFT") & (F.col("confidence") > shift_above))
    )
    return running_totals(
        annotation.withColumn("opens", opens), [TID], "batch_id", {"segment_id": F.col("opens").cast("long")}
    )


def merge_segments(batches: DataFrame, decided: DataFrame) -> DataFrame:
    """Join each segment's batches: start of the first, end of the last, contents in order, topic of the first.

    The text of one segment is one cell and so must fit one; `segment_spans` gives everything else
    without it.
    """
    placed = batches.select(TID, "batch_id", "start", "end", "content").join(
        decided.select(TID, "batch_id", "segment_id", F.when(F.col("opens"), F.struct("topic", "keywords")).alias("_first")),
        [TID, "batch_id"],
    )
    parts = F.sort_array(F.collect_list(F.struct("batch_id", "content", "start", "end")))
    merged = placed.groupBy(TID, "segment_id").agg(parts.alias("_parts"), F.first("_first", True).alias("_first"))
    return merged.select(
        TID,
        "segment_id",
        F.col("_parts")[0]["start"].alias("start"),
        F.element_at("_parts", -1)["end"].alias("end"),
        F.array_join(F.transform("_parts", lambda p: p["content"]), " ").alias("content"),
        "_first.topic",
        "_first.keywords",
    )


def segment_spans(batches: DataFrame, decided: DataFrame) -> DataFrame:
    """Segments without their text: plain mergeable aggregates, however long a segment is."""
    placed = batches.select(TID, "batch_id", "start", "end").join(
        decided.select(TID, "batch_id", "segment_id", "opens", "topic", "keywords"), [TID, "batch_id"]
    )
    return placed.groupBy(TID, "segment_id").agg(
        F.min_by("start", "batch_id").alias("start"),
        F.max_by("end", "batch_id").alias("end"),
        F.min_by(F.struct("topic", "keywords"), "batch_id").alias("_first"),
    ).select(TID, "segment_id", "start", "end", "_first.topic", "_first.keywords")


def segment_metadata(segments: DataFrame) -> DataFrame:
    """The reported form of a segment."""
    return segments.select(
        TID,
        F.col("segment_id").cast("int").alias("segment_id"),
        F.col("start").alias("start_time"),
        F.col("end").alias("end_time"),
        (F.col("end") - F.col("start")).alias("duration"),
        F.col("topic").alias("dominant_topic"),
        F.col("keywords").alias("top_keywords"),
        F.col("content").alias("transcript"),
    )


def topic_list(metadata: DataFrame) -> DataFrame:
    """One topic entry per segment, numbered from 0."""
    return metadata.select(
        TID, (F.col("segment_id") - 1).alias("topic_id"), F.col("dominant_topic").alias("topic"), F.col("top_keywords").alias("words")
    )


BOX = "struct<x:int,y:int,w:int,h:int>"
ANALYZED = (
    "array<struct<segment_id:int,start_time:double,end_time:double,transcript:string,topic:string,keywords:array<string>,"
    "frame_analyses:array<struct<ordinal:int,timestamp:double,frame_type:string,software_analysis:struct<"
    f"ocr_matches:array<struct<software:string,detected_text:string,confidence:double,location:{BOX}>>,"
    "logo_matches:array<struct<software:string,confidence:double,location:struct<x:int,y:int>>>>,analysis:string>>>>"
)


def results_documents(
    metadata: DataFrame, register: str = "gen-ai", analyzed: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """The results document of each transcript, one row whatever its size: topics, segments, register, analyzed_segments.

    `analyzed`: segments rolled up with their frames (`visual.analyze_segments`), their video_id being the transcript's id;
    transcripts without any have an empty array. `texts` (video_id, text_id, text): what the ids in `detected_text` of their matches stand
    for; each text is moved once, to the document. It is looked up among the texts of its document.
    For transcripts whose document doesn't fit a cell use the rows of `topic_list` and of the metadata themselves.
    """
    fields = ["segment_id", "start_time", "end_time", "duration", "dominant_topic", "top_keywords", "transcript"]
    rows, none = metadata.select(TID, F.struct(*fields).alias("_segment")), F.array().cast(ANALYZED)
    entries = none
    if analyzed is not None:
        # Both kinds of rows meet in one grouping: what is seen holds texts, and a join would move them once more.
        fields = ["segment_id", "start_time", "end_time", "transcript", "topic", "keywords", "frame_analyses"]
        seen = analyzed.select(F.col("video_id").alias(TID), F.struct(*fields).alias("_seen"))
        rows = rows.unionByName(seen, True)
        entries = F.sort_array(F.collect_list("_seen")).cast(ANALYZED)
    said = []
    if texts is not None:
        rows = rows.unionByName(texts.select(F.col("video_id").alias(TID), F.struct("text_id", "text").alias("_text")), True)
        said = [F.collect_list("_text").alias("_texts")]
    gathered = rows.groupBy(TID).agg(F.sort_array(F.collect_list("_segment")).alias("segments"), entries.alias("analyzed_segments"), *said)
    shown = _with_texts("analyzed_segments", "_texts") if said else F.col("analyzed_segments")
    topics = F.transform(
        "segments",
        lambda s: F.struct(
            (s["segment_id"] - 1).alias("topic_id"), s["dominant_topic"].alias("topic"), s["top_keywords"].alias("words")
        ),
    )
    # a video without a segment of a transcript has no document
    return gathered.filter(F.size("segments") > 0).select(TID, topics.alias("topics"), "segments", F.lit(register).alias("register"), shown.alias("analyzed_segments"))


def _with_texts(analyzed: str, texts: str):
    """The analysed segments with the texts whose ids their matches hold, matches in order of what they hold now."""

    def filled(named):
        match = lambda m: m.withField("detected_text", F.try_element_at(named, m["detected_text"]))
        frame = lambda f: f.withField("software_analysis.ocr_matches", F.sort_array(F.transform(f["software_analysis"]["ocr_matches"], match)))
        return F.transform(analyzed, lambda s: s.withField("frame_analyses", F.transform(s["frame_analyses"], frame)))

    return F.transform(F.array(F.map_from_entries(texts)), filled)[0]  # the map is made once


def report_lines(metadata: DataFrame) -> DataFrame:
    """The text report as numbered lines: every topic's words, the number of segments, every segment's span.

    Lines are ordered by (transcript_id, block, line).
    """
    number = F.col("segment_id")
    topic_line = F.concat(F.lit("Topic "), number.cast("string"), F.lit(": "), F.array_join("top_keywords", ", "))
    span_line = F.concat(
        F.lit("Segment "), number.cast("string"), F.lit(" ("), fixed_point(F.col("start_time"), 2), F.lit("s - "),
        fixed_point(F.col("end_time"), 2), F.lit("s):"),
    )
    per_segment = metadata.select(
        TID,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("block"), number.cast("long").alias("line"), topic_line.alias("text")),
                F.struct(F.lit(3).alias("block"), number.cast("long").alias("line"), span_line.alias("text")),
            )
        ).alias("_l"),
    ).select(TID, "_l.*")
    counts = metadata.groupBy(TID).agg(F.count(F.lit(1)).alias("n")).select(
        TID,
        F.lit(2).alias("block"),
        F.lit(1).cast("long").alias("line"),
        F.concat(F.lit("Generated and analyzed "), F.col("n").cast("string"), F.lit(" segments")).alias("text"),
    )
    return per_segment.unionByName(counts)


def transcript_only(utterances: DataFrame) -> DataFrame:
    """Transcripts as they are, marked as not segmented."""
    return utterances.select(TID, "seq", "content", "start", "end", F.lit(True).alias("transcription_only"))


def segment_keywords(metadata: DataFrame, k: int = 5, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """The top TF-IDF terms of every segment within its transcript."""
    totals = metadata.groupBy(TID).agg(F.max("segment_id").alias("n_segments"))
    units = metadata.select(TID, "segment_id", term_counts("transcript").alias("terms"))
    counted = skew_join(units, totals, [TID], spread=["segment_id"], min_rows=min_rows)
    return top_terms(counted, "segment_id", "n_segments", k)
