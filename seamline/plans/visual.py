"""The whole way from segments and frames to analysed segments, and from screenshots to their summaries."""

from pyspark.sql import Column, DataFrame, functions as F

from seamline import fixed_values as fixed
from seamline.operators import detection, frames as sampling
from seamline.operators.frames import SAMPLE, VID
from seamline.operators.skew import HOT_MIN_ROWS, skew_join
from seamline.session import written
from seamline.sources.catalogs import available_logos


def frame_id(video: str = VID, frame_no: str = "frame_no") -> Column:
    return F.concat_ws("#", F.col(video), F.col(frame_no))


def sampled_frames(
    segments: DataFrame, frames: DataFrame, internal: int = fixed.INTERNAL_FRAMES, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """The frame behind each sample of each segment; reads only numbers and times of the frames."""
    samples = written(sampling.first_extractions(sampling.sampling_plan(segments, internal), min_rows), "samples")
    found = sampling.fetch_frames(samples, frames.select(VID, "frame_no", "ts"), min_rows)
    return written(found.withColumn("frame_id", frame_id()), "frames")


def matched_frames(
    sampled: DataFrame, frames: DataFrame, texts: DataFrame, catalog: DataFrame, logos: DataFrame,
    threshold: float = fixed.LOGO_THRESHOLD, min_rows: int = HOT_MIN_ROWS, places: DataFrame | None = None,
):
    """Sampled frames with their text and logo matches.

    Each frame is searched once however many samples show it, and no frame outside the samples is.

    `places` (text_no, frame_id, video_id) says which frames show a text, for texts without a frame_id: these are moved once, to the frames
    that are sampled. Then the texts with matches come back too (video_id, text_id, text), and `detected_text` of a match is a text_id,
    for `results_documents` to fill in: texts don't travel with samples and segments.
    """
    wanted = written(sampled.select("frame_id", VID, "frame_no").distinct(), "wanted")
    pixels = frames.select(VID, "frame_no", "pixels").join(wanted, [VID, "frame_no"]).select("frame_id", "pixels")
    if places is None:
        read = detection.match_names(texts.join(wanted.select("frame_id"), "frame_id", "left_semi"), catalog, together=True)
    else:
        said = texts.join(places.join(wanted.select("frame_id"), "frame_id", "left_semi"), "text_no")
        # the video rides in the box, which matches keep
        numbered = detection.match_names(said.withColumn("bbox", F.struct("bbox", VID)), catalog, together=True).withColumn("text_id", F.monotonically_increasing_id().cast("string"))
        read = written(numbered.withColumn(VID, F.col(f"location.{VID}")).withColumn("location", F.col("location.bbox")), "read")
        apart = read.select(VID, "text_id", F.col("detected_text").alias("text"))
        read = read.withColumn("detected_text", F.col("text_id"))
    found = detection.detection_summaries(wanted, read, detection.match_logos(pixels, available_logos(catalog, logos), threshold))
    summaries = found.select("frame_id", "ocr_matches", "logo_matches")  # not stored: this join is all that reads it
    matched = skew_join(sampled, summaries, ["frame_id"], spread=SAMPLE, min_rows=min_rows)
    return matched if places is None else (matched, apart)


def analyze_segments(segments: DataFrame, matched: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Each segment with the matches and the description (video_id, segment_id, ordinal, analysis) of its frames."""
    return sampling.roll_up_described(segments, matched, descriptions.select(*SAMPLE, "analysis"))


def frame_contexts(segments: DataFrame, matched: DataFrame, descriptions: DataFrame, has_catalog: Column) -> DataFrame:
    """The text to describe each sampled frame with, given the descriptions made so far."""
    described = matched.join(descriptions.select(*SAMPLE, "analysis"), SAMPLE, "left")
    chained = sampling.chain_previous(described).withColumn("previous", F.when(F.col("previous.analysis").isNotNull(), F.col("previous")))
    told = chained.join(segments.select(VID, "segment_id", "transcript", "dominant_topic", "top_keywords"), [VID, "segment_id"])
    return told.select(*SAMPLE, sampling.frame_context(has_catalog).alias("context"))
