"""The whole way from utterances to segments."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from seamline import fixed_values as fixed
from seamline.operators.annotation import annotations_from_responses, completed_annotations, native_annotation
from seamline.operators.batching import assign_batches, batches_with_context, combine_batches, distinct_requests, share_answers
from seamline.operators.segmenting import decide_segments, merge_segments, segment_metadata, segment_spans
from seamline.session import written
from seamline.sources.stores import AnswerStore


def stored_batches(utterances: DataFrame, size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Batches with their text, stored once for the branches that follow."""
    return written(combine_batches(assign_batches(utterances, size)), "batches")


def segment_transcripts(
    utterances: DataFrame,
    size: int = fixed.BATCH_SIZE,
    annotate: Callable[[DataFrame], DataFrame] = native_annotation,
) -> DataFrame:
    """The topic segments of every transcript: id, start, end, duration, topic, keywords, text.

    `annotate` maps batches to (transcript_id, batch_id, topic, keywords, relationship, confidence); see
    `annotate_from` for annotations that come from a table of model responses.
    Batches and annotations are stored in the shared folder between the steps: three branches read the
    first and two read the second, each only its own columns.
    """
    batches = stored_batches(utterances, size)
    annotation = written(annotate(batches), "annotation")
    return segment_metadata(merge_segments(batches, decide_segments(annotation)))


def annotate_from(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """An `annotate` that reads model responses (transcript_id, batch_id, response); batches without one get the defaults."""
    return lambda batches: completed_annotations(batches, annotations_from_responses(responses))


def segment_spans_of(
    utterances: DataFrame, size: int = fixed.BATCH_SIZE, annotate: Callable[[DataFrame], DataFrame] = native_annotation
) -> tuple[DataFrame, DataFrame]:
    """The same segments without their text as one cell, for transcripts whose segments are too long for one.

    Returns (segments, batches with their segment_id); ordered by batch_id the batches are the text.
    """
    batches = stored_batches(utterances, size)
    decided = decide_segments(written(annotate(batches), "annotation"))
    placed = batches.select("transcript_id", "batch_id", "start", "end", "content").join(
        decided.select("transcript_id", "batch_id", "segment_id"), ["transcript_id", "batch_id"]
    )
    return segment_spans(batches, decided), placed


def segments_in_pieces(
    utterances: DataFrame, size: int = fixed.BATCH_SIZE, annotate: Callable[[DataFrame], DataFrame] = native_annotation
) -> DataFrame:
    """Batches with id, times and topic of their segment; segments meet the narrow rows first, so texts are joined once."""
    batches = stored_batches(utterances, size)
    decided = decide_segments(written(annotate(batches), "annotation"))
    spans = segment_spans(batches, decided).selectExpr("transcript_id", "segment_id", "start AS start_time", "end AS end_time", "topic")
    told = decided.select("transcript_id", "batch_id", "segment_id").join(spans, ["transcript_id", "segment_id"])
    return batches.select("transcript_id", "batch_id", "content").join(told, ["transcript_id", "batch_id"])


def segment_with_answers(utterances: DataFrame, store: AnswerStore, ask: Callable[[DataFrame], DataFrame], run: str, size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Segments from answers of a model: requests that no earlier run has answered are asked once each, and shared back to all batches with that content.

    `ask` maps requests (request_id, content, prev_content, uses) to (request_id, response); a request without an answer gets the defaults.
    """
    grouped = written(batches_with_context(assign_batches(utterances, size)), "batches")
    store.answer(distinct_requests(grouped), ask, run)
    responses = share_answers(grouped, store.load()).select("transcript_id", "batch_id", "response")
    annotation = written(annotate_from(responses)(grouped), "annotation")
    return segment_metadata(merge_segments(grouped, decide_segments(annotation)))
