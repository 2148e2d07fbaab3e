import random

import pytest
from pyspark.sql import Window as W, functions as F

from seamline.operators import audio, frames

SEG = "video_id string, segment_id int, start_time double, end_time double"


def test_sampling_plan(spark):
    df = spark.createDataFrame([("v", 1, 10.0, 18.0), ("v", 2, 0.0, 2.0)], SEG)
    got = frames.sampling_plan(df).orderBy("segment_id", "ordinal").collect()
    assert [(r.timestamp, r.frame_type) for r in got if r.segment_id == 1] == [
        (10.0, "segment_start"), (18.0, "segment_end"), (12.0, "internal"), (14.0, "internal"), (16.0, "internal"),
    ]
    assert [r.timestamp for r in got if r.segment_id == 2] == [0.0, 2.0]


@pytest.mark.parametrize("min_rows", [2, 1000])
def test_first_extraction_wins(spark, min_rows):
    df = spark.createDataFrame([("v", 1, 0.0, 8.0), ("v", 2, 8.0004, 16.0)], SEG)
    got = frames.first_extractions(frames.sampling_plan(df), min_rows).orderBy("segment_id", "ordinal").collect()
    assert len(got) == 10
    assert (got[5].timestamp, got[5].frame_type) == (8.0, "segment_end")


def test_frames_at_or_before(spark):
    seen = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 1.0), ("v", 2, 2.5)], "video_id string, frame_no long, ts double")
    asked = spark.createDataFrame([("v", t) for t in (-1.0, 0.0, 2.4, 9.0)], "video_id string, timestamp double")
    got = frames.fetch_frames(asked, seen, min_rows=1).collect()
    assert sorted((r.timestamp, r.frame_no) for r in got) == [(0.0, 0), (2.4, 1), (9.0, 2)]


def test_thumbnails(spark):
    df = spark.createDataFrame([("a", 62.0), ("b", 3.0)], "video_id string, duration double")
    got = frames.thumbnail_plan(df, 5, 5).orderBy("video_id", "index").collect()
    assert [r.timestamp for r in got if r.video_id == "a"] == pytest.approx([0, 12.4, 24.8, 37.2, 49.6])
    assert [r.timestamp for r in got if r.video_id == "b"] == [0.0]


def test_previous_analysis_and_context(spark):
    df = spark.createDataFrame([("v", 1, i, float(i), f"a{i}") for i in range(5)], "video_id string, segment_id int, ordinal int, timestamp double, analysis string")
    got = frames.chain_previous(df).orderBy("ordinal").collect()
    assert [r.previous and r.previous.analysis for r in got] == [None, "a0", "a1", "a2", "a3"]

    told = frames.chain_previous(df).selectExpr(
        "*", "'internal' AS frame_type", "'said' AS transcript", "'topic' AS dominant_topic", "array('k', 'l') AS top_keywords",
        "array(named_struct('software', 'App', 'detected_text', 'an app')) AS ocr_matches",
        "array(named_struct('software', 'Logo', 'confidence', 0.825D)) AS logo_matches",
    ).filter("ordinal = 1")
    want = (
        "Analyzing frame at 1.00s\nFrame type: internal\n\nTranscript context: said\nTopic: topic\nKeywords: k, l\n"
        "\nSoftware Detection Results:\nText detected: App (an app)\nLogos detected: Logo (confidence: 0.82)\n"
        "\nPrevious frame analysis (0.00s):\na0"
    )
    assert told.select(frames.frame_context(F.lit(True))).first()[0] == want
    assert "Detection" not in told.select(frames.frame_context(F.lit(False))).first()[0]


def test_scene_changes_cross_partitions(spark):
    shades = [0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 5.5] * 30
    data = [(v, i, float(i), [[s + k, s], [s, s]]) for k, v in enumerate(("v", "w", None)) for i, s in enumerate(shades)] + [("v", 1000, 0.0, None)]
    df = spark.createDataFrame(data, "video_id string, frame_no long, ts double, pixels array<array<double>>").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = frames.scene_changes(df, 0.6).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    changes = [(i, abs(b - a)) for i, (a, b) in enumerate(zip(shades, shades[1:]), 1) if abs(b - a) > 0.6]
    assert sorted((str(r.video_id), r.frame_no, r.difference) for r in got) == sorted((v, i, d) for v in ("v", "w", "None") for i, d in changes)


def test_transcript_context_keeps_silent_samples(spark):
    samples = spark.createDataFrame([("v", 1, 0, 5.0), ("v", 1, 1, 500.0)], "video_id string, segment_id int, ordinal int, timestamp double")
    said = spark.createDataFrame([("v", 0, "far", 0.0, 1.0), ("v", 2, "late", 6.0, 8.0), ("v", 1, "near", 2.0, 3.5)], "transcript_id string, seq long, content string, start double, end double")
    got = frames.transcript_context(samples, said, 2.0, width=3.0, min_rows=1).orderBy("ordinal").collect()
    assert [r.context for r in got] == ["near late", ""]


LEVELS = [(0.0, -10), (0.5, -10), (1.0, -30), (1.5, -30), (2.0, -30), (2.5, -10), (3.0, -30), (3.5, -10)]


def test_silence_and_retiming(spark):
    levels = spark.createDataFrame([("a", t, float(x)) for t, x in LEVELS], "track_id string, t double, level_db double")
    quiet = audio.silence_intervals(levels, width=1.0, min_rows=1)
    assert [(r.start, r.end) for r in quiet.collect()] == [(1.0, 2.5)]

    tracks = spark.createDataFrame([("a", 4.0), ("b", 3.0)], "track_id string, duration double")
    pieces = audio.retimed_pieces(quiet, tracks, width=1.0, min_rows=1).orderBy("track_id", "start").collect()
    assert [(r.start, r.end, r.is_silent) for r in pieces[:3]] == [(0.0, 1.0, False), (1.0, 2.5, True), (2.5, 4.0, False)]
    assert [r.new_end - r.new_start for r in pieces] == [0.5, 0.1875, 0.75, 1.5]
    assert [r.new_start for r in pieces[1:3]] == [pieces[0].new_end, pieces[1].new_end]

    asked = spark.createDataFrame([("a", t) for t in (0.5, 1.75, 2.5, 4.0)] + [("b", 3.0)], "track_id string, t double")
    got = {(r.track_id, r.t): r.new_t for r in audio.retimed(asked, quiet, width=1.0, min_rows=1).collect()}
    assert got == {("a", 0.5): 0.25, ("a", 1.75): 0.59375, ("a", 2.5): 0.6875, ("a", 4.0): 1.4375, ("b", 3.0): 1.5}


def test_long_quiet_stretches_match_brute_force(spark):
    rng = random.Random(4)
    data = [("hot", i / 8, -30.0 if rng.random() < 0.8 else -5.0) for i in range(400)]
    levels = spark.createDataFrame(data, "track_id string, t double, level_db double")
    got = audio.silence_intervals(levels, at_least=0.5, width=10.0, min_rows=20)
    want, start = [], None
    for _, t, level in data + [("hot", None, 0.0)]:
        if level < -25 and start is None:
            start = t
        elif level >= -25 and start is not None:
            end = t if t is not None else data[-1][1]
            if end - start >= 0.5:
                want.append((start, end))
            start = None
    assert sorted((r.start, r.end) for r in got.collect()) == want


def test_resampling_and_normalising(spark):
    df = spark.createDataFrame([("a", c, t, x) for c in (0, 1) for t, x in ((0.0, 1.0), (0.25, 3.0), (0.5, -2.0))], "track_id string, channel int, t double, x double")
    mono = audio.mono_resampled(df, 2).orderBy("n").collect()
    assert [(r.n, r.x) for r in mono] == [(0, 2.0), (1, -2.0)]
    scaled = audio.normalized(df, 1.0, gain_db=0.0)
    assert scaled.agg(F.sqrt(F.avg(F.col("x") * F.col("x")))).first()[0] == pytest.approx(1.0, abs=1e-5)
    silent = spark.createDataFrame([("s", 0, 0.0, 0.0)], df.schema)
    assert audio.normalized(silent, 1.0).first().x == 0.0


def test_a_change_of_size_is_a_scene_change(spark):
    rows = [("v", 0, 0.0, [[1.0, 2.0]]), ("v", 1, 1.0, [[1.0, 2.0], [1.0, 2.0]]), ("v", 2, 2.0, [[1.0, 2.0], [1.0, 2.0]])]
    df = spark.createDataFrame(rows, "video_id string, frame_no long, ts double, pixels array<array<double>>")
    got = frames.scene_changes(df, 0.5).collect()
    assert [(r.frame_no, r.difference) for r in got] == [(1, None)]
