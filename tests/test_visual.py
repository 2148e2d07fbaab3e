from pyspark.sql import functions as F

from seamline.operators import segmenting
from seamline.plans import visual

IMAGE = [[0.0, 0.0, 0.0, 0.0], [0.0, 10.0, 20.0, 0.0], [0.0, 30.0, 40.0, 0.0]]
BLANK = [[0.0] * 4] * 3


def test_segments_with_their_frames_texts_and_logos(spark):
    segments = spark.createDataFrame(
        [("v", 1, 0.0, 8.0, "said one", "topic", ["k"]), ("v", 2, 8.0, 9.0, "said two", "other", ["l"])],
        "video_id string, segment_id int, start_time double, end_time double, transcript string, dominant_topic string, top_keywords array<string>",
    )
    frames = spark.createDataFrame([("v", 0, 0.0, BLANK), ("v", 1, 3.0, IMAGE), ("v", 2, 8.5, BLANK)], "video_id string, frame_no long, ts double, pixels array<array<double>>")
    texts = spark.createDataFrame([("v#1", 0, "In VS CODE now", None, 90.0), ("v#9", 1, "vs code", None, 90.0)], "frame_id string, text_no long, text string, bbox struct<x:int,y:int,w:int,h:int>, confidence double")
    catalog = spark.createDataFrame([("VS Code",), ("Slack",)], "software string")
    logos = spark.createDataFrame([("slack", [[10.0, 20.0], [30.0, 40.0]]), ("zoom", [[1.0, 2.0]])], "software string, pixels array<array<double>>")

    sampled = visual.sampled_frames(segments, frames, min_rows=2)
    seen = {(r.segment_id, r.ordinal): r.frame_no for r in sampled.collect()}
    assert seen == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (1, 3): 1, (1, 4): 1, (2, 0): 1, (2, 1): 2}

    matched = visual.matched_frames(sampled, frames, texts, catalog, logos, 0.95, min_rows=2)
    descriptions = matched.select("video_id", "segment_id", "ordinal", F.concat(F.lit("saw "), "frame_id").alias("analysis"))
    done = visual.analyze_segments(segments, matched, descriptions).orderBy("segment_id").collect()
    first = done[0].frame_analyses
    assert [a.ordinal for a in first] == [0, 1, 2, 3, 4]
    assert [len(a.software_analysis.ocr_matches) for a in first] == [0, 1, 0, 1, 1]
    hit = first[1].software_analysis.logo_matches
    assert [(h.software, h.confidence, h.location.x, h.location.y) for h in hit] == [("Slack", 1.0, 1, 1)]
    assert done[1].frame_analyses[0].analysis == "saw v#1" and done[1].topic == "other"

    made = descriptions.filter("ordinal = 0")
    told = {(r.segment_id, r.ordinal): r.context for r in visual.frame_contexts(segments, matched, made, F.lit(True)).collect()}
    assert told[(1, 1)] == (
        "Analyzing frame at 8.00s\nFrame type: segment_end\n\nTranscript context: said one\nTopic: topic\nKeywords: k\n"
        "\nSoftware Detection Results:\nText detected: VS Code (In VS CODE now)\nLogos detected: Slack (confidence: 1.00)\n"
        "\nPrevious frame analysis (0.00s):\nsaw v#0"
    )
    assert "Previous" not in told[(1, 2)]


def test_analyzed_segments_are_part_of_the_results_document(spark):
    metadata = spark.createDataFrame(
        [(v, i, i * 8.0, i * 8.0 + 8, 8.0, "topic", ["k"], "said") for v, n in (("v", 2), ("w", 1), (None, 1)) for i in range(1, n + 1)],
        "transcript_id string, segment_id int, start_time double, end_time double, duration double, dominant_topic string, top_keywords array<string>, transcript string",
    )
    segments = metadata.withColumnRenamed("transcript_id", "video_id").filter("video_id = 'v' OR video_id IS NULL")
    frames = spark.createDataFrame([("v", 1, 15.0, IMAGE)], "video_id string, frame_no long, ts double, pixels array<array<double>>")
    texts = spark.createDataFrame([("v#1", 0, "In VS CODE now", None, 90.0)], "frame_id string, text_no long, text string, bbox struct<x:int,y:int,w:int,h:int>, confidence double")
    catalog = spark.createDataFrame([("VS Code",), ("Slack",)], "software string")
    logos = spark.createDataFrame([("slack", [[10.0, 20.0], [30.0, 40.0]])], "software string, pixels array<array<double>>")
    matched = visual.matched_frames(visual.sampled_frames(segments, frames), frames, texts, catalog, logos, 0.95)
    analyzed = visual.analyze_segments(segments, matched, matched.withColumn("analysis", F.lit("seen")))
    documents = segmenting.results_documents(metadata, analyzed=analyzed)
    bare = segmenting.results_documents(metadata)
    assert documents.schema["analyzed_segments"].dataType == bare.schema["analyzed_segments"].dataType
    assert {r.transcript_id: r.analyzed_segments for r in bare.collect()} == {"v": [], "w": [], None: []}
    found = {r.transcript_id: r.analyzed_segments for r in documents.collect()}
    assert [s.segment_id for s in found["v"]] == [1, 2] and found["w"] == [] and [s.frame_analyses for s in found[None]] == [[]]
    seen = found["v"][1].frame_analyses[0]
    assert (seen.frame_type, seen.analysis, seen.software_analysis.ocr_matches[0].software, seen.software_analysis.logo_matches[0].software) == ("segment_end", "seen", "VS Code", "Slack")


def test_what_frames_show_is_moved_once_to_segments_and_once_to_documents(spark):
    """Frames hold whole texts; neither their descriptions nor the transcript's metadata may send them through a join of their own."""
    matched = spark.createDataFrame(
        [("v", 1, o, float(o), "internal", [], []) for o in range(3)] + [("v", 2, 0, 8.0, "segment_start", [], []), ("w", 1, 0, 8.0, "segment_start", [], [])],
        "video_id string, segment_id int, ordinal int, timestamp double, frame_type string, "
        "ocr_matches array<struct<software:string,detected_text:string,confidence:double,location:struct<x:int,y:int,w:int,h:int>>>, "
        "logo_matches array<struct<software:string,confidence:double,location:struct<x:int,y:int>>>",
    )
    said = spark.createDataFrame([("v", 1, 0, "a"), ("v", 1, 2, "b"), ("v", 1, 2, "c"), ("v", 2, None, "d"), (None, 1, 0, "e")], "video_id string, segment_id int, ordinal int, analysis string")
    segments = spark.createDataFrame(
        [(v, i, i * 8.0, i * 8.0 + 8, 8.0, "topic", ["k"], "said") for v, i in (("v", 1), ("v", 2), ("v", 3), ("w", 1), (None, 1))],
        "video_id string, segment_id int, start_time double, end_time double, duration double, dominant_topic string, top_keywords array<string>, transcript string",
    )
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for c in before:
            spark.conf.set(c, "-1")
        analyzed = visual.analyze_segments(segments, matched, said)
        documents = segmenting.results_documents(segments.withColumnRenamed("video_id", "transcript_id"), analyzed=analyzed)
        plan = documents._jdf.queryExecution().executedPlan().toString()
        moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(moves) == 4 and not any("ordinal" in m.split("ENSURE")[0] for m in moves)  # frames, descriptions, segments; documents
        got = {(r.transcript_id, s.segment_id): [(a.ordinal, a.analysis) for a in s.frame_analyses] for r in documents.collect() for s in r.analyzed_segments}
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    assert got == {("v", 1): [(0, "a"), (1, None), (2, "b"), (2, "c")], ("v", 2): [(0, None)], ("v", 3): [], ("w", 1): [(0, None)], (None, 1): []}


def test_texts_travel_to_their_document_alone(spark):
    """With `places`, matches carry ids, and documents are what they are with whole texts in every match; rows that come twice still count twice."""
    segments = spark.createDataFrame(
        [(v, i, i * 8.0, i * 8.0 + 8, 8.0, "topic", ["k"], "said") for v in ("v", "w") for i in (0, 1)],
        "video_id string, segment_id int, start_time double, end_time double, duration double, dominant_topic string, top_keywords array<string>, transcript string",
    )
    frames = spark.createDataFrame([(v, n, n * 4.0, IMAGE) for v, first in (("v", 0), ("w", 10)) for n in range(first, first + 4)], "video_id string, frame_no long, ts double, pixels array<array<double>>")
    frames = frames.withColumn("ts", F.col("ts") - F.when(F.col("video_id") == "w", 40.0).otherwise(0.0))
    shown = frames.select(F.col("frame_no").alias("text_no"), "video_id").withColumn("frame_id", visual.frame_id(frame_no="text_no"))
    shown = shown.unionByName(shown.filter("text_no = 2"))
    rows = [(0, "slack and VS Code", None, 1.0), (0, "another SLACK", (1, 2, 3, 4), 2.0), (2, "vs code", None, 3.0), (11, "slack", None, 4.0), (11, "slack", None, 4.0), (13, "nothing", None, 5.0), (99, "slack", None, 6.0), (None, "slack", None, 7.0), (1, None, None, 8.0)]
    texts = spark.createDataFrame(rows, "text_no long, text string, bbox struct<x:int,y:int,w:int,h:int>, confidence double")
    catalog = spark.createDataFrame([("VS Code",), ("Slack",)], "software string")
    logos = spark.createDataFrame([("slack", [[10.0, 20.0], [30.0, 40.0]])], "software string, pixels array<array<double>>")
    metadata, sampled = segments.withColumnRenamed("video_id", "transcript_id"), visual.sampled_frames(segments, frames)
    said = sampled.withColumn("analysis", F.lit("seen"))
    whole = visual.matched_frames(sampled, frames, texts.join(shown.drop("video_id"), "text_no"), catalog, logos, 0.95)
    matched, apart = visual.matched_frames(sampled, frames, texts, catalog, logos, 0.95, places=shown)
    ids = {m.detected_text for r in matched.collect() for m in r.ocr_matches}
    assert ids == {r.text_id for r in apart.collect()} and all(i.isdigit() for i in ids) and apart.filter("text = 'nothing'").count() == 0
    want = segmenting.results_documents(metadata, analyzed=visual.analyze_segments(segments, whole, said))
    got = segmenting.results_documents(metadata, analyzed=visual.analyze_segments(segments, matched, said), texts=apart)
    assert got.schema["analyzed_segments"].dataType == want.schema["analyzed_segments"].dataType
    listed = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert listed(got) == listed(want)
    sizes = {f.analysis + str(len(f.software_analysis.ocr_matches)) for r in got.collect() for s in r.analyzed_segments for f in s.frame_analyses}
    assert {"seen0", "seen2", "seen3"} <= sizes
