import datetime as dt
import json

from pyspark.sql import functions as F

from __spark_entry__ import queries
from seamline.operators import intake
from seamline.sources import catalogs, transcripts
from seamline.plans.stages import run_stages
from seamline.sources.stores import AnswerStore, SegmentStore, StageStates, ThumbnailStore
from seamline.streaming.ingest import TranscriptIngest, stream_transcript_lines


def test_routes(spark):
    inputs = [
        ("https://youtu.be/dQw4w9WgXcQ", False), ("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=5", False), ("/a/b/talk.MP4", False),
        ("/a/t.JSON", False), ("/a/x.webm", False), ("/a/p.PNG", True), ("/a/b/talk.MP4", True), ("/a/none.mkv", False),
    ]
    df = spark.createDataFrame(inputs, "path string, analyze_screenshot boolean")
    listing = spark.createDataFrame([("/a/b/talk.MP4",), ("/a/t.JSON",), ("/a/x.webm",), ("/a/p.PNG",)], "path string")
    got = {(r.path, r.analyze_screenshot): (r.kind, r.error) for r in intake.route_inputs(df, listing, min_rows=1).collect()}
    assert [got[i][0] for i in inputs] == ["url", None, "video", "transcript", None, "image", None, None]
    assert got[inputs[1]][1].startswith("Input file not found: https://www")
    assert got[inputs[4]][1] == "Unsupported file format. Supported formats: .mp4, .mkv, .json"
    assert got[inputs[6]][1] == "Unsupported image format. Supported formats: .png, .jpg, .jpeg"


def test_base_names(spark):
    want = {
        "https://youtu.be/dQw4w9WgXcQ": "yt_dQw4w9WgXcQ", "youtube.com/watch?v=dQw4w9WgXcQ": "yt_dQw4w9WgXcQ", "/a/b/talk.mp4": "talk",
        "talk.tar.gz": "talk.tar", "/x/.bashrc": ".bashrc", "plain": "plain",
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.b for r in df.select("path", intake.base_name(F.col("path")).alias("b")).collect()} == want


def test_stages_projects_and_thumbnails(spark):
    day = lambda d: dt.datetime(2025, 1, d)
    projects = spark.createDataFrame([("new",), ("mid",), ("done",)], "project string")
    states = spark.createDataFrame([("mid", 5, day(1)), ("mid", 3, day(2)), ("done", 9, day(1))], "project string, stage int, saved_at timestamp")
    assert {(r.project, r.stage) for r in intake.projects_before_stage(projects, states, 4).collect()} == {("new", -1), ("mid", 3)}

    kept = spark.createDataFrame([("talk_2024", day(1)), ("talk_intro_2025", day(3)), ("talkative_1", day(9))], "project string, created timestamp")
    bases = spark.createDataFrame([("talk",), ("talk_intro",), ("none",)], "base_name string")
    found = {r.base_name: r.project for r in intake.latest_projects(bases, kept).collect()}
    assert found == {"talk": "talk_intro_2025", "talk_intro": "talk_intro_2025", "none": None}

    available = spark.createDataFrame([("v", "hqdefault", True), ("v", "default", True), ("v", "sddefault", False)], "video_key string, quality string, available boolean")
    videos = spark.createDataFrame([("v",), ("w",)], "video_key string")
    assert {r.video_key: r.url for r in intake.best_thumbnails(videos, available).collect()} == {"v": "https://img.youtube.com/vi/v/hqdefault.jpg", "w": None}


def test_defects(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), (None, 0.0, 1.0), ("b", 2.0, 2.0), ("c", None, 1.0)], "video_id string, start_time double, end_time double")
    good, bad = intake.split_by_defect(df, ["video_id"])
    assert [r.video_id for r in good.collect()] == ["a"]
    assert sorted(r.defect for r in bad.collect()) == ["does not end after its start", "missing key", "missing time"]


def test_transcript_files_and_catalog(spark, tmp_path):
    said = [{"content": f"c{i}", "start": float(i), "end": i + 1.0} for i in range(12)]
    values = {"one": json.dumps(said, indent=2), "two": json.dumps(said[:3]), "broken": '{"content": ', "none": "[]", "other": '{"a": 1}'}
    for project, value in values.items():
        (tmp_path / project).mkdir()
        (tmp_path / project / "transcript.json").write_text(value)
    got = transcripts.read_transcript_files(spark, str(tmp_path)).select(transcripts.project_of(F.col("transcript_id")).alias("p"), "seq", "content")
    assert sorted(map(tuple, got.collect())) == sorted([("one", i, f"c{i}") for i in range(12)] + [("two", i, f"c{i}") for i in range(3)])
    bad = transcripts.transcript_defects(transcripts.transcript_texts(spark, str(tmp_path)))
    assert {r.transcript_id.split("/")[-2]: r.problem for r in bad.collect()} == {
        "broken": "not an array of utterances", "none": "no utterances", "other": "not an array of utterances",
    }

    utterances = spark.createDataFrame([("t", i * 2, f"c{i}", float(i), i + 1.0) for i in range(25)], transcripts.TRANSCRIPTS)
    transcripts.write_transcript_lines(utterances, str(tmp_path / "lines"), part=10)
    back = transcripts.read_transcript_lines(spark, str(tmp_path / "lines")).orderBy("seq").collect()
    assert [(r.seq, r.content) for r in back] == [(i, f"c{i}") for i in range(25)]

    answers = tmp_path / "asr"
    answers.mkdir()
    one = {"transcript_id": "a", "metadata": {"x": 1}, "results": {"utterances": [{"transcript": "hi", "start": 0.5, "end": 1.0, "speaker": 2}]}}
    (answers / "a.json").write_text(json.dumps(one) + "\n")
    flat = transcripts.flatten_asr(transcripts.read_asr(spark, str(answers))).collect()
    assert [tuple(r) for r in flat] == [("a", 0, "hi", 0.5, 1.0)]

    (tmp_path / "names.txt").write_text("  Firefox \n\n \t\nVS Code\n")
    names = catalogs.read_catalog(spark, str(tmp_path / "names.txt"))
    assert sorted(r.software for r in names.collect()) == ["Firefox", "VS Code"]
    templates = spark.createDataFrame([("firefox", [[1.0]]), ("Other", [[2.0]])], "software string, pixels array<array<double>>")
    assert [r.software for r in catalogs.available_logos(names, templates).collect()] == ["Firefox"]


def test_segment_store_adds_nothing_twice(spark, tmp_path):
    work = spark.createDataFrame([("v", i, float(i)) for i in range(6)], "video_id string, segment_id int, x double")
    store = SegmentStore(spark, str(tmp_path / "s"), work.schema, buckets=4)
    assert store.load().count() == 0
    store.append_new(work.filter("segment_id < 3"), "1")
    store.append_new(work, "2")
    store.append_new(work, "2")
    store.append_new(work, "3")
    assert sorted(r.segment_id for r in store.load().collect()) == list(range(6))


def test_thumbnail_store(spark, tmp_path):
    entry = lambda *ids, video="v": spark.createDataFrame([(video, f"/t{i}", i) for i in ids], "video_id string, path string, index int")
    store = ThumbnailStore(spark, str(tmp_path / "t"), buckets=2)
    listed = lambda video="v": sorted(r["index"] for r in store.thumbnails().filter(F.col("video_id") == video).collect())
    assert listed() == []
    store.append(entry(1), 1)
    store.append(entry(2), 2)
    store.append(entry(2), 2)
    store.append(entry(7, 8, video="w"), 3)
    assert listed() == [1, 2]
    store.replace(entry(3, 4), 4)
    store.append(entry(5), 5)
    assert listed() == [3, 4, 5]
    store.clear(entry(0), 6)
    assert listed() == [] and listed("w") == [7, 8] and store.last_updated().count() == 2


def test_a_change_leaves_other_buckets_alone(spark, tmp_path):
    store = ThumbnailStore(spark, str(tmp_path / "t"), buckets=8)
    store.append(spark.range(40).selectExpr("CAST(id AS STRING) AS video_id", "concat('/t', id) AS path"), 1)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    store.replace(spark.createDataFrame([("3", "/new")], "video_id string, path string"), 2)
    changed = {p.parent.name for p, _ in set(before.items()) ^ set(files().items())}
    assert len(changed) == 1 and store.thumbnails().count() == 40 and store.thumbnails().filter("path = '/new'").count() == 1


def test_requests_are_asked_once(spark, tmp_path):
    store, asked = AnswerStore(spark, str(tmp_path / "a")), []

    def ask(requests):
        asked.append(requests.count())
        return requests.selectExpr("request_id", "IF(request_id = 'c', NULL, concat('to ', request_id)) AS response")

    requests = lambda *ids: spark.createDataFrame([(i,) for i in ids], "request_id string")
    store.answer(requests("a", "b"), ask, "1")
    store.answer(requests("a", "b", "c"), ask, "2")
    store.answer(requests("a", "b", "c", "d"), ask, "3")
    store.answer(requests("a", "b", "c", "d"), ask, "3")
    assert asked == [2, 1, 2, 2]
    assert sorted(tuple(r) for r in store.load().collect()) == [("a", "to a"), ("b", "to b"), ("d", "to d")]


def test_stages_go_on_where_they_stopped(spark, tmp_path):
    states, done = StageStates(spark, str(tmp_path / "s")), []
    projects = lambda *names: spark.createDataFrame([(n,) for n in names], "project string")

    def stage(name, fails=()):
        def work(pending):
            here = sorted(r.project for r in pending.collect())
            done.append((name, here))
            if name in fails:
                raise ValueError("no")

        return name, work

    first = [stage("AUDIO_PROCESSED"), stage("VIDEO_ANALYZED", ["VIDEO_ANALYZED"]), stage("PROCESS_COMPLETE")]
    assert run_stages(projects("a", "b"), states, first, "1") == "VIDEO_ANALYZED: no"
    second = [stage("AUDIO_PROCESSED"), stage("VIDEO_ANALYZED"), stage("PROCESS_COMPLETE")]
    assert run_stages(projects("a", "b", "c"), states, second, "2") is None
    assert done == [
        ("AUDIO_PROCESSED", ["a", "b"]), ("VIDEO_ANALYZED", ["a", "b"]),
        ("AUDIO_PROCESSED", ["c"]), ("VIDEO_ANALYZED", ["a", "b", "c"]), ("PROCESS_COMPLETE", ["a", "b", "c"]),
    ]
    assert run_stages(projects("a", "b", "c"), states, second, "3") is None and done[-1] == ("PROCESS_COMPLETE", [])


def test_micro_batches_are_merged(spark, tmp_path):
    ingest = TranscriptIngest(spark, str(tmp_path / "out"), size=2, buckets=2, most=2)
    batch = lambda tid, first, *words: spark.createDataFrame([(tid, first + i, w, float(first + i), first + i + 0.5) for i, w in enumerate(words)], "transcript_id string, seq long, content string, start double, end double")
    arrivals = [batch("a", 0, "one two", "one two"), batch("b", 0, "red"), batch("a", 2, "one two"), batch("c", 0, "blue"), batch("b", 0, "green")]
    for number, rows in enumerate(arrivals):
        ingest.on_batch(rows, number)
        if number == 2:
            ingest.on_batch(rows, number)
        assert len(ingest.live_folders("utterances")) <= 3 and len(ingest.live_folders("segments")) <= 3
    text = {r.transcript_id: r.transcript for r in ingest.segments().collect()}
    assert text == {"a": "one two one two one two", "b": "green", "c": "blue"}


def test_streaming_picks_up_files_once_and_extends_transcripts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def arrive(name, tid, words, first=0):
        said = [{"content": w, "start": float(first + i), "end": first + i + 0.5} for i, w in enumerate(words)]
        (inbox / name).write_text(json.dumps({"transcript_id": tid, "utterances": said}) + "\n")

    ingest = TranscriptIngest(spark, str(tmp_path / "out"), size=2, buckets=2)
    run = lambda: ingest.run(stream_transcript_lines(spark, str(inbox)))
    text = lambda: {k: " ".join(r.transcript for r in rows) for k, rows in grouped().items()}

    def grouped():
        out = {}
        for r in ingest.segments().orderBy("transcript_id", "segment_id").collect():
            out.setdefault(r.transcript_id, []).append(r)
        return out

    arrive("1.json", "a", ["one two", "one two", "one two"])
    run()
    assert text() == {"a": "one two one two one two"}
    before = grouped()
    run()
    assert grouped() == before
    arrive("2.json", "b", ["red", "blue"])
    arrive("3.json", "a", ["one two", "one two", "one two", "three"])
    run()
    assert text() == {"a": "one two one two one two three", "b": "red blue"}
    assert grouped()["a"][-1].end_time == 3.5


def test_a_streamed_table_may_be_a_folder_of_files(spark, tmp_path):
    turns = [(c, t, "user", f"about {'sails harbours anchors' if t < 4 else 'engines wings fuel'} {c}") for c in range(3) for t in range(8)]
    said = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    said.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {tuple(r) for r in queries()["x1_streamed_segments"](spark, str(tmp_path)).collect()}
    assert found and found == {tuple(r) for r in queries()["segments_of_conversations"](spark, str(tmp_path)).collect()}
