"""Registered queries: input routing, incremental work, stores, streaming."""

from pyspark.sql import functions as F, types as T

from seamline.operators import intake
from seamline.plans.adapters import TURN_SPAN, days, given, listing, table, talk, timed, with_ctes
from seamline.plans.registry import query
from seamline.plans.stages import run_stages
from seamline.plans.transcript_queries import FLAT_SEGMENTS, flat
from seamline.session import scratch_folder, written
from seamline.sources.stores import SegmentStore, StageStates, ThumbnailStore
from seamline.sources.transcripts import exploded
from seamline.streaming.ingest import TranscriptIngest, stream_transcript_lines

URL = r"^(https?://)?(www\.)?(youtube\.com/watch\?v=|youtu\.be/)[a-zA-Z0-9_-]{11}$"


@query(
    "i1_routes",
    with_ctes(
        ["given", "listing"],
        f"""SELECT page_id, path, analyze_screenshot, is_url, error, CASE WHEN is_url THEN 'url' WHEN error IS NOT NULL THEN NULL
            WHEN analyze_screenshot THEN 'image' WHEN lower(path) LIKE '%.json' THEN 'transcript' ELSE 'video' END AS kind FROM (
          SELECT *, CASE WHEN is_url THEN NULL WHEN path NOT IN (SELECT path FROM listing) THEN concat('Input file not found: ', path)
            WHEN analyze_screenshot AND NOT regexp_matches(lower(path), '[.](png|jpg|jpeg)$') THEN 'Unsupported image format. Supported formats: .png, .jpg, .jpeg'
            WHEN NOT analyze_screenshot AND NOT regexp_matches(lower(path), '[.](mp4|mkv|json)$') THEN 'Unsupported file format. Supported formats: .mp4, .mkv, .json'
            END AS error FROM (SELECT *, regexp_matches(path, '{URL}') AS is_url FROM given))""",
    ),
)
def i1(spark, folder):
    return intake.route_inputs(given(spark, folder), listing(spark, folder))


@query(
    "i2_base_names",
    with_ctes(
        ["given"],
        f"""SELECT page_id, is_url, CASE WHEN is_url THEN concat('yt_', right(path, 11))
          ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '^([.]*[^.].*)[.][^.]*$', '\\1') END AS base_name
        FROM (SELECT *, regexp_matches(path, '{URL}') AS is_url FROM given)""",
    ),
)
def i2(spark, folder):
    path = F.col("path")
    return given(spark, folder).select("page_id", intake.is_video_url(path).alias("is_url"), intake.base_name(path).alias("base_name"))


DONE = "(CAST(video_id AS BIGINT) + segment_id) % 3 = 0"


@query("i3_pending_segments", with_ctes(["days"], f"SELECT video_id, segment_id, start_time, end_time FROM days WHERE NOT ({DONE})"))
def i3(spark, folder):
    work = days(spark, folder).select("video_id", "segment_id", "start_time", "end_time")
    return intake.not_yet_done(work, work.filter(DONE), ["video_id", "segment_id"])


@query(
    "i4_projects_before_stage",
    """SELECT CAST(c_custkey AS VARCHAR) AS project, CAST(coalesce(stage, -1) AS INT) AS stage FROM customer LEFT JOIN (
      SELECT user_id, arg_max(event_id % 10, ts) AS stage FROM events GROUP BY user_id) ON user_id = c_custkey WHERE coalesce(stage, -1) < 5""",
)
def i4(spark, folder):
    projects = table(spark, folder, "customer").selectExpr("CAST(c_custkey AS STRING) AS project")
    states = table(spark, folder, "events").selectExpr(
        "CAST(user_id AS STRING) AS project", "CAST(event_id % 10 AS INT) AS stage", "ts AS saved_at"
    )
    return intake.projects_before_stage(projects, states, 5)


PROJECT = "concat(event_type, '_', props, '_', event_id)"


@query(
    "i5_latest_projects",
    f"""SELECT base_name, arg_max(project, {{'c': created, 'p': project}}) AS project FROM (
      SELECT DISTINCT event_type AS base_name FROM events UNION SELECT DISTINCT concat(event_type, '_', props) FROM events UNION SELECT 'none')
    LEFT JOIN (SELECT {PROJECT} AS project, ts AS created FROM events) ON starts_with(project, concat(base_name, '_')) GROUP BY base_name""",
)
def i5(spark, folder):
    events = table(spark, folder, "events")
    both = F.array(F.col("event_type"), F.concat("event_type", F.lit("_"), "props"), F.lit("none"))
    bases = events.select(F.explode(both).alias("base_name")).distinct()
    return intake.latest_projects(bases, events.select(F.expr(PROJECT).alias("project"), F.col("ts").alias("created")))


QUALITY = "CASE event_type WHEN 'error' THEN 'maxresdefault' WHEN 'click' THEN 'sddefault' WHEN 'view' THEN 'hqdefault' WHEN 'purchase' THEN 'mqdefault' ELSE 'default' END"


@query(
    "i6_best_thumbnails",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS video_key, 'https://img.youtube.com/vi/' || c_custkey || '/' || q || '.jpg' AS url FROM customer LEFT JOIN (
      SELECT user_id, arg_min(q, list_position(['maxresdefault', 'sddefault', 'hqdefault', 'mqdefault', 'default'], q)) AS q
      FROM (SELECT user_id, {QUALITY} AS q FROM events WHERE value > 60 AND event_id % 4 = 0) GROUP BY user_id) ON user_id = c_custkey""",
)
def i6(spark, folder):
    videos = table(spark, folder, "customer").selectExpr("CAST(c_custkey AS STRING) AS video_key")
    availability = table(spark, folder, "events").selectExpr(
        "CAST(user_id AS STRING) AS video_key", f"{QUALITY} AS quality", "value > 60 AND event_id % 4 = 0 AS available"
    )
    return intake.best_thumbnails(videos, availability)


WITH_FAULTS = [
    "event_id", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE video_id END AS video_id", "t AS start_time",
    "CASE WHEN event_id % 7 = 0 THEN t - value WHEN event_id % 13 = 0 THEN NULL ELSE t + value END AS end_time",
]


@query(
    "i7_defects",
    with_ctes(
        ["timed"],
        f"""SELECT *, CASE WHEN video_id IS NULL THEN 'missing key' WHEN end_time IS NULL THEN 'missing time'
          WHEN end_time <= start_time THEN 'does not end after its start' END AS defect FROM (SELECT {', '.join(WITH_FAULTS)} FROM timed)""",
    ),
)
def i7(spark, folder):
    good, bad = intake.split_by_defect(timed(spark, folder).selectExpr(*WITH_FAULTS), ["video_id", "event_id"])
    return good.withColumn("defect", F.lit(None).cast("string")).unionByName(bad)


@query("s7_segment_store", with_ctes(["days"], "SELECT video_id, segment_id, start_time, end_time FROM days"))
def s7(spark, folder):
    work = days(spark, folder).select("video_id", "segment_id", "start_time", "end_time")
    store = SegmentStore(spark, scratch_folder(spark, "analyzed"), work.schema, buckets=8)
    store.append_new(work.filter(DONE), "1")
    store.append_new(work, "2")
    store.append_new(work, "2")
    return store.load()


@query(
    "s8_thumbnail_store",
    """SELECT CAST(user_id AS VARCHAR) AS video_id, concat('/thumbs/', event_id, '.jpg') AS path, CAST(event_id % 50 AS INT) AS index FROM (
      SELECT *, bool_or(event_type = 'signup') OVER w AS signed, bool_or(event_type = 'purchase') OVER w AS bought
      FROM events WINDOW w AS (PARTITION BY user_id))
    WHERE CASE user_id % 3
      WHEN 0 THEN event_type IN ('error', 'purchase') OR (event_type IN ('click', 'view') AND NOT signed)
      WHEN 1 THEN event_type IN ('purchase', 'signup') OR NOT bought ELSE true END""",
)
def s8(spark, folder):
    """Every event changes a list: clicks, views and errors are entries; a third of the videos is cleared at its signups, before the errors; another third
    has its list replaced by its purchases; the other signups and purchases are entries too."""
    entries = table(spark, folder, "events").selectExpr(
        "CAST(user_id AS STRING) AS video_id", "user_id % 3 AS part", "event_type", "concat('/thumbs/', event_id, '.jpg') AS path",
        "CAST(event_id % 50 AS INT) AS index",
    )
    store = ThumbnailStore(spark, scratch_folder(spark, "thumbnails"), buckets=8)
    store.append(entries.filter("event_type IN ('click', 'view')"), 1)
    store.clear(entries.filter("event_type = 'signup' AND part = 0"), 2)
    store.append(entries.filter("event_type = 'error'"), 3)
    store.replace(entries.filter("event_type = 'purchase' AND part = 1"), 4)
    store.append(entries.filter("event_type IN ('signup', 'purchase') AND NOT (event_type = 'signup' AND part = 0) AND NOT (event_type = 'purchase' AND part = 1)"), 5)
    return store.thumbnails().select("video_id", "path", "index")


@query(
    "i4_resumed_stages",
    with_ctes(
        ["days"],
        f"""SELECT video_id, segment_id, start_time, end_time, CASE WHEN {DONE} THEN 'first' ELSE 'second' END AS analyzed_in, 9 AS stage FROM days""",
    ),
)
def i4_resumed(spark, folder):
    """Videos go through their stages; the analysis fails in the first run when part of it is stored, and the second run goes on from there."""
    work = written(days(spark, folder).select("video_id", "segment_id", "start_time", "end_time"), "segments")
    place = scratch_folder(spark, "project")
    states, store = StageStates(spark, f"{place}/states"), SegmentStore(spark, f"{place}/analyzed", T.StructType([*work.schema.fields, T.StructField("analyzed_in", T.StringType())]), buckets=8)
    projects = work.select(F.col("video_id").alias("project")).distinct()

    def analysis(run):
        def analyze(pending):
            own = work.join(pending.withColumnRenamed("project", "video_id"), "video_id", "left_semi").withColumn("analyzed_in", F.lit(run))
            if run == "first":
                store.append_new(own.filter(DONE), run)
                raise RuntimeError("stopped halfway")
            store.append_new(own, run)

        return analyze

    def stages(run):
        return [("SEGMENTS_IDENTIFIED", lambda pending: None), ("VIDEO_ANALYZED", analysis(run)), ("PROCESS_COMPLETE", lambda pending: None)]

    if run_stages(projects, states, stages("first"), "first") != "VIDEO_ANALYZED: stopped halfway":
        raise RuntimeError("the first run should have stopped")
    failed = run_stages(projects, states, stages("second"), "second")
    if failed:
        raise RuntimeError(failed)
    latest = states.load().groupBy(F.col("project").alias("video_id")).agg(F.max("stage").alias("stage"))
    return store.load().join(latest, "video_id")


@query("x1_streamed_segments", with_ctes(["talk_segments"], f"SELECT {FLAT_SEGMENTS} FROM talk_segments"))
def x1(spark, folder):
    arriving = (
        spark.readStream.schema("conv_id bigint, turn bigint, role string, text string")
        .parquet(f"{folder}/conversations.parque[t]")  # a glob, which a stream takes for one file as well as for a folder of them
        .selectExpr(
            "CAST(conv_id AS STRING) AS transcript_id", "turn AS seq", "text AS content", f"{TURN_SPAN} AS start",
            f"{TURN_SPAN} + length(text) / CAST(16 AS DOUBLE) AS end",
        )
    )
    ingest = TranscriptIngest(spark, scratch_folder(spark, "ingest"), size=2, buckets=8)
    ingest.run(arriving)
    return flat(ingest.segments())


@query("x1_streamed_json_files", with_ctes(["talk_segments"], f"SELECT {FLAT_SEGMENTS} FROM talk_segments"))
def x1_json(spark, folder):
    """Conversations as JSON files in four micro-batches; long ones come in two pieces; the last micro-batch comes twice; folders are merged on the way."""
    files, out = scratch_folder(spark, "inbox"), scratch_folder(spark, "ingest")
    said = talk(spark, folder).withColumn("_file", F.expr("CAST(transcript_id AS BIGINT) % 3 + IF(seq >= 4, 1, 0)"))
    whole = talk(spark, folder).groupBy("transcript_id").agg(F.min("seq").alias("_first"))
    lines = said.join(whole, "transcript_id").groupBy("transcript_id", "_file").agg(
        (F.min("seq") - F.first("_first")).alias("first"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "content", "start", "end"))), lambda u: F.struct(u["content"].alias("content"), u["start"].alias("start"), u["end"].alias("end"))).alias("utterances"),
    )
    stored = written(lines, "lines")
    ingest = TranscriptIngest(spark, out, size=2, buckets=8, most=2)
    for number in range(4):
        stored.filter(F.col("_file") == number).drop("_file").write.mode("append").json(files)
        ingest.run(stream_transcript_lines(spark, files))
    ingest.on_batch(exploded(stored.filter("_file = 3")), 3)
    return flat(ingest.segments())
