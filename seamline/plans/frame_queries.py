"""Registered queries: frame sampling, timelines, audio levels."""

from pyspark.sql import functions as F

from seamline.operators import audio, frames, segmenting
from seamline.plans import visual
from seamline.operators.batching import assign_batches, combine_batches
from seamline.plans.adapters import (
    ANALYSIS, DAY, days, event_frames, images, levels, logo_templates, names, ocr_texts, samples, table, talk, timed, with_ctes,
)
from seamline.plans.registry import query
from seamline.session import written

VID = "video_id"
SAMPLE = [VID, "segment_id", "ordinal"]


@query("v1_sampling_plan", with_ctes(["plan"], "SELECT * FROM plan"))
def v1(spark, folder):
    return frames.sampling_plan(days(spark, folder))


@query("v2_first_extractions", with_ctes(["extracted"], "SELECT * FROM extracted"))
def v2(spark, folder):
    return frames.first_extractions(frames.sampling_plan(days(spark, folder)))


def _fetched(spark, folder):
    taken = written(frames.first_extractions(frames.sampling_plan(days(spark, folder))), "samples")
    return frames.fetch_frames(taken, event_frames(spark, folder))


@query("v3_fetched_frames", with_ctes(["fetched"], "SELECT * FROM fetched"))
def v3(spark, folder):
    return _fetched(spark, folder)


@query(
    "v4_thumbnail_plan",
    with_ctes(
        ["timed"],
        """SELECT video_id, CAST(i AS INTEGER) AS index, i * (duration / n) AS timestamp FROM (
          SELECT *, unnest(range(n)) AS i FROM (
            SELECT video_id, max(t) AS duration, greatest(1, least(CAST(floor(max(t) / 100000) AS BIGINT), 10)) AS n FROM timed GROUP BY video_id))""",
    ),
)
def v4(spark, folder):
    videos = timed(spark, folder).groupBy(VID).agg(F.max("t").alias("duration"))
    return frames.thumbnail_plan(videos, interval=100_000)


@query(
    "v5_sliced_rows",
    with_ctes(["timed", "days"], "SELECT t.event_id, video_id, segment_id, t.t FROM timed t JOIN days d USING (video_id) WHERE t.t >= start_time AND t.t < start_time + 100000"),
)
def v5(spark, folder):
    # Spans longer than a day, so that neighbours overlap.
    spans = days(spark, folder).select(VID, "segment_id", "start_time", (F.col("start_time") + 100_000).alias("end_time"))
    rows = timed(spark, folder).select("event_id", VID, "t")
    return frames.slice_by_segments(rows, spans, "t", width=DAY, spread=["event_id"]).select("event_id", VID, "segment_id", "t")


def _described(spark, folder):
    return written(_fetched(spark, folder).withColumn("analysis", F.expr(ANALYSIS)), "descriptions")


PREVIOUS = f"""(SELECT *, {ANALYSIS} AS analysis, lag(timestamp) OVER w AS previous_timestamp, lag({ANALYSIS}) OVER w AS previous_analysis
  FROM fetched WINDOW w AS (PARTITION BY video_id, segment_id ORDER BY ordinal))"""


@query("v6_previous_analysis", with_ctes(["fetched"], f"SELECT video_id, segment_id, ordinal, timestamp, analysis, previous_timestamp, previous_analysis FROM {PREVIOUS}"))
def v6(spark, folder):
    return frames.chain_previous(_described(spark, folder)).select(
        *SAMPLE, "timestamp", "analysis", F.col("previous.timestamp").alias("previous_timestamp"),
        F.col("previous.analysis").alias("previous_analysis"),
    )


def _with_matches(described):
    ocr = "named_struct('software', concat('app', frame_no % 7), 'detected_text', concat('seen ', frame_no))"
    logo = "named_struct('software', concat('logo', frame_no % 5), 'confidence', (frame_no % 100) / CAST(128 AS DOUBLE))"
    return described.withColumn("ocr_matches", F.expr(f"IF(frame_no % 3 = 0, array({ocr}), slice(array({ocr}), 1, 0))")).withColumn(
        "logo_matches", F.expr(f"IF(frame_no % 2 = 0, array({logo}, {logo}), slice(array({logo}), 1, 0))")
    )


LOGO_TEXT = "concat('logo', frame_no % 5, ' (confidence: ', printf('%.2f', (frame_no % 100) / 128::DOUBLE), ')')"


@query(
    "v7_frame_context",
    with_ctes(
        ["fetched", "days"],
        f"""SELECT video_id, segment_id, ordinal, concat_ws(chr(10), printf('Analyzing frame at %.2fs', timestamp), 'Frame type: ' || frame_type,
          chr(10) || 'Transcript context: ' || transcript, 'Topic: ' || dominant_topic, 'Keywords: ' || array_to_string(top_keywords, ', '),
          chr(10) || 'Software Detection Results:',
          CASE WHEN frame_no % 3 = 0 THEN concat('Text detected: app', frame_no % 7, ' (seen ', frame_no, ')') END,
          CASE WHEN frame_no % 2 = 0 THEN concat('Logos detected: ', {LOGO_TEXT}, ', ', {LOGO_TEXT}) END,
          CASE WHEN previous_analysis IS NOT NULL THEN concat(chr(10), printf('Previous frame analysis (%.2fs):', previous_timestamp), chr(10), previous_analysis) END
        ) AS context FROM {PREVIOUS} JOIN days USING (video_id, segment_id)""",
    ),
)
def v7(spark, folder):
    chained = frames.chain_previous(_described(spark, folder))
    told = _with_matches(chained).join(days(spark, folder), [VID, "segment_id"])
    return told.select(*SAMPLE, frames.frame_context(F.lit(True)).alias("context"))


@query(
    "v8_segment_roll_up",
    with_ctes(
        ["fetched", "days"],
        f"""SELECT video_id, segment_id, start_time, end_time, transcript, dominant_topic AS topic, array_to_string(top_keywords, ', ') AS keywords,
          coalesce(string_agg(concat(ordinal, ':', {ANALYSIS}, ':', CASE WHEN frame_no % 3 = 0 THEN 1 ELSE 0 END, ':',
            CASE WHEN frame_no % 2 = 0 THEN 2 ELSE 0 END), ' | ' ORDER BY ordinal) FILTER (frame_no IS NOT NULL), '') AS analyses
        FROM days LEFT JOIN fetched USING (video_id, segment_id) GROUP BY ALL""",
    ),
)
def v8(spark, folder):
    rolled = frames.roll_up_segments(days(spark, folder), _with_matches(_described(spark, folder)))
    entry = lambda a: F.concat(
        a["ordinal"].cast("string"), F.lit(":"), a["analysis"], F.lit(":"),
        F.size(a["software_analysis"]["ocr_matches"]).cast("string"), F.lit(":"),
        F.size(a["software_analysis"]["logo_matches"]).cast("string"),
    )
    return rolled.withColumn("keywords", F.array_join("keywords", ", ")).withColumn(
        "analyses", F.array_join(F.transform("frame_analyses", entry), " | ")
    ).drop("frame_analyses")


@query(
    "t15_analyzed_documents",
    with_ctes(
        ["fetched", "days", "ocr", "names", "logo_pixels", "logo_hits"],
        f"""SELECT video_id AS transcript_id, count(*) OVER (PARTITION BY video_id) AS segments, segment_id, topic, analyses FROM (
          SELECT video_id, segment_id, dominant_topic AS topic,
            coalesce(string_agg(concat(ordinal, ':', {ANALYSIS}, ':', coalesce(t.n, 0), ':', coalesce(l.n, 0)), ' | ' ORDER BY ordinal)
              FILTER (frame_no IS NOT NULL), '') AS analyses
          FROM days LEFT JOIN fetched USING (video_id, segment_id)
          LEFT JOIN (SELECT frame_id, count(*) AS n FROM ocr JOIN (SELECT software FROM names UNION SELECT software FROM logo_pixels) c
            ON contains(lower(text), lower(c.software)) GROUP BY frame_id) t ON t.frame_id = CAST(frame_no AS VARCHAR)
          LEFT JOIN (SELECT frame_id, count(*) AS n FROM logo_hits GROUP BY frame_id) l ON l.frame_id = CAST(frame_no AS VARCHAR)
          GROUP BY video_id, segment_id, dominant_topic)""",
    ),
)
def t15_analyzed(spark, folder):
    """Days as segments, events as frames; the image and the document of an event's number are what its frame shows and says."""
    segments, shown = days(spark, folder), event_frames(spark, folder)
    pixels = shown.join(images(spark, folder).select(F.col("vec_id").alias("frame_no"), "pixels"), "frame_no")
    texts = ocr_texts(spark, folder).drop("frame_id")
    places = shown.select(F.col("frame_no").alias("text_no"), VID).withColumn("frame_id", visual.frame_id(frame_no="text_no"))
    logos = logo_templates(spark, folder)
    catalog = written(names(spark, folder).union(logos.select("software")).distinct(), "catalog")
    sampled = visual.sampled_frames(segments, shown)
    matched, said = visual.matched_frames(sampled, pixels, texts, catalog, logos, places=places)
    analyzed = visual.analyze_segments(segments, matched, sampled.withColumn("analysis", F.expr(ANALYSIS)))
    metadata = segments.withColumnRenamed(VID, "transcript_id").withColumn("duration", F.col("end_time") - F.col("start_time"))
    documents = segmenting.results_documents(metadata, analyzed=analyzed, texts=said)
    entry = lambda a: F.concat(
        a["ordinal"].cast("string"), F.lit(":"), a["analysis"], F.lit(":"),
        F.size(a["software_analysis"]["ocr_matches"]).cast("string"), F.lit(":"),
        F.size(a["software_analysis"]["logo_matches"]).cast("string"),
    )
    each = documents.select("transcript_id", F.size("segments").cast("long").alias("segments"), F.explode("analyzed_segments").alias("s"))
    return each.select("transcript_id", "segments", "s.segment_id", "s.topic", F.array_join(F.transform("s.frame_analyses", entry), " | ").alias("analyses"))


def _silences(spark, folder):
    return audio.silence_intervals(levels(spark, folder), at_least=3600.0, width=DAY)


@query("v9_silence_intervals", with_ctes(["silences"], "SELECT * FROM silences"))
def v9(spark, folder):
    return _silences(spark, folder)


CUMULATED = """(SELECT *, sum("end" - "start") OVER (PARTITION BY track_id ORDER BY "start") - ("end" - "start") AS silent_before,
  coalesce(lag("end") OVER (PARTITION BY track_id ORDER BY "start"), 0) AS since FROM silences)"""


@query(
    "v10_retimed_pieces",
    with_ctes(
        ["silences", "timed"],
        f"""SELECT track_id, "start", "end", is_silent, round((("start" - before) / 2 + before / 8), 6) AS new_start,
          round((("start" - before) / 2 + before / 8) + ("end" - "start") / (CASE WHEN is_silent THEN 8 ELSE 2 END), 6) AS new_end FROM (
          SELECT track_id, since AS "start", "start" AS "end", false AS is_silent, silent_before AS before FROM {CUMULATED}
          UNION ALL SELECT track_id, "start", "end", true, silent_before FROM {CUMULATED}
          UNION ALL SELECT t.track_id, coalesce(l, 0), duration, false, coalesce(q, 0) FROM
            (SELECT video_id AS track_id, max(tick) + 100 AS duration FROM timed GROUP BY ALL) t LEFT JOIN
            (SELECT track_id, max("end") AS l, sum("end" - "start") AS q FROM silences GROUP BY ALL) s USING (track_id))
        WHERE "end" > "start\"""",
    ),
)
def v10_pieces(spark, folder):
    tracks = timed(spark, folder).groupBy(F.col(VID).alias("track_id")).agg((F.max("tick") + 100).alias("duration"))
    return audio.retimed_pieces(written(_silences(spark, folder), "silences"), tracks, width=DAY)


@query(
    "v10_retimed",
    with_ctes(
        ["silences", "timed"],
        f"""SELECT event_id, e.video_id AS track_id, e.t, round((e.t - q) / 2 + q / 8, 6) AS new_t FROM (
          SELECT event_id, video_id, tick AS t, coalesce(silent_before + least(tick, "end") - "start", 0) AS q
          FROM timed e ASOF LEFT JOIN {CUMULATED} c ON e.video_id = c.track_id AND e.tick >= c."start") e""",
    ),
)
def v10(spark, folder):
    times = timed(spark, folder).select("event_id", F.col(VID).alias("track_id"), F.col("tick").alias("t"))
    return audio.retimed(times, written(_silences(spark, folder), "silences"), width=DAY)


RATE = 1 / 4096


@query("v11_mono_resampled", with_ctes(["timed"], "SELECT video_id AS track_id, CAST(floor(t / 4096) AS BIGINT) AS n, round(avg(value), 6) AS x FROM timed GROUP BY ALL"))
def v11(spark, folder):
    return audio.mono_resampled(samples(spark, folder), RATE)


@query(
    "v12_normalized",
    with_ctes(["timed"], """SELECT event_id, video_id AS track_id, t, round(value * (0.25 / sqrt(avg(value * value) OVER (PARTITION BY video_id))
      * pow(10::DOUBLE, -3::DOUBLE / 20)), 6) AS x FROM timed"""),
)
def v12(spark, folder):
    return audio.normalized(samples(spark, folder), 0.25).select("event_id", "track_id", "t", "x")


@query(
    "v13_scene_changes",
    """SELECT CAST(label AS VARCHAR) AS video_id, vec_id AS frame_no, CAST(vec_id AS DOUBLE) AS ts, difference FROM (
      SELECT *, round(list_sum(list_transform(list_zip(embedding, before), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / 64, 6) AS difference FROM (
        SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) WHERE before IS NOT NULL) WHERE difference > 0.125""",
)
def v13(spark, folder):
    seen = images(spark, folder).select(
        F.col("label").cast("string").alias(VID), F.col("vec_id").alias("frame_no"), F.col("vec_id").cast("double").alias("ts"), "pixels"
    )
    return frames.scene_changes(seen, 0.125)


@query(
    "v14_transcript_context",
    with_ctes(
        ["talk", "talk2_batches"],
        """SELECT s.*, coalesce(string_agg(content, ' ' ORDER BY seq), '') AS context FROM (
          SELECT transcript_id AS video_id, CAST(batch_id + 1 AS INT) AS segment_id, CAST(o AS INT) AS ordinal,
            CASE o WHEN 0 THEN "start" WHEN 1 THEN "end" ELSE "start" + ("end" - "start") / 4 * (o - 1) END AS timestamp
          FROM talk2_batches, (SELECT range AS o FROM range(5)) WHERE o < 2 OR "end" - "start" > 2) s
        LEFT JOIN talk u ON s.video_id = u.transcript_id AND s.timestamp BETWEEN u."start" - 4 AND u."end" + 4 GROUP BY ALL""",
    ),
)
def v14(spark, folder):
    spans = combine_batches(assign_batches(talk(spark, folder), 2)).select(
        F.col("transcript_id").alias(VID), (F.col("batch_id") + 1).cast("int").alias("segment_id"),
        F.col("start").alias("start_time"), F.col("end").alias("end_time"),
    )
    return frames.transcript_context(written(frames.sampling_plan(spans), "samples"), talk(spark, folder), 4.0)
