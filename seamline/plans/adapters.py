"""The given tables seen as transcripts, segments, frames, levels, texts and images.

Each view exists twice: as a DataFrame, and as the text of a common table expression for the SQL the
queries are checked against. Expressions both engines read the same way are written once.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline.fixed_values import STOP_WORDS

DAY = 86400.0
EPOCH = 1704067200000000  # start of 2024 in microseconds


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_ctes(names, select: str) -> str:
    """`select` behind the named expressions and those they build on, in order of definition."""
    needed, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += CTE[name][0]
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in CTE if n in needed) + "\n" + select


STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
CTE = {}


def cte(name: str, sql: str, uses=()):
    CTE[name] = (list(uses), sql)


def duck_tokens(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({STOPS}, t))"


# Transcripts: conversations by turn, documents by non-blank line.
TURN_SPAN = "CAST(turn AS DOUBLE) * 128"
cte(
    "talk",
    f"""SELECT CAST(conv_id AS VARCHAR) AS transcript_id, turn AS seq, text AS content, {TURN_SPAN} AS "start",
    {TURN_SPAN} + length(text) / CAST(16 AS DOUBLE) AS "end" FROM conversations""",
)
cte(
    "paper",
    """SELECT CAST(doc_id AS VARCHAR) AS transcript_id, n AS seq, line AS content, CAST(n AS DOUBLE) * 128 AS "start",
    CAST(n AS DOUBLE) * 128 + length(line) / CAST(16 AS DOUBLE) AS "end" FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS n FROM documents)
    WHERE trim(line) <> ''""",
)


def talk(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS transcript_id", "turn AS seq", "text AS content", f"{TURN_SPAN} AS start",
        f"{TURN_SPAN} + length(text) / CAST(16 AS DOUBLE) AS end",
    )


def paper(spark, folder) -> DataFrame:
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.filter(F.trim("line") != "").selectExpr(
        "CAST(doc_id AS STRING) AS transcript_id", "CAST(n AS BIGINT) AS seq", "line AS content",
        "CAST(n AS DOUBLE) * 128 AS start", "CAST(n AS DOUBLE) * 128 + length(line) / CAST(16 AS DOUBLE) AS end",
    )


for source, size in (("talk", 2), ("talk", 1), ("paper", 5)):
    cte(
        f"{source}{size}_assigned",
        f"""SELECT *, (rn - 1) // {size} AS batch_id, CAST(ceil(n_rows / {size}) AS BIGINT) AS n_batches FROM (
        SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seq) AS rn,
          count(*) OVER (PARTITION BY transcript_id) AS n_rows FROM {source})""",
        [source],
    )
    cte(
        f"{source}{size}_batches",
        f"""SELECT transcript_id, batch_id, max(n_batches) AS n_batches, arg_min("start", seq) AS "start",
        arg_max("end", seq) AS "end", string_agg(content, ' ' ORDER BY seq) AS content
        FROM {source}{size}_assigned GROUP BY ALL""",
        [f"{source}{size}_assigned"],
    )
    cte(
        f"{source}{size}_tf",
        f"""SELECT transcript_id, batch_id, max(n_batches) AS n_batches, term, count(*) AS n FROM (
        SELECT transcript_id, batch_id, n_batches, unnest({duck_tokens('content')}) AS term FROM {source}{size}_batches)
        GROUP BY transcript_id, batch_id, term""",
        [f"{source}{size}_batches"],
    )
    # Similarity of each batch to the batch before it.
    cte(
        f"{source}{size}_pairs",
        f"""SELECT transcript_id, batch_id, term, sum(a) AS a, sum(b) AS b FROM (
        SELECT transcript_id, batch_id + 1 AS batch_id, term, n AS a, 0 AS b FROM {source}{size}_tf WHERE batch_id + 1 < n_batches
        UNION ALL SELECT transcript_id, batch_id, term, 0, n FROM {source}{size}_tf WHERE batch_id > 0)
        GROUP BY transcript_id, batch_id, term""",
        [f"{source}{size}_tf"],
    )
    cte(
        f"{source}{size}_sims",
        f"""SELECT transcript_id, batch_id, coalesce(round(sum(a * b) / nullif(
          sqrt(sum(pow(a * (CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5::DOUBLE) + 1 END), 2)))
          * sqrt(sum(pow(b * (CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5::DOUBLE) + 1 END), 2))), 0), 6), 0) AS sim
        FROM {source}{size}_pairs GROUP BY ALL""",
        [f"{source}{size}_pairs"],
    )
    cte(
        f"{source}{size}_top",
        f"""SELECT transcript_id, batch_id, string_agg(term, ', ' ORDER BY score DESC, term) AS keywords,
          arg_min(term, r) AS topic FROM (
          SELECT *, row_number() OVER (PARTITION BY transcript_id, batch_id ORDER BY score DESC, term) AS r FROM (
            SELECT transcript_id, batch_id, term, round(n * (ln((1 + n_batches) /
              (1 + count(*) OVER (PARTITION BY transcript_id, term))::DOUBLE) + 1), 6) AS score FROM {source}{size}_tf))
        WHERE r <= 5 GROUP BY ALL""",
        [f"{source}{size}_tf"],
    )
    cte(
        f"{source}{size}_native",
        f"""SELECT b.transcript_id, b.batch_id, coalesce(topic, 'Unknown') AS topic, coalesce(keywords, '') AS keywords,
          CASE WHEN b.batch_id = 0 OR coalesce(sim, 0) < 0.1 THEN 'NEW' WHEN sim < 0.3 THEN 'SHIFT' ELSE 'CONTINUATION' END AS relationship,
          CASE WHEN b.batch_id = 0 THEN 100.0::DOUBLE WHEN coalesce(sim, 0) < 0.3 THEN floor(100 * (1 - coalesce(sim, 0)) + 0.5)
            ELSE floor(100 * sim + 0.5) END AS confidence
        FROM {source}{size}_batches b LEFT JOIN {source}{size}_sims USING (transcript_id, batch_id)
        LEFT JOIN {source}{size}_top USING (transcript_id, batch_id)""",
        [f"{source}{size}_batches", f"{source}{size}_sims", f"{source}{size}_top"],
    )

# Model responses for the conversations' batches of two: some readable, some broken, some incomplete.
ASKED = "(CAST(transcript_id AS BIGINT) * 7 + batch_id * 3) % 10"
RELATION = "CASE (CAST(transcript_id AS BIGINT) + batch_id) % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'SHIFT' ELSE 'CONTINUATION' END"
SURE = "(60 + (CAST(transcript_id AS BIGINT) * 13 + batch_id * 29) % 41)"
RESPONSE = f"""CASE WHEN {ASKED} = 0 THEN 'I cannot tell.' WHEN {ASKED} = 1 THEN '{{"topic": broken'
  WHEN {ASKED} = 2 THEN concat('{{"topic":"open ', batch_id, '","relationship":"', {RELATION}, '"}}')
  ELSE concat('Sure! {{"topic":"topic ', batch_id % 5, '","keywords":["k', batch_id, '","', transcript_id, '"],"relationship":"',
    {RELATION}, '","confidence":', {SURE}, '}} That is all.') END"""
cte(
    "answered",
    f"""SELECT transcript_id, batch_id,
      CASE WHEN {ASKED} < 2 THEN 'Unknown' WHEN {ASKED} = 2 THEN concat('open ', batch_id) ELSE concat('topic ', batch_id % 5) END AS topic,
      CASE WHEN {ASKED} <= 2 THEN '' ELSE concat('k', batch_id, ', ', transcript_id) END AS keywords,
      CASE WHEN {ASKED} < 2 THEN 'NEW' ELSE {RELATION} END AS relationship,
      CASE WHEN {ASKED} <= 2 THEN 0.0::DOUBLE ELSE {SURE}::DOUBLE END AS confidence
    FROM talk2_batches""",
    ["talk2_batches"],
)


def segments_cte(name: str, batches: str, annotation: str):
    cte(
        f"{name}_decided",
        f"""SELECT *, CAST(sum(CASE WHEN batch_id = 0 OR (relationship = 'NEW' AND confidence > 70)
          OR (relationship = 'SHIFT' AND confidence > 85) THEN 1 ELSE 0 END)
          OVER (PARTITION BY transcript_id ORDER BY batch_id) AS BIGINT) AS segment_id FROM {annotation}""",
        [annotation],
    )
    cte(
        f"{name}_segments",
        f"""SELECT transcript_id, CAST(segment_id AS INTEGER) AS segment_id, arg_min("start", batch_id) AS start_time,
          arg_max("end", batch_id) AS end_time, arg_max("end", batch_id) - arg_min("start", batch_id) AS duration,
          arg_min(topic, batch_id) AS dominant_topic, arg_min(keywords, batch_id) AS top_keywords,
          string_agg(content, ' ' ORDER BY batch_id) AS transcript
        FROM {batches} JOIN {name}_decided USING (transcript_id, batch_id) GROUP BY transcript_id, segment_id""",
        [batches, f"{name}_decided"],
    )


segments_cte("answered", "talk2_batches", "answered")
segments_cte("talk", "talk2_batches", "talk2_native")
segments_cte("paper", "paper5_batches", "paper5_native")

# Videos: one per user; segments are days, frames are events.
SECONDS_DUCK = f"(epoch_us(ts) - {EPOCH}) / 1000000::DOUBLE"
# From the parts of the time of day, so that the session's time zone plays no role.
SECONDS_SPARK = (
    "((datediff(CAST(ts AS DATE), DATE'2024-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000 "
    "+ CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)) / CAST(1000000 AS DOUBLE)"
)
cte("timed", f"SELECT *, floor(t * 64) / 64 AS tick FROM (SELECT *, CAST(user_id AS VARCHAR) AS video_id, {SECONDS_DUCK} AS t FROM events)")
DAY_COLUMNS = [
    "video_id", "CAST(day + 1 AS INT) AS segment_id", "day * CAST(86400 AS DOUBLE) AS start_time",
    "(day + 1) * CAST(86400 AS DOUBLE) AS end_time", "concat('day ', day, ' of ', video_id) AS transcript",
    "concat('day ', day) AS dominant_topic",
]
cte(
    "days",
    f"SELECT {', '.join(DAY_COLUMNS)}, ['d' || day, 'w' || (day // 7)] AS top_keywords FROM "
    "(SELECT DISTINCT video_id, CAST(floor(t / 86400) AS BIGINT) AS day FROM timed)",
    ["timed"],
)


def timed(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr("*", "CAST(user_id AS STRING) AS video_id", f"{SECONDS_SPARK} AS t").selectExpr("*", "floor(t * 64) / CAST(64 AS DOUBLE) AS tick")


def days(spark, folder) -> DataFrame:
    seen = timed(spark, folder).selectExpr("video_id", "CAST(floor(t / 86400) AS BIGINT) AS day").distinct()
    return seen.selectExpr(*DAY_COLUMNS, "array(concat('d', day), concat('w', day div 7)) AS top_keywords")


def event_frames(spark, folder) -> DataFrame:
    return timed(spark, folder).selectExpr("video_id", "event_id AS frame_no", "t AS ts")


cte(
    "plan",
    """SELECT video_id, segment_id, o AS ordinal, CASE o WHEN 0 THEN start_time WHEN 1 THEN end_time
      ELSE start_time + (end_time - start_time) / 4 * (o - 1) END AS timestamp,
      CASE o WHEN 0 THEN 'segment_start' WHEN 1 THEN 'segment_end' ELSE 'internal' END AS frame_type
    FROM days, (SELECT CAST(range AS INT) AS o FROM range(5)) WHERE o < 2 OR end_time - start_time > 2""",
    ["days"],
)
cte(
    "extracted",
    """SELECT video_id, segment_id, ordinal, first_value(timestamp) OVER w AS timestamp, first_value(frame_type) OVER w AS frame_type
    FROM plan WINDOW w AS (PARTITION BY video_id, printf('%.3f', timestamp) ORDER BY segment_id, ordinal)""",
    ["plan"],
)
cte(
    "fetched",
    """SELECT e.*, f.event_id AS frame_no, f.t AS frame_ts FROM extracted e ASOF JOIN timed f
    ON e.video_id = f.video_id AND e.timestamp >= f.t""",
    ["extracted", "timed"],
)
ANALYSIS = "concat('saw frame ', frame_no, ' as ', frame_type)"

# Audio: one track per user, its level falling with the event's value. Times are kept to 1/64 s, so that
# sums and halves of them are exact in any order.
LEVEL = "-value / 4"
cte("levels", f"SELECT video_id AS track_id, tick AS t, max({LEVEL}) AS level_db FROM timed GROUP BY ALL", ["timed"])
cte(
    "silences",
    """SELECT track_id, min(t) FILTER (silent) AS "start", coalesce(max(t) FILTER (NOT silent), max(t)) AS "end" FROM (
      SELECT track_id, t, level_db < -25 AS silent,
        sum(CASE WHEN level_db >= -25 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t)
          - CASE WHEN level_db >= -25 THEN 1 ELSE 0 END AS stretch FROM levels)
    GROUP BY track_id, stretch HAVING min(t) FILTER (silent) IS NOT NULL
      AND coalesce(max(t) FILTER (NOT silent), max(t)) - min(t) FILTER (silent) >= 3600""",
    ["levels"],
)


def levels(spark, folder) -> DataFrame:
    return timed(spark, folder).selectExpr("video_id AS track_id", "tick AS t", f"{LEVEL} AS level_db")


def samples(spark, folder) -> DataFrame:
    return timed(spark, folder).selectExpr("video_id AS track_id", "length(event_type) AS channel", "event_id", "t", "value AS x")


# Images: each embedding as 8 x 8 gray values; a logo per label, cut from its first image.
def images(spark, folder) -> DataFrame:
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda y: F.transform(F.slice("embedding", y * 8 + 1, F.lit(8)), lambda v: v.cast("double")),
    )
    return table(spark, folder, "embeddings").select("vec_id", "label", "embedding", rows.alias("pixels"))


def logo_templates(spark, folder) -> DataFrame:
    first = images(spark, folder).groupBy("label").agg(F.min_by("pixels", "vec_id").alias("pixels"))
    patch = F.transform(F.slice("pixels", 3, 3), lambda row: F.slice(row, 3, 3))
    return first.select(F.concat(F.lit("logo "), F.col("label").cast("string")).alias("software"), patch.alias("pixels"))


cte("pixels", "SELECT vec_id, label, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT range AS i FROM range(64))")
cte(
    "logo_pixels",
    """SELECT 'logo ' || label AS software, x - 2 AS dx, y - 2 AS dy, v FROM pixels
    WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label) AND x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4""",
    ["pixels"],
)
cte(
    "logo_hits",
    """SELECT * FROM (SELECT CAST(vec_id AS VARCHAR) AS frame_id, software, CAST(x - dx AS INT) AS x, CAST(y - dy AS INT) AS y,
      round((9 * sum(p.v * l.v) - sum(p.v) * sum(l.v)) / sqrt((9 * sum(p.v * p.v) - pow(sum(p.v), 2))
        * (9 * sum(l.v * l.v) - pow(sum(l.v), 2))), 6) AS confidence
    FROM pixels p, logo_pixels l GROUP BY vec_id, software, x - dx, y - dy HAVING count(*) = 9) WHERE confidence >= 0.8""",
    ["pixels", "logo_pixels"],
)

# Recognised text: the documents; names to look for: the lines of the benchmark texts, whole.
cte("names", "SELECT DISTINCT s AS software FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM benchmark) WHERE s <> ''")
cte(
    "ocr",
    """SELECT CAST(doc_id AS VARCHAR) AS frame_id, doc_id AS text_no, text, doc_id % 2 = 0 AS whole,
      CAST(doc_id % 100 AS DOUBLE) AS confidence FROM documents""",
)
cte(
    "name_hits",
    """SELECT frame_id, software, text AS detected_text, confidence FROM ocr JOIN names ON contains(lower(text), lower(software))""",
    ["ocr", "names"],
)


def names(spark, folder) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.explode(F.split("text", "\n")).alias("software")).filter("software <> ''").distinct()


def ocr_texts(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS frame_id", "doc_id AS text_no", "text",
        "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE named_struct('x', CAST(doc_id % 640 AS INT), 'y', 0, 'w', 64, 'h', 16) END AS bbox",
        "CAST(doc_id % 100 AS DOUBLE) AS confidence",
    )


# Given inputs: page addresses and what can be made of them.
MADE = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat('https://youtu.be/', substring(md5(url), 1, 11))
  WHEN 2 THEN concat('www.youtube.com/watch?v=', substring(md5(url), 3, 11))
  WHEN 3 THEN concat('https://www.youtube.com/watch?v=', substring(md5(url), 1, 11), '&t=5')
  WHEN 4 THEN concat('/media/talk.', page_id, '.MP4') WHEN 5 THEN concat('/media/', page_id, '.webm')
  WHEN 6 THEN concat('/media/shot_', page_id, '.PNG') ELSE concat('/media/', page_id, '.json') END"""
cte("given", f"SELECT page_id, {MADE} AS path, page_id % 3 = 0 AS analyze_screenshot FROM pages")
cte("listing", "SELECT DISTINCT path FROM given WHERE page_id % 5 <> 0 AND page_id % 8 > 3", ["given"])


def given(spark, folder) -> DataFrame:
    return table(spark, folder, "pages").selectExpr("page_id", f"{MADE} AS path", "page_id % 3 = 0 AS analyze_screenshot")


def listing(spark, folder) -> DataFrame:
    return given(spark, folder).filter("page_id % 5 <> 0 AND page_id % 8 > 3").select("path").distinct()
