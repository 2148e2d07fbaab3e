"""Personal data: patterned entities, and terms of the same documents that give an entity away. DataFrame operations only.

Entities are e-mail addresses, IP addresses, card numbers and phone numbers, by the patterns below. They are what is protected.
The terms are words of at least three letters outside the entities. Over the whole corpus, a term t tells
PMI(t; e) = log2(N n(t,e) / (n(t) n(e))) bits about an entity e, where n(t), n(e) and n(t,e) count the documents with t, with e and
with both, however far apart, and N all. Knowing e outright is worth IC(e) = log2(N / n(e)) bits. A term that tells at least
`DISCLOSED` of that discloses e, unless chance explains it: were t independent of e, at least n(t,e) of its n(t) documents would hold e
with a probability of at most 2^(-n(t) D), D the divergence in bits of n(t,e) / n(t) from w(e) (Chernoff). A long document holds more
words of any kind, so w(e), the chance that a word falls into documents with e, is their share of all code points, and at least n(e) / N.
DISCLOSED implies n(t) <= n(e)^DISCLOSED N^(1 - DISCLOSED), as n(t,e) <= n(e); terms over that are left out before the join with the
entities of their documents, and no other term is. All M pairs of an entity and a term within its bound are tested, together or not, so a
probability p would be reached by chance in M p of them. Pairs with a probability of at most p disclose if M p is at most `CHANCE` of
the number of such pairs that also tell enough (Benjamini and Hochberg), for the largest such p.
A disclosing term is generalised to a placeholder wherever it occurs, or removed where it tells everything of some entity.

Cases: a null text is the empty one. Positions are code points, ends exclusive. Repeated rows are rows of their own and count as
documents of their own, so copies of one text are evidence; take them out first where they shall not be. A null doc_id is carried
along. A text of one long run of a pattern's characters is read once, not once for each start: runs are matched possessively and only
from their first character or the end of the match before. Offsets are running totals and texts are cut by blocks of code points, so a
text of many spans isn't read from its start for each. Other columns are carried by `sanitised` and ignored by `spans`. An empty table gives an empty result.
"""

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.tables import small_side
from seamline.session import written

# The patterns, written so that the engine never tries a run twice.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAMES = [*KINDS, "term"]
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD = r"\p{L}{3,}+"
DISCLOSED, EVERYTHING = 0.9, 0.999
CHANCE = 0.05
BLOCK = 128  # numbers in a block of a running total
PIECE = 1024  # code points in a piece of a text
STEPS = 64  # steps a bit in which chances are ranked


def _let(value: Column, body: Callable) -> Column:
    """`body` of `value`, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chain(values: Column, op: Callable) -> Column:
    add = lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x)))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), add)


def running(values: Column, op: Callable) -> Column:
    """Running totals of an array under `op`, which must be associative; by blocks, whose totals are chained."""

    def joined(blocks):
        heads = _chain(F.transform(blocks, lambda b: F.element_at(b, -1)), op)
        own = lambda h: F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.element_at(h, i), x))))
        return F.flatten(_let(heads, own))

    def whole(v):
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        return F.when(F.size(v) == 0, v).otherwise(_let(F.transform(starts, lambda i: _chain(F.slice(v, i, BLOCK), op)), joined))

    return _let(values, whole)


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, match>> of the matches of `pattern`, which is never empty, from left to right."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    nothing = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found):
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda x, y: x + y)
        return F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))

    return F.when(F.rlike(text, pattern), _let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)).otherwise(nothing)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from `start` up to `end` of a text in pieces."""

    def part(i):
        first = F.greatest(start - i * PIECE, F.lit(0))
        return F.substring(F.element_at(pieces, i + 1), first + 1, F.least(end - i * PIECE, F.lit(PIECE)) - first)

    numbers = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
    return F.when(end > start, F.array_join(F.transform(numbers, part), "")).otherwise("")


def _between(spans: Column, length: Column) -> Column:
    """array<struct<from, to>> of what lies before each of `spans`, which are sorted by start, and after all; to < from inside an overlap."""
    covered = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    pair = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    return F.zip_with(F.concat(F.array(F.lit(0)), covered), F.concat(F.transform(spans, lambda s: s["start"]), F.array(length)), pair)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _good(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: _holds(kind, m["match"]))


def _is_kind(i: int):
    return lambda s: s["kind"] == i


def _as_kind(i: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["match"].alias("match"))


def entities(text: Column) -> Column:
    """array<struct<start, kind, end, match>> of the base spans, by start, then kind (its number in NAMES)."""
    found = []
    for i, (kind, pattern) in enumerate(KINDS.items()):
        found.append(F.transform(_good(matches(text, pattern), kind), _as_kind(i)))
    return F.array_sort(F.concat(*found))


def _outside(text: Column, base: Column) -> Column:
    """`text` with a space for each base span, the rest of a word that a span cuts into included."""

    def joined(cut):
        pieces, length = cut["pieces"], cut["length"]
        letter = lambda at: _cut(pieces, at, at + 1).rlike(r"\p{L}")

        def own(gap):
            found = _cut(pieces, gap["from"], gap["to"])
            found = F.when((gap["from"] > 0) & letter(gap["from"] - 1), F.regexp_replace(found, r"^\p{L}++", "")).otherwise(found)
            return F.when((gap["to"] < length) & letter(gap["to"]), F.regexp_replace(found, r"(?<!\p{L})\p{L}++$", "")).otherwise(found)

        return F.array_join(F.transform(F.filter(_between(base, length), lambda g: g["to"] > g["from"]), own), " ")

    cut = F.struct(_pieces(text).alias("pieces"), F.length(text).alias("length"))
    return F.when(F.size(base) == 0, text).otherwise(_let(cut, joined))


def _words() -> Column:
    """The distinct words of a row of `_found`, as they are written."""
    return F.array_distinct(F.regexp_extract_all(_outside(F.col("_text"), F.col("base")), F.lit(WORD), F.lit(0)))


def _terms() -> Column:
    return F.array_distinct(F.transform(_words(), lambda w: F.lower(w)))


def _found(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """Stored: the carried columns, tag, _text and base of every row."""
    rows = docs.select(*carried, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return written(rows.withColumn("base", entities(F.col("_text"))).withColumn("tag", F.monotonically_increasing_id()), "entities")


def disclosing(found: DataFrame) -> DataFrame:
    """Stored (entity, term, told) of the terms that give an entity away; told is the share of IC. `found`: a result of `_found`."""
    total = F.lit(found.count()).cast("double")
    with_base = found.filter(F.size("base") > 0)
    name = lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["match"]))
    holds = written(with_base.select("tag", F.length("_text").alias("size"), F.explode(F.array_distinct(F.transform("base", name))).alias("entity")), "holds")
    limit = F.pow("n_entity", F.lit(DISCLOSED)) * F.pow(total, F.lit(1 - DISCLOSED)) * (1 + 1e-9)
    by_entity = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.sum("size").alias("size")).filter(F.col("n_entity") < total)
    by_entity = written(by_entity.withColumn("limit", limit), "by-entity")
    most = by_entity.agg(F.max("limit")).first()[0] or 0.0
    # each text is read for its words here, and only here, if nothing discloses anything
    by_term = found.filter(F.lit(most > 0)).select(F.explode(_terms()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    by_term = written(by_term.filter(F.col("n_term") <= most), "by-term")
    rare = with_base.select("tag", F.explode(_terms()).alias("term")).join(small_side(by_term), "term")
    pairs = rare.join(holds.select("tag", "entity").join(small_side(by_entity), "entity"), "tag").filter(F.col("n_term") <= F.col("limit"))
    both = pairs.groupBy("entity", "term", "n_entity", "n_term", "size").agg(F.count(F.lit(1)).alias("n_both"))
    size = F.lit(found.agg(F.sum(F.length("_text"))).first()[0] or 0).cast("double")
    p, q, chance = F.col("n_entity") / total, F.col("n_both") / F.col("n_term"), F.greatest(F.col("size") / size, F.col("n_entity") / total)
    told = F.log2(q / p) / -F.log2(p)
    other = F.when(q < 1, (1 - q) * F.log2((1 - q) / (1 - chance))).otherwise(0.0)
    bits = F.when((q > chance) & (chance < 1), F.col("n_term") * (q * F.log2(q / chance) + other)).otherwise(0.0)
    tested = _tested(by_entity, by_term)
    step = F.floor(F.least(bits, F.lit(_enough(tested))) * STEPS).cast("long").alias("step")
    likely = written(both.select("entity", "term", told.alias("told"), step).filter((F.col("told") >= DISCLOSED) & (F.col("step") > 0)), "likely")
    return likely.filter(F.col("step") >= _least_step(likely, tested)).select("entity", "term", "told")


def _tested(by_entity: DataFrame, by_term: DataFrame) -> int:
    """The number of pairs of an entity and a term that is within its bound. Only how many have each count goes to the driver: different
    counts are fewer than the square root of twice the (document, term) or (document, entity) pairs."""
    terms = sorted((r["n_term"], r["n"]) for r in by_term.groupBy("n_term").agg(F.count(F.lit(1)).alias("n")).collect())
    counts, totals = [n for n, _ in terms], [0, *accumulate(n for _, n in terms)]
    limits = by_entity.groupBy("limit").agg(F.count(F.lit(1)).alias("n")).collect()
    return sum(r["n"] * totals[bisect_right(counts, r["limit"])] for r in limits)


def _enough(tested: int) -> float:
    """Bits at which a pair counts whatever the others are."""
    return log2(max(tested, 1) / CHANCE) + 1


def _least_step(likely: DataFrame, tested: int) -> int:
    """The least step of bits, 1 / STEPS each, at which chance explains no more than its share of the pairs from there on."""
    steps = sorted((r["step"], r["n"]) for r in likely.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect())
    left, least = sum(n for _, n in steps), int(_enough(tested) * STEPS) + 1
    for step, n in steps:
        if tested * 2.0 ** (-step / STEPS) <= CHANCE * left:
            least = min(least, step)
        left -= n
    return least


def _apart(words: Column, base: Column) -> Column:
    """Those of `words` that overlap no base span: no span that starts before a word's end ends after its start."""
    event = lambda s, at, kind, match: F.struct(at.alias("at"), F.lit(kind).alias("is_base"), s["start"].alias("start"), s["end"].alias("end"), match.alias("match"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, s["start"], 1, F.lit(""))), F.transform(words, lambda w: event(w, w["end"], 0, w["match"]))))

    def own(all_events):
        reached = running(F.transform(all_events, lambda e: F.when(e["is_base"] == 1, e["end"]).otherwise(0)), lambda x, y: F.greatest(x, y))
        paired = F.zip_with(all_events, reached, lambda e, r: F.struct(e.alias("e"), r.alias("r")))
        return F.transform(F.filter(paired, lambda x: (x["e"]["is_base"] == 0) & (x["r"] <= x["e"]["start"])), lambda x: x["e"])

    return _let(events, own)


def _with_terms(found: DataFrame) -> DataFrame:
    """`found` with `terms`: array<struct<start, kind, end, told>> of the disclosing terms of its texts, beside an entity or not."""
    told = written(disclosing(found).groupBy("term").agg(F.max("told").alias("told")), "terms")
    words = found.filter(F.lit(not told.isEmpty())).select("tag", F.explode(_words()).alias("word"))
    hits = words.join(small_side(told), F.lower("word") == F.col("term")).select("tag", "word", "told")
    hits = written(hits.groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("word", "told"))).alias("hits")), "term-hits")
    # only the texts that hold such terms are moved to meet them
    tags = small_side(hits.select("tag"))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("hits"), "|"), F.lit(r")(?!\p{L})"))
    own = _apart(matches(F.col("_text"), pattern), F.col("base"))
    span = lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), w["end"].alias("end"), F.element_at("hits", w["match"]).alias("told"))
    touched = found.join(tags, "tag", "left_semi").join(hits, "tag").withColumn("terms", F.transform(own, span)).drop("hits")
    rest = found.join(tags, "tag", "left_anti").withColumn("terms", F.array().cast(touched.schema["terms"].dataType))
    return touched.unionByName(rest)


def _said(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _all() -> Column:
    """Base spans and terms as one array, by start, then kind."""
    part = lambda s, t: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), t.alias("told"))
    base = F.transform("base", lambda s: part(s, F.lit(0.0)))
    terms = F.coalesce(F.transform("terms", lambda s: part(s, s["told"])), F.array().cast("array<struct<start:int,kind:int,end:int,told:double>>"))
    return F.array_sort(F.concat(base, terms))


def spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    rows = _with_terms(_found(docs, [F.col("doc_id")]))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    n_term = F.size(F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,told:double>>"))).cast("long")
    return rows.select("doc_id", *counts, n_term.alias("n_term"), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(_all()).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by the name of its kind in brackets, or by nothing where a term tells everything; of spans
    that overlap the first counts and the others are cut off with it."""
    masks = F.array(*[F.lit(f"[{n.upper()}]") for n in NAMES])
    mask = lambda s: F.when(s["told"] >= EVERYTHING, F.lit("")).otherwise(F.element_at(masks, s["kind"] + 1))

    def joined(pieces):
        # after the last gap stands no mask
        said = F.concat(F.transform(spans, mask), F.array(F.lit("")))
        own = lambda gap, m: F.when(gap["to"] >= gap["from"], F.concat(_cut(pieces, gap["from"], gap["to"]), m)).otherwise("")
        return F.array_join(F.zip_with(_between(spans, F.length(text)), said, own), "")

    return _let(_pieces(text), joined)


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with spans masked in `text`, and n_chars, if there is one, counted again. Rows without spans come back as they are."""
    names = docs.columns
    rows = _with_terms(_found(docs, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")]))
    rows = rows.withColumn("spans", _all())
    touched = F.size("spans") > 0
    text = F.when(touched, masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    rows = rows.withColumn("clean", text)
    kept = {c: F.col("row").getField(c) for c in names} | {"text": F.col("clean")}
    if "n_chars" in names:
        kept["n_chars"] = F.when(touched, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[kept[c].alias(c) for c in names])
