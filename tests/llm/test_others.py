"""Personal data, nearest vectors, classifiers, the pipeline."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, SHORT, awkward, near_classes, personal_spans
from pyspark.sql import functions as F

import corpus_pipeline
from seamline.llm import exact_dedup, near_dedup, nearest, personal_data, quality, toxicity
from seamline.llm.fast_words import slabs
from seamline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_personal_data_patterns(spark):
    draw = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.z", "1.2.3.4", "300.1.1.1", ".5", "00", "4952935900253052", "4111 1111-1111 1111", "-", " ", "+1 (017) 555-7713", "+", "é", "🙂", "%", "999", "\n", "("]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))) for i in range(600)]
    rows += [(9001, None), (9002, ""), (9003, "1" * 50_000), (9004, "a" * 100_000), (9005, "1 " * 20_000), (9006, "a.b@c.d" * 500), (9007, "a@" * 10_000), (9008, "1.1." * 10_000)]
    texts = dict(rows)
    for row in personal_data.spans(spark.createDataFrame(rows, SHORT)).collect():
        want = personal_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == digest(want)
        assert row["n_email"] == want.count("email") and row["n_ip"] == want.count("ip") and row["n_card"] == want.count("card") and row["n_phone"] == want.count("phone")


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"ask {['Quillfeather', 'Ravenbrook'][i % 2]} about number {i}: {['q@a.org', 'r@b.org'][i % 2]} in this {'other ' * i}matter") for i in range(12)]
    rows += [(100 + i, f"ask anyone about this other number, a matter of {i}") for i in range(200)]
    found = {r["doc_id"]: r for r in personal_data.spans(spark.createDataFrame(rows, SHORT)).collect()}
    for i, text in rows:
        start = text.find("Quillfeather") if "Quillfeather" in text else text.find("Ravenbrook")
        if start >= 0:
            end = start + (12 if "Quill" in text else 10)
            assert found[i]["n_term"] == 1 and f"term:{start}:{end}" in found[i]["spans"].split(",")
        else:
            assert found[i]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in personal_data.sanitised(spark.createDataFrame(rows, SHORT)).collect()}
    assert "Quillfeather" not in clean[0] and "q@a.org" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[150] == rows[62][1]


def test_personal_data_awkward(spark):
    clean = personal_data.sanitised(awkward(spark, [*AWKWARD, (10, "mail a@b.org now")]))
    assert clean.columns == awkward(spark).columns and clean.count() == len(AWKWARD) + 1
    got = clean.filter("doc_id = 10").first()
    assert got["text"] == "mail [EMAIL] now" and got["n_chars"] == len("mail [EMAIL] now") and got["plain"] == "p"
    assert clean.filter("doc_id = 4 AND text IS NULL").count() == 1
    assert personal_data.spans(awkward(spark, [])).count() == personal_data.sanitised(awkward(spark, [])).count() == 0


def test_masks_of_overlapping_spans(spark):
    row = spark.sql("SELECT 'abcdefghij' AS t, array(named_struct('start', 1, 'kind', 0, 'end', 4, 'told', 0D), named_struct('start', 3, 'kind', 2, 'end', 6, 'told', 0D), named_struct('start', 8, 'kind', 4, 'end', 9, 'told', 1D)) AS s")
    assert row.select(personal_data.masked(F.col("t"), F.col("s")).alias("x")).first()["x"] == "a[EMAIL]ghj"


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 7)
    monkeypatch.setattr(nearest, "FAN_IN", 3)
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(300, 16)).astype(np.float32).astype(float)
    vectors[200:] = vectors[5]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [float("inf")] * 16), (1100, [1.0, None]), (1120, [1.0, 2.0]), (1140, [2.0, 1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(table, "id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:20]
        assert [(k, i) for k, i, _ in got.pop(q)] == [*enumerate(order, 1)]
    assert got == {1120: [(1, 1140, 4.0)], 1140: [(1, 1120, 4.0)]}
    assert nearest.nearest(table.limit(0), "id % 20 = 0").count() == 0


def labelled(spark, n=900):
    draw = random.Random(8)
    words = ["stone", "river", "of", "and", "light", "walks", "over", "green"]
    rows, labels = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 5 == 0
        own = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        if bad:
            own = [w.upper() + "!!" for w in own]
        if rude:
            own[3:3] = ["blockhead", "nitwit"]
        rows.append((i, " ".join(own)))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, SHORT), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, folds, fold, label", [(quality, 5, 0, "quality"), (toxicity, 3, 1, "toxic")])
def test_classifiers(spark, module, folds, fold, label):
    docs, labels = labelled(spark)
    rows = module.scored(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 900
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in rows)
    assert np.mean([r["predicted"] == r[label] for r in held]) >= 0.98
    # held-out labels teach nothing
    turned = labels.withColumn(label, F.when(quality.held_out(F.col("doc_id"), folds, fold), 1 - F.col(label)).otherwise(F.col(label)))
    again = {r["doc_id"]: r["score"] for r in module.scored(docs, turned).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_repeated_ids_teach_once(spark):
    docs, labels = labelled(spark, 60)
    several = docs.crossJoin(spark.range(5)).select("doc_id", F.concat("text", F.lit(" "), "id").alias("text"))
    sample = quality.labelled_sample(labels, "quality", 5, 0, 30)
    taken = [sorted(map(tuple, quality.labelled_texts(d, sample).collect())) for d in (several, several.repartition(7, "text"), several.orderBy(F.desc("text")))]
    assert len(taken[0]) == sample.count() == 30 and taken[0] == taken[1] == taken[2]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_awkward(spark, module):
    _, labels = labelled(spark, 50)
    none = labels.limit(0)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (777, 1, 1), (2, 1, 0), (3, 5, 5)], "doc_id long, quality int, toxic int")
    for frame, n in ((awkward(spark), len(AWKWARD)), (awkward(spark, []), 0)):
        for some in (none, odd, labels):
            rows = module.scored(frame, some).collect()
            assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in module.scored(awkward(spark), none).collect()} == {0.5}
    kept = quality.kept(awkward(spark), none)
    assert kept.columns == awkward(spark).columns and kept.count() == len(AWKWARD)


def test_label_model_finds_the_better_voters():
    draw = np.random.default_rng(2)
    truth = (draw.random(4000) < 0.2).astype(int)
    wrong = draw.random((4000, 6)) < np.array([0.02, 0.05, 0.05, 0.1, 0.1, 0.45])
    votes = np.where(wrong, 1 - truth[:, None], truth[:, None]).astype(np.int8)
    votes[draw.random(votes.shape) < 0.3] = -1
    model = toxicity.LabelModel(votes, 0.2)
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.97
    told = model.rates[2, 0] - model.rates[2, 1]
    assert told[0] > told[3] > told[5]


def test_pipeline_stages(spark):
    """Every stage against a plain version of it, on the documents that its predecessor kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            agree = [(i in after) == bool(q) for i, q in labels.items()]
            assert np.mean(agree) > 0.9 and all(after[i] == before[i] for i in after)
        if name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                groups.setdefault("".join(c.lower() if c.isascii() else c for c in t), []).append(i)
            assert set(after) == {max(g) for g in groups.values()}
        if name == "near_dedup":
            assert set(after) == {low for low, _ in near_classes([*before.items()]).values()}
        if name == "personal_data":
            assert set(after) == set(before)
            assert all((after[i] != t) == bool(personal_spans(t)) for i, t in before.items())
            assert all(personal_spans(t) == "" for t in after.values())
        before = after
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {p["doc_id"] for p in pieces} == set(before)
    assert len({p["sequence_id"] for p in pieces}) <= -(-sum(p["length"] for p in pieces) // 2048) + 2


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_pipeline_awkward(spark, tmp_path, rows):
    """Without labels nothing is rejected; of equal texts one stays, each document comes out in gapless pieces."""
    awkward(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = near_dedup.keep_one(exact_dedup.keep_one(awkward(spark, rows))).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in kept}
    assert sum(p["piece"] == 0 for p in pieces) == len(kept)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 2048 for n in filled.values())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)
    assert exact_dedup and near_dedup


def test_terms_of_rare_entities_far_off_and_without_them(spark):
    filler = "ask anyone about this other number " * 20
    rows = [(0, f"Quillfeather {filler} q@a.org"), (1, f"{filler} +1 (017) 555-7713 äq@b.org Ravenbrook"), (2, f"{filler} r@c.org RAVENBROOK {filler}ravenbrook")]
    rows += [(10 + i, f"{filler} Thornfield {i} {'t@d.org' if i < 8 else ''}") for i in range(9)]
    rows += [(100 + i, filler) for i in range(200)]
    # a word once beside an entity of a tenth of the documents and more is no evidence
    rows += [(400 + i, f"{filler} all@e.org {'Larkspur' if i == 0 else ''}") for i in range(40)]
    found = {r["doc_id"]: r for r in personal_data.spans(spark.createDataFrame(rows, SHORT)).collect()}
    want = {0: ["Quillfeather"], 1: [], 2: [], **{10 + i: ["Thornfield"] for i in range(9)}}
    for i, text in rows:
        spans = [x.split(":") for x in found[i]["spans"].split(",") if x.startswith("term")]
        assert [text[int(s) : int(e)] for _, s, e in spans] == want.get(i, []) and found[i]["n_term"] == len(spans)
    clean = {r["doc_id"]: r["text"] for r in personal_data.sanitised(spark.createDataFrame(rows, SHORT)).collect()}
    assert "Quillfeather" not in clean[0] and clean[18] == f"{filler} [TERM] 8 " and clean[400] == f"{filler} [EMAIL] Larkspur"
    assert clean[100] == filler


def test_many_spans_in_one_text(spark):
    """More spans than a block of a running total holds, in a text of many pieces."""
    draw = random.Random(5)
    parts = ["q@a.org", "x@b.orgé", "1.2.3.4", "word", "é🙂", "+1 (017) 555-7713", "Name"]
    text = " ".join(draw.choice(parts) for _ in range(3 * personal_data.BLOCK * 3))
    row = spark.createDataFrame([(1, text)], SHORT).withColumn("base", personal_data.entities(F.col("text")))
    spans = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0.0).alias("told")))
    got = row.select("base", personal_data.masked(F.col("text"), spans).alias("masked"), personal_data._outside(F.col("text"), F.col("base")).alias("outside")).first()
    base = [(s["start"], s["end"], s["kind"]) for s in got["base"]]
    assert ",".join(f"{personal_data.NAMES[k]}:{a}:{e}" for a, e, k in base) == personal_spans(text) and len(base) > 2 * personal_data.BLOCK
    assert len(text) > 3 * personal_data.PIECE
    want, words, at = "", [], 0
    for a, e, k in base:
        if a >= at:
            want += text[at:a] + f"[{personal_data.NAMES[k].upper()}]"
            words += text[at:a].split()
        at = max(at, e)
    assert got["masked"] == want + text[at:]
    # the é that an address is cut off from is no word
    assert [w for w in got["outside"].split()] == [w for w in [*words, *text[at:].split()] if w != "é"]


def test_chance_is_held_against_all_pairs(spark):
    """One coincidence among many pairs is no evidence; the same one among few is."""
    filler = "ask anyone about this other number " * 10
    rows = [(0, f"{filler} Quillfeather q@a.org")] + [(i, filler) for i in range(1, 100)]
    letters = "abcdefghij"
    many = [(1000 + i, f"{filler} {letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}name") for i in range(400)]
    count = lambda r: sum(x["n_term"] for x in personal_data.spans(spark.createDataFrame(r, SHORT)).collect())
    assert count(rows) == 1 and count(rows + many) == 0


def test_quality_holds_one_table_and_a_small_slab(spark):
    """A worker's arrays stay within the table of sums, the hash powers and little else, whatever lies in a batch; results don't depend on the slab."""
    draw = random.Random(11)
    texts = [" ".join(draw.choice(["a", "Bc", "12", ".", "word", "É1"]) for _ in range(700)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    list(quality._count([batch.slice(0, 1)]))  # tables that stay are made before
    tracemalloc.start()
    pieces = list(quality._count([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    sums = np.zeros((quality.BUCKETS // quality.SLICE, quality.SLICE * quality.DIMS))
    for piece in pieces:
        sums[piece.column("slice")[0].as_py()] = np.frombuffer(piece.column("sums")[0].as_py(), "<i8")
    places, signs = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for slab in slabs(batch.column("text"), 1 << 14):
        cut = quality.Cut(slab)
        for i in np.flatnonzero(cut.text[1:] == cut.text[:-1]).tolist():
            for a, b in ((i, i + 1), (i + 1, i)):
                for at in (cut.word[a], cut.shape[a]):
                    for other in (cut.word[b], cut.shape[b]):
                        for k in range(quality.NONZERO):
                            want[at, places[other, k]] += signs[other, k]
    assert np.array_equal(sums.reshape(want.shape), want)
    vectors = np.random.default_rng(2).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    pool = lambda size: np.vstack([quality.pooled(s, vectors) for s in slabs(batch.column("text"), size)])
    assert np.array_equal(pool(quality.SLAB), pool(1 << 20))
