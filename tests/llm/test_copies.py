"""Exact and near copies, repeated passages."""

import functools
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, SHORT, awkward, near_classes, repeated_bytes

from seamline.llm import components, exact_dedup, fast_words, near_dedup, packing, quality, repeats, tables
from seamline.llm.run_index import RunIndex


def test_exact_copies(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["Ab", "aB", "AB é", "ab É", "", None, f"own {i}", "ÀB", "àb"])) for i in range(300)]
    low = {i: "".join(c.lower() if c.isascii() else c for c in t or "") for i, t in rows}
    for row in exact_dedup.copies(spark.createDataFrame(rows, SHORT)).collect():
        same = [i for i, t in low.items() if t == low[row["doc_id"]]]
        assert (row["keep_id"], row["group_size"], row["kept"]) == (max(same), len(same), row["doc_id"] == max(same))
        assert row["text_sha256"] == hashlib.sha256(low[row["doc_id"]].encode()).hexdigest()


def test_exact_copies_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    rows = [(i, f"text {i % 70}") for i in range(100)]
    assert exact_dedup.copies(spark.createDataFrame(rows, SHORT)).filter("kept").count() == 70


@pytest.mark.parametrize("rows_sent", [0, 500_000])
def test_exact_copies_on_both_sides_of_the_broadcast_bound(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", rows_sent)
    rows = [(i, "hot" if i % 3 == 0 else f"Text {i % 70}" if i < 200 else f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, SHORT)
    low = [t.lower() for _, t in rows]
    last = {t: i for i, t in enumerate(low)}
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(docs).collect()) == sorted(last.values())
    assert {r["doc_id"] for r in exact_dedup.copies(docs).filter("kept").collect()} == set(last.values())
    several = {hashlib.sha256(t.encode()).hexdigest() for t in low if low.count(t) > 1}
    assert {r["text_sha256"] for r in exact_dedup.repeated_texts(docs).collect()} == several


def test_exact_copies_awkward(spark):
    kept = exact_dedup.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 5, 6, 7, 8, 9]
    flags = exact_dedup.copies(awkward(spark))
    assert flags.count() == len(AWKWARD) and flags.filter("kept").count() == 7
    assert exact_dedup.copies(awkward(spark, [])).count() == exact_dedup.keep_one(awkward(spark, [])).count() == 0


def near_rows(seed=2, n=120):
    draw = random.Random(seed)
    base = [[draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randint(1, 3) for _ in range(draw.randint(3, 80))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
            words[draw.randrange(len(words))] = draw.choice(["new", "other", "again"])
        rows.append((i, " ".join(words * draw.choice([1, 1, 1, 2]))))
    return [*rows, (900, ""), (901, None), (902, "  "), (903, "x " * 400), (904, "x " * 401), (905, "X\t" * 340)]


def test_near_copies_are_the_components_of_all_pairs(spark):
    rows = near_rows()
    want = near_classes(rows)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.classes(spark.createDataFrame(rows, SHORT)).collect()}
    assert got == want


@pytest.mark.parametrize("members", [2048, 3])
def test_groups_just_below_the_similarity(spark, monkeypatch, members):
    """Texts that all share bands, most of them not near enough: what the stars leave open is compared in tiles."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    draw = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in draw.sample(range(120), draw.choice([1, 2, 3, 4])):
            words[at] = f"x{draw.randrange(60)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.classes(spark.createDataFrame(rows, SHORT)).collect()}
    want = near_classes(rows)
    assert got == want and 1 < len({c for c, _ in want.values()})


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(3)
    errors = []
    for k in range(100):
        counts = draw.integers(1, 40, (2, 60))
        text = np.repeat([0, 1], 60)
        times = near_dedup.signatures(text, np.tile(np.arange(60, dtype=np.uint64) + np.uint64(1000 * k), 2), counts.ravel(), 2)
        errors.append((times[0] == times[1]).mean() - np.minimum(*counts).sum() / np.maximum(*counts).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_near_copies_awkward(spark):
    kept = near_dedup.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    # the three equal texts leave one row; blank ones are near to nothing
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 8, 9]
    assert near_dedup.classes(awkward(spark)).count() == len(AWKWARD)
    assert near_dedup.classes(awkward(spark, [])).count() == near_dedup.keep_one(awkward(spark, [])).count() == 0


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """A round is some seven shuffles; one more was done to see that nothing changes, and a second search began from the first links."""
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda links, large: rounds.append(large) or star(links, large))
    for links, n in (([(5, 1), (1, 7), (9, 8), (5, 1), (3, 3)], 0), ([], 0), ([(5, 1), (5, 2)], 2)):
        rounds.clear()
        got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == ({5: 1, 7: 1, 9: 8} if len(links) == 5 else {2: 1, 5: 1} if links else {}) and len(rounds) == n


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def passages(seed=2, n=150):
    draw = random.Random(seed)
    fox = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf, then sleeps for an hour or two. "
    parts = lambda: draw.choice(["a" * draw.randint(1, 150), "xyz " * draw.randint(1, 60), "é" * draw.randint(1, 90), fox, str(draw.random())])
    return [(i, None if i == 3 else "".join(parts() for _ in range(draw.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("most", [2048, 3])
def test_repeated_passages(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    rows = passages()
    want = repeated_bytes(rows)
    texts = dict(rows)
    for row in repeats.without_repeats(spark.createDataFrame(rows, SHORT)).collect():
        data, spans = (texts[row["doc_id"]] or "").encode(), want[row["doc_id"]]
        assert np.frombuffer(row["spans"] or b"", "<i8").reshape(-1, 2).tolist() == spans
        left = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(data)]))
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], bytes(row["kept"])) == (len(data), len(data) - len(left), len(spans), left)
        assert row["kept_sha256"] == hashlib.sha256(left).hexdigest()


def repeated_places(texts, least):
    seen, found = set(), []
    for t, text in enumerate(texts):
        for s in range(len(text) - least + 1):
            if text[s : s + least] in seen:
                found.append((t, s))
            seen.add(text[s : s + least])
    return found


@pytest.mark.parametrize("least", [3, 100])
def test_run_index(least):
    draw = random.Random(6)
    texts = ["".join(draw.choice("ab") * draw.randint(1, 20) for _ in range(draw.randint(1, 25))).encode() for _ in range(30)]
    assert [*zip(*[x.tolist() for x in RunIndex(texts, least).repeats()])] == repeated_places(texts, least)


def test_run_index_of_short_and_empty_texts():
    draw = random.Random(1)
    for _ in range(400):
        least = draw.choice([1, 2, 3, 5, 8])
        texts = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 12))).encode() for _ in range(draw.randint(1, 4))]
        assert [*zip(*[x.tolist() for x in RunIndex(texts, least).repeats()])] == repeated_places(texts, least)


def test_streamed_statistics():
    """Row, length and place above of every suffix, against sorted suffixes."""
    texts, least = [b"banana", b"ananas", b"", b"bandana"], 3
    index = RunIndex(texts, least)
    codes = [c for t, text in enumerate(texts) for c in [*(b + 1000 for b in text), t]]
    order = sorted(range(len(codes)), key=lambda p: codes[p:])
    shared = lambda p, q: next(k for k in range(len(codes)) if codes[p + k] != codes[q + k])
    want = [(r, p, order[r - 1]) for r, p in enumerate(order) if r and shared(p, order[r - 1]) >= least]
    assert sorted(zip(*[x.tolist() for x in index.matches()])) == want
    assert len(index.samples) == len(index.reach) == len(index.starts) < len(codes)


def test_repeated_passages_awkward(spark):
    rows = repeats.without_repeats(awkward(spark), digest=True).collect()
    assert len(rows) == len(AWKWARD)
    removed = {r["doc_id"]: r["n_removed"] for r in rows}
    assert removed[9] == 60_000 - 1 and removed[8] == 150_000 - 5 and removed[5] == 0
    assert repeats.without_repeats(awkward(spark, [])).count() == 0


def test_equal_windows_choose_alike_in_slabs_of_any_length(monkeypatch):
    """Hashes that differ in their low bits only: which of them count must not depend on the length of the slab."""
    from seamline.llm import anchors
    from seamline.llm.fast_words import slabs, stretch_hash

    monkeypatch.setattr(anchors, "stretch_hash", lambda *a: stretch_hash(*a) & np.uint64((1 << 20) - 1))
    passage = " ".join(f"word{i * 7919 % 1009}" for i in range(60)).encode()
    chosen = []
    for after in (b"", b" x" * 700_000):
        text, anchor, start, count, _ = anchors.pieces(next(slabs([passage + after], 1 << 21)))
        chosen.append([(a, s, c) for a, s, c in zip(anchor.tolist(), start.tolist(), count.tolist()) if s + c + anchors.WINDOW < len(passage) - anchors.WINDOW])
    assert len(chosen[0]) > 2 and chosen[0] == chosen[1]


def test_a_tile_takes_little_more_room_than_its_counts(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "CELLS", 1 << 18)
    n, size = 4096, 20
    bodies = np.arange(n * size) // (2 * size) * size + np.arange(n * size) % size  # neighbours are alike
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size).astype(np.int32)), pa.array(bodies))
    ids = pa.array(np.arange(n))
    tile = pa.table({"node": ids, "root": ids, "body": lists})
    left, right = np.arange(0, n, 2), np.arange(1, n, 2)
    tracemalloc.start()
    found = near_dedup._links(0.8)(tile, left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(found[1].to_pylist(), found[0].to_pylist())) == [(i, i + 1) for i in range(0, n, 2)]
    assert peak < 3 * len(left) * len(right) * 4


def test_workers_give_arrow_memory_back_after_a_task(monkeypatch):
    """Kept workers would hold it beside the stages that follow."""
    texts = [f"words of a text told {i} times over and over again" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([str(i) for i in range(50)]), pa.array(texts)], ["doc_id", "key", "plain"])
    done = []

    class Pool:
        def release_unused(self):
            done.append(True)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert sum(b.num_rows for b in near_dedup._sign([batch])) == 50 and done == [True]
    list(quality._count([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert len(done) == 2
    fast_words._POWERS.clear()
    fast_words.powers(1000)
    assert len(fast_words.powers(1000)[0]) == 1000 and len(fast_words._POWERS["up"]) == 1024


def test_a_worker_empties_the_cache_of_a_stage_when_another_begins(monkeypatch):
    """Packing's words stayed beside the stages of the next table."""
    monkeypatch.setattr(fast_words, "_KEPT", [])
    batch = pa.RecordBatch.from_arrays([pa.array(["a few words"])], ["text"])
    known = functools.lru_cache(str.upper)
    count = lambda batches: (b.num_rows + len(known(t.as_py())) for b in batches for t in b.column("text"))
    for _ in range(2):  # kept from task to task
        assert list(fast_words.giving_back(count, known)([batch])) == [12] and known.cache_info().currsize == 1
    assert known.cache_info().misses == 1
    list(quality._count([batch]))
    assert known.cache_info().currsize == 0 and fast_words._KEPT == []


def test_packing_gives_its_words_back(spark):
    """Seen in a worker: packing, then quality in the same process."""
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(20)], "doc_id long, text string").coalesce(1)

    def held(batches):
        for batch in batches:
            before = packing.byte_bpe.cache_info().currsize
            list(quality._count([batch.select(["text"])]))
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([before]), pa.array([packing.byte_bpe.cache_info().currsize])], ["pid", "before", "after"])

    for _ in range(20):  # until the task meets a worker that has packed
        packing.pieces(docs).collect()
        found = docs.mapInArrow(held, "pid long, before long, after long").collect()
        if found[0]["before"]:
            break
    assert [(r["before"], r["after"]) for r in found] == [(1, 0)]
