"""Conversation tries, benchmark passages and centroid clusters against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from helpers import awkward

from seamline.llm import centroids, decontamination, prefix_trie
from seamline.llm.word_search import WordSearch

TURNS = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    """The nodes by walking every prefix of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), digest(f"{len(role)}:{role}{text}"), role, text))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ending = defaultdict(list), defaultdict(list)
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole = tuple(turns.get(base, [])[:h] + ts[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ending[whole].append(c)
    own_tokens = lambda p: (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in list(members):
        for d in range(len(p) + 1):
            saved[p[:d]] += own_tokens(p)
            leaves[p[:d]] += p not in children
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], digest(",".join(map(str, sorted(ending.get(p, []))))))
        for p, m in members.items()
    )


def trie(spark, rows):
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect())


def conversations(draw, n, longest):
    rows = []
    for conv in draw.sample(range(-120, 250), n):
        for turn in range(draw.randint(0, longest)):
            rows.append((conv, draw.choice([turn, turn, turn, 3, None]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "bb", "é🙂", None, "", "1:x"])))
    return rows + [(100, t, "user", "a") for t in range(6)] + [(None, 1, "user", "nobody")] + [(101, 2, "u", "same")] * 4


def test_trie(spark):
    draw = random.Random(5)
    rows = conversations(draw, 60, 9)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_long_and_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(200, 240) for t in range(7)] + [(7, t, "system", f"{t % 3}" * 40) for t in range(40)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_trie_corner_cases(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(1, 0, "u", "x")], [(4, None, None, None)], [(5, 0, "u", "x"), (5, 1, "u", "y")]):
        assert trie(spark, rows) == plain_trie(rows)
    clashing = spark.createDataFrame([(1, 0, "u", "x", "y", 3, 4)], TURNS + ", symbol string, at long, part int")
    assert [tuple(r) for r in prefix_trie.prefix_trie(clashing).orderBy("depth").collect()] == plain_trie([(1, 0, "u", "x")])


def test_positions_over_partitions(spark):
    rows = [(c, t, "u", str(t)) for c in (1, 2, 3) for t in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.turns(spark.createDataFrame(rows, TURNS)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    at = {(r["conv_id"], bytes(r["symbol"])): r["at"] for r in got}
    assert all(at[c, hashlib.sha256(f"1:u{t}".encode()).digest()] == t for c in (1, 2, 3) for t in range(900))


def word_list(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = word_list(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(item)
    out = []
    for doc, text in docs:
        words, hit, named = word_list(text), set(), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                if (w := tuple(words[i : i + length])) in windows:
                    hit.update(range(i, i + length))
                    named |= windows[w]
        names = sorted(str(i) for i in named if i is not None)
        out.append((doc, len(words), len(hit), len(names), digest(",".join(names)), bool(hit)))
    return sorted(out, key=repr)


def passages(draw):
    vocabulary = ["a", "b", "The", "née", "42", "x-y", "日本", "don't"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([2, 4, 9, 10, 11, 25]))) for i in range(25)] + [(3, "second text of one item that has ten words or more"), (None, "nobody owns these words"), (90, None), (91, ""), (92, "?!"), (93, "zebra")]
    items += [(200 + i, "one passage that stands in many items of the benchmark table at once") for i in range(30)]
    docs = [(i, text(draw.choice([0, 3, 12, 60]))) for i in range(60)]
    docs += [(200 + i, f"{text(4)} {draw.choice([t for _, t in items if t])} {text(6)}") for i in range(40)]
    return docs + [(1, "a zebra! ZEBRA"), (2, None), (None, "nobody owns these words"), (2, "zebra"), (2, "zebra")], items


def test_benchmark_passages(spark):
    docs, items = passages(random.Random(9))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slice_rows in (100_000, 40):
        got = decontamination.digests(decontamination.contaminated(*frames, slice_rows=slice_rows))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_hits(docs, items)


def test_benchmark_passages_corner_cases(spark):
    items = spark.createDataFrame([(1, "the same text told twice", 5, "x")], "item_id long, text string, row int, window string")
    none, docs = items.limit(0), awkward(spark)
    got = decontamination.contaminated(docs, items).collect()
    assert len(got) == docs.count() and sum(len(r["spans"]) > 0 for r in got) == 4
    assert all(r["items"] == ([1] if r["spans"] else []) for r in got)
    assert {r["n_words"] for r in got} >= {0, 1, 5, 30_000}
    assert all(not r["spans"] for r in decontamination.contaminated(docs, none).collect())
    assert decontamination.contaminated(awkward(spark, []), items).count() == 0


def test_slabs_lose_nothing():
    draw = random.Random(2)
    for _ in range(200):
        words = [draw.choice("abc") for _ in range(draw.randint(0, 60))]
        patterns = {tuple(draw.choice("abc") for _ in range(draw.choice([1, 2, 3, 5, 10]))) for _ in range(4)}
        search = WordSearch([w.encode() for w in p] for p in patterns)
        whole = search.spans(" ".join(words))
        hit = {k for p in patterns for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p for k in range(i, i + len(p))}
        assert {k for a, b in whole[1] for k in range(a, b)} == hit
        assert all(search.spans(" ".join(words), size) == whole for size in (1, 7, 30))


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((digest(f"1:{i}"), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, vs in own.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    spent = defaultdict(int)
    for _, c, d in found:
        spent[c] += d
    return sorted(((i, c, d, spent[c], sum(spent.values()), digest(",".join(map(str, centres[c])))) for i, c, d in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, [3]) for i, v in rows], "vec_id long, embedding array<double>, id int, cluster int, numbers array<int>")


def test_clusters(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i), (draw.normal(size=64) * draw.choice([0.1, 1, 30]) + draw.choice([-2, 0, 5])).tolist()) for i in range(300)]
    rows += [(7, rows[7][1])] * 5 + [(None, rows[3][1]), (8, None), (9, []), (10, [1.0] * 63), (11, [1.0] * 63 + [None]), (12, [float("nan")] * 64), (13, [float("inf")] + [0.0] * 63), (14, [0.0] * 64)]
    got = centroids.with_inertia(vectors(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows)


def test_clusters_of_few_vectors(spark):
    for rows in ([(1, [0.5] * 64)], [(1, [0.5] * 64), (2, [0.5] * 64), (2, [-0.25] * 64)]):
        assert sorted(tuple(r) for r in centroids.with_inertia(vectors(spark, rows)).collect()) == plain_clusters(rows)
    for rows in ([], [(None, [1.0] * 64)], [(3, [1e30] * 64)]):
        assert centroids.with_inertia(vectors(spark, rows)).count() == 0


def test_search_is_exact_and_skips():
    draw = np.random.default_rng(1)
    for scale, offset in ((50, 0), (3, 2**26), (2**25, 0), (0, 5)):
        points = np.rint(draw.normal(size=(400, 8)) * scale + offset * draw.integers(0, 2, size=(400, 1))).astype(np.int64)
        centres = points[draw.choice(400, 60)]
        search = centroids.Search(centres)
        number, distance, done = search.nearest(points, points.sum(axis=1), (points**2).sum(axis=1))
        every = ((points[:, None] - centres) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert done <= every.size
    spread = np.arange(0, 60_000, 1000)[:, None] * np.ones(8, np.int64)
    _, _, done = centroids.Search(spread).nearest(spread + 3, (spread + 3).sum(axis=1), ((spread + 3) ** 2).sum(axis=1))
    assert done < 4 * len(spread)
