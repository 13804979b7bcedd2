"""Image hashes, neighbours, evidence, decisions, memory and families, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import dedup, images, transfer

SIGNED = "id long, category string, label int, name_n string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def distance(a, b):
    return sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b))


def pictures(seed=3, n=90):
    r = random.Random(seed)
    base = [[signed(r.getrandbits(64)) for _ in range(4)] for _ in range(12)]
    rows = []
    for i in range(n):
        for _ in range(r.randint(1, 2)):
            words = list(r.choice(base))
            for _ in range(r.randint(0, 5)):
                k = r.randrange(4)
                words[k] = signed((words[k] ^ (1 << r.randrange(64))) & ((1 << 64) - 1))
            rows.append((i, f"sha{r.randrange(40)}", words))
    return rows + [(n, None, None)]


def test_words_of_grey(spark):
    grey = [(x * 7 + y * 13 + (x * y) % 5) % 256 for y in range(16) for x in range(17)]
    bits = "".join("1" if grey[y * 17 + x + 1] > grey[y * 17 + x] else "0" for y in range(16) for x in range(16))
    want = [signed(int(bits[i : i + 64], 2)) for i in range(0, 256, 64)]
    assert spark.createDataFrame([(grey,)], "g array<int>").select(images.words_of_grey(F.col("g")).alias("w")).first().w == want


@pytest.mark.parametrize("hot", [2048, 1])
def test_near_codes_lose_nothing(spark, hot):
    rows = [("c", w) for _, _, w in pictures() if w] + [("c", [0, 0, 0, k]) for k in range(40)] + [("d", [0, 0, 0, 1])]
    df = spark.createDataFrame(rows, "category string, words array<long>")
    got = {(r.category, tuple(r.x), tuple(r.y)): r.dist for r in images.near_codes(df, df, 4, hot=hot).collect()}
    every = {(c, tuple(w)) for c, w in rows}
    assert got == {(c, x, y): distance(x, y) for c, x in every for d, y in every if c == d and distance(x, y) <= 4}


def test_order_of_nearest(spark):
    index = spark.createDataFrame([(i, "c", [w, 0, 0, 0], 1, "n") for i, w in enumerate((0, 1, 3, 7))], "id long, category string, words array<long>, label int, name_n string")
    asked = spark.createDataFrame([("c", [0, 0, 0, 0])], "category string, words array<long>")
    rows = sorted((r["rank"], r.id, r.dist) for r in images.nearest_images(asked, index, 2, 4).collect())
    assert rows == [(1, 0, 0), (2, 1, 1), (3, 2, 2)]
    assert [r.id for r in images.nearest_images(asked, index, 9, 1).collect()] == [0]


@pytest.mark.parametrize("leave_out", [False, True])
def test_evidence_and_decisions(spark, leave_out):
    r = random.Random(5)
    pics = pictures(7)
    cards = [(i, r.choice(["s", "f", "x"]), r.choice([0, 1, 1, 1, None]), f"n{i % 2}") for i in range(92)]
    of = {c[0]: c for c in cards}
    c, p = spark.createDataFrame(cards, SIGNED), spark.createDataFrame(pics, "id long, sha string, words array<long>")
    index = images.retrieval_index(c, p)
    near, exact = {}, {}
    for i, category, _, name in cards:
        mine = [x for x in pics if x[0] == i and x[1]]
        found = {}
        for words in {tuple(x[2]) for x in mine}:
            every = sorted({(distance(words, x[2]), x[0], tuple(x[2])) for x in pics if x[2] and of[x[0]][1] == category and of[x[0]][2] is not None}, key=lambda t: (t[0], t[1], [v & ((1 << 64) - 1) for v in t[2]]))
            for d, j, _ in [t for t in every if t[0] <= 4][:5]:
                if not (leave_out and j == i):
                    found[j] = min(d, found.get(j, 257))
        for j, d in found.items():
            near[i, j] = (d, of[j][2], of[j][3] == name)
        shas = {x[1] for x in mine}
        exact[i] = {x[0] for x in pics if x[1] in shas and of[x[0]][1] == category and of[x[0]][2] is not None and not (leave_out and x[0] == i)}
    got = {(x.query_id, x.id): (x.dist, x.label, x.same_name) for x in images.perceptual_records(c, p, index, k=5, leave_out=leave_out).collect()}
    assert got == near and len(got) > 30
    summary = {x.query_id: (x.n_exact, x.exact_low, x.exact_high, x.exact_same) for x in images.exact_summary(c, p, index, leave_out).collect()}
    assert summary == {i: (min(2, len(s)), min(of[j][2] for j in s), max(of[j][2] for j in s), any(of[j][3] == of[i][3] for j in s)) for i, s in exact.items() if s}
    decided = {x.id: (x.image_decision, x.image_reason) for x in images.image_decisions(c, p, index, "s", "f", k=5, leave_out=leave_out).collect()}
    for i, category, _, _ in cards:
        labels = {of[j][2] for j in exact[i]}
        same = {v[1] for k, v in near.items() if k[0] == i and v[2]}
        e, n = (labels.pop() if len(labels) == 1 else None), (same.pop() if len(same) == 1 else None)
        if exact[i] and e is None:
            want = (None, "exact_sha256_conflict")
        elif e is not None and n is not None and e != n:
            want = (None, "image_conflict")
        elif e is not None:
            many = category == "s" and len(exact[i]) >= 2 and any(of[j][3] == of[i][3] for j in exact[i])
            want = (e, "exact_sha256_multi_name") if many else (None, "exact_sha256_observe")
        elif n is not None and (category == "f" or category == "s" and n == 1):
            want = (n, "dhash_name_positive" if n else "dhash_name_negative")
        else:
            want = (None, "image_abstain")
        assert decided[i] == want, (i, decided[i], want)
    assert images.image_decisions(c.limit(0), p, index, "s", "f").count() == 0


def test_memory_cascade(spark):
    rows = [(i, "c", [i % 4, 0, 0, -1], int(i % 4 == 3), f"t{i}", f"s{i}") for i in range(16)]
    train = spark.createDataFrame(rows, "id long, category string, words array<long>, label int, text_key string, sha string")
    asked = spark.createDataFrame([(1, "c", [0, 0, 0, -1], "t3", "s0"), (2, "c", [0, 0, 0, -1], "?", "s3"), (3, "c", [63 << 20, 0, 0, -1], "?", "?"), (4, "c", [1 << 50, 1 << 50, 7, 0], None, None), (5, "d", [0, 0, 0, -1], "t3", "s3")], "id long, category string, words array<long>, text_key string, sha string")
    votes = images.memory_votes(asked, train, purity=0.7)
    got = {r.id: (r.memory_label, r.memory_source) for r in transfer.memory_lookup(asked, transfer.unanimous_keys(train, F.col("text_key")), transfer.unanimous_keys(train, F.col("sha")), votes).collect()}
    # 3: only the four at distance 6 vote
    assert got == {1: (1, "text"), 2: (1, "sha"), 3: (0, "dhash"), 4: (None, None), 5: (None, None)}


def test_families_by_images(spark):
    pics = [x for x in pictures(11, 60) if x[2]]
    df = spark.createDataFrame([(i, s, w) for i, s, w in pics], "id long, sha string, words array<long>")
    got = {r.id: r.family for r in dedup.families(images.hash_edges(df)).collect()}
    parent = {i: i for i, _, _ in pics}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _, a in pics:
        for j, _, b in pics:
            if i < j and distance(a, b) <= 6:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    want = {i: root(i) for i in parent}
    assert got == {i: f for i, f in want.items() if list(want.values()).count(f) > 1}


def few_bits(n=300):
    """Products with codes that vary in 9 bits only, so that keys bring all of them together, beside a category of codes that vary in all."""
    r = random.Random(13)
    cards = [(i, "s" if i % 3 else "f", r.choice([0, 1, 1, None]), f"n{i % 2}") for i in range(n)] + [(n + i, "w", i % 2, "n0") for i in range(60)]
    pics = [(i, f"sha{i}", [r.getrandbits(8), -r.randint(0, 1), -(2**63), 5]) for i in range(n) for _ in range(2)] + [(n + i, f"sha{i}", [signed(r.getrandbits(64)) for _ in range(4)]) for i in range(60)]
    return cards, pics


@pytest.mark.parametrize("tile", [1 << 15, 70])
def test_crowded_categories_meet_once(spark, monkeypatch, tile):
    cards, pics = few_bits()
    c, p = spark.createDataFrame(cards, SIGNED), spark.createDataFrame(pics, "id long, sha string, words array<long>")
    index, of = images.retrieval_index(c, p), {x[0]: x for x in cards}
    asked = c.join(p, "id").select("category", "words").distinct()
    monkeypatch.setattr(images, "FEW_PAIRS", 1)
    monkeypatch.setattr(images, "TILE_X", tile)
    monkeypatch.setattr(images, "TILE_Y", tile)
    assert {x.category for x in images._crowded(asked, index["dhash"], 4).collect()} == {"s", "f"}
    got = {}
    for x in images.nearest_images(asked, index["dhash"], 4, 6).collect():
        got.setdefault((x.category, tuple(x.words)), []).append((x["rank"], x.dist, x.id, x.label, x.name_n))
    want = {}
    known = {(of[i][1], i, tuple(w)) for i, _, w in pics if of[i][2] is not None}
    for category, words in {(of[i][1], tuple(w)) for i, _, w in pics}:
        near = sorted((distance(words, w), i, [v & ((1 << 64) - 1) for v in w]) for k, i, w in known if k == category and distance(words, w) <= 4)[:6]
        if near:
            want[category, words] = [(n + 1, d, i, of[i][2], of[i][3]) for n, (d, i, _) in enumerate(near)]
    assert {k: sorted(v) for k, v in got.items()} == want
    main = p.where("id % 2 = 0").dropDuplicates(["id"]).select("id", "words").join(c, "id")
    rows = main.collect()
    votes = {x.id: x.dhash_label for x in images.memory_votes(main, main, 3, 0.7).collect()}
    for x in rows:
        labels = [y.label for y in rows if y.category == x.category and y.label is not None and distance(x.words, y.words) <= 3]
        share = sum(labels) / len(labels) if labels else None
        assert (x.id in votes) == bool(labels)
        assert not labels or votes[x.id] == ((1 if share > 0.5 else 0) if max(share, 1 - share) >= 0.7 else None)


@pytest.mark.parametrize("leave_out", [False, True])
def test_summary_by_name_is_that_of_records(spark, monkeypatch, leave_out):
    cards, pics = few_bits(120)
    c, p = spark.createDataFrame(cards, SIGNED), spark.createDataFrame(pics, "id long, sha string, words array<long>")
    index = images.retrieval_index(c, p)
    want = {}
    for x in images.perceptual_records(c, p, index, k=9, leave_out=leave_out).collect():
        if x.same_name:
            want.setdefault(x.query_id, []).append(x.label)
    monkeypatch.setattr(images, "FEW_PAIRS", 1)
    got = {x.query_id: (x.near_low, x.near_high) for x in images.near_summary(c, p, index, k=9, leave_out=leave_out).collect()}
    assert len(got) > 60 and got == {i: (min(v), max(v)) for i, v in want.items()}


@pytest.mark.parametrize("leave_out", [False, True])
@pytest.mark.parametrize("tile", [1 << 15, 70])
def test_codes_soon_compared_are_not_keyed(spark, monkeypatch, leave_out, tile):
    cards, pics = few_bits(120)
    c, p = spark.createDataFrame(cards, SIGNED), spark.createDataFrame(pics, "id long, sha string, words array<long>")
    index = images.retrieval_index(c, p)
    decisions = lambda: {x.id: tuple(x) for x in images.image_decisions(c, p, index, "s", "f", k=9, leave_out=leave_out).collect()}
    near = lambda: {x.query_id: (x.near_low, x.near_high) for x in images.near_summary(c, p, index, k=9, leave_out=leave_out).collect()}
    want, by_keys = decisions(), near()

    def keyed(*_):
        raise AssertionError("keys of codes whose pairs are few enough to be compared")

    monkeypatch.setattr(images, "_keyed", keyed)
    monkeypatch.setattr(images, "FEW_PAIRS", 1)
    monkeypatch.setattr(images, "TILE_X", tile)
    monkeypatch.setattr(images, "TILE_Y", tile)
    assert near() == by_keys and len(by_keys) > 60
    assert decisions() == want


def test_many_codes_are_keyed_unless_crowded(spark, monkeypatch):
    cards, pics = few_bits(120)
    c, p = spark.createDataFrame(cards, SIGNED), spark.createDataFrame(pics, "id long, sha string, words array<long>")
    index = images.retrieval_index(c, p)
    asked = c.join(p, "id").select("category", "words")
    main = p.dropDuplicates(["id"]).select("id", "words").join(c, "id")
    found = lambda: sorted(tuple(map(str, x)) for x in images.nearest_images(asked, index["dhash"], 4, 6).collect())
    votes = lambda: {x.id: x.dhash_label for x in images.memory_votes(main, main, 3, 0.7).collect()}
    want, voted = found(), votes()
    monkeypatch.setattr(images, "FEW_PAIRS", 1)
    monkeypatch.setattr(images, "SOME_PAIRS", 1)
    tiled, keyed = images._searched(asked, index["dhash"], 4, 6)
    assert {x.category for x in tiled[0].select("category").distinct().collect()} == {"s", "f"}
    assert {x.category for x in keyed.select("category").distinct().collect()} == {"w"}
    assert found() == want and votes() == voted


@pytest.mark.parametrize("few", [1, 1 << 20])
def test_words_without_value_are_near_nothing(spark, monkeypatch, few):
    monkeypatch.setattr(images, "FEW_PAIRS", few)
    rows = [(0, "c", 1, "n", [0, 0, 0, 0]), (1, "c", 1, "n", [1, 0, 0, 0]), (2, "c", 0, "n", [0, None, 0, 0]), (3, "c", 0, "n", [1, None, 0, 0]), (4, "c", 0, "n", None)]
    df = spark.createDataFrame(rows, "id long, category string, label int, name_n string, words array<long>")
    assert sorted((x.words[0], x.id, x.dist) for x in images.nearest_images(df, df, 4, 9).collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]
    assert {x.id: x.dhash_label for x in images.memory_votes(df, df).collect()} == {0: 1, 1: 1}


def test_packed_words_keep_distances():
    r = np.random.default_rng(4)
    narrow = np.stack([r.integers(0, 1 << 9, 80), -r.integers(0, 4, 80), np.full(80, -(2**63)), r.integers(0, 2, 80)], axis=1)
    for codes, most_bits in [(narrow, 32), (r.integers(-(2**63), 2**63 - 1, (80, 4)), 256), (np.array([[0, 0, 0, 0], [-1, -1, -1, -1]] * 40), 5)]:
        x, y = codes[:30].view(np.uint64), codes[30:].view(np.uint64)
        assert images._packed(x, y, 4)[2] <= most_bits
        for at, d in images._distances(x, y, 4):
            want = np.array([[distance(a, b) for b in codes[30:].tolist()] for a in codes[:30].tolist()])[at : at + len(d)]
            assert (np.minimum(d, 5) == np.minimum(want, 5)).all()
