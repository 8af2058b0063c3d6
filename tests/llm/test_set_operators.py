"""Operators that compare texts or vectors: against brute force on small corpora."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.llm import jaccard, toxicity
from pixelspark.llm.components import connected_components
from pixelspark.llm.decontamination import contamination
from pixelspark.llm.embeddings import near_duplicates
from pixelspark.llm.repeats import remove_repeats
from pixelspark.llm.scratch import Scratch
from pixelspark.llm.sharding import cuts_within, level_cuts, shard_by_bytes, smallest_capacity

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def corpus(seed, n=120):
    """Random texts, exact copies, near copies, a shared passage, short ones, nulls."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    base, passage, out = text(90), text(40), []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = base
        elif kind in (1, 2):
            w = base.split()
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 3:
            t = f"{text(30)} {passage} {text(30)}"
        elif kind == 4:
            t = text(rng.randint(0, 6))
        else:
            t = text(rng.randint(20, 120)).title()
        out.append((1000 - i, t))
    return [*out, (5000, None), (5001, ""), (5002, "   ")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, n string, key int, bucket int")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("seed,short_list,more", [(1, 16, {}), (2, 1, {}), (3, 1, {}), (4, 4, {"often": 10}), (5, 1, {"often": 10, "fan": 4, "part_tokens": 40}), (6, 16, {"fan": 2})])
def test_jaccard_equals_brute_force(spark, seed, short_list, more):
    """Also with hot tokens (``often``) and with exchanges in two steps (``fan``)."""
    rows = corpus(seed)
    sets, u = {i: shingles(t) for i, t in rows}, Union()
    for a, sa in sets.items():
        for b, sb in sets.items():
            if a < b and sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                u.join(a, b)
    got = jaccard.jaccard_components(frame(spark, rows), short_list=short_list, **more).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), u.find(r["doc_id"]))


def test_jaccard_odd_rows(spark):
    rows = [(7, "a b c"), (7, "a b c"), (None, "A b C"), (3, "a b c d e f"), (4, None)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == [(0, 1, 7), (3, 2, 3), (4, 0, 4), (7, 1, 7), (7, 1, 7)]
    assert jaccard.jaccard_components(frame(spark, rows).limit(0)).isEmpty()
    assert jaccard.jaccard_components(frame(spark, [(1, None), (2, "")])).count() == 2


def test_pack_round_trip():
    for v in (np.array([0], np.uint64), np.array([3, 255, 2**40], np.uint64)):
        assert (jaccard.widen(jaccard.narrow(v)) == v).all()
    for v in (np.array([], np.uint64), np.array([0, 5, 2**47], np.uint64), np.sort(np.random.default_rng(1).integers(0, 2**48, 999)).astype(np.uint64)):
        assert (jaccard.unpack(jaccard.pack(v)) == v).all() and (jaccard.unpack(jaccard.pack(v, step=True)) == v).all()


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            if s in seen:
                hit[p : p + window] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out[i] = (len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed,window,k,more", [(4, 100, 36, {}), (5, 30, 11, {}), (6, 20, 20, {}), (7, 300, 60, {}), (8, 100, 36, {"often": 10}), (9, 30, 11, {"often": 10, "fan": 4, "part_bytes": 2000}), (4, 100, 36, {"fan": 2, "part_bytes": 9000})])
def test_repeats_equal_brute_force(spark, seed, window, k, more):
    """Also with hot anchors (``often``) and with exchanges in two steps (``fan``)."""
    rows = [*corpus(seed), (6000, "ab" * 300), (6001, "z" * 500), (6002, "\0" * 250 + "q" + "\0" * 120)]
    want = brute_repeats(rows, window)
    got = remove_repeats(frame(spark, rows), window, k, **more).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def test_repeats_in_pieces_and_with_odd_ids(spark, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(2, long), (2, long), (None, long[500:900]), (1, "short"), (3, None)]
    monkeypatch.setattr("pixelspark.llm.repeats.PIECE", 700)  # pickled with the functions
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 0), (2, 0), (2, 3000), (3, 0), (99, 400)]
    assert remove_repeats(frame(spark, rows).limit(0)).isEmpty()


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["same text", "x" * rng.randint(0, 400)]) if i % 3 else None) for i in range(600)]
    got = shard_by_bytes(frame(spark, rows), shards=10).toPandas()
    assert len(got) == 600 and got.groupby("text_md5").shard.nunique().max() == 1 and set(got.shard) <= set(range(10))
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    size = got.groupby("text_md5")["size"].sum().sort_values(ascending=False)
    left, alone = int(size.sum()), 0
    while alone < 9 and size.iloc[alone] * (10 - alone) > left:
        left -= int(size.iloc[alone])
        alone += 1
    rest = [int(v) for _, v in sorted(size.iloc[alone:].items())]
    assert alone and got.groupby("shard")["size"].sum().max() == max(int(size.iloc[0]), smallest_capacity(rest, 10 - alone))
    odd = shard_by_bytes(frame(spark, [(None, None), (1, "a"), (1, "a")]), shards=4).toPandas()
    assert len(odd) == 3 and odd[odd.doc_id == 1].shard.nunique() == 1 and sorted(odd[odd.doc_id == 1].slot) == [0, 1]
    assert shard_by_bytes(frame(spark, rows).limit(0)).isEmpty()


def test_shards_of_many_repeated_rows(spark):
    """One row, without an id, repeated more often than what gets its slots at once."""
    many = spark.range(140_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = shard_by_bytes(many.unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"))), shards=3)
    per = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.countDistinct("text_md5").alias("texts")).collect()
    assert sorted(tuple(r)[1:] for r in per) == [(50, 50, 0, 49, 1), (140_000, 140_000, 0, 139_999, 1)]


def brute_capacity(sizes, shards):
    """The least largest sum over all ways to cut the sequence, by dynamic programming."""
    total = [0]
    for v in sizes:
        total.append(total[-1] + v)
    best = [0, *[float("inf")] * len(sizes)]
    for _ in range(shards):
        best = [0] + [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(1, len(total))]
    return best[-1]


def test_capacity_equals_brute_force():
    rng = random.Random(6)
    for _ in range(80):
        sizes, shards = [rng.randint(1, 30) for _ in range(rng.randint(0, 25))], rng.randint(1, 8)
        assert smallest_capacity(sizes, shards) == brute_capacity(sizes, shards)


def test_shards_of_a_long_text_and_of_one_hot_row(spark):
    rows = [(1, "é" * 2_000_000), *[(2, "again")] * 300, *[(None, None)] * 200, *[(i, f"text {i}") for i in range(10, 400)]]
    got = shard_by_bytes(frame(spark, rows), shards=7).toPandas()
    assert len(got) == len(rows) and int(got["size"].max()) == 4_000_016
    assert got.groupby("text_md5").shard.nunique().max() == 1
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))


def test_capacity_is_the_smallest_and_cuts_keep_it():
    rng = random.Random(5)
    for _ in range(60):
        sizes, shards = [rng.randint(1, 30) for _ in range(rng.randint(1, 40))], rng.randint(1, 9)
        c = smallest_capacity(sizes, shards)
        assert cuts_within(sizes, shards, c) and cuts_within(sizes, shards, c - 1) is None
        ends = level_cuts(sizes, shards, c)
        assert ends[-1] == len(sizes) and all(sum(sizes[a:b]) <= c for a, b in zip([0, *ends], ends, strict=False))


@pytest.mark.parametrize("block", [100_000, 7])
def test_contamination_equals_brute_force(spark, block):
    rows = corpus(7, 60)
    text = dict(rows)
    words = lambda t: WORDS.findall((t or "").translate(LOW))
    items = [(1, " ".join(text[1000].split()[10:40])), (12, " ".join(text[997].split()[25:50]).upper()), (3, "abc"), (4, " ".join(text[995].split()[:2])), (5, None), (6, ".!"), (None, " ".join(text[1000].split()[20:32])), (12, "a b")]
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s : s + 10]), set()).update(() if i is None else (str(i),))
    got = contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=block, lot=10 * block).collect()
    assert len(got) == len(rows)
    for r in got:
        w, hit, ids = words(text[r["doc_id"]]), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[tuple(w[s : s + n])]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest() and r["contaminated"] == bool(hit)


def test_contamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    rows = [(7, "x one two"), (7, "x one two"), (None, "one two"), (3, None), (7, "nothing")]
    got = sorted((r["doc_id"] or 0, r["n_hit"]) for r in contamination(frame(spark, rows), items).collect())
    assert got == [(0, 2), (3, 0), (7, 0), (7, 2), (7, 2)]
    assert contamination(frame(spark, rows), items.limit(0)).where("contaminated").isEmpty()
    assert contamination(frame(spark, rows), items.limit(0)).count() == 5
    assert contamination(frame(spark, rows).limit(0), items).isEmpty()


def test_contamination_long_words_and_hot_windows(spark):
    """Windows whose words are very long, a window in many items, one that covers a whole long text."""
    big = [c * 3000 for c in "abcdefghijklm"]
    items = [(1, " ".join(big)), (2, " ".join(big[:9] + ["z"]))] + [(i, "one two three") for i in range(100, 400)]
    rows = [(1, "q " + " ".join(big[1:12])), (2, " ".join(big[:9])), (3, "one two three " * 20_000), (4, "one two"), (5, " ".join(big[:9] + ["zz"]))]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (12, 11, ["1"]), 2: (9, 0, []), 3: (60_000, 60_000, [str(i) for i in range(100, 400)]), 4: (2, 0, []), 5: (10, 0, [])}


@pytest.mark.parametrize("more", [{}, {"block": 4, "hot": 3}])
def test_embeddings_equal_brute_force(spark, more):
    """Also with buckets cut into blocks and copies dealt over several keys."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=16) * (0.0 if i % 3 == 0 else 0.06)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[0][1], None), (304, [1.0], 0), (305, [2.0], 0), (306, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit("x"))
    got = {r["vec_id"]: r for r in near_duplicates(df, **more).collect()}
    m = np.array([r[1] for r in rows[:300]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:300]])
    link = (m @ m.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    assert sum(got[i]["n_links"] for i in range(300)) >= 0.99 * link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(300))
    u = Union()
    for a, b in zip(*np.nonzero(link), strict=True):
        u.join(int(a), int(b))
    assert sum(got[i]["component_id"] != u.find(i) for i in range(300)) <= 3
    for i in (300, 301, 302, 303, 306):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[304]["n_links"] == got[305]["n_links"] == 1 and got[305]["component_id"] == 304
    assert near_duplicates(df.limit(0)).isEmpty()


def test_embedding_labels_and_sizes(spark):
    """Labels stay apart whatever they contain; huge, tiny and very long vectors are compared as others are."""
    long = [float(i % 7) for i in range(20_000)]
    rows = [(1, [2.0], "a,1.0"), (2, [1.0, 2.0], "a"), (3, [1e200, 1e200], "b"), (4, [1.1e200, 1.1e200], "b"), (5, [1e-310, 1e-310], "b"), (6, [1.0, -1.0], "b"), (7, [1.7e308, -1.7e308], "b")]
    rows += [(8, long, "c"), (9, [x * 3 for x in long], "c"), (9, long, "c"), (None, long, "c"), (None, None, "c"), (10, [0.0, -0.0], "b"), (11, [-0.0, 5.0], "b"), (12, [0.0, 5.0], "b"), (13, [1.0, None], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    want = [(0, 3, 8, False), (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 1, 6, True), (7, 1, 6, False)]
    want += [(8, 3, 8, True), (9, 3, 8, False), (9, 3, 8, False), (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False), (13, 0, 13, True)]
    assert [g for g in got if g[2] is not None] == want and [g for g in got if g[2] is None] == [(0, 0, None, True)]


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    links += [(200, 200), *((300 + i, 300) for i in range(1, 50))]
    u = Union()
    for a, b in links:
        u.join(a, b)
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: u.find(x) for e in links for x in e if e[0] != e[1]}


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        w = [word() for _ in range(rng.randint(5, 60))]
        if bad:
            w += rng.sample(["nasty", "vile", "awful", "gross"], 3)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "nasty vile awful")]
    labels += [(7000, 1), (None, 1), (3, None)]
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    known = got[got.doc_id < 1200]
    truth = known.doc_id % 8 == 0
    assert known[truth].predicted.mean() > 0.9 and known[~truth].predicted.mean() < 0.02
    assert got[got.doc_id.isin([5000, 5001])].score.nunique() == 1 and not got[got.doc_id.isin([5000, 5001])].predicted.any()
    again = toxicity.toxicity(frame(spark, rows[::-1]), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)
    none = toxicity.toxicity(frame(spark, rows[:50]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("predicted = 1").isEmpty() and none.count() == 50
    assert toxicity.toxicity(frame(spark, rows[:1]).limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).isEmpty()


def test_positive_unlabelled_risk_uses_the_prior():
    rng = np.random.default_rng(1)
    pos = [np.array([0]) for _ in range(50)]
    unl = [np.array([0]) if rng.random() < 0.2 else np.array([1]) for _ in range(500)]
    w, b = toxicity.train_pu(pos, unl, 2, prior=0.2)
    assert w[0] + b > 1 and w[1] + b < -1  # without the prior, half of the mass would call feature 0 negative
