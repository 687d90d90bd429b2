import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import near_copies
from lectern.llm.near_copies import components, element_set, group_pairs, near_copy_groups, plan_bands, prob_min_hash, probability_jaccard, shingle_counts, shingle_set


def brute(rows, threshold, elements):
    own = {i: set(elements(t).tolist()) for i, t in rows if i is not None}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and own[b] and len(own[a] & own[b]) >= threshold * len(own[a] | own[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in own}


def test_elements():
    assert len(element_set("The the cat, THE cat2! 猫猫狗")) == 5 - 1 + 1 and element_set(None).size == 0 and element_set(" .. ").size == 0
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and shingle_set("").size == 0


def sign(sets, slots, seed=0, made=None):
    """Signatures of (elements, weights) pairs."""
    return prob_min_hash(np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets]), np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]), len(sets), slots, seed, made)


def slow_probability_jaccard(a, b):
    A, B = dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1]))
    return sum(1 / sum(max(A.get(e, 0) / A[d], B.get(e, 0) / B[d]) for e in A.keys() | B.keys()) for d in A.keys() & B.keys())


def test_agreement_estimates_similarity():
    a, b = np.arange(0, 60, dtype=np.uint64) * np.uint64(7919), np.arange(20, 80, dtype=np.uint64) * np.uint64(7919)
    one = np.ones(60)
    x, y = sign([(a, one), (b, one)], 4096)
    assert abs((x == y).mean() - 40 / 80) < 0.04
    wa, wb = np.linspace(0.5, 3, 60), np.linspace(2, 1, 60)
    x, y = sign([(a, wa), (b, wb)], 4096)
    assert abs((x == y).mean() - slow_probability_jaccard((a, wa), (b, wb))) < 0.04
    assert (sign([(a, wa), (a, 7 * wa)], 512)[0] == sign([(a, wa), (a, 7 * wa)], 512)[1]).all()


@pytest.mark.parametrize("seed", range(5))
def test_weighted_similarity_is_its_definition(seed):
    rng = np.random.default_rng(seed)
    side = lambda: (np.sort(rng.choice(50, 30, replace=False)).astype(np.uint64), rng.integers(1, 5, 30).astype(float))
    a, b = side(), side()
    assert probability_jaccard(a, b) == pytest.approx(slow_probability_jaccard(a, b)) and probability_jaccard(a, a) == pytest.approx(1)
    assert probability_jaccard((a[0], np.ones(30)), (b[0], np.ones(30))) == pytest.approx(len(set(a[0]) & set(b[0])) / len(set(a[0]) | set(b[0])))
    assert probability_jaccard(a, (b[0] + np.uint64(99), b[1])) == 0


def test_stopping_early_changes_nothing():
    """Beside more arrivals than any slot needs; most are never made."""
    e, w = np.array([3, 5, 8, 13], np.uint64), np.array([1.0, 0.2, 5.0, 1.0])
    made: list = []
    sig = sign([(e, w), (e[:1], w[:1])], 64, 9, made)
    best = {}
    with np.errstate(over="ignore"):
        for x, y in zip(e, w):
            h = near_copies._mix(x + np.uint64(9) * near_copies._M1 + np.arange(1, 4001, dtype=np.uint64) * near_copies._GOLDEN)
            for t, s in zip(np.cumsum(-np.log(((h >> np.uint64(32)) + 0.5) * 2.0**-32) / y).tolist(), (((h & near_copies._LOW) * np.uint64(64)) >> np.uint64(32)).tolist()):
                if s not in best or t < best[s][0]:
                    best[s] = (t, int(x))
    assert [best[k][1] for k in range(64)] == sig[0].tolist() and set(sig[1].tolist()) == {3}
    many = np.arange(1, 100_001, dtype=np.uint64)
    made.clear()
    sign([(many, np.ones(len(many)))], 444, 0, made)
    assert sum(made) < 3 * len(many)  # nearly every element stops after its first block of arrivals
    assert (sign([(many[:90], np.ones(90))] * 3 + [(many[:7], np.ones(7))], 444)[1] == sign([(many[:90], np.ones(90))], 444)[0]).all()


def test_bands_reach_the_recall():
    bands, rows = plan_bands(0.7)
    assert (1 - 0.7**rows) ** bands <= 1e-4


def edits(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.pop(k), lambda: w.insert(k, f"new{rng.randrange(9999)}"), lambda: w.__setitem__(k, f"x{rng.randrange(9999)}")])()
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out, i = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(30)]
        for _ in range(rng.randrange(1, 7)):
            w = edits(rng, base, rng.randrange(6))
            rng.shuffle(w)
            out.append((i := i + rng.randrange(1, 5), " ".join(w)))
    out += [(5000 + k, out[0][1]) for k in range(60)] + [(9001, None), (9002, ""), (9003, " . "), (9004, None), (None, "w1 w2 w3")]
    return out + out[:9]


@pytest.mark.parametrize("bucket", [256, 3])
def test_groups_are_those_of_brute_force(spark, rows, bucket):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id bigint, body string, text string")
    got = {r["id"]: r["group_id"] for r in near_copy_groups(df, "id", F.col("body"), 0.7, element_set, bucket_rows=bucket).collect()}
    assert got == brute(dict.fromkeys(rows), 0.7, element_set)


def test_one_hot_bucket_of_different_texts(spark):
    """Records that share most words: many share every band, few exactly."""
    rng = random.Random(2)
    base = [f"c{k}" for k in range(40)]
    rows = [(k, " ".join(base[: 40 - rng.randrange(3)] + [f"u{k}_{j}" for j in range(rng.randrange(4))])) for k in range(150)]
    df = spark.createDataFrame(rows, "id bigint, body string")
    got = {r["id"]: r["group_id"] for r in near_copy_groups(df, "id", F.col("body"), 0.8, element_set, bucket_rows=16).collect()}
    assert got == brute(rows, 0.8, element_set)


def test_default_shingles_and_empty(spark):
    t = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(1, t), (2, t + " more"), (3, t.replace("w50 ", "q ")), (4, " ".join(t.split()[::-1]))], "id bigint, body string")
    got = {r["id"]: r["group_id"] for r in near_copy_groups(df, "id", F.col("body")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert near_copy_groups(df.limit(0), "id", F.col("body")).count() == 0


def test_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(k, k + 1) for k in range(n)], "a bigint, b bigint").repartition(5)
    got = components(links, spark.range(n + 5).withColumnRenamed("id", "node")).collect()
    assert {r["node"]: r["root"] for r in got} == {k: 0 if k <= n else k for k in range(n + 5)}


def test_pairs(spark):
    g = spark.createDataFrame([(k, 1) for k in range(40)] + [(100, 100)], "q bigint, group_id bigint")
    assert group_pairs(g, "q").count() == 40 * 39 // 2
    big = spark.range(2100).select(F.col("id").alias("q"), F.lit(0).alias("group_id"))
    p = group_pairs(big, "q")
    assert p.count() == 2100 * 2099 // 2 == p.distinct().count()


def test_weighted_groups_are_those_of_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(30):
        base = [f"w{rng.randrange(900)}" for _ in range(20)] + ["refrain of the old song"] * rng.randrange(4)
        for j in range(3):
            rows.append((10 * k + j, " ".join(edits(rng, base, rng.randrange(3)))))
    rows += [(1000, None), (1001, "")]
    own = {i: shingle_counts(t, 2) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in own:
        for b in own:
            if a < b and len(own[a][0]) and len(own[b][0]) and slow_probability_jaccard(own[a], own[b]) >= 0.6 - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(rows, "id bigint, body string")
    for bucket in (256, 2):
        got = {r["id"]: r["group_id"] for r in near_copy_groups(df, "id", F.col("body"), 0.6, lambda t: shingle_counts(t, 2), weighted=True, bucket_rows=bucket).collect()}
        assert got == {i: find(i) for i in own} and len(set(got.values())) < len(rows) - 20


def test_a_hot_bucket_costs_its_length(spark, monkeypatch):
    """One bucket of 20,000 variants of a template and 40 strangers: comparisons are counted."""
    n, strangers = 20_000, 40
    rng = random.Random(1)
    own = {k: frozenset([*range(40), 1000 + rng.randrange(10**6)]) for k in range(n)} | {n + k: frozenset(range(10**7 + 50 * k, 10**7 + 50 * k + 40)) for k in range(strangers)}
    kinds = spark.createDataFrame([(c, sorted(s), None) for c, s in own.items()], "cls bigint, own array<bigint>, weight array<double>").repartition(4)
    hot = kinds.select(F.lit(7).cast("bigint").alias("band"), "cls", F.lit(len(own)).cast("bigint").alias("n"))
    hot = near_copies._different_buckets(hot.unionByName(hot.withColumn("band", F.lit(8).cast("bigint"))))
    assert hot.count() == len(own)
    seen = []
    monkeypatch.setattr(near_copies, "set_similarity", lambda a, b: seen.append(1) or len(a[0] & b[0]) / len(a[0] | b[0]))

    def compare(members):
        buckets, out = {}, []
        for r in members.collect():
            buckets.setdefault(r["bucket"], ([], [], []))[r["side"]].append((r["cls"], r["grp"], own[r["cls"]], None))
        for side in buckets.values():
            assert sum(map(len, side)) < 900
            out += near_copies._forest(side[0], 0.7) if side[0] else near_copies._forest(side[1], 0.7, side[2])
        return out

    first = compare(near_copies._chunks(hot, 256))
    assert len(seen) < 10 * n
    links = spark.createDataFrame(first, "a bigint, b bigint")
    groups = components(links, kinds.select(F.col("cls").alias("node"))).cache()
    assert groups.select("root").distinct().count() == strangers + 1
    seen.clear()
    assert compare(near_copies._outside_main_group(hot, kinds, groups, 0.7, 256)) == [] and len(seen) < 2 * strangers * n
    groups.unpersist()
