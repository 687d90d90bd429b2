from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions.tokens import load_vocabulary
from lectern.llm import packing
from lectern.llm.packing import DEFAULT_VOCABULARY, count_tokens, fill_report, pack_documents, pack_items, token_counts


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_items_fit(sizes):
    where = pack_items(sizes, 100)
    load, large = Counter(), Counter()
    for s, b in zip(sizes, where):
        load[b] += s
        large[b] += 3 * s > 100
    assert len(where) == len(sizes) and all(v <= 100 for v in load.values()) and all(v <= 2 for v in large.values())
    assert len(load) <= max(1, 2 * -(-sum(sizes) // 100)) and sorted(load) == list(range(len(load)))


def test_matching_and_best_fit():
    w = pack_items([60, 50, 40, 50], 100)
    assert w[0] == w[2] and w[1] == w[3]
    w = pack_items([70, 80, 20, 30], 100)
    assert w[0] == w[3] and w[1] == w[2]
    assert pack_items([], 10) == [] and pack_items([10, 10], 10) == [0, 1]


def test_little_space_is_left():
    import random

    rng = random.Random(1)
    sizes = [min(2048, int(rng.lognormvariate(5.7, 0.8)) + 1) for _ in range(5000)]
    assert sum(sizes) / (2048 * len(set(pack_items(sizes, 2048)))) > 0.99


def test_token_counts_of_long_texts(spark):
    enc = load_vocabulary(DEFAULT_VOCABULARY).encode_ordinary
    t = "Grénadis walked home, and 42 geese followed. 走了！\n\n" * 12_000
    assert count_tokens(enc, t) == len(enc(t)) and count_tokens(enc, None) == 0
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}


def test_documents(spark):
    word = " home"
    sizes = {1: 5, 2: 60, 3: 95, 4: 100, 5: 101, 6: 350, 7: 40, 8: 1, 9: 7, 10: 200}
    rows = [(k, word * n, "clash", 3) for k, n in sizes.items()] + [(11, None, "", 0), (12, "", "", 0), (1, word * 5, "", 0), (None, "x", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container_id string, tokens int")
    boxes = spark.createDataFrame([("c", 100), ("d", 1000), ("c", 100), ("e", 0), ("f", None)], "container_id string, capacity_tokens int")
    got = pack_documents(docs, boxes, shard_items=4).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        load[r["container_id"], r["shard"], r["bin"]] += r["tokens"]
        pieces[r["container_id"], r["doc_id"]].append((r["piece"], r["pieces"], r["tokens"]))
    assert {k[0] for k in load} == {"c", "d"} and all(v <= {"c": 100, "d": 1000}[k[0]] for k, v in load.items())
    for c, cap in (("c", 100), ("d", 1000)):
        for d, n in sizes.items():
            p = sorted(pieces[c, d])
            assert sum(x[2] for x in p) == n and len(p) == p[0][1] == -(-n // cap) and all(x[2] == cap for x in p[:-1])
    assert pack_documents(docs.limit(0), boxes).count() == 0 and pack_documents(docs, boxes.limit(0)).count() == 0


def test_more_kinds_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(packing, "KINDS_PER_PASS", 3)
    docs = spark.createDataFrame([(k, " home" * (k + 1)) for k in range(9)], "doc_id bigint, text string")
    boxes = spark.createDataFrame([(f"c{k}", 10 + k) for k in range(8)], "container_id string, capacity_tokens int")
    got = pack_documents(docs, boxes).groupBy("container_id").agg({"tokens": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == {f"c{k}": 45 for k in range(8)}


def test_fill_over_the_tables(spark):
    """Every kind of container is more than 98 % full, against the packed rows counted here."""
    d = "/root/testdata/sf0.01"
    packed = pack_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/containers.parquet")).cache()
    rows = packed.collect()
    for r in fill_report(packed).collect():
        own = [x for x in rows if x["container_id"] == r["container_id"]]
        boxes = Counter()
        for x in own:
            boxes[x["shard"], x["bin"]] += x["tokens"]
        assert max(boxes.values()) <= r["capacity"] and (r["containers"], r["tokens"], r["documents"]) == (len(boxes), sum(boxes.values()), len({x["doc_id"] for x in own}))
        assert r["least"] <= r["containers"] and r["unused"] == len(boxes) * r["capacity"] - r["tokens"] and r["fill"] > 0.98
    packed.unpersist()
