import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.tokens import load_vocabulary
from lectern.llm import queries as q
from lectern.llm.leaks import words
from lectern.llm.one_form import SHAPES
from lectern.llm.packing import DEFAULT_VOCABULARY
from tests.test_queries import D, duck, plain  # noqa: F401


def seen(text):
    """How a text reads, without the lattice."""
    t = unicodedata.normalize("NFKC", text)
    t = unicodedata.normalize("NFKC", "".join(c for c in t if unicodedata.category(c) != "Cf" and (unicodedata.category(c) != "Cc" or c.isspace())))
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(SHAPES))).strip()


def check_one_form(spark, duck, df):
    texts = {("evidence", i): t for i, t in duck.execute("select validation_id, any_value(evidence) from validations group by 1").fetchall()}
    texts |= {("context", i): t for i, t in duck.execute("select context_id, any_value(context) from contexts group by 1").fetchall()}
    got = {(r["source"], r["id"]): r["text"] for r in df.collect()}
    forms = defaultdict(set)
    for k, t in texts.items():
        assert (t is None) == (got[k] is None)
        if t is not None:
            assert seen(got[k]) == seen(t)
            forms[seen(t)].add(got[k])
    assert set(got) == set(texts) and all(len(v) == 1 for v in forms.values())


def check_other_characters(spark, duck, df):
    rows = duck.execute("select distinct validation_id, evidence, context from validations join contexts using (context_id) where evidence is not null and context is not null").fetchall()
    assert sorted(r[0] for r in df.collect()) == sorted({i for i, e, c in rows if e not in c and seen(e) and seen(e) in seen(c)})


def check_similarity(spark, duck, df):
    stretch = {r[0] for r in duck.execute("select validation_id from validations join contexts using (context_id) where trim(evidence) <> '' and contains(context, evidence)").fetchall()}
    got = {r["validation_id"]: r["evidence_similarity"] for r in df.collect()}
    n = duck.execute("select count(distinct validation_id) from validations").fetchone()[0]
    assert len(got) == n and stretch and all(got[i] == 1.0 for i in stretch) and all(v is None or v == 0 or 0.8 <= v <= 1 for v in got.values())
    assert {r[0] for r in q.p1_found(spark, D).collect()} <= {i for i, v in got.items() if v == 1.0}


def quotas(leaves, want, least, available, size):
    """The allocation by bisection for one multiplier in each node, before rounding."""
    floor = np.minimum(least, available)
    out = np.zeros(len(leaves))

    def share(weights, room, total):
        total = min(total, room.sum())
        if not weights.sum():
            weights = room.astype(float)
        lo, hi = 0.0, 1e15
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.minimum(room, mid * weights).sum() < total else (lo, mid)
        x = np.minimum(room, hi * weights)
        left = total - x.sum()  # parts without a target of their own take what the others cannot
        free = (room - x) * (weights == 0)
        return x + (free * left / free.sum() if left > 1e-6 and free.sum() else 0)

    def down(rows, quota, level):
        parts = defaultdict(list)
        for r in rows:
            parts[leaves[r][: level + 1]].append(r)
        parts = [np.array(p) for p in parts.values()]
        base = np.array([floor[p].sum() for p in parts], float)
        extra = np.array([max(0.0, want[p].sum() - b) for p, b in zip(parts, base)])
        room = np.array([available[p].sum() for p in parts]) - base
        for p, x in zip(parts, base + share(extra, room, max(0.0, quota - base.sum()))):
            if len(p) == 1:
                out[p] = x
            else:
                down(p, x, level + 1)

    down(np.arange(len(leaves)), max(size, floor.sum()), 0)
    return out


def check_report(spark, duck, df):
    have = {r[:3]: r[3] for r in duck.execute(q._TARGETS + "SELECT question_type, depth_bin, context_length, n FROM u").fetchall()}
    targets = duck.execute("select distinct t.plan_id, question_type, depth_bin, context_length, coalesce(target_share, 0), coalesce(min_rows, 0), sample_size from sample_targets t join sample_plans p using (plan_id)").fetchall()
    got = {(r["plan_id"], r["question_type"], r["depth_bin"], r["context_length"]): r for r in df.collect()}
    assert len(got) == len(targets)
    for plan in {t[0] for t in targets}:
        own = sorted(t for t in targets if t[0] == plan)
        size, least, share = own[0][6], np.array([t[5] for t in own]), np.array([t[4] for t in own])
        available = np.array([have.get(t[1:4], 0) for t in own])
        want = np.maximum(least, share * size)
        if want.sum() > size and want.sum() > least.sum():
            want = least + (want - least) * max(0.0, size - least.sum()) / (want.sum() - least.sum())
        rows = [got[t[:4]] for t in own]
        assert [r["available"] for r in rows] == available.tolist()
        assert [r["reached"] for r in rows] == [bool(n >= m and n >= s * size) for n, m, s in zip(available, least, share)]
        quota = np.array([r["quota"] for r in rows])
        assert (quota <= available).all() and (quota >= np.minimum(least, available)).all() and quota.sum() == min(max(size, np.minimum(least, available).sum()), available.sum())
        assert np.abs(quota - quotas([t[1:4] for t in own], want, least, available, size)).max() <= 3  # whole numbers, on three levels


def check_sample(spark, duck, df):
    report = {(r["plan_id"], r["question_type"], r["depth_bin"], r["context_length"]): r["quota"] for r in q.p4_report(spark, D).collect()}
    every = defaultdict(list)
    for r in q._usable_assignments(spark, D).withColumn("h", F.xxhash64(F.lit(0), "assignment_id")).collect():
        every[r["question_type"], r["depth_bin"], r["context_length"]].append((r["h"] % 2**64, r["assignment_id"]))
    drawn = defaultdict(list)
    for r in df.collect():
        drawn[r["plan_id"], r["question_type"], r["depth_bin"], r["context_length"]].append((r["draw_rank"], r["assignment_id"]))
    assert set(drawn) == {k for k, n in report.items() if n}
    for k, rows in drawn.items():
        assert sorted(rows) == [(n + 1, i) for n, (_, i) in enumerate(sorted(every[k[1:]])[: report[k]])]


def check_packed(spark, duck, df):
    enc = load_vocabulary(DEFAULT_VOCABULARY).encode_ordinary
    sizes = {i: len(enc(t)) for i, t in duck.execute("select doc_id, text from documents where text <> ''").fetchall()}
    boxes, pieces = Counter(), defaultdict(int)
    for r in df.collect():
        boxes[r["container_id"], r["capacity"], r["shard"], r["bin"]] += r["tokens"]
        pieces[r["container_id"], r["doc_id"]] += r["tokens"]
        assert r["pieces"] == -(-sizes[r["doc_id"]] // r["capacity"])
    kinds = {k[0] for k in boxes}
    assert kinds == {r[0] for r in duck.execute("select container_id from containers").fetchall()} and all(n <= k[1] for k, n in boxes.items())
    assert dict(pieces) == {(c, i): n for c in kinds for i, n in sizes.items() if n}


def check_too_long(spark, duck, df):
    enc = load_vocabulary(DEFAULT_VOCABULARY).encode_ordinary
    rows = duck.execute("select doc_id, text from documents where text <> ''").fetchall()
    assert sorted(map(tuple, df.select("container_id", "doc_id").collect())) == sorted((c, i) for c, n in duck.execute("select container_id, capacity_tokens from containers").fetchall() for i, t in rows if len(enc(t)) > n)


def check_fill(spark, duck, df):
    for r in df.collect():
        assert r["containers"] * r["capacity"] == r["tokens"] + r["unused"] and r["least"] <= r["containers"] <= r["least"] + 1


def check_leaks(spark, duck, df):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    items = {i: set(words(p)) | set(words(x)) for i, p, x in duck.execute("select item_id, passage, question from test_items").fetchall()}
    rows = df.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == set(map(tuple, q.p7_found(spark, D).collect()))
    for r in rows:
        for s, c in zip(r["spans"], r["places"]):
            inside = words(texts[r["doc_id"]])[s["start"] : s["end"]]
            cut = words(texts[r["doc_id"]][c["start"] : c["end"]])
            assert len(inside) >= 21 and abs(len(cut) - len(inside)) <= 1 and sum(w in items[r["item_id"]] for w in cut) >= 0.8 * len(cut)


def check_pairs(spark, duck, df):
    assert df.count() == df.distinct().count() > 0


def check_cleaned(spark, duck, df):
    from lectern.llm.leaks import leaked_items

    left = df.cache()
    found = {r["doc_id"] for r in q.p7_found(spark, D).collect()}
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in left.collect():
        assert (r["text"] == texts[r["doc_id"]]) == (r["doc_id"] not in found) and (r["removed"] > 0) == (r["doc_id"] in found)
    assert left.count() == len(texts) and leaked_items(left, spark.read.parquet(f"{D}/test_items.parquet")).count() == 0
    left.unpersist()


def check_subjects(spark, duck, df):
    rows = df.select("doc_id", "subject").distinct().collect()
    want = set(duck.execute("select distinct doc_id, subject from doc_labels join documents using (doc_id) where subject is not null").fetchall())
    assert len(rows) == df.count() and len(want & set(map(tuple, rows))) >= 0.5 * len(want)  # a dozen labels to learn from


def check_composition(spark, duck, df):
    got = {r["subject"]: r["documents"] for r in df.collect() if r["documents"]}
    assert got == dict(Counter(r["subject"] for r in q.p8_subjects(spark, D).collect()))


def check_weighted(spark, duck, df):
    rows = df.collect()
    assert len(rows) == duck.execute("select count(distinct q_id) from questions").fetchone()[0] and all(r["group_id"] <= r["q_id"] for r in rows)


CHECKS = {
    "p1_found": check_other_characters, "p1_one_form": check_one_form, "p1_similarity": check_similarity, "p2_weighted": check_weighted, "p4_report": check_report, "p4_sample": check_sample, "p6_found": check_too_long, "p6_packed": check_packed, "p6_fill": check_fill,
    "p7_found": check_pairs, "p7_leaks": check_leaks, "p7_cleaned": check_cleaned, "p8_found": check_subjects, "p8_subjects": check_subjects, "p8_composition": check_composition,
}


@pytest.mark.parametrize("name", list(q.queries()))
def test_query(spark, duck, name):  # noqa: F811
    df = q.queries()[name](spark, D)
    cols = sorted(df.columns)
    rows = df.collect()
    if name not in q.oracle_sql():
        CHECKS[name](spark, duck, df)
    else:
        r = duck.execute(q.oracle_sql()[name])
        names = [x[0] for x in r.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(names) == cols
        assert sorted((tuple(plain(x[c]) for c in cols) for x in rows), key=str) == sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=str)


def test_found_columns(spark):
    want = {"p1_found": ["validation_id"], "p2_found": ["q_id_a", "q_id_b"], "p4_found": ["plan_id", "question_type", "depth_bin", "context_length"], "p6_found": ["container_id", "doc_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject"]}
    for name, cols in want.items():
        assert q.queries()[name](spark, D).columns == cols
