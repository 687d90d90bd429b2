import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.quota_sample import allocate, permuted_rank, quota_report, quota_sample, whole_shares


@settings(deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 200))
def test_whole_shares(parts, total):
    wanted, most = np.array([w for w, _ in parts]), np.array([m for _, m in parts])
    got = whole_shares(wanted, total, most)
    assert got.sum() == min(total, most.sum()) and (got <= most).all() and (got >= 0).all()


def test_unmet_goes_to_siblings_then_cousins():
    kind = np.array(["s", "s", "s", "s", "m", "m"])
    depth = np.array(["0", "0", "1", "1", "0", "0"])
    length = np.array([1, 2, 1, 2, 1, 2])
    share, least = np.array([0.2, 0.2, 0.2, 0.2, 0.1, 0.1]), np.zeros(6, int)
    got = allocate([kind, depth, length], share, least, np.array([5, 100, 100, 100, 100, 100]), 100)
    assert got.tolist() == [5, 35, 20, 20, 10, 10]
    got = allocate([kind, depth, length], share, least, np.array([5, 6, 100, 100, 100, 100]), 100)
    assert got.tolist() == [5, 6, 35, 34, 10, 10] or got.tolist() == [5, 6, 34, 35, 10, 10]
    got = allocate([kind, depth, length], share, least, np.array([5, 6, 7, 8, 100, 100]), 100)
    assert got[:4].tolist() == [5, 6, 7, 8] and got.sum() == 100


def test_minimum_is_kept():
    got = allocate([np.array(["a", "b", "c"])], np.array([0.98, 0.01, 0.01]), np.array([0, 10, 10]), np.array([1000, 50, 4]), 100)
    assert got[1] >= 10 and got[2] == 4 and got.sum() == 100


T = "plan_id bigint, kind string, depth string, target_share double, min_rows bigint, quota string"


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame([(k, "a" if k % 3 else "b", "x", "clash") for k in range(300)] + [(1000, "c", "x", "")], "id bigint, kind string, depth string, plan_id string")
    targets = spark.createDataFrame([(1, "a", "x", 0.5, 3, ""), (1, "b", "x", 0.45, 3, ""), (1, "c", "x", 0.05, 5, ""), (1, "d", "x", 0.0, 1, ""), (2, "a", "x", 1.0, None, ""), (9, "a", "x", None, 2, ""), (1, "a", "x", 0.5, 3, "")], T)
    plans = spark.createDataFrame([(1, 100), (2, 10_000), (1, 100), (3, 5)], "plan_id bigint, sample_size bigint")
    return rows.drop("plan_id"), targets, plans


def test_report_and_sample(tables):
    rows, targets, plans = tables
    r = {(x["plan_id"], x["kind"]): x for x in quota_report(rows, ["kind", "depth"], targets, plans).collect()}
    assert len(r) == 6
    assert {k: v["reached"] for k, v in r.items()} == {(1, "a"): True, (1, "b"): True, (1, "c"): False, (1, "d"): False, (2, "a"): False, (9, "a"): True}
    assert r[1, "c"]["quota"] == 1 and r[1, "d"]["quota"] == 0 and r[2, "a"]["quota"] == 200 and sum(v["quota"] for k, v in r.items() if k[0] == 1) == 100
    s = quota_sample(rows, "id", ["kind", "depth"], targets, plans, seed=4).collect()
    for key, x in r.items():
        own = [y for y in s if (y["plan_id"], y["kind"]) == key]
        assert len(own) == x["quota"] == len({y["id"] for y in own}) and sorted(y["draw_rank"] for y in own) == list(range(1, len(own) + 1))
    assert sorted(s) == sorted(quota_sample(rows.repartition(5), "id", ["kind", "depth"], targets, plans, seed=4).collect())
    assert sorted(s) != sorted(quota_sample(rows, "id", ["kind", "depth"], targets, plans, seed=5).collect())


def test_rank_is_dense(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'h' else cast(id % 50 as string) end as kind")
    got = permuted_rank(df, "id", ["kind"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["kind"], []).append(r["draw_rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and len(got) == 5000


def test_empty(tables):
    rows, targets, plans = tables
    assert quota_sample(rows.limit(0), "id", ["kind", "depth"], targets, plans).count() == 0
    assert quota_report(rows, ["kind", "depth"], targets.limit(0), plans).count() == 0
    assert {x["reached"] for x in quota_report(rows.limit(0), ["kind", "depth"], targets.where("plan_id < 3"), plans).collect()} == {False}
