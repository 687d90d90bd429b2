import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.intervals import coalesce_ranges, interval_states, periods_and_gaps

ranges = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=30)


def covered(rs):
    return {x for s, n in rs for x in range(s, s + n)}


@settings(deadline=None)
@given(ranges, ranges)
def test_states_merge_like_sets(a, b):
    def state(rs):
        return coalesce_ranges(np.zeros(len(rs), np.int64), np.array([s for s, _ in rs], np.int64), np.array([s + n for s, n in rs], np.int64))[1:]

    sa, sb = state(a), state(b)
    two = np.concatenate((sa[0], sb[0]))
    c, s, e = coalesce_ranges(np.concatenate((np.zeros(len(two), np.int64), np.ones(len(a), np.int64))), np.concatenate((two, [x for x, _ in a])).astype(np.int64), np.concatenate((sa[1], sb[1], [x + n for x, n in a])).astype(np.int64))
    assert s[c == 1].tolist() == sa[0].tolist() and e[c == 1].tolist() == sa[1].tolist()
    s, e = s[c == 0], e[c == 0]
    assert {x for p, q in zip(s, e) for x in range(p, q)} == covered(a + b)
    assert all(e[k] < s[k + 1] for k in range(len(s) - 1))


SCHEMA = "set_id bigint, kind string, start_pos bigint, end_pos bigint, s bigint, e bigint"


def found(spark, rows):
    df = spark.createDataFrame([(k, "x", 7, 8, s, e) for k, s, e in rows], SCHEMA)
    return sorted(map(tuple, periods_and_gaps(df, "set_id", "s", "e").collect()), key=str)


def test_nested_touching_gaps_and_odd_rows(spark):
    rows = [(1, 0, 10), (1, 2, 5), (1, 10, 12), (1, 20, 30), (1, 20, 30), (1, 5, 5), (1, 9, 3), (1, -1, 4), (1, None, 4), (1, 4, None), (2, 3, 4), (3, 7, 7)]
    assert found(spark, rows) == sorted([(1, "period", 0, 12), (1, "gap", 12, 20), (1, "period", 20, 30), (2, "period", 3, 4)], key=str)


def test_null_key_and_empty_table(spark):
    assert found(spark, [(None, 1, 2), (None, 4, 5)]) == sorted([(None, "period", 1, 2), (None, "gap", 2, 4), (None, "period", 4, 5)], key=str)
    assert found(spark, []) == []


def test_one_entity_with_most_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(s), int(s) + int(n)) for k, s, n in zip(rng.choice([1, 1, 2], 20_000), rng.integers(0, 100_000, 20_000), rng.integers(1, 9, 20_000))]
    df = spark.createDataFrame([(k, "x", 0, 0, s, e) for k, s, e in rows], SCHEMA).repartition(7)
    got = {r["set_id"]: sum(b - a for a, b in zip(r["starts"], r["ends"])) for r in interval_states(df, "set_id", "s", "e").collect()}
    assert got == {k: len({x for q, s, e in rows if q == k for x in range(s, e)}) for k in (1, 2)}


def test_trees_of_many_partitions(spark):
    """Deep trees give what one level gives."""
    rng = np.random.default_rng(4)
    rows = [(int(k) or None, int(s), int(s) + int(n)) for k, s, n in zip(rng.integers(0, 6, 3000), rng.integers(0, 9_000, 3000), rng.integers(1, 9, 3000))]
    df = spark.createDataFrame([(k, "x", 0, 0, s, e) for k, s, e in rows], SCHEMA)
    state = lambda n, fan: {r["set_id"]: (list(r["starts"]), list(r["ends"])) for r in interval_states(df.repartition(n), "set_id", "s", "e", fan).collect()}
    assert state(1, 16) == state(40, 3) == state(30, 2) and len(state(9, 16)) == 6
