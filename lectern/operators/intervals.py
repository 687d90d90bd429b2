"""Continuous periods and gaps per entity.

The aggregate's state for one entity is a pair of equally long lists (starts, ends) of disjoint, sorted, half-open ranges
that do not touch. Two states combine by a linear merge, so the aggregate is associative and commutative: every input
partition first reduces its own rows to one state per entity, the states of an entity are then merged in groups, and the
groups once more. Only states are shuffled, never rows, so an entity that holds a third of all rows costs no more than one
list of its disjoint periods per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.session import cut, need_columns, task_count

_STATE = "k string, starts array<bigint>, ends array<bigint>"
#: Rows that a partition gathers before it reduces them.
BLOCK_ROWS = 1_000_000


def coalesce_ranges(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends) of disjoint ranges, sorted by code and start, that cover the same points of each code; touching
    ranges become one."""
    if not len(starts):
        return codes, starts, ends
    order = np.lexsort((starts, codes))
    c, s = codes[order], starts[order]
    reach = pd.Series(ends[order]).groupby(c).cummax().to_numpy()
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (s[1:] > reach[:-1]))))
    return c[first], s[first], reach[np.append(first[1:] - 1, len(s) - 1)]


def _states(k: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    """One state per key of the ranges given."""
    codes, keys = pd.factorize(k, use_na_sentinel=False)
    c, s, e = coalesce_ranges(codes, s, e)
    at = np.flatnonzero(np.diff(c)) + 1
    own = keys[c[np.concatenate(([0], at))]] if len(c) else keys[:0]
    lists = lambda x: pd.Series(np.split(x, at) if len(x) else [], dtype=object)
    return pd.DataFrame({"k": pd.Series(own, dtype=object), "starts": lists(s), "ends": lists(e)})


def _flat(states: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pd.concat(states, ignore_index=True)
    n = pdf["starts"].map(len).to_numpy(np.int64)
    return np.repeat(pdf["k"].to_numpy(dtype=object), n), np.concatenate([*pdf["starts"], np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*pdf["ends"], np.empty(0, np.int64)]).astype(np.int64)


def _reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(_states(pdf["k"].to_numpy(dtype=object), pdf["s"].to_numpy(np.int64), pdf["e"].to_numpy(np.int64)))
        rows += len(pdf)
        if rows >= BLOCK_ROWS:
            merged = _states(*_flat(held))
            held, rows = [merged], int(merged["starts"].map(len).sum())
            if rows >= BLOCK_ROWS // 2:  # ranges that don't combine: hand them on, the tree merges them
                yield merged
                held, rows = [], 0
    if held:
        yield _states(*_flat(held))


def _merge_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the states of each (k, salt) of a partition sorted by them; a key may go on in the next batch."""
    held: list[pd.DataFrame] = []
    last: tuple = ()
    for pdf in batches:
        if not len(pdf):
            continue
        k, salt = pdf["k"].to_numpy(dtype=object), pdf["salt"].to_numpy()
        end = len(pdf)  # of the keys that are whole
        while end and (k[end - 1], salt[end - 1]) == (k[-1], salt[-1]):
            end -= 1
        if held and (k[0], salt[0]) != last:
            yield _merged(held)
            held = []
        if end:
            yield _merged([*held, pdf.iloc[:end]])
            held = []
        held.append(pdf.iloc[end:])
        last = (k[-1], salt[-1])
    if held:
        yield _merged(held)


def _merged(states: list[pd.DataFrame]) -> pd.DataFrame:
    """One state for each run of equal (k, salt)."""
    pdf = pd.concat(states, ignore_index=True)
    same = (pdf["k"].isna() & pdf["k"].shift().isna() | (pdf["k"] == pdf["k"].shift())) & (pdf["salt"] == pdf["salt"].shift())
    same.iloc[0] = False
    run = (~same).cumsum().to_numpy() - 1
    n = pdf["starts"].map(len).to_numpy(np.int64)
    flat = lambda c: np.concatenate([*pdf[c]]).astype(np.int64)
    out = _states(np.repeat(run, n), flat("starts"), flat("ends"))
    first = np.flatnonzero(~same.to_numpy())[out["k"].to_numpy(np.int64)]
    return pd.DataFrame({"k": pdf["k"].to_numpy(dtype=object)[first], "salt": pdf["salt"].to_numpy()[first], "starts": out["starts"], "ends": out["ends"]})


def interval_states(df: DataFrame, key: str, start: str | F.Column, end: str | F.Column, fan_in: int = 16) -> DataFrame:
    """(key, starts, ends): the disjoint periods of each entity as two lists.

    Rows without either end, with a negative start or with end <= start are no ranges and count for nothing. A null key is
    an entity of its own. Repeated rows change nothing. An empty input gives no rows. Positions are BIGINT. A merge takes the
    states of at most ``fan_in`` partitions of an entity; the partial states of all partitions are written to the shared folder, which
    tells how many there are.
    """
    kind = df.schema[key].dataType
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    rows = df.select(F.col(key).cast("string").alias("k"), s.cast("bigint").alias("s"), e.cast("bigint").alias("e")).where("s >= 0 and e > s")
    part = cut(rows.mapInPandas(_reduce_rows, _STATE).withColumn("salt", F.spark_partition_id()).select("k", "salt", "starts", "ends"))
    nodes, tasks = part.rdd.getNumPartitions(), task_count(df.sparkSession)
    while nodes:
        nodes = -(-nodes // fan_in)
        part = part.withColumn("salt", F.floor(F.col("salt") / fan_in).cast("int"))
        part = part.repartition(tasks, "k", "salt").sortWithinPartitions("k", "salt").mapInPandas(_merge_sorted, "k string, salt int, starts array<bigint>, ends array<bigint>")
        if nodes == 1:
            break
    return part.select(F.col("k").cast(kind).alias(key), "starts", "ends")


def periods_and_gaps(df: DataFrame, key: str, start: str | F.Column, end: str | F.Column, fan_in: int = 16) -> DataFrame:
    """(key, kind, start_pos, end_pos): 'period' for each longest continuous range of an entity, 'gap' for each uncovered
    range between two neighbouring periods. See :func:`interval_states` for the treatment of odd rows. An entity whose rows
    are all unusable does not appear."""
    if isinstance(start, str) and isinstance(end, str):
        need_columns(df, key)
    state = interval_states(df, key, start, end, fan_in)
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_pos"), b.alias("end_pos"))
    n = F.size("starts")
    periods = F.transform(F.arrays_zip("starts", "ends"), lambda x: pair("period", x["starts"], x["ends"]))
    gaps = F.transform(
        F.arrays_zip(F.slice("ends", F.lit(1), n - 1).alias("a"), F.slice("starts", F.lit(2), n - 1).alias("b")),
        lambda x: pair("gap", x["a"], x["b"]),
    )
    return state.select(key, F.explode(F.concat(periods, gaps)).alias("r")).select(key, "r.kind", "r.start_pos", "r.end_pos")
