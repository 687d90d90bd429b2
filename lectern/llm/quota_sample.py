"""Samples whose categories follow target proportions.

Categories are the leaves of a tree (one level for each category column). Quotas go down the tree: a node divides its quota
among its children by their own targets, what a child cannot hold goes to its siblings, and only what a whole branch cannot
hold reaches its cousins. At the leaves rows are drawn by permuted dense rank: rows are ordered by a seeded hash of their id
and numbered. The number comes from counts per slice of the hash, so that no task holds a whole category.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.session import need_columns

#: Slices of the hash; a category's rows are numbered within each.
SLICE_BITS = 10


def whole_shares(wanted: np.ndarray, total: int, most: np.ndarray) -> np.ndarray:
    """Whole numbers of sum min(total, sum of most) that are near ``wanted`` and at most ``most``: what does not fit goes to
    the others in proportion to their wants, fractions to the largest remainders, ties to the first."""
    wanted, most = wanted.astype(float), most.astype(np.int64)
    total = int(min(total, most.sum()))
    out, free = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    while free.any():
        left = total - out[~free].sum()
        weight = np.where(free, wanted, 0.0)
        if weight.sum() <= 0:
            weight = np.where(free, most, 0).astype(float)
        out = np.where(free, left * weight / weight.sum() if weight.sum() > 0 else 0.0, out)
        over = free & (out >= most)
        if not over.any():
            break
        out[over], free = most[over], free & ~over
    whole = np.minimum(np.floor(out + 1e-9).astype(np.int64), most)
    rest = total - int(whole.sum())
    for k in np.lexsort((np.arange(len(out)), -(out - whole))):
        if rest <= 0:
            break
        add = 1 if whole[k] < most[k] else 0
        whole[k] += add
        rest -= add
    while rest > 0:
        k = int(np.argmax(most - whole))
        add = min(rest, int(most[k] - whole[k]))
        if add <= 0:
            break
        whole[k] += add
        rest -= add
    return whole


def allocate(levels: list[np.ndarray], share: np.ndarray, least: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Rows to draw from each leaf. ``levels`` has the leaf's category on each level, outermost first."""
    floor = np.minimum(least, available)
    want = np.maximum(least, share * size)
    if want.sum() > size and want.sum() > least.sum():
        want = least + (want - least) * max(0.0, size - least.sum()) / (want.sum() - least.sum())
    out = np.zeros(len(share), np.int64)

    def down(rows: np.ndarray, quota: int, level: int) -> None:
        if level == len(levels):
            out[rows] = whole_shares(want[rows], quota, available[rows])
            return
        codes, names = pd.factorize(levels[level][rows])
        parts = [rows[codes == k] for k in range(len(names))]
        if level == len(levels) - 1 and all(len(p) == 1 for p in parts):
            out[rows] = floored(rows, [np.array([r]) for r in rows], quota)
            return
        for p, q in zip(parts, floored(rows, parts, quota)):
            down(p, int(q), level + 1)

    def floored(rows: np.ndarray, parts: list[np.ndarray], quota: int) -> np.ndarray:
        """Each part gets its floors, the rest follows the targets."""
        base = np.array([floor[p].sum() for p in parts], np.int64)
        extra = np.array([max(0.0, want[p].sum() - b) for p, b in zip(parts, base)])
        room = np.array([available[p].sum() for p in parts], np.int64) - base
        return base + whole_shares(extra, max(0, quota - int(base.sum())), room)

    down(np.arange(len(share)), int(max(size, floor.sum())), 0)
    return out


def quota_report(rows: DataFrame, categories: list[str], targets: DataFrame, plans: DataFrame, plan: str = "plan_id", share: str = "target_share", least: str = "min_rows", size: str = "sample_size") -> DataFrame:
    """(plan, categories, target_share, min_rows, wanted, available, quota, reached): one row for each target. ``wanted`` is
    share times sample size, ``available`` the usable rows of the category, ``quota`` what the plan draws from it after what
    other categories lack has been passed on, ``reached`` whether the category itself holds min_rows and ``wanted``.

    ``rows`` has one row per usable item. Null shares and minima count as 0; a plan without a size has size 0; targets of a
    plan that is not in ``plans`` are reported with size 0. Repeated targets and plans count once."""
    need_columns(targets, plan, *categories, share, least)
    have = rows.groupBy(*categories).agg(F.count("*").alias("available"))
    t = targets.select(plan, *categories, F.coalesce(share, F.lit(0.0)).alias("target_share"), F.coalesce(least, F.lit(0)).cast("bigint").alias("min_rows")).dropDuplicates([plan, *categories])
    p = plans.groupBy(plan).agg(F.max(size).cast("bigint").alias("size"))
    base = (
        t.join(p, plan, "left")
        .join(have, categories, "left")
        .select(plan, *categories, "target_share", "min_rows", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("available", F.lit(0)).alias("available"))
    )

    def one_plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(categories, ignore_index=True)
        pdf["quota"] = allocate([pdf[c].to_numpy() for c in categories], pdf["target_share"].to_numpy(float), pdf["min_rows"].to_numpy(np.int64), pdf["available"].to_numpy(np.int64), int(pdf["size"].iloc[0]))
        return pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", quota bigint"
    done = base.groupBy(plan).applyInPandas(one_plan, fields)
    wanted = F.col("target_share") * F.col("size")
    return done.select(plan, *categories, "target_share", "min_rows", wanted.alias("wanted"), "available", "quota", ((F.col("available") >= F.col("min_rows")) & (F.col("available") >= wanted)).alias("reached"))


def permuted_rank(rows: DataFrame, id_col: str, categories: list[str], seed: int = 0, upto: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``draw_rank``: 1, 2, ... within each category in an order fixed by ``seed``. With ``upto`` (categories,
    most) only rows of slices that hold a rank of at most ``most`` are numbered."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = rows.withColumn("h_", h).withColumn("slice_", F.shiftrightunsigned("h_", 64 - SLICE_BITS))
    counts = rows.groupBy(*categories, "slice_").agg(F.count("*").alias("n_"))
    by = ", ".join(f"`{c}`" for c in categories)
    before = counts.selectExpr(*(f"`{c}`" for c in categories), "slice_", f"coalesce(sum(n_) over (partition by {by} order by slice_ rows between unbounded preceding and 1 preceding), 0) as before_")
    if upto is not None:
        before = before.join(upto, categories).where("before_ < most").drop("most")
    return rows.join(before, [*categories, "slice_"]).selectExpr(*(f"`{c}`" for c in rows.columns if c not in ("h_", "slice_")), f"cast(before_ + row_number() over (partition by {by}, slice_ order by h_, `{id_col}`) as bigint) as draw_rank")


def quota_sample(rows: DataFrame, id_col: str, categories: list[str], targets: DataFrame, plans: DataFrame, seed: int = 0, **names: str) -> DataFrame:
    """(plan, id_col, categories, draw_rank): for each plan its sample of ``rows``, which have one row per usable item without
    nulls in the categories. See :func:`quota_report` for how many are drawn from each category. The samples of all plans
    follow one order, so a larger quota contains a smaller one. Same seed, same sample."""
    plan = names.get("plan", "plan_id")
    report = quota_report(rows, categories, targets, plans, **names).where("quota > 0").select(plan, *categories, "quota")
    most = report.groupBy(*categories).agg(F.max("quota").alias("most"))
    ranked = permuted_rank(rows.select(id_col, *categories), id_col, categories, seed, most)
    return ranked.join(report, categories).where("draw_rank <= quota").select(plan, id_col, *categories, "draw_rank")
