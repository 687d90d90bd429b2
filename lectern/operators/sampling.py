"""Seeded sampling. Order comes from a hash of key and seed, the same in every engine and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(key: Column | str, seed: int = 0) -> Column:
    """A text that orders rows as if at random."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def seeded_number(key: Column, seed: int = 0) -> Column:
    """A number below 2**28 from the same hash."""
    return F.conv(F.substring(seeded(key, seed), 1, 7), 16, 10).cast("bigint")


def stratified_positions(novels: DataFrame, key: str, tokens: str, samples: int, layer: int = 50_000, seed: int = 0) -> DataFrame:
    """(novel, layer, k, position): ``samples`` positions spread evenly over layers of ``layer`` tokens, the first layers one
    more where they don't divide; within a layer with replacement."""
    layers = F.ceil(F.col(tokens) / layer).cast("bigint")
    rows = novels.where(F.col(tokens) > 0).select(key, tokens, layers.alias("layers_")).withColumn("layer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("layers_") - 1)))
    n = F.floor(F.lit(samples) / F.col("layers_")) + (F.col("layer") < F.lit(samples) % F.col("layers_")).cast("int")
    rows = rows.withColumn("n_", n).where("n_ > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_") - 1)))
    start = F.col("layer") * layer
    size = F.least(F.col(tokens), start + layer) - start
    at = seeded_number(F.concat_ws("-", F.col(key).cast("string"), F.col("layer").cast("string"), F.col("k").cast("string")), seed)
    return rows.select(key, "layer", "k", (start + at % size).cast("bigint").alias("position"))


def random_positions(spark: SparkSession, tokens: int, samples: int, seed: int = 0) -> DataFrame:
    """(position): min(samples, tokens) different positions."""
    return spark.range(tokens).select(F.col("id").alias("position")).orderBy(seeded("position", seed), "position").limit(min(samples, tokens))


def random_positions_each(novels: DataFrame, key: str, tokens: str, samples: int, seed: int = 0) -> DataFrame:
    """(novel, position): min(samples, tokens) different positions of each novel. Up to four times ``samples`` tokens all
    positions are ordered by their hash; beyond, hashed draws are made one after the other and repeats left out, so the work
    does not grow with the novel. Twice as many draws as samples and 64 more leave too few with a chance below 1e-40."""
    few = F.col(tokens) <= 4 * samples
    n = F.when(few, F.col(tokens)).otherwise(2 * samples + 64).cast("bigint")
    draws = novels.where(F.col(tokens) > 0).select(key, tokens, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("k"))
    h = seeded_number(F.concat_ws("-", F.col(key).cast("string"), F.col("k").cast("string")), seed)
    drawn = draws.select(key, F.when(few, F.col("k")).otherwise(h % F.col(tokens)).cast("bigint").alias("position"), F.when(few, h).otherwise(F.col("k")).alias("turn"))
    first = drawn.groupBy(key, "position").agg(F.min("turn").alias("turn"))
    return first.withColumn("n_", F.row_number().over(W.partitionBy(key).orderBy("turn", "position"))).where(F.col("n_") <= samples).select(key, "position")


def sampling_strategy(name: str):
    """The sampler of a name, in any case; an error for unknown names."""
    known = {"stratified": stratified_positions, "random": random_positions_each}
    if name.lower() not in known:
        raise ValueError(f"unknown sampling strategy {name!r}")
    return known[name.lower()]


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random, as a top-n of the hash: no task sorts all rows."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def depth_bin_index(end_pos: Column, length: Column | int, bins: int = 5) -> Column:
    length = length if isinstance(length, Column) else F.lit(length)
    depth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(length > 0, F.coalesce(end_pos, F.lit(0)) / length).otherwise(0.0)))
    return F.least((depth * bins).cast("int"), F.lit(bins - 1))


def _placed(rows: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """``rows`` with h_, slice_ and before_: how many rows of the group come in earlier slices of the hash. Only counts per
    slice are put in order, so that no task holds a group."""
    rows = rows.withColumn("h_", seeded(key, seed)).withColumn("slice_", F.substring("h_", 1, 3))
    counts = rows.groupBy(*group, "slice_").agg(F.count("*").alias("c_"))
    earlier = F.sum("c_").over(W.partitionBy(*group).orderBy("slice_").rowsBetween(W.unboundedPreceding, -1))
    return rows.join(counts.select(*group, "slice_", F.coalesce(earlier, F.lit(0)).alias("before_")), [*group, "slice_"])


def _rank(group: list[str], key: str) -> Column:
    return F.col("before_") + F.row_number().over(W.partitionBy(*group, "slice_").orderBy("h_", key))


def sample_by_depth(questions: DataFrame, key: str, end_pos: str, most: int, length: int, seed: int = 0) -> DataFrame:
    """``questions`` with depth_bin_index, at most ``most`` of them: an even share from each fifth of the novel, the first
    fifths one more where it doesn't divide; what a fifth lacks is filled from all the others at random. All of them when
    there are no more than ``most``.

    Rows are numbered by slices of the hash, and only slices that the share reaches into are put in order."""
    rows = questions.withColumn("depth_bin_index", depth_bin_index(F.col(end_pos), length))
    if most <= 0:
        return rows.limit(0)
    counts = {r["depth_bin_index"]: r["n"] for r in rows.groupBy("depth_bin_index").agg(F.count("*").alias("n")).collect()}
    if most >= sum(counts.values()):
        return rows
    share = {b: most // 5 + (b < most % 5) for b in range(5)}
    quota = F.lit(most // 5) + (F.col("depth_bin_index") < most % 5).cast("int")
    placed = _placed(rows, ["depth_bin_index"], key, seed)
    near = placed.where(F.col("before_") < quota).withColumn("rank_", _rank(["depth_bin_index"], key))
    keep = rows.columns
    taken = near.where(F.col("rank_") <= quota).select(*keep)
    short = sum(max(0, q - counts.get(b, 0)) for b, q in share.items())
    if not short:
        return taken
    rest = near.where(F.col("rank_") > quota).select(*keep).unionByName(placed.where(F.col("before_") >= quota).select(*keep))
    fill = _placed(rest.withColumn("all_", F.lit(1)), ["all_"], key, seed + 1).where(F.col("before_") < short)
    return taken.unionByName(fill.withColumn("rank_", _rank(["all_"], key)).where(F.col("rank_") <= short).select(*keep))


def sample_each(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random from each group. Groups are cut to ``n`` rows within slices of the hash first, so that the last
    step sees at most n rows of each slice, however large the group."""
    h = seeded(key, seed)
    sliced = df.withColumn("h_", h).withColumn("s_", F.substring("h_", 1, 2))
    few = sliced.withColumn("r_", F.row_number().over(W.partitionBy(group, "s_").orderBy("h_", key))).where(F.col("r_") <= n)
    return few.withColumn("r_", F.row_number().over(W.partitionBy(group).orderBy("h_", key))).where(F.col("r_") <= n).drop("h_", "s_", "r_")


def random_choice(key: Column, choices: tuple[str, ...], seed: int = 0) -> Column:
    """One of ``choices`` for each key."""
    return F.element_at(F.array(*map(F.lit, choices)), (seeded_number(key, seed) % len(choices)).cast("int") + 1)
