"""Groups of records that differ by small edits.

A record is a weighted set of elements. Its signature is a ProbMinHash: each element is a Poisson process whose rate is its
weight, each arrival falls on a random slot, and a slot keeps the element that reaches it first. Arrivals are made in order of
time while the record's latest slot is kept up to date, so an element stops as soon as its next arrival comes after that slot.
Two signatures agree in a slot with probability equal to the probability Jaccard similarity of the sets, which for equal
weights is the Jaccard similarity. Signatures are cut into bands; records that share a band are compared exactly, by the same
similarity, and links are followed to groups.

Records with the same set are one class from the start. A band's bucket is never spread out into pairs: the task that holds
it sends a spanning forest of its verified links. A bucket of more than ``bucket_rows`` classes goes in two steps. First it is
cut into chunks, each compared within itself and with two pivots that all chunks share, which links a bucket of one template
at the cost of its length. Then, with the groups so far, only classes outside the bucket's main group are compared with the
rest, in blocks ordered by set size, every two blocks in a task of their own and pairs of one group left out. So no link is
lost and no task grows with the bucket.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import HAN
from lectern.plans.session import cut, spread

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)
_WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
#: Classes in a bucket that one task compares among themselves.
BUCKET_ROWS = 256
#: Buckets of more than two classes whose keys are sent to all executors; more of them are joined by a shuffle.
SENT_BUCKETS = 500_000


def plan_bands(threshold: float, rows: int = 6, miss: float = 1e-4) -> tuple[int, int]:
    """(bands, rows): as many bands as let a pair at the threshold be missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows))), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Elements whose next arrivals are made at once.
_AT_ONCE = 16_384


def prob_min_hash(record: np.ndarray, elements: np.ndarray, weights: np.ndarray, records: int, slots: int, seed: int = 0, made: list | None = None) -> np.ndarray:
    """The element that reaches each slot of each record first, as an array of ``records`` rows.

    ``record`` (ascending), ``elements`` (uint64) and ``weights`` (positive) are parallel; a record's elements must be distinct,
    and every record needs one. The i-th arrival of an element is the same in every record but for the rate. ``made`` is given
    the number of arrivals made, step by step."""
    first, winner = np.full(records * slots, np.inf), np.zeros(records * slots, np.uint64)
    latest = np.full(records, np.inf)  # running maximum over the slots of each record
    now = np.zeros(len(elements))
    with np.errstate(over="ignore"):
        base = elements.astype(np.uint64) + np.uint64(seed) * _M1
    active, done = np.arange(len(elements)), 0
    step = int(min(64, max(2, 2 * slots * records // max(1, len(elements)))))
    while len(active):
        for part in np.array_split(active, -(-len(active) // _AT_ONCE)):
            of = record[part]
            part, of = part[now[part] < latest[of]], of[now[part] < latest[of]]
            with np.errstate(over="ignore"):
                h = _mix(base[part, None] + np.arange(done + 1, done + step + 1, dtype=np.uint64) * _GOLDEN)
            times = now[part, None] + np.cumsum(-np.log(((h >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32), axis=1) / weights[part, None]
            now[part] = times[:, -1] if len(part) else 0.0
            early = times < latest[of][:, None]
            row, _ = np.nonzero(early)
            times, slot = times[early], of[row] * slots + (((h[early] & _LOW) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, slot, times)
            won = first[slot] == times
            winner[slot[won]] = elements[part[row[won]]]
            if made is not None:
                made.append(int(h.size))
            here = np.unique(of)
            latest[here] = first.reshape(records, slots)[here].max(axis=1)
        active = active[now[active] < latest[record[active]]]
        done += step
    return winner.reshape(records, slots)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; a Han character is a run by itself."""
    return _WORD.findall(text.lower()) if text else []


def element_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the different words."""
    return np.array(sorted({xxhash.xxh64_intdigest(w) for w in words_of(text)}), np.uint64)


def _shingles(text: str | None, size: int) -> list[str]:
    w = words_of(text)
    return [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the different runs of ``size`` words; of all words where there are fewer."""
    return np.array(sorted(map(xxhash.xxh64_intdigest, set(_shingles(text, size)))), np.uint64)


def shingle_counts(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The elements of :func:`shingle_set` and how often each occurs."""
    n = Counter(map(xxhash.xxh64_intdigest, _shingles(text, size)))
    return np.array(sorted(n), np.uint64), np.array([n[e] for e in sorted(n)], np.float64)


def set_similarity(a: tuple, b: tuple) -> float:
    """Jaccard similarity of two frozen sets, each the first of a tuple."""
    both = len(a[0] & b[0])
    return both / max(1, len(a[0]) + len(b[0]) - both)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted elements, weights): the sum over common elements d of
    1 / sum over e of max(a_e / a_d, b_e / b_d). With the common elements in order of a_e / b_e, the maximum is the first
    ratio for all from d on and for those of ``a`` alone, and the second for all before d and those of ``b`` alone."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][ia], b[1][ib]
    by = np.argsort(wa / wb, kind="stable")
    wa, wb = wa[by], wb[by]
    from_a = wa[::-1].cumsum()[::-1] + (a[1].sum() - wa.sum())
    before_b = wb.cumsum() - wb + (b[1].sum() - wb.sum())
    return float((1.0 / (from_a / wa + before_b / wb)).sum())


_SET = "struct<own:array<bigint>,weight:array<double>>"


def _sets(elements, weighted: bool):
    @F.pandas_udf(_SET)
    def make(texts: pd.Series) -> pd.DataFrame:
        got = [elements(t) for t in texts]
        own = [(g[0] if weighted else g).view(np.int64) for g in got]
        return pd.DataFrame({"own": pd.Series(own, dtype=object), "weight": pd.Series([g[1] if weighted else None for g in got], dtype=object)})

    return make("text")


def _bands(bands: int, rows: int, seed: int):
    """(cls, bands): the keys of all bands of each class."""

    def keys(own: list, weight: list) -> np.ndarray:
        n = [len(x) for x in own]
        flat = np.concatenate(own).astype(np.int64).view(np.uint64)
        sig = prob_min_hash(np.repeat(np.arange(len(n)), n), flat, np.concatenate(weight) if isinstance(weight[0], np.ndarray) else np.ones(len(flat)), len(n), bands * rows, seed).reshape(len(n), bands, rows)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(n), bands))
            for j in range(rows):
                key = _mix(key ^ sig[:, :, j]) * _M2 + np.uint64(j)
        return key.view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["own"].map(len).to_numpy()
            part = (np.cumsum(size) - size) // _AT_ONCE
            for k in np.unique(part):
                own = pdf[part == k]
                yield pd.DataFrame({"cls": own["cls"].to_numpy(), "bands": list(keys(own["own"].tolist(), own["weight"].tolist()))})

    return run


def _forest(members: list[tuple], threshold: float, other: list[tuple] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members``, or between ``members`` and ``other``: each is (class, group so far,
    set, weights or None). Pairs that are of one group by then are not compared."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    alike = probability_jaccard if members and members[0][3] is not None else set_similarity
    out = []
    for k, (a, ga, sa, wa) in enumerate(members):
        mine = find(ga)
        for b, gb, sb, wb in other if other is not None else members[:k]:
            if gb == ga or a == b or (wa is None and (len(sa) < threshold * len(sb) or len(sb) < threshold * len(sa))):
                continue
            his = find(gb)
            if mine != his and alike((sa, wa), (sb, wb)) >= threshold - 1e-9:
                root[mine] = mine = his
                out.append((a, b) if a < b else (b, a))
    return out


def _bucket_links(threshold: float):
    """Over partitions sorted by bucket; side 0: compared among themselves, 1 with 2: compared with one another."""

    def links(rows: list) -> list[tuple[int, int]]:
        sides: list[list] = [[], [], []]
        for side, c, group, own, weight in rows:
            plain = not isinstance(weight, np.ndarray)
            sides[side].append((c, group, frozenset(own.tolist()) if plain else own, None if plain else weight))
        return _forest(sides[0], threshold) if sides[0] else _forest(sides[1], threshold, sides[2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, out = None, [], []
        for pdf in batches:
            for b, *row in zip(pdf["bucket"].tolist(), pdf["side"].tolist(), pdf["cls"].tolist(), pdf["grp"].tolist(), pdf["own"], pdf["weight"]):
                if b != bucket:
                    out += links(held)
                    bucket, held = b, []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
            out = []
        if rest := links(held):
            yield pd.DataFrame(rest, columns=["a", "b"])

    return run


def components(links: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``nodes`` reaches over ``links`` (a, b).

    Alternating large-star and small-star steps on the links; each round's links are written to the shared folder. Links
    never grow in number, and the rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: each node with its smaller neighbours
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = cut(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("the links did not settle")
    return nodes.join(edges.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_copy_groups(df: DataFrame, id_col: str, text: Column, threshold: float = 0.8, elements=shingle_set, weighted: bool = False, rows: int = 6, miss: float = 1e-4, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_col, group_id): one row per record; records that share a group are linked directly or through others.

    Two records are linked when the Jaccard similarity of their ``elements`` (by default runs of five words) is at least
    ``threshold``; with ``weighted``, ``elements`` gives (elements, weights), as :func:`shingle_counts` does, and the probability
    Jaccard similarity counts. ``group_id`` is the smallest id of the group. Rows that repeat an id count once; rows with a null
    id are left out. A record without any element (null, empty or blank text) is a group of its own. Ids are BIGINT. A pair at
    the threshold is missed with probability ``miss`` at most, before links through others.
    """
    bands, rows = plan_bands(threshold, rows, miss)
    base = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).where("id is not null").groupBy("id").agg(F.min_by("text", F.coalesce("text", F.lit(""))).alias("text"))
    sets = cut(spread(base).select("id", _sets(elements, weighted).alias("s")).select("id", "s.own", "s.weight").withColumns({"p": F.xxhash64("own", "weight"), "q": F.xxhash64(F.lit(1), "own", "weight")}))
    classes = cut(sets.where("size(own) > 0").groupBy("p", "q").agg(F.min("id").alias("cls"), F.first("own").alias("own"), F.first("weight").alias("weight")))
    kinds = classes.select("cls", "own", "weight")
    links = _Links(kinds, threshold)
    banded = cut(spread(kinds).mapInPandas(_bands(bands, rows, seed), "cls bigint, bands array<bigint>")).select("cls", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("cls").alias("least"), F.max("cls").alias("most")).where("n > 1"))
    more = shared.where("n > 2").select("band", "n")
    held = cut(banded.join(F.broadcast(more) if more.count() <= SENT_BUCKETS else more, "band").select("band", "cls", "n"))
    small = held.where(F.col("n") <= bucket_rows).groupBy("band").agg(F.sort_array(F.collect_list("cls")).alias("all")).select("all").unionByName(shared.where("n = 2").select(F.array("least", "most").alias("all"))).distinct()
    found = links.among(small.select(F.xxhash64("all").alias("bucket"), F.explode("all").alias("cls")).select("bucket", F.lit(0).alias("side"), "cls", F.col("cls").alias("grp")))
    hot = held.where(F.col("n") > bucket_rows)
    if not hot.isEmpty():
        hot = cut(_different_buckets(hot))
        found = cut(found.unionByName(links.among(_chunks(hot, bucket_rows))))
        groups = cut(components(found, kinds.select(F.col("cls").alias("node"))))
        far = links.among(_outside_main_group(hot, kinds, groups, threshold if not weighted else 0.0, bucket_rows))
        found = far.unionByName(groups.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    found = components(found, kinds.select(F.col("cls").alias("node")))
    roots = sets.where("size(own) > 0").select("id", "p", "q").join(classes.select("p", "q", "cls"), ["p", "q"]).join(found, F.col("cls") == F.col("node")).select("id", F.col("root").alias("group_id"))
    alone = sets.where("size(own) = 0").select("id", F.col("id").alias("group_id"))
    return roots.unionByName(alone).withColumnRenamed("id", id_col)


class _Links:
    """Verified links inside buckets of classes."""

    def __init__(self, kinds: DataFrame, threshold: float):
        self.kinds, self.threshold = kinds, threshold

    def among(self, members: DataFrame) -> DataFrame:
        """(a, b) for ``members`` (bucket, side, cls, grp)."""
        rows = members.join(self.kinds, "cls").select("bucket", "side", "cls", "grp", "own", "weight")
        return rows.repartition("bucket").sortWithinPartitions("bucket", "side", "cls").mapInPandas(_bucket_links(self.threshold), "a bigint, b bigint").distinct()


def _different_buckets(rows: DataFrame) -> DataFrame:
    """Large buckets, one of those with the same members."""
    h = F.xxhash64("cls")
    sums = rows.groupBy("band").agg(F.count("*").alias("c"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return rows.join(sums.groupBy("c", "x", "s").agg(F.min("band").alias("band")).select("band"), "band")


def _chunks(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Members of large buckets in chunks of about ``bucket_rows``, and with each chunk the two pivots of its bucket."""
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    bucket = F.xxhash64("band", "chunk").alias("bucket")
    own = rows.withColumn("chunk", F.pmod(F.xxhash64("cls"), chunks).cast("int")).select(bucket, "cls")
    pivots = rows.groupBy("band").agg(F.first("n").alias("n"), F.min("cls").alias("x"), F.max("cls").alias("y"))
    pivots = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(bucket, F.explode(F.array("x", "y")).alias("cls"))
    return own.unionByName(pivots).distinct().select("bucket", F.lit(0).alias("side"), "cls", F.col("cls").alias("grp"))


def _outside_main_group(rows: DataFrame, kinds: DataFrame, groups: DataFrame, threshold: float, bucket_rows: int) -> DataFrame:
    """Members of large buckets, once for each pair of blocks they take part in. Blocks hold either the members of the bucket's
    largest group or others, and follow the size of the sets; two blocks of the largest group make no pair, nor do blocks whose
    sizes cannot meet the threshold. Ranks come from counts per (bucket, part, size, slice of the hash), so that no window holds
    a bucket."""
    mine = rows.join(groups, F.col("cls") == F.col("node")).select("band", "cls", F.col("root").alias("grp"))
    main = mine.groupBy("band", "grp").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"), F.count("*").alias("of"))
    sized = mine.join(main.where("of > 1"), "band").join(kinds.select("cls", F.size("own").alias("len")), "cls")
    sized = cut(sized.select("band", "cls", "grp", (F.col("grp") == F.col("main")).alias("inside"), "len", F.pmod(F.xxhash64("cls"), F.lit(1024)).alias("slice")))
    counts = sized.groupBy("band", "inside", "len", "slice").agg(F.count("*").alias("c"))
    order = "partition by band, inside order by len, slice rows between unbounded preceding and 1 preceding"
    before = counts.selectExpr("band", "inside", "len", "slice", f"coalesce(sum(c) over ({order}), 0) as before")
    block = f"cast((before + row_number() over (partition by band, inside, len, slice order by cls) - 1) div {bucket_rows} as int) as block"
    placed = cut(sized.join(before, ["band", "inside", "len", "slice"]).selectExpr("band", "cls", "grp", "inside", "len", block))
    limits = placed.groupBy("band", "inside", "block").agg(F.min("len").alias("least"), F.max("len").alias("most"))
    x, y = limits.where("not inside").alias("x"), limits.alias("y")
    ordered = F.col("y.inside") | (F.col("x.block") <= F.col("y.block"))
    near = (F.col("x.most") >= threshold * F.col("y.least")) & (F.col("y.most") >= threshold * F.col("x.least"))
    mates = cut(x.join(y, "band").where(ordered & near).select("band", F.col("x.block").alias("i"), F.col("y.inside").alias("with"), F.col("y.block").alias("j")))
    bucket = F.xxhash64("band", "i", "with", "j").alias("bucket")
    same = ~F.col("with") & (F.col("i") == F.col("j"))
    one = placed.where("not inside").join(mates.withColumn("block", F.col("i")), ["band", "block"]).select(bucket, F.when(same, 0).otherwise(1).alias("side"), "cls", "grp")
    two = placed.join(mates.where(~same).withColumn("block", F.col("j")).withColumn("inside", F.col("with")), ["band", "inside", "block"]).select(bucket, F.lit(2).alias("side"), "cls", "grp")
    return one.unionByName(two)


def group_pairs(groups: DataFrame, id_col: str, blocks: int = 16) -> DataFrame:
    """(id_col_a, id_col_b): all pairs within the groups, the smaller id first. Groups meet in blocks by id, so that one
    large group is spread over ``blocks`` squared keys; the pairs themselves are the result asked for."""
    own = groups.join(groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"), "group_id").withColumn("blk", F.when(F.col("n") > 2_000, F.pmod(F.xxhash64(id_col), F.lit(blocks))).otherwise(F.lit(0)))
    every = F.explode(F.when(F.col("n") > 2_000, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.lit(0))))
    a = own.select("group_id", F.col(id_col).alias(f"{id_col}_a"), F.col("blk").alias("ba"), every.alias("bb"))
    b = own.select("group_id", F.col(id_col).alias(f"{id_col}_b"), F.col("blk").alias("bb"), every.alias("ba"))
    return a.join(b, ["group_id", "ba", "bb"]).where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b")
