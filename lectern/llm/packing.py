"""Packing documents into containers of fixed capacity.

Documents are measured in tokens of a public tokenizer. A document longer than the capacity is cut into full pieces, which
fill containers by themselves, and a remainder. Items above a third of the capacity go at most two to a container: the
largest is matched with the largest that still fits beside it, until none is left. Smaller items go, the largest first, to
the container with the least sufficient room. Items are divided over shards of bounded size, each packed by itself, so
that the waste of a shard's last container is spread over thousands of items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.tokens import load_vocabulary
from lectern.plans.session import cut, send_file

#: Items per shard on average.
SHARD_ITEMS = 20_000
#: Kinds of container that one pass over the measured documents takes; more are taken in several.
KINDS_PER_PASS = 1_000
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_STRETCH = 100_000


def count_tokens(encode, text: str | None) -> int:
    """Tokens of a whole text. Very long texts are encoded stretch by stretch, cut before a blank that follows a letter,
    where the tokenizer cuts as well."""
    if not text:
        return 0
    n = at = 0
    while len(text) - at > 2 * _STRETCH:
        end = at + _STRETCH
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
            end += 1
        n += len(encode(text[at:end]))
        at = end
    return n + len(encode(text[at:] if at else text))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, tokens). A null text has 0 tokens. The driver reads the vocabulary file and sends it to every executor."""
    local = send_file(docs.sparkSession, vocabulary)
    state: list = []

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(load_vocabulary(local()).encode_ordinary)
        return texts.map(lambda t: count_tokens(state[0], t)).astype("int64")

    return docs.select(F.col(id_col), count(text_col).alias("tokens"))


def pack_items(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item; sizes are positive and at most ``capacity``."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    where = [0] * len(sizes)
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    bins = 0
    large = [k for k in order if 3 * sizes[k] > capacity]
    waiting = [(sizes[k], -p) for p, k in enumerate(large)]  # ascending by size
    waiting.sort()
    while waiting:
        size, p = waiting.pop()
        where[large[-p]] = bins
        at = bisect_left(waiting, (capacity - size + 1, -len(large) - 1)) - 1
        if at >= 0:
            mate, q = waiting.pop(at)
            where[large[-q]] = bins
            size += mate
        if size < capacity:
            insort(rooms, (capacity - size, bins))
        bins += 1
    for k in order[len(large) :]:
        at = bisect_left(rooms, (sizes[k], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, bins
            bins += 1
        where[k] = b
        if room > sizes[k]:
            insort(rooms, (room - sizes[k], b))
    return where


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over partitions sorted by (shard, container)."""
    held: list[pd.DataFrame] = []
    key = None

    def flush() -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        pdf["bin"] = pack_items(pdf["tokens"].tolist(), int(pdf["capacity"].iloc[0]))
        return pdf[["container_id", "capacity", "shard", "bin", "doc_id", "piece", "pieces", "tokens"]]

    for pdf in batches:
        for k, part in pdf.groupby(["shard", "container_id"], sort=False):
            if k != key and held:
                yield flush()
                held = []
            key = k
            held.append(part)
    if held:
        yield flush()


def pack_documents(docs: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_id, capacity, shard, bin, doc_id, piece, pieces, tokens): every document in one container of each capacity,
    or, when it is longer than the capacity, cut into ``pieces``. (container_id, shard, bin) names one container.

    Null and empty texts have no tokens and are not packed; repeated ids count once (the longest text); containers with a
    null or non-positive capacity are left out; repeated containers count once. ``containers`` is a small table of kinds of
    container; documents are measured once for all of them.
    """
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text <> ''")
    counts = cut(token_counts(sized, "doc_id", "text", vocabulary).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0"))
    shards = max(1, round(counts.count() / shard_items))
    kinds = containers.where("capacity_tokens > 0 and container_id is not null").groupBy("container_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity")).orderBy("container_id").collect()
    sharded = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    each = None
    for k in range(0, max(1, len(kinds)), KINDS_PER_PASS):
        kind = [F.struct(F.lit(r["container_id"]).alias("container_id"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in kinds[k : k + KINDS_PER_PASS]]
        part = sharded.withColumn("kind", F.explode(F.array(*kind) if kind else F.expr("cast(array() as array<struct<container_id:string,capacity:bigint>>)"))).select("doc_id", "tokens", "shard", "kind.*")
        each = part if each is None else each.unionByName(part)
    pieces = F.ceil(F.col("tokens") / F.col("capacity")).cast("bigint")
    cuts = each.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), "pieces")))
    items = cuts.withColumn("tokens", F.least("capacity", F.col("tokens") - (F.col("piece") - 1) * F.col("capacity")))
    full = items.where("tokens = capacity").select("container_id", "capacity", F.lit(None).cast("int").alias("shard"), (F.xxhash64("doc_id", "piece")).alias("bin"), "doc_id", "piece", "pieces", "tokens")
    rest = items.where("tokens < capacity").select("container_id", "capacity", "shard", "doc_id", "piece", "pieces", "tokens")
    packed = rest.repartition("shard", "container_id").sortWithinPartitions("shard", "container_id").mapInPandas(_pack, "container_id string, capacity bigint, shard int, bin bigint, doc_id bigint, piece bigint, pieces bigint, tokens bigint")
    return packed.unionByName(full)


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_id, capacity, containers, documents, cut, tokens, unused, fill, least): one row for each kind of container of
    :func:`pack_documents`: how many containers hold how many documents (``cut``: those in more than one piece) and tokens, the
    space left over, the share filled, and the number of containers that no packing can go below. A kind that holds nothing has
    no row."""
    boxes = packed.groupBy("container_id", "capacity", "shard", "bin").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") == 1).alias("documents"), F.count_if((F.col("piece") == 1) & (F.col("pieces") > 1)).alias("cut"))
    sums = boxes.groupBy("container_id", "capacity").agg(F.count("*").alias("containers"), F.sum("documents").alias("documents"), F.sum("cut").alias("cut"), F.sum("tokens").alias("tokens"))
    space = F.col("containers") * F.col("capacity")
    return sums.select("container_id", "capacity", "containers", "documents", "cut", "tokens", (space - F.col("tokens")).alias("unused"), (F.col("tokens") / space).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least"))
