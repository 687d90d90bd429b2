"""Finding quoted evidence in its context, exactly or nearly."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.session import task_count

_SPACES = re.compile(r"\s+")
# Marks that compatibility form leaves and that count as their plain counterparts.
_MARKS = str.maketrans("。【】", ".[]")
MATCH = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("similarity", T.DoubleType())])


def plain_text(text: str) -> str:
    """Compatibility form, lower case, single spaces, plain marks."""
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", text).lower()).translate(_MARKS).strip()


def _near_ends(evidence: str, context: str, most: float) -> np.ndarray:
    """For each place of the context, whether some stretch that ends there can be made of the evidence by at most ``most``
    deletions and insertions. One pass over the context; each step takes all prefixes of the evidence at once."""
    n = len(evidence)
    steps = np.arange(n + 1)
    letters = np.array([ord(c) for c in evidence], np.int64)
    same = {c: np.flatnonzero(letters == ord(c)) for c in set(context)}
    cost, out = steps.copy(), np.zeros(len(context) + 1, bool)
    for j, c in enumerate(context):
        new = cost + 1
        at = same[c]
        new[at + 1] = np.minimum(new[at + 1], cost[at])
        new[0] = 0  # a stretch may begin anywhere
        cost = np.minimum.accumulate(new - steps) + steps
        out[j + 1] = cost[n] <= most
    return out


def best_similarity(evidence: str, context: str, floor: float = 0.0) -> float | None:
    """The best ratio of the evidence with any stretch of the context of 0.8 to 1.2 times its length (10 at least), or null when
    that is below ``floor``.

    Upper bounds of the ratio rule out most stretches: with a floor, the edits that stretches with the same end need at least;
    then the letters a stretch has in common with the evidence, counted for all stretches of a length at once. Stretches are
    compared from the highest bound down, until no bound exceeds the best ratio. The best ratio is the same as without bounds."""
    n, best = len(evidence), 0.0
    widest = min(int(n * 1.2), len(context))
    sizes = range(max(10, int(n * 0.8)), widest + 1)
    ends = _near_ends(evidence, context, (n + widest) * (1 - floor) + 1e-9) if floor > 0.5 and sizes else None
    if not sizes or ends is not None and not ends.any():
        return 0.0 if floor <= 0 else None
    letters = sorted(set(evidence))
    need = np.array([evidence.count(c) for c in letters], np.int32)[:, None]
    place = {c: k for k, c in enumerate(letters)}
    of = np.array([place.get(c, -1) for c in context], np.int64)
    seen = np.zeros((len(letters), len(context) + 1), np.int32)
    at = np.flatnonzero(of >= 0)
    seen[of[at], at + 1] = 1
    seen = seen.cumsum(axis=1, dtype=np.int32)
    found = []
    for size in sizes:
        start = np.arange(len(context) - size + 1) if ends is None else np.flatnonzero(ends[size:])
        bound = 2.0 * np.minimum(seen[:, start + size] - seen[:, start], need).sum(axis=0) / (n + size)
        near = (bound >= floor) & (bound > 0)
        found.append((bound[near], start[near], np.full(int(near.sum()), size)))
    bound, start, size = map(np.concatenate, zip(*found))
    m = SequenceMatcher(None)
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] <= best:
            break
        m.set_seqs(evidence, context[start[k] : start[k] + size[k]])
        best = max(best, m.ratio())
    return best if best >= floor else None


def match(evidence: str | None, context: str | None, threshold: float = 0.8) -> tuple[bool, float]:
    """(found, similarity): a stretch of the context word for word is 1.0; blank texts are never found."""
    if not evidence or not evidence.strip() or not context or not context.strip():
        return False, 0.0
    e, c = plain_text(evidence), plain_text(context)
    if e in c:
        return True, 1.0
    best = best_similarity(e, c)
    return best >= threshold, best


@F.pandas_udf(T.StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """See :func:`plain_text`; null stays null."""
    return texts.map(plain_text, na_action="ignore")


def match_evidence(df: DataFrame, evidence: str, context: str, threshold: float = 0.8, floor: float = 0.0) -> DataFrame:
    """``df`` with evidence_found and evidence_similarity. Texts are normalized first; quotations that are whole are settled
    by the engine, and only the others go to the slow comparison, which is spread evenly over the tasks.

    Null and blank texts have similarity 0. A similarity below ``floor`` comes out as null: with a floor of the threshold
    only stretches that may reach it are compared, a thousandth of the work where nothing matches."""

    @F.pandas_udf(T.DoubleType())
    def similarity(evidence: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([best_similarity(e, c, floor) for e, c in zip(evidence, context)], dtype=float)

    # not to be called once more by filters that are moved below them
    text = lambda c: normalize_text.asNondeterministic()(F.coalesce(c, F.lit("")))
    ready = df.withColumn("e_", text(evidence)).withColumn("c_", text(context))
    blank = (F.col("e_") == "") | (F.col("c_") == "")
    state = F.when(blank, 0).when(F.contains("c_", "e_"), 1)
    ready = ready.withColumn("s_", state)
    settled = ready.where("s_ is not null").withColumn("evidence_similarity", F.col("s_").cast("double"))
    rest = ready.where("s_ is null").repartition(task_count(df.sparkSession)).withColumn("evidence_similarity", F.nanvl(similarity("e_", "c_"), F.lit(None).cast("double")))
    return settled.unionByName(rest).drop("e_", "c_", "s_").withColumn("evidence_found", F.coalesce((F.col("evidence_similarity") >= threshold) & (F.col("evidence_similarity") > 0), F.lit(False)))
