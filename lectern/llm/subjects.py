"""Subjects of documents by what their sentences are about.

Sentences are embedded by weighted terms and a truncated singular value decomposition. A term's weight is its inverse
frequency by sentence over the whole corpus times how far the labels of the documents it occurs in stray from the labels at
large, so that names and phrases of every kind of document weigh little. Centroids seeded in the sentences of each label
are refined by cosine similarity (spherical k-means) over labelled and unlabelled sentences, so that words no labelled document
holds stand beside those they occur with. A centroid stands for a subject when the labels of the documents behind it are far
better explained by the subject than by the labels at large, and for none otherwise, which is where figures of speech gather.
A sentence takes the subject of its nearest centroid, a document the subjects of at least a quarter of its sentences.

The model is fitted on a bounded sample of sentences; frequencies and assignments cover every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import HAN
from lectern.llm.one_form import TAG, shape
from lectern.plans.session import cut

_TOKENS = re.compile(f"[{HAN}]+|[^\\W\\d_{HAN}]+|[.!?。¶]")
_ENDS = frozenset(".!?。¶")

#: Labelled documents that the model is fitted on, and sentences of them, at most.
LABEL_DOCS, LABEL_SENTENCES = 3_000, 60_000
#: Other documents and sentences of them, which have a part in the embedding and the centroids, at most.
OTHER_DOCS, OTHER_SENTENCES = 2_500, 40_000
#: Terms of a sentence in the sample; a longer one counts as several. With the numbers above this bounds what the driver collects.
SENTENCE_TERMS = 200
MAX_SUBJECTS = 1_000
DIMENSIONS, CENTROIDS, ROUNDS = 64, 1_000, 8
#: Sentences of the sample for each centroid, at least.
CENTROID_SENTENCES = 25
#: Sentences with fewer terms (headings, numbers) do not count; terms that occur less often in the corpus weigh nothing.
LEAST_TERMS, LEAST_FREQUENCY = 3, 5
SHARE = 0.25
#: Documents that a centroid about a subject holds without its label, as some sentences stray and a few labels are wrong.
STRANGE = 0.1
#: Cosine similarity of centroids from which one's evidence counts for the other.
ALIKE = 0.6
#: Log of the odds, for a subject beside none, from which a centroid stands for it.
EVIDENCE = 2.0


class _Ids(dict):
    """Numbers of terms: 0 for the end of a sentence, a list for a run of Han characters."""

    def __missing__(self, w: str):
        if w in _ENDS:
            x = 0
        elif re.match(f"[{HAN}]", w):
            return [self._of(w[i : i + 2]) for i in range(len(w) - 1)]
        else:
            x = self._of(w)
        if len(self) < 500_000:
            self[w] = x
        return x

    @staticmethod
    def _of(w: str) -> int:
        return (xxhash.xxh32_intdigest(w) & 0x7FFFFFFF) or 1


def sentence_terms(text: str | None, ids: _Ids) -> list[int]:
    """Term numbers of a whole text with 0 after each sentence."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub("", text)
    toks = [ids[w] for w in _TOKENS.findall(shape(text.replace("\n", "¶")).lower())]
    if any(type(x) is list for x in toks):
        toks = [y for x in toks for y in (x if type(x) is list else (x,))]
    toks.append(0)
    return toks


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Terms of each document, and one row without a document that holds the partition's term counts; in it term 0 counts
    the sentences."""
    ids, known, counts = _Ids(), np.empty(0, np.int32), np.empty(0, np.int64)
    for pdf in batches:
        terms = [np.array(sentence_terms(t, ids), np.int32) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "terms": terms, "counts": None})
        flat = np.concatenate(terms) if terms else np.empty(0, np.int32)
        here, sentence = _sentences(flat)
        own, n = np.unique(flat[here], return_counts=True)
        both, at = np.unique(np.concatenate((known, own, np.zeros(1, np.int32))), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, n, [int(sentence[-1]) + 1 if len(here) else 0]))).astype(np.int64)
        known = both
    yield pd.DataFrame({"doc_id": [None], "terms": [known], "counts": [counts]})


def _sentences(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of terms that count, number of the sentence of each), over sentences with enough terms; numbers are dense."""
    end = terms == 0
    sentence = np.cumsum(end) - end
    here = np.flatnonzero(~end)
    size = np.bincount(sentence[here], minlength=int(end.sum()) + 1)
    keep = size >= LEAST_TERMS
    here = here[keep[sentence[here]]]
    return here, (np.cumsum(keep) - 1)[sentence[here]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _nearest(e: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of ``c`` that is most like each row of ``e``."""
    return np.concatenate([(e[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(e), 4096)] or [np.empty(0, np.int64)])


def _sums(cuts: np.ndarray, index: np.ndarray, value: np.ndarray | None, m: np.ndarray) -> np.ndarray:
    """For each stretch of ``index`` the sum of the rows of ``m`` it names, times ``value``. Columns are summed one by one, as
    their places lie side by side then."""
    out, columns = np.zeros((len(cuts) - 1, m.shape[1]), np.float32), np.ascontiguousarray(m.T)
    for a in range(0, len(cuts) - 1, 8192):
        b = min(len(cuts) - 1, a + 8192)
        lo, hi = cuts[a], cuts[b]
        full = cuts[a + 1 : b + 1] > cuts[a:b]
        if hi > lo:
            at, starts, own = index[lo:hi], (cuts[a:b] - lo)[full], None if value is None else value[lo:hi]
            part = np.empty((m.shape[1], len(starts)), np.float32)
            for k, column in enumerate(columns):
                x = column[at]
                np.add.reduceat(x if own is None else x * own, starts, out=part[k])
            out[a:b][full] = part.T
    return out


def _turns(kind: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Places such that the kinds take turns, in random order within each."""
    turn = rng.permutation(len(kind))
    order = np.lexsort((turn, kind))
    place = np.empty(len(kind), np.int64)
    place[order] = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])
    return np.lexsort((turn, place))


def _evidence(near: np.ndarray, of: np.ndarray, has: np.ndarray, centroids: int) -> np.ndarray:
    """(centroid, subject): the log of how much better a centroid about the subject explains the labels of the documents behind
    it than one about nothing. ``near`` and ``of`` have the centroid and the document of each labelled sentence, ``has``
    (document, subject) the labels. A document counts once for each centroid, as its sentences share their label."""
    usual = has[of].mean(0).clip(1e-3, 1 - 1e-3)
    pair = np.unique(near * len(has) + of)
    c, d = pair // len(has), pair % len(has)
    with_it = np.zeros((centroids, has.shape[1]))
    np.add.at(with_it, c, has[d])
    without = np.bincount(c, minlength=centroids)[:, None] - with_it
    return with_it * np.log((1 - STRANGE) / usual) + without * np.log(STRANGE / (1 - usual))


def _pooled(c: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Evidence of each centroid with that of others of a similar direction, less the more they differ."""
    out = np.empty_like(evidence)
    for a in range(0, len(c), 512):
        out[a : a + 512] = ((c[a : a + 512] @ c.T - ALIKE) / (1 - ALIKE)).clip(0, 1) @ evidence
    return out


class SubjectModel:
    """Term vectors, centroids and their subjects."""

    def __init__(self, sentences: list[np.ndarray], of: np.ndarray, labels: list[frozenset | None], terms: np.ndarray, frequency: np.ndarray, total: int, subjects: list[str], seed: int = 0):
        """``sentences`` as term numbers, with the document of each in ``of`` and each document's labels (None: not labelled);
        ``terms`` (sorted) with the number of times the corpus holds them, in ``total`` sentences."""
        rng = np.random.default_rng(seed)
        self.subjects, self.terms = subjects, terms
        self.vectors, self.centroids, self.meaning = np.zeros((len(terms), 1), np.float32), np.zeros((1, 1), np.float32), np.array([-1])
        n, k = len(sentences), len(subjects)
        known = np.array([x is not None for x in labels], bool)
        if not n or not k or not known[of].any():
            return
        rows = np.repeat(np.arange(n), [len(x) for x in sentences])
        cols = np.searchsorted(terms, np.concatenate(sentences))
        kinds = {frozenset([s]): i for i, s in enumerate(subjects)} | {frozenset(): k}
        kind = np.array([-1 if x is None else kinds.get(x, k + 1) for x in labels])[of]
        base = (np.bincount(kind[kind >= 0], minlength=k + 2) + 1e-3) / (kind >= 0).sum()
        seen = np.zeros((len(terms), k + 2))
        labelled = kind[rows] >= 0
        np.add.at(seen, (cols[labelled], kind[rows[labelled]]), 1)
        p = (seen + 10 * base) / (seen.sum(1, keepdims=True) + 10)
        stray = (p * np.log(p / base)).sum(1)
        weight = (np.log(np.maximum(total, 1) / np.maximum(frequency, 1)).clip(0) * (stray + 0.2) * (frequency >= LEAST_FREQUENCY)).astype(np.float32)
        cuts = np.searchsorted(rows, np.arange(n + 1))
        value = weight[cols]
        value /= np.maximum(np.sqrt(np.bincount(rows, value * value, minlength=n)), 1e-9)[rows].astype(np.float32)
        by = np.argsort(cols, kind="stable")
        cuts_t, rows_t, value_t = np.searchsorted(cols[by], np.arange(len(terms) + 1)), rows[by], value[by]
        wide = min(DIMENSIONS + 10, len(terms), n)
        q = np.linalg.qr(rng.normal(size=(len(terms), wide)).astype(np.float32))[0]
        again = lambda q: _sums(cuts_t, rows_t, value_t, _sums(cuts, cols, value, q))
        for _ in range(3):
            q = np.linalg.qr(again(q))[0]
        _, u = np.linalg.eigh((q.T @ again(q)).astype(np.float64))
        self.vectors = (q @ u[:, ::-1][:, : min(DIMENSIONS, wide)].astype(np.float32)) * weight[:, None]
        e = _unit(_sums(cuts, cols, None, self.vectors))
        c = e[_turns(kind, rng)[: max(1, min(CENTROIDS, n // CENTROID_SENTENCES))]]
        for _ in range(ROUNDS):
            near = _nearest(e, c)
            o = np.argsort(near, kind="stable")
            at = np.searchsorted(near[o], np.arange(len(c) + 1))
            c = np.where((at[1:] > at[:-1])[:, None], _unit(_sums(at, o, None, e)), c)
        has = np.array([[x is not None and s in x for s in subjects] for x in labels], float)
        told = np.flatnonzero(kind >= 0)
        own = _evidence(_nearest(e, c)[told], of[told], has, len(c))
        evidence = np.where((np.abs(own.max(1)) >= EVIDENCE)[:, None], own, _pooled(c, own))
        self.centroids = c
        self.meaning = np.where(evidence.max(1) >= EVIDENCE, evidence.argmax(1), -1)

    def assign(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence number of each counted term's sentence once, subject number of it or -1) for a stretch of terms."""
        here, sentence = _sentences(terms)
        if not len(here):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = int(sentence[-1]) + 1
        first = np.searchsorted(sentence, np.arange(n))
        t = terms[here]
        at = np.searchsorted(self.terms, t).clip(max=max(0, len(self.terms) - 1))
        known = self.terms[at] == t if len(self.terms) else np.zeros(len(t), bool)
        e = _sums(np.searchsorted(sentence[known], np.arange(n + 1)), at[known], None, self.vectors)
        return here[first], np.where(np.abs(e).sum(1) > 0, self.meaning[_nearest(e, self.centroids)], -1)


def _assign(model: SubjectModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(model.subjects) + 1
        for pdf in batches:
            terms = [np.asarray(t, np.int32) for t in pdf["terms"]]
            if not terms:
                continue
            where, subject = model.assign(np.concatenate(terms))
            doc = np.searchsorted(np.cumsum([len(t) for t in terms]), where, side="right")
            counts = np.bincount(doc * k + subject + 1, minlength=len(terms) * k).reshape(len(terms), k)
            total = counts.sum(1)
            d, s = np.nonzero(counts[:, 1:])
            if len(d):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject": [model.subjects[x] for x in s], "sentences": counts[d, s + 1], "of": total[d]})

    return run


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sentences that count, in stretches of at most SENTENCE_TERMS."""
    for pdf in batches:
        ids, places, out = [], [], []
        for i, t in zip(pdf["doc_id"], pdf["terms"]):
            t = np.asarray(t, np.int32)
            here, s = _sentences(t)
            at = np.searchsorted(s, np.arange(int(s[-1]) + 2)) if len(s) else np.zeros(1, np.int64)
            for a, b in zip(at[:-1], at[1:]):
                for x in range(a, b, SENTENCE_TERMS):
                    ids.append(i), places.append(x), out.append(t[here[x : min(b, x + SENTENCE_TERMS)]])
        if ids:
            yield pd.DataFrame({"doc_id": ids, "place": places, "sentence": out})


def _sampled(feats: DataFrame, chosen: DataFrame, most: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(doc_id of each sentence, sentences): at most ``most`` of the chosen documents, by a hash; cut and drawn by the executors,
    and collected as columns, which take a fraction of the memory of rows."""
    own = feats.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", "terms").mapInPandas(_sample, "doc_id bigint, place bigint, sentence array<int>")
    got = own.orderBy(F.xxhash64(F.lit(seed), "doc_id", "place"), "doc_id", "place").limit(most).toArrow().combine_chunks()
    ids, places = got["doc_id"].to_numpy(), got["place"].to_numpy()
    flat = pc.list_flatten(got["sentence"]).to_numpy().astype(np.int64)
    every = np.split(flat, np.cumsum(pc.list_value_length(got["sentence"]).to_numpy())[:-1]) if len(ids) else []
    order = np.lexsort((places, ids))
    return ids[order], [every[k] for k in order]


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_docs: int = LABEL_DOCS, label_sentences: int = LABEL_SENTENCES, other_docs: int = OTHER_DOCS, other_sentences: int = OTHER_SENTENCES, seed: int = 0) -> DataFrame:
    """(doc_id, subject, sentences, of): for each document and subject that any of its sentences is about, how many are, and
    of how many sentences. Documents without such a sentence (null and empty texts too) do not appear.

    ``labels`` has doc_id and subject, null for none; repeated labels count once, labels of unknown subjects are ignored.
    The model is fitted on at most ``label_sentences`` sentences of ``label_docs`` labelled documents and ``other_sentences`` of
    ``other_docs`` others, chosen by hashes. Ids are unique; a repeated id counts as one more document. Without labels nothing
    is about anything. More than MAX_SUBJECTS subjects are an error.
    """
    spark = docs.sparkSession
    names = sorted(r["subject"] for r in subjects.where("subject is not null").select("subject").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    made = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null").mapInPandas(_features, "doc_id bigint, terms array<int>, counts array<bigint>"))
    feats = made.where("doc_id is not null").select("doc_id", "terms")
    by_hash = lambda df, n: df.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)
    told = labels.where(F.col("doc_id").isNotNull() & (F.col("subject").isNull() | F.col("subject").isin(names))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_set("subject").alias("subjects"))
    chosen = by_hash(told, label_docs).collect()
    first = spark.createDataFrame([(r["doc_id"],) for r in chosen], "doc_id bigint")
    others = by_hash(feats.select("doc_id").join(told, "doc_id", "left_anti"), other_docs)
    label_of = {r["doc_id"]: frozenset(r["subjects"]) for r in chosen}
    (own, mine), (foreign, theirs) = _sampled(feats, first, label_sentences, seed), _sampled(feats, others, other_sentences, seed)
    sentences = mine + theirs
    known, of = np.unique(np.concatenate((own, foreign)), return_inverse=True)
    terms = np.unique(np.concatenate([*sentences, np.empty(0, np.int64)]))
    wanted = spark.createDataFrame(pd.DataFrame({"term": np.append(terms, 0).astype(np.int32)}), "term int")
    partial = made.where("doc_id is null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    got = {r["term"]: r["n"] for r in partial.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    model = SubjectModel(sentences, of, [label_of.get(i) for i in known.tolist()], terms, np.array([got.get(int(t), 0) for t in terms], float), int(got.get(0, 0)), names, seed)
    ready = spark.sparkContext.broadcast(model)
    return feats.mapInPandas(lambda it, b=ready: _assign(b.value)(it), "doc_id bigint, subject string, sentences bigint, of bigint")


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE, **more) -> DataFrame:
    """(doc_id, subject, sentences, of): the subjects of at least ``share`` of a document's sentences. See
    :func:`subject_shares`."""
    return subject_shares(docs, labels, subjects, **more).where(F.col("sentences") >= share * F.col("of"))
