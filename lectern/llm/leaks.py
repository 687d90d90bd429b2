"""Test material inside training documents.

Documents are folded to words (Han characters are words by themselves) and gathered into shards. Each shard gets an
FM-index over the words of the test material, every other word being a separator: a suffix array by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All short phrases of the test material are
searched backward at once, their places are located from the samples, and runs of neighbouring hits are extended with a
bounded number of changed, missing and added words; a stretch begins and ends with an equal word, so that a shorter
quotation never counts as a longer one with its end left out. Spans that meet are merged for removal.

Hits are taken in slices of bounded size. A phrase that occurs often in both the items and the shard (a stock phrase) is only
followed in item texts that hold several of them: elsewhere each case has a run with a phrase of its own, which finds it.

A stretch of n >= 24 words with at most n/9 edits holds a run of at least 6 words without an edit, and a Chinese stretch of
n >= 36 a run of at least 7, so phrases of these lengths miss nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import HAN
from lectern.llm import one_form
from lectern.llm.one_form import TAG, shape

_WORDS = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_SPELLED = re.compile(f"[^\\W_{HAN}]")
_SPLIT_WORD = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")

MIN_WORDS, PHRASE = 24, 6
MIN_HAN, PHRASE_HAN = 36, 7
ONE_IN = 9
SHARD_WORDS = 2_000_000
SAMPLE = 4
#: Test items that one pass takes, and characters of them; more are taken in several passes.
ITEMS_PER_PASS, CHARACTERS_PER_PASS = 20_000, 20_000_000
#: Pairs of a place in a shard and a place in the items that are held at once.
SLICE_PAIRS = 2_000_000
#: Such pairs of one phrase in one shard from which it is a stock phrase.
STOCK_PAIRS = 50_000


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, blanks, markup and differences of characters of the same shape."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub("", text.replace("<br", " <br").replace("<p", " <p").replace("</p", " </p"))
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "-\r" in text:
        text = _SPLIT_WORD.sub("", text)
    return _WORDS.findall(shape(text).lower())


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_BLOCK = re.compile(r"<(?=br|p|/p)")
_ASCII_RUNS = re.compile(r"[\x00-\x7f]+|[^\x00-\x7f]+")
_CLUSTER = regex.compile(r"\X")


class _Traced:
    """A text with the place in the original of each of its characters, kept through changes."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def replace(self, spans, new) -> None:
        """``spans`` in order, as (start, end), become what ``new`` makes of their text."""
        out, start, end, at = [], [], [], 0
        for a, b in spans:
            x = new(self.text[a:b])
            out += [self.text[at:a], x]
            start += [self.start[at:a], np.full(len(x), self.start[a])]
            end += [self.end[at:a], np.full(len(x), self.end[b - 1])]
            at = b
        if at:
            self.text = "".join([*out, self.text[at:]])
            self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])

    def clusters(self, new) -> None:
        """Each character with the marks on it becomes what ``new`` makes of it; ASCII text stays."""
        spans = []
        for m in _ASCII_RUNS.finditer(self.text):
            if m[0][0] > "\x7f":
                a = max(0, m.start() - 1)
                spans += [(a + c.start(), a + c.end()) for c in _CLUSTER.finditer(self.text[a : m.end()])]
        self.replace([(a, b) for a, b in spans if new(self.text[a:b]) != self.text[a:b]], new)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the :func:`words` of a text begins and ends in it, in characters."""
    t = _Traced(text)
    spans = lambda pattern: [m.span() for m in pattern.finditer(t.text)]
    if "<" in text:
        t.replace(spans(_BLOCK), lambda x: " " + x)
        t.replace(spans(TAG), lambda x: "")
    if "&" in text:
        t.replace(spans(_ENTITY), html.unescape)
    if "-\n" in text or "-\r" in text:
        t.replace(spans(_SPLIT_WORD), lambda x: "")
    if not t.text.isascii():
        nfkc, nfc, nfd = (lambda x, f=f: unicodedata.normalize(f, x) for f in ("NFKC", "NFC", "NFD"))
        t.text = t.text.translate(one_form.LUNATE_SHAPES)
        t.clusters(nfkc)
        t.replace([(k, k + 1) for k, c in enumerate(t.text) if c.translate(one_form.DELETE) == ""], lambda x: "")
        t.clusters(lambda x: nfkc(x))
        t.clusters(lambda x: nfc(nfd(x).translate(one_form.SHAPES)))
    t.replace([(k, k + 1) for k, c in enumerate(t.text) if c.lower() != c], str.lower)
    found = list(_WORDS.finditer(t.text))
    start, end = t.start[[m.start() for m in found]], t.end[[m.end() - 1 for m in found]]
    own, want = [m[0] for m in found], words(text)
    if own == want:
        return start, end
    # text whose parts change one another: words between those that agree share their range
    start2, end2 = np.empty(len(want), np.int64), np.empty(len(want), np.int64)
    for _, a, b, x, y in SequenceMatcher(None, own, want, autojunk=False).get_opcodes():
        for k in range(x, y):
            same = b - a == y - x
            start2[k] = start[a + k - x] if same else start[a] if a < b else end[a - 1] if a else 0
            end2[k] = end[a + k - x] if same else end[b - 1] if a < b else start2[k]
    return start2, end2


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffix array of ``seq``; each 0 counts as a separator smaller than any word and than the separators after it. The
    last element must be 0."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    new[s == 0] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    single = new & np.append(new[1:], True)
    slots = np.flatnonzero(~single)  # places of the order that are not settled
    h = 1
    while len(slots):
        at = order[slots]
        key = rank[at] * n + rank[at + h]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks in a sequence of symbols below 2**levels."""

    def __init__(self, seq: np.ndarray, top: int):
        self.n, self.levels = len(seq), max(1, int(top).bit_length())
        self.words, self.before, self.zeros = [], [], []
        pad = -self.n % 64 + 64
        for b in range(self.levels - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(np.uint8)
            w = np.packbits(np.append(bit, np.zeros(pad, np.uint8)), bitorder="little").view(np.uint64)
            self.words.append(w)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(w), dtype=np.int64)[:-1])).astype(np.int32))
            one = bit.astype(bool)
            self.zeros.append(int(self.n - np.count_nonzero(one)))
            seq = np.concatenate((seq[~one], seq[one]))

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            a, b = self.ones(level, start), self.ones(level, i)
            start = np.where(one, self.zeros[level] + a, start - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - start

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before."""
        symbol, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level in range(self.levels):
            b = self.ones(level, i)
            one = (self.ones(level, i + 1) - b) == 1
            a = self.ones(level, start)
            start = np.where(one, self.zeros[level] + a, start - a)
            i = np.where(one, self.zeros[level] + b, i - b)
            symbol = symbol * 2 + one
        return symbol, i - start


class FMIndex:
    """Phrase search in a sequence of word numbers (0: separator, last)."""

    def __init__(self, seq: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_order(seq)
        self.bwt = WaveletMatrix(seq[order - 1].astype(np.int32), top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        self.sampled = (order % sample == 0) | (seq[order - 1] == 0)  # and after a separator, which no walk then crosses
        self.sample_rank = np.cumsum(self.sampled) - self.sampled
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``phrases`` (words > 0)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.bwt.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            if j == phrases.shape[1] - 1:
                lo[live], hi[live] = self.first[c], self.first[c + 1]
            else:
                lo[live], hi[live] = self.first[c] + self.bwt.rank(c, lo[live]), self.first[c] + self.bwt.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi[hi < lo] = lo[hi < lo]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the sequence of each row of the suffix order; steps back to the next sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.positions[self.sample_rank[at[done]]] + steps[live[done]]
            live, at = live[~done], at[~done]
            steps[live] += 1
            symbol, before = self.bwt.symbol_and_rank(at)
            at = self.first[symbol] + before
        return out


class TestMaterial:
    """The words of all units (passages and questions) in one array, with a separator before and after each."""

    def __init__(self, items: list[tuple], texts: tuple[int, ...] = (1, 2)):
        self.vocabulary: dict[str, int] = {}
        seq, unit_item, starts, lengths = [0], [], [], []
        for row in items:
            for k in texts:
                w = words(row[k])
                if w:
                    unit_item.append(row[0])
                    starts.append(len(seq))
                    lengths.append(len(w))
                    seq += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
                    seq.append(0)
        self.seq = np.array(seq, np.int64)
        self.item = np.array(unit_item, np.int64)
        self.start, self.length = np.array(starts, np.int64), np.array(lengths, np.int64)
        is_han = np.zeros(len(self.vocabulary) + 1, bool)
        for w, i in self.vocabulary.items():
            is_han[i] = bool(re.match(f"[{HAN}]", w))
        han = np.array([is_han[self.seq[s : s + n]].mean() > 0.5 for s, n in zip(self.start, self.length)], bool)
        self.least = np.where(han, MIN_HAN, MIN_WORDS)
        phrase = np.where(han, PHRASE_HAN, PHRASE)
        self.phrases = []  # (words in a phrase, distinct phrases, and of each window its phrase, place and unit)
        for size in sorted({PHRASE, PHRASE_HAN}):
            at, unit = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for u in np.flatnonzero((phrase == size) & (self.length >= self.least)):
                at.append(self.start[u] + np.arange(self.length[u] - size + 1))
                unit.append(np.full(len(at[-1]), u))
            at, unit = np.concatenate(at), np.concatenate(unit)
            if len(at):
                distinct, number = np.unique(self.seq[at[:, None] + np.arange(size)], axis=0, return_inverse=True)
                self.phrases.append((size, distinct, number.reshape(-1), at, unit))


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def whole_phrases(size: int, least: int) -> int:
    """Phrases of ``size`` words that at least stay whole in a stretch of at least ``least`` words, at most one in ONE_IN of
    them edited: an edit spoils no more than ``size`` of them, and the longest stretches keep the most."""
    return min(n - size + 1 - size * (n // ONE_IN) for n in range(least, least + 10 * ONE_IN))


def exact_runs(index: FMIndex, test: TestMaterial, stock_pairs: int = STOCK_PAIRS, slice_pairs: int = SLICE_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of equal words in slices: unit, place in the test material, place in the shard, length. A run may go on in the
    next slice, and one that holds a stock phrase may be shorter than it could be."""
    for size, distinct, number, at, unit in test.phrases:
        lo, hi = index.search(distinct)
        n = hi - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        where = index.locate(np.repeat(lo[hit], n[hit]) + _spread(n[hit]))
        first = np.cumsum(n) - n
        stock = n * np.bincount(number, minlength=len(n)) > stock_pairs
        several = np.bincount(unit, stock[number], minlength=len(test.item)) >= whole_phrases(size, MIN_WORDS if size == PHRASE else MIN_HAN)
        windows = np.flatnonzero((n[number] > 0) & (~stock[number] | several[unit]))
        pairs = n[number[windows]]
        for part in np.split(windows, np.flatnonzero(np.diff((np.cumsum(pairs) - pairs) // slice_pairs)) + 1):
            m = n[number[part]]
            t, u = np.repeat(at[part], m), np.repeat(unit[part], m)
            d = where[np.repeat(first[number[part]], m) + _spread(m)]
            if not len(t):
                continue
            by = np.lexsort((t, d - t, u))
            t, u, d = t[by], u[by], d[by]
            begins = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | ((d - t)[1:] != (d - t)[:-1]) | (t[1:] != t[:-1] + 1))))
            yield u[begins], t[begins], d[begins], np.diff(np.append(begins, len(t))) + size - 1


def promising(test: TestMaterial, seq: np.ndarray, u: np.ndarray, t: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a run may belong to a case: some window of the least length that meets the run has enough words that occur
    within the band of possible shifts. A case always has such a window with at most 5 edits (7 of Han), so none is lost."""
    out = np.zeros(len(u), bool)
    units = test.seq.astype(seq.dtype)
    unit_end = test.start + test.length
    for least, edits in ((MIN_WORDS, 5), (MIN_HAN, 7)):
        for short in (True, False):
            mine = np.flatnonzero((test.least[u] == least) & ((n <= 8) == short))
            span = np.arange(-least + 1, least + (8 if short else least))
            wide = np.arange(span[0] - edits, span[-1] + edits + 1)
            for part in np.array_split(mine, max(1, len(mine) // 8_000)) if len(mine) else []:
                places = t[part, None] + span
                want = units.take(places, mode="clip")
                inside = (places >= test.start[u[part], None]) & (places < unit_end[u[part], None])
                there = seq.take(d[part, None] + wide, mode="clip")
                met = there[:, : len(span)] == want
                for shift in range(1, 2 * edits + 1):
                    met |= there[:, shift : shift + len(span)] == want
                met &= inside
                total = np.cumsum(met, axis=1, dtype=np.int16)
                best = (total[:, least:] - total[:, :-least]).max(axis=1)
                out[part] = np.maximum(best, total[:, least - 1]) >= least - edits
    return out


def _reach(a: np.ndarray, b: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """(words of a, words of b) of the longest prefix of ``a`` that meets a prefix of ``b`` with at most 0, 1, ... edits and ends
    with an equal word."""
    a, b = a.tolist(), b.tolist()
    la, lb = len(a), len(b)

    def slide(i: int, k: int) -> int:
        while i < la and 0 <= i + k < lb and a[i] == b[i + k] and a[i]:
            i += 1
        return i

    row = {0: slide(0, 0)}
    out = [(row[0], row[0])]
    for _ in range(edits):
        if out[-1][0] >= la:
            break
        new, best = {}, out[-1]
        for k in range(min(row) - 1, max(row) + 2):
            i = max(row.get(k, -1) + 1, row.get(k + 1, -1) + 1, row.get(k - 1, -1))
            i = min(i, la, lb - k)
            if i >= 0 and i + k >= 0:
                new[k] = slide(i, k)
                if new[k] > i and new[k] > best[0]:
                    best = new[k], new[k] + k
        row = new
        out.append(best)
    return out


def extended(test: TestMaterial, seq: np.ndarray, u: int, t: int, d: int, n: int, lo: int, hi: int) -> tuple[int, int, int, int] | None:
    """(words of the unit, edits, first and last place in the shard) of a case around a run, or None. ``lo``, ``hi``: the
    document's places in the shard."""
    start, end, least = test.start[u], test.start[u] + test.length[u], int(test.least[u])
    edits = int(test.length[u]) // ONE_IN
    room_l, room_r = int(t - start), int(end - t - n)
    left = _reach(test.seq[start:t][::-1], seq[max(lo, d - room_l - edits) : d][::-1], edits)
    right = _reach(test.seq[t + n : end], seq[d + n : min(hi, d + n + room_r + edits)], edits)
    best = None
    for e1, (a1, b1) in enumerate(left):
        for e2, (a2, b2) in enumerate(right):
            size = a1 + n + a2
            if size >= least and (e1 + e2) * ONE_IN <= size and (best is None or size > best[0]):
                best = (int(size), e1 + e2, int(d - b1), int(d + n + b2))
    return best


def search_shard(test: TestMaterial, ids: list, lengths: list[int], seq: np.ndarray, texts: list[str] | None = None) -> pd.DataFrame:
    """Cases of one shard: a row for each document and item with the merged spans; with ``texts``, in characters too."""
    offsets = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
    index = FMIndex(seq, len(test.vocabulary))
    kept = [(np.empty(0, np.int64),) * 4]
    for u, t, d, n in exact_runs(index, test):
        whole = n >= test.least[u]
        near = np.flatnonzero(~whole)
        keep = np.concatenate((np.flatnonzero(whole), near[promising(test, seq, u[near], t[near], d[near], n[near])]))
        kept.append((u[keep], t[keep], d[keep], n[keep]))
    del index
    u, t, d, n = map(np.concatenate, zip(*kept))
    doc = np.searchsorted(offsets, d, side="right") - 1
    found: dict[tuple, list] = {}
    for k in np.lexsort((-n, u, doc)).tolist():
        where = int(doc[k])
        key = (where, int(test.item[u[k]]))
        spans = found.get(key)
        if spans and any(x[2] <= d[k] and d[k] + n[k] <= x[3] for x in spans):
            continue
        case = extended(test, seq, int(u[k]), int(t[k]), int(d[k]), int(n[k]), int(offsets[where]), int(offsets[where + 1]))
        if case:
            found.setdefault(key, []).append(case)
    rows, places = [], {}
    for (where, item), cases in found.items():
        spans: list[list[int]] = []
        for _, _, a, b in sorted(cases, key=lambda c: c[2:]):
            a, b = a - int(offsets[where]), b - int(offsets[where])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        best = max(cases, key=lambda c: c[0])
        if texts and where not in places:
            places[where] = word_places(texts[where])
        cuts = [{"start": int(places[where][0][a]), "end": int(places[where][1][b - 1])} for a, b in spans] if texts else None
        rows.append((ids[where], item, best[0], best[1], [{"start": a, "end": b} for a, b in spans], cuts))
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "edits", "spans", "places"])


class _Shard:
    """Documents gathered until they make a shard."""

    def __init__(self, material: TestMaterial, shard_words: int, with_texts: bool):
        self.material, self.shard_words, self.with_texts = material, shard_words, with_texts
        self.kind = np.uint16 if len(material.vocabulary) < 65_535 else np.int64
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.parts, self.texts, self.held = [], [], [], [], 0

    def add(self, i, text: str) -> bool:
        """Whether the text is long enough to carry anything."""
        w = words(text)
        if len(w) < MIN_WORDS * 8 // ONE_IN:
            return False
        get = self.material.vocabulary.get
        self.parts += [np.fromiter((get(x, 0) for x in w), self.kind, len(w)), np.zeros(1, self.kind)]
        self.ids.append(i)
        self.lengths.append(len(w) + 1)
        self.held += len(w) + 1
        if self.with_texts:
            self.texts.append(text)
        return True

    def full(self) -> bool:
        return self.held >= self.shard_words

    def search(self) -> pd.DataFrame:
        if not self.ids:
            return pd.DataFrame(columns=["doc_id", "item_id", "words", "edits", "spans", "places"])
        return search_shard(self.material, self.ids, self.lengths, np.concatenate(self.parts), self.texts or None)


def _search(material: TestMaterial, shard_words: int, with_places: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = _Shard(material, shard_words, with_places)
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                shard.add(i, text)
                if shard.full():
                    yield shard.search()
                    shard.clear()
        yield shard.search()

    return run


def without(text: str, places: list[tuple[int, int]]) -> str:
    """``text`` without the given ranges of characters; a blank stands where two words would meet."""
    out, at = "", 0
    for a, b in sorted(places):
        if b > at:
            out += text[at : max(a, at)]
            at = b
            if _SPELLED.fullmatch(out[-1:]) and _SPELLED.fullmatch(text[at : at + 1]):
                out += " "
    return out + text[at:]


def _clean(material: TestMaterial, shard_words: int):
    """(doc_id, text, removed) for every document; what is left of a document is searched again until nothing is found."""

    def flush(shard: _Shard) -> Iterator[pd.DataFrame]:
        gone = dict.fromkeys(range(len(shard.ids)), 0)
        left = dict(enumerate(shard.texts))
        again = _Shard(material, shard_words, True)
        for k, text in left.items():
            again.add(k, text)
        while again.ids:
            places: dict[int, list] = {}
            for r in again.search().itertuples():
                places.setdefault(r.doc_id, []).extend((p["start"], p["end"]) for p in r.places)
            again.clear()
            for k, own in places.items():
                before, left[k] = len(left[k]), without(left[k], own)
                gone[k] += before - len(left[k])
                again.add(k, left[k])
        if left:
            yield pd.DataFrame({"doc_id": [i for i, _ in shard.ids], "text": list(left.values()), "removed": [n + gone[k] for k, (_, n) in enumerate(shard.ids)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = _Shard(material, shard_words, True)
        for pdf in batches:
            short = []
            for i, text, n in zip(pdf["doc_id"], pdf["text"], pdf["removed"]):
                if text is None or not shard.add((i, n), text):
                    short.append((i, text, n))
                if shard.full():
                    yield from flush(shard)
                    shard.clear()
            if short:
                yield pd.DataFrame(short, columns=["doc_id", "text", "removed"])
        yield from flush(shard)

    return run


def _passes(items: DataFrame, item_col: str, item_texts: tuple[str, ...]) -> Iterator:
    """The test material in passes of bounded size, each sent to every executor. A single item is never divided."""
    spark = items.sparkSession
    chosen = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("i"), *item_texts).dropDuplicates(["i"])
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in item_texts), F.lit(0))
    n, characters = chosen.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_PER_PASS), -(-characters // CHARACTERS_PER_PASS))
    for k in range(passes):
        part = chosen if passes == 1 else chosen.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        yield spark.sparkContext.broadcast(TestMaterial([tuple(r) for r in part.orderBy("i").collect()], tuple(range(1, len(item_texts) + 1))))


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_texts: tuple[str, ...] = ("passage", "question"), shard_words: int = SHARD_WORDS, with_places: bool = True) -> DataFrame:
    """(doc_id, item_id, words, edits, spans, places): every document that carries a stretch of at least 24 words (36 Han
    characters) of a text of an item, at most one word in nine of it changed, left out or added; ``words`` and ``edits`` of the
    longest such stretch, ``spans`` the merged ranges of the document's folded words to remove, and ``places`` the same ranges in
    characters of its text (null without ``with_places``).

    Null and empty texts carry nothing; item texts shorter than the least stretch are never found; repeated items count
    once; a document of any length is searched whole, in one shard. The items go to every executor, at most ITEMS_PER_PASS
    and about CHARACTERS_PER_PASS at once, more in several passes over the documents.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    span = "array<struct<start:bigint,end:bigint>>"
    out = None
    for sent in _passes(items, item_col, item_texts):
        found = rows.mapInPandas(lambda it, b=sent: _search(b.value, shard_words, with_places)(it), f"doc_id bigint, item_id bigint, words bigint, edits bigint, spans {span}, places {span}")
        out = found if out is None else out.unionByName(found)
    return out


def cleaned_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_texts: tuple[str, ...] = ("passage", "question"), shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, removed): every document without what :func:`leaked_items` finds in it, and the number of characters taken
    out. What is left carries nothing any more: where the rest of a document meets in a new stretch, that goes too. Documents
    that carry nothing, null texts among them, keep their text. Nothing is shuffled."""
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("removed", F.lit(0).cast("bigint"))
    for sent in _passes(items, item_col, item_texts):
        out = out.mapInPandas(lambda it, b=sent: _clean(b.value, shard_words)(it), "doc_id bigint, text string, removed bigint")
    return out
