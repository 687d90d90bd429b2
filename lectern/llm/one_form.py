"""One form for text that reads the same but is written in other characters.

A text is brought to compatibility form, characters that show nothing are deleted, every kind of blank becomes one space,
and each word is read through a lattice: each position offers every letter of the same shape, whatever its alphabet, and a
Viterbi search takes the path of the best character n-gram score, where leaving an alphabet inside a word costs more than
any likely pair of letters gains. The lattice depends on shapes only, so two spellings of the same shape get the same path.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.evidence import match_evidence

# Letters of other alphabets that have the shape of the Latin letter in the same place of the second string, by the
# public table of confusable characters, less those that only some typefaces draw alike.
CYRILLIC = "ЅІЈАВЕКМНОРСТУХЬаеорсухѕіјѡѴѵҮүһӀӏԁԌԚԛԜԝ"
CYRILLIC_AS = "SIJABEKMHOPCTYXbaeopcyxsijwVvYyhIldGQqWw"
GREEK = "ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορυϜϳϺ"
GREEK_AS = "JABEZHIKMNOPTYXayivopuFjM"
# Compatibility form makes other letters of these, so they are replaced before it.
LUNATE = "ϲϹϱ"
LUNATE_AS = "cCp"
ARMENIAN = "ՍՏՕհոսցօ"
ARMENIAN_AS = "USOhnugo"
CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ"
CHEROKEE_AS = "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"
COPTIC = "ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ"
COPTIC_AS = "HIKMNOoPpCcTYX"
LISU = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPdDTGKJCZFMNLSRVHWXYAEIOU"
LATIN_FORMS = "ɑɡᴄᴏᴜᴠᴡᴢꜱ"
LATIN_FORMS_AS = "agcouvwzs"
# Characters without a shape that the category Cf does not hold.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))

SHAPE = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + COPTIC + LISU + LATIN_FORMS, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + COPTIC_AS + LISU_AS + LATIN_FORMS_AS))
SHAPES = str.maketrans(SHAPE)
LUNATE_SHAPES = str.maketrans(LUNATE, LUNATE_AS)
#: Letters of each shape; the Latin one first, one form of a letter for each alphabet.
READINGS: dict[str, str] = {}
for _c, _s in SHAPE.items():
    if _c not in LATIN_FORMS:
        READINGS[_s] = READINGS.get(_s, _s) + _c

_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
#: Markup, for those who fold texts.
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_BLANKS = re.compile(r"\s+")
_FOREIGN = re.compile(r"[ɐ-ʯͰ-֏Ꭰ-᏿ᴀ-ᵿⲀ-⳿ꓐ-꓿꜠-ꟿ]")
_ONLY_SHARED = re.compile(f"[{''.join(READINGS)}̀-ͯ]+")
_CHANGE = -40.0  # log score of leaving an alphabet inside a word
_RARE = -12.0  # of a pair of letters never seen


class _Unseen(dict):
    """Deletes format characters, controls other than blanks, and UNSEEN; filled as characters turn up."""

    def __missing__(self, o: int):
        c = chr(o)
        gone = c in UNSEEN or unicodedata.category(c) == "Cf" or (unicodedata.category(c) == "Cc" and not c.isspace())
        self[o] = None if gone else o
        return self[o]


DELETE = _Unseen()
#: Whether a text may hold a character to delete; a quick look before the slower translation.
_MAYBE_UNSEEN = re.compile("[" + re.escape(UNSEEN) + "\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\U000110bd-\U0001d17a\U000e0000-\U000e0fff]")


def plain(text: str) -> str:
    """Compatibility form without unseen characters and with single spaces; letters keep their alphabet."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(LUNATE_SHAPES) if any(c in text for c in LUNATE) else text)
    if _MAYBE_UNSEEN.search(text):
        text = unicodedata.normalize("NFKC", text.translate(DELETE))
    return _BLANKS.sub(" ", text).strip()


def shape(text: str) -> str:
    """``plain`` with every letter that has a Latin shape replaced by the Latin letter, accents kept."""
    text = plain(text)
    if text.isascii() or not _FOREIGN.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(SHAPES))


def alphabet(c: str) -> str:
    """The alphabet of a letter, by blocks; combining marks have none."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x300 <= o < 0x370:
        return ""
    for name, a, b in (("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("armenian", 0x530, 0x590), ("cherokee", 0x13A0, 0x1400), ("coptic", 0x2C80, 0x2D00), ("lisu", 0xA4D0, 0xA500)):
        if a <= o < b:
            return name
    return "other"


class Lattice:
    """Reads words under n-gram counts of letter pairs; ``counts`` maps two characters (the first may be '^') to their count."""

    def __init__(self, counts: dict[str, int]):
        first: Counter = Counter()
        for pair, n in counts.items():
            first[pair[0]] += n
        self.log = {pair: math.log(n / first[pair[0]]) for pair, n in counts.items()}
        self.known: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        if a != "^" and (x := alphabet(a)) and (y := alphabet(b)) and x != y:
            return _CHANGE
        return self.log.get(a + b, _RARE)

    def read(self, word: str) -> str:
        """The best path through the letters that have the shapes of ``word``, which is in NFD."""
        if word in self.known:
            return self.known[word]
        shapes = word.translate(SHAPES)
        paths = {"^": (0.0, "")}
        for c in shapes:
            if 0x300 <= ord(c) < 0x370:  # a mark goes with its letter
                paths = {a: (s, p + c) for a, (s, p) in paths.items()}
                continue
            new = {}
            for b in READINGS.get(c, c):
                new[b] = max(((s + self.step(a, b), p + b) for a, (s, p) in paths.items()), key=lambda x: x[0])
            paths = new
        out = max(paths.values(), key=lambda x: x[0])[1]
        if len(self.known) < 200_000:
            self.known[word] = out
        return out

    def _word(self, m: re.Match) -> str:
        w = m[0]
        return self.read(w) if _FOREIGN.search(w) or _ONLY_SHARED.fullmatch(w) else w

    def form(self, text: str | None) -> str | None:
        """The one form of ``text``."""
        if text is None:
            return None
        text = plain(text)
        return unicodedata.normalize("NFC", _WORD.sub(self._word, unicodedata.normalize("NFD", text)))


def count_pairs(texts: Iterator[str], into: Counter) -> None:
    """Adds the letter pairs of words that can be read in one alphabet only."""
    words: Counter = Counter()
    for t in texts:
        if t:
            words.update(_WORD.findall(unicodedata.normalize("NFD", plain(t))))
    for w, n in words.items():
        own = {alphabet(c) for c in w if c not in READINGS and c not in SHAPE} - {""}
        shared = {alphabet(c) for c in w} - {""}
        if len(own) == 1 and own == shared and "other" not in own:
            for a, b in zip("^" + w, w):
                into[a + b] += n


def letter_pairs(*texts: tuple[DataFrame, str]) -> dict[str, int]:
    """Counts of letter pairs over all rows of the given (table, column) pairs. Each partition sends its sums; what reaches
    the driver is at most one row for each pair of letters of the alphabets that have shared shapes."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter = Counter()
        for pdf in batches:
            count_pairs(iter(pdf["t"]), got)
        if got:
            yield pd.DataFrame({"pair": list(got), "n": list(got.values())}, columns=["pair", "n"])

    total = None
    for df, col in texts:
        part = df.select(F.col(col).alias("t")).where("t is not null").mapInPandas(partial, "pair string, n bigint")
        total = part if total is None else total.unionByName(part)
    return {r["pair"]: int(r["n"]) for r in total.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def one_form(counts: dict[str, int]):
    """A column function that brings texts to their one form under the given letter pairs. Null stays null; a text without
    any seen character becomes the empty string; texts are processed whole, whatever their length."""

    state: list[Lattice] = []

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(Lattice(counts))
        return texts.map(state[0].form, na_action="ignore")

    return form.asNondeterministic()  # else a filter on the result is moved below it and calls it once more


def quotes_in_other_characters(quotes: DataFrame, texts: DataFrame, id_col: str, key: str, quote: str, text: str) -> DataFrame:
    """(id_col, quote_form): quotes that are no stretch of the text of their ``key`` character for character but read as one.

    Quotes and texts that repeat (same id, same key) count once. Null quotes, quotes that show nothing and quotes without a
    text are left out; blanks at either end of a quote do not matter. A quote may hold up to the whole text. Both sides are
    brought to one form before the join, each row once.
    """
    form = one_form(letter_pairs((quotes, quote), (texts, text)))
    q = quotes.select(F.col(id_col).alias("q_id_"), F.col(key).alias("k_"), F.col(quote).alias("quote_")).where("quote_ is not null and k_ is not null").dropDuplicates(["q_id_", "k_"])
    t = texts.select(F.col(key).alias("k_"), F.col(text).alias("text_")).where("text_ is not null and k_ is not null").dropDuplicates(["k_"])
    q, t = q.withColumn("quote_form", form("quote_")), t.withColumn("text_form", form("text_"))
    hit = q.join(t, "k_").where(~F.contains("text_", "quote_") & (F.col("quote_form") != "") & F.contains("text_form", "quote_form"))
    return hit.select(F.col("q_id_").alias(id_col), "quote_form").dropDuplicates([id_col])


def recomputed_similarity(quotes: DataFrame, texts: DataFrame, id_col: str, key: str, quote: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(id_col, evidence_found, evidence_similarity): quotes beside the text of their ``key``, both in one form: 1 for a stretch of
    it, else the best ratio with any stretch of about its length when that reaches ``threshold``, else null; 0 for null and blank
    quotes and quotes without a text. Quotes that repeat (same id, same key) count once, the first by its text."""
    form = one_form(letter_pairs((quotes, quote), (texts, text)))
    q = quotes.select(F.col(id_col).alias("q_id_"), F.col(key).alias("k_"), F.col(quote).alias("quote_")).groupBy("q_id_", "k_").agg(F.min("quote_").alias("quote_")).withColumn("quote_", form("quote_"))
    t = texts.select(F.col(key).alias("k_"), F.col(text).alias("text_")).where("text_ is not null and k_ is not null").dropDuplicates(["k_"]).withColumn("text_", form("text_"))
    known = q.where("k_ is not null").join(t, "k_", "left").unionByName(q.where("k_ is null").withColumn("text_", F.lit(None).cast("string")))
    return match_evidence(known, "quote_", "text_", threshold, threshold).select(F.col("q_id_").alias(id_col), "evidence_found", "evidence_similarity")
