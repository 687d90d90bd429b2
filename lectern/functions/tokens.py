"""Token sequences: a tokenizer that needs no file, one with a public vocabulary, and windows over tokens."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.session import send_file

#: A word with the blanks before it; lossless, and the same in every engine.
WORDS = r"\s*\S+|\s+"
_WORDS = re.compile(WORDS)
#: Tokens of a piece of text, see :func:`pieces`; a power of two.
_PIECE_BITS = 6
PIECE = 1 << _PIECE_BITS
# What ends a sentence and a paragraph.
_SENTENCE, _PARAGRAPH = re.compile(r"[.!?][\s\n]"), re.compile(r"\n\n")
# How a byte-level vocabulary splits text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encode(text: Column | str) -> Column:
    """Words as tokens; joining them gives the text back."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def decode(tokens: Column | str) -> Column:
    return F.array_join(tokens, "")


def count_tokens(text: Column | str) -> Column:
    return F.size(encode(text))


def first_tokens(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def token_slice(tokens: Column, start: Column, end: Column) -> Column:
    """tokens[start:end]; a missing start is 0, a missing end the length; negative ends count from the end, as in Python."""
    n = F.size(tokens)
    at = lambda x, default: F.when(x.isNull(), default).when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    a, b = at(start, F.lit(0)).cast("int"), at(end, n).cast("int")
    return F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0)))


def pieces(text: Column | str) -> Column:
    """The text in pieces of ``PIECE`` tokens each, the last of what is left."""
    return F.regexp_extract_all(text, F.lit(f"(?:{WORDS}){{1,{PIECE}}}"), F.lit(0))


def count_in_pieces(held: Column) -> Column:
    return F.when(F.size(held) > 0, (F.size(held) - 1) * PIECE + count_tokens(F.element_at(held, -1))).otherwise(0)


def piece_span(held: Column, a: Column, b: Column) -> list[Column]:
    """Strings and lists of strings that make up tokens[a:b] when joined in this order: whole pieces are taken as they are, and
    only the first and the last are split into tokens. Places are integers from 0 on; beyond the text there is nothing."""
    i, j, x, y = F.shiftright(a, _PIECE_BITS), F.shiftright(b, _PIECE_BITS), a.bitwiseAND(PIECE - 1), b.bitwiseAND(PIECE - 1)
    part = lambda k, at, n: decode(F.slice(encode(F.get(held, k)), at + 1, n))
    first = F.when(b > a, part(i, x, F.when(j > i, F.lit(PIECE)).otherwise(b - a)))
    return [first, F.when(j > i + 1, F.slice(held, i + 2, j - i - 1)), F.when((j > i) & (y > 0), part(j, F.lit(0), y))]


def load_vocabulary(path: str):
    """A byte-level encoder from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def vocabulary_functions(path: str, spark: SparkSession | None = None):
    """(encode, decode, count) over the vocabulary at ``path``, which is sent to the executors when ``spark`` is given and must
    be there already otherwise. Decoding joins the bytes of a whole sequence, so that a character cut by a slice becomes one
    replacement mark."""
    held: list = []
    local = send_file(spark, path) if spark else lambda: path

    def own():
        if not held:
            held.append(load_vocabulary(local()))
        return held[0]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def enc(texts: pd.Series) -> pd.Series:
        return texts.map(own().encode_ordinary, na_action="ignore")

    @F.pandas_udf(T.StringType())
    def dec(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: own().decode_bytes([int(x) for x in t]).decode("utf-8", "replace"), na_action="ignore")

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(own().encode_ordinary(t)) if t else 0).astype("int64")

    return enc, dec, count


def aligned_place(tokens: list[str], at: int, forward: bool, most: int = 100) -> int:
    """The token place after the nearest paragraph end within ``most`` tokens, else sentence end, else ``at``; the place is
    counted by reading the text before it anew."""
    lo, hi = (at, min(len(tokens), at + most)) if forward else (max(0, at - most), at)
    text = "".join(tokens[lo:hi])
    for mark in (_PARAGRAPH, _SENTENCE):
        ends = [m.end() for m in mark.finditer(text)]
        if ends:
            return lo + len(_WORDS.findall(text[: ends[0 if forward else -1]]))
    return at


WINDOW = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def window_around(tokens: list[str], at: int, size: int, most: int = 100) -> tuple[list[str], int, int]:
    """The tokens of a window of ``size`` around ``at``, its start moved back and its end forward to a boundary."""
    a = aligned_place(tokens, max(0, at - size // 2), False, most)
    b = aligned_place(tokens, min(len(tokens), at + size // 2), True, most)
    return list(tokens[a:b]), a, b


def aligned_window(size: int, most: int = 100):
    """A column function (tokens, place) -> STRUCT<tokens, start, end>."""

    @F.pandas_udf(WINDOW)
    def window(tokens: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([window_around(list(t), int(p), size, most) for t, p in zip(tokens, at)], columns=["tokens", "start", "end"])

    return window


CHAR_WINDOW = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def char_window_around(text: str, at: int, size: int, most: int = 100) -> tuple[str, int, int]:
    """The text of a window of ``size`` tokens around character ``at``; both ends aligned within four characters a token."""
    tokens = _WORDS.findall(text)
    place = len(_WORDS.findall(text[:at]))
    a = len("".join(tokens[: max(0, place - size // 2)]))
    b = len("".join(tokens[: min(len(tokens), place + size // 2)]))
    for mark in (_PARAGRAPH, _SENTENCE):
        ends = [m.end() for m in mark.finditer(text[max(0, a - most * 4) : a])]
        if ends:
            a = max(0, a - most * 4) + ends[-1]
            break
    for mark in (_PARAGRAPH, _SENTENCE):
        m = mark.search(text[b : b + most * 4])
        if m:
            b += m.end()
            break
    return text[a:b], a, b


def aligned_char_window(size: int, most: int = 100):
    """A column function (text, character) -> STRUCT<text, start, end>."""

    @F.pandas_udf(CHAR_WINDOW)
    def window(texts: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([char_window_around(t, int(p), size, most) for t, p in zip(texts, at)], columns=["text", "start", "end"])

    return window
