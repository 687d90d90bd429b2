"""Text in pieces: previews, labels, prompts, and boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han characters, for a character class.
HAN = "㐀-䶿一-鿿豈-﫿"
SENTENCE_END = r"[.!?]\s"
PARAGRAPH_END = r"\n\n"


def preview(text: Column, most: int = 50) -> Column:
    """The first ``most`` characters and three dots when there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def hover(text: Column) -> Column:
    """At most 100 characters, the last three of them dots when cut."""
    return F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text)


def token_count_label(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.23M; halves are rounded up."""
    return F.when(n >= 1_000_000, F.format_string("%.2fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def bin_label(start: Column, end: Column) -> Column:
    return F.concat(F.floor(start / 1000).cast("string"), F.lit("K-"), F.floor(end / 1000).cast("string"), F.lit("K"))


def dataset_name(path: Column, suffix: str = ".jsonl") -> Column:
    """The last part of a path without the suffix."""
    return F.replace(F.element_at(F.split(path, "/"), -1), F.lit(suffix), F.lit(""))


def result_key(question: Column, depth_bin: Column, length: Column) -> Column:
    """What names a result within a run: the question, with depth and length where both are given."""
    both = F.coalesce((depth_bin != "") & (length != 0), F.lit(False))
    return F.when(both, F.concat_ws("|", question, depth_bin, length.cast("string"))).otherwise(question)


def choice_lines(choice: Column) -> Column:
    """'key. value' lines in the order of the map; a null value is empty."""
    return F.array_join(F.transform(F.map_entries(choice), lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("")))), "\n")


def sorted_choice_lines(choice: Column) -> Column:
    """'KEY. value' lines by key; a null value is empty."""
    line = lambda k: F.concat(F.upper(k), F.lit(". "), F.coalesce(F.try_element_at(choice, k), F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.map_keys(choice)), line), "\n")


def render(template: str, **values: Column) -> Column:
    """A template with {name} replaced by the named columns (null: empty); other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def messages(template: dict, **values: Column) -> tuple[Column, Column]:
    """(system, user) of a template with its values; constraints follow the system text, a line each."""
    system = "\n".join([template.get("system", ""), *(f"- {c}" for c in template.get("constraints") or [])]).strip("\n")
    return render(system, **values), render(template["user"], **values)


def boundary_after(text: Column, at: Column, pattern: str = SENTENCE_END) -> Column:
    """The end of the first match at or after character ``at`` (from 0), else ``at``."""
    rest = F.substr(text, at + 1)
    where = F.regexp_instr(rest, F.lit(pattern))
    return F.when(where > 0, at + where + 1).otherwise(at).cast("int")


def boundary_before(text: Column, at: Column, pattern: str = SENTENCE_END) -> Column:
    """The end of the last match before character ``at``, else ``at``."""
    head = F.substr(text, F.lit(1), at)
    pieces = F.split(head, pattern)
    last = F.element_at(pieces, -1)
    return F.when(F.size(pieces) > 1, F.length(head) - F.length(last)).otherwise(at).cast("int")


def int_list(text: Column) -> Column:
    """Comma-separated whole numbers."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int"))
