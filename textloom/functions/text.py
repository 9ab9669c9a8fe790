"""Scalar rules on text columns: file names, words, lists, fences, tokens. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token carries the white space before it; the last one also what follows it, so tokens concatenate to the text.
TOKEN = r"\s*\S+(?:\s+$)?"
#: A sentence carries its closing marks and the white space after them.
SENTENCE = r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+$"
WORD = r"\s*\S+|\s+$"


def is_safe_filename(c: Column) -> Column:
    """True unless the name is null, empty, ``.``, ``..`` or holds a directory."""
    return F.coalesce(~c.isin("", ".", "..") & ~F.contains(c, F.lit("/")), F.lit(False))


def safe_stem(c: Column) -> Column:
    """The name without directories and last suffix; null when nothing is left."""
    name = F.substring_index(c, "/", -1)
    return F.nullif(F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1"), F.lit(""))


def hyphenated(c: Column) -> Column:
    """Every run of characters other than ASCII letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")


def sanitise(c: Column) -> Column:
    """hyphenated, or ``doc`` when nothing is left."""
    return F.coalesce(F.nullif(hyphenated(c), F.lit("")), F.lit("doc"))


def chunk_set_name(stem: Column, library: Column | None, strategy: Column | None, ts: Column) -> Column:
    """``<doc>_<library>-<strategy>_<time>``; the middle part falls back to the strategy, then to ``chunks``."""
    library = F.lit("") if library is None else F.coalesce(library, F.lit(""))
    strategy = F.lit("") if strategy is None else F.coalesce(strategy, F.lit(""))
    kind = F.when((library != "") & (strategy != ""), hyphenated(F.concat(library, F.lit("-"), strategy))).when(strategy != "", hyphenated(strategy)).otherwise("chunks")
    return F.concat_ws("_", sanitise(stem), kind, F.date_format(ts, "yyyy-MM-dd_HH-mm-ss-SSSSSS"))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def token_count(c: Column) -> Column:
    """Tokens of the rule above: as many as there are runs without white space."""
    return word_count(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def split_list(c: Column, separator: str) -> Column:
    """Parts between separators, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def truncated_error(kind: Column, message: Column, most: int) -> Column:
    """``Type: message`` with the message cut."""
    return F.concat(kind, F.lit(": "), F.substring(message, 1, most))


def suffix_prefix_overlap(a: Column, b: Column, cap: int | None = None) -> Column:
    """The largest n for which the last n characters of a are the first n of b; 0 if none."""
    tail, head = (F.right(a, F.lit(cap)), F.left(b, F.lit(cap))) if cap else (a, b)

    def longest(p: Column) -> Column:
        most = F.least(F.length(p["tail"]), F.length(p["head"]))
        lengths = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.array_max(F.filter(lengths, lambda n: F.endswith(p["tail"], F.left(p["head"], n)))), F.lit(0))

    # Both ends are cut once for all lengths.
    return F.get(F.transform(F.array(F.struct(tail.alias("tail"), head.alias("head"))), longest), F.lit(0))


def strip_fence(c: Column, language: str) -> Column:
    """Without one opening fence (plain or of this language, any case) and one closing fence, trimmed."""
    space = r"[ \t\n\f\r]"
    opened = F.regexp_replace(F.regexp_replace(c, f"^{space}+|{space}+$", ""), f"^```(?i:{language})?{space}*", "")
    closed = F.regexp_replace(opened, f"{space}*```$", "")
    return F.regexp_replace(closed, f"^{space}+|{space}+$", "")


def contextualized(headings: Column, text: Column) -> Column:
    """The headings, one a line, then the text."""
    return F.concat_ws("\n", F.filter(headings, lambda h: h.isNotNull()), text)


