"""Recovery of structured fields from model answers: clean JSON, a closed prefix, or single fields.

The steps are columns of one row: fence, scan for the last closed object, parse, and patterns per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

STRINGS = ("cleaned_chunk", "title", "context", "summary")
LISTS = ("keywords", "questions")
#: Lists are read as text first, because a field that is no list counts as an empty one; _bad holds what is no JSON.
_SCHEMA = "struct<" + ",".join(f"{f}:string" for f in (*STRINGS, *LISTS, "_bad")) + ">"
_LIST = "array<string>"
STRICT = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}  # only double quotes make a JSON string
#: Numbers that aren't finite; Spark gives them as text in quotes.
NOT_FINITE = ("NaN", "Infinity", "-Infinity")


#: A string (the last one may be open), a brace, or what lies between.
_PIECE = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]|[^"{}]++'


def closes(c: Column) -> Column:
    """last: how many characters reach to the last return to depth 0 outside strings; 0 if none. n: how many returns there are."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("last"), F.lit(0).alias("n"))

    def step(a: Column, piece: Column) -> Column:
        at = a["at"] + F.length(piece)
        depth = a["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        back = (piece == "}") & (a["depth"] == 1)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(back, at).otherwise(a["last"]).alias("last"), (a["n"] + back.cast("int")).alias("n"))

    return F.aggregate(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), state, step, lambda a: F.struct(a["last"].alias("last"), a["n"].alias("n")))


def last_close(c: Column) -> Column:
    return closes(c)["last"]


def _fields(parsed: Column) -> Column:
    lists = {f: F.coalesce(F.from_json(F.when(F.startswith(F.trim(parsed[f]), F.lit("[")), parsed[f]), _LIST), F.array().cast(_LIST)) for f in LISTS}
    plain = lambda v: F.when(v.isin(*[f'"{x}"' for x in NOT_FINITE]), F.replace(v, F.lit('"'), F.lit(""))).otherwise(F.coalesce(v, F.lit("")))
    return F.struct(*[plain(parsed[f]).alias(f) for f in STRINGS], *[lists[f].alias(f) for f in LISTS])


def parsed_object(c: Column) -> Column:
    """A JSON object parsed once: its fields as text and _bad, which is null where the text is JSON."""
    return F.from_json(c, _SCHEMA, STRICT)


def parse_fields(c: Column) -> Column:
    """The six fields of a JSON object: missing strings are '', lists that are no lists are empty, numbers (also NaN) keep their text."""
    return _fields(parsed_object(c))


def is_object(c: Column) -> Column:
    return F.startswith(F.trim(c), F.lit("{"))


def field_pattern(name: str) -> str:
    return f'"{name}"\\s*:\\s*"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)"'


def fields_by_pattern(c: Column, original: Column) -> tuple[Column, Column]:
    """(fields, whether any was found): each complete field on its own; without one, the cleaned text is the original."""
    strings, found = {}, F.lit(False)
    for f in STRINGS:
        pattern = "(?s)" + field_pattern(f)
        hit = F.regexp_like(c, F.lit(pattern))
        raw = F.regexp_extract(c, pattern, 1)
        value = F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "struct<v:string>")["v"], raw)
        strings[f] = F.when(hit, value).otherwise(original if f == "cleaned_chunk" else F.lit(""))
        found = found | hit
    lists = {}
    for f in LISTS:
        value = F.from_json(F.nullif(F.regexp_extract(c, f'(?s)"{f}"\\s*:\\s*(\\[.*?\\])', 1), F.lit("")), _LIST)
        lists[f] = F.coalesce(value, F.array().cast(_LIST))
        found = found | value.isNotNull()
    return F.struct(*[strings[f].alias(f) for f in STRINGS], *[lists[f].alias(f) for f in LISTS]), found


def recovered(answers: DataFrame, raw: str = "raw_response", original: str = "original") -> DataFrame:
    """answers with the six fields and ``status``: ok, repaired, partial or error (then the fields are empty, the text the original).

    An answer is scanned and parsed once; patterns are tried only on what isn't one JSON object and the text behind it.
    """
    rows = answers.withColumn("_raw", T.strip_fence(F.coalesce(raw, F.lit("")), "json"))
    rows = rows.withColumn("_closes", closes(F.col("_raw")))
    # An object that ends before the last close has others behind it, which is no JSON.
    closed = is_object(F.col("_raw")) & (F.col("_closes.n") == 1)
    rows = rows.withColumn("_parsed", parsed_object(F.when(closed, F.left("_raw", F.col("_closes.last")))))
    rows = rows.withColumn("_valid", F.col("_parsed").isNotNull() & F.col("_parsed._bad").isNull())
    fields, found = fields_by_pattern(F.when(~F.col("_valid"), F.col("_raw")), F.col(original))
    rows = rows.withColumn("_found", found).withColumn("_by_pattern", fields)
    status = F.when(F.col("_valid") & (F.col("_closes.last") == F.length("_raw")), "ok").when(F.col("_valid"), "repaired").when(F.col("_found"), "partial").otherwise("error")
    rows = rows.withColumn("status", status)
    empty = F.struct(F.col(original).alias("cleaned_chunk"), *[F.lit("").alias(f) for f in STRINGS[1:]], *[F.array().cast(_LIST).alias(f) for f in LISTS])
    chosen = rows.withColumn("_out", F.when(F.col("_valid"), _fields(F.col("_parsed"))).when(F.col("_found"), F.col("_by_pattern")).otherwise(empty))
    return chosen.select(*answers.columns, *[F.col("_out")[f].alias(f) for f in (*STRINGS, *LISTS)], "status")
