"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, digit cues, plus-digit cues, URL schemes and identifier
words. Small deterministic parsers then grow each anchor to the left and right and validate what they find.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip``, ``card``, ``phone``. Kinds that the method adds:
``url`` (scheme and authority, where it carries user information or an address), ``handle`` (an at-sign name that is no
email, at least two characters) and ``account`` (an identifier cue in one of the four languages of the corpus, followed by a value of at least
LEAST_VALUE characters with a digit). Names and values have no upper length and are taken whole. Kinds may overlap one another.

Null and empty texts have no spans. Texts are scanned whole; time and memory grow with the length of one text. Null and shared ids are kept as
they are; repeated rows are scanned one by one and an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import textscan as ts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "handle", "account")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
Span = tuple[int, int]

#: Identifier cues, lower case; a value follows after at most MAX_GAP separators.
CUES = (
    "account", "iban", "passport", "password", "api_key", "apikey", "secret", "ssn", "token", "user id", "userid", "username",
    "passwort", "kennwort", "kontonummer", "benutzername", "benutzerkennung", "reisepass", "zugangscode",
    "mot de passe", "numéro de compte", "numero de compte", "nom d'utilisateur", "identifiant", "passeport", "code secret",
    "contraseña", "contrasena", "número de cuenta", "numero de cuenta", "nombre de usuario", "usuario", "pasaporte", "clave secreta",
)
MAX_GAP = 4
LEAST_VALUE = 6

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE_TAIL = re.compile(r"[ ().0-9-]+")
_AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:@\[\]-]+")
_HANDLE = re.compile(r"[A-Za-z0-9_]{2,}")
_GAP = re.compile(r"[ \t]*[:=#]?[ \t]*[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9_./+=-]+")
_LAST_DIGIT = re.compile(r".*[0-9]")

AT, DOT, DIGIT, PLUS, SCHEME, CUE = range(6)


def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors; a match yields (kind of anchor, its length)."""
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", (AT, 1))
    for d in "0123456789":
        automaton.add_word(f".{d}", (DOT, 2))
        automaton.add_word(f"+{d}", (PLUS, 2))
        for e in "0123456789":
            for gap in ("", " ", "-"):
                automaton.add_word(d + gap + e, (DIGIT, 2 + len(gap)))
    for s in ("://",):
        automaton.add_word(s, (SCHEME, len(s)))
    for c in CUES:
        for form in {c, c.capitalize(), c.title(), c.upper()}:
            automaton.add_word(form, (CUE, len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def email_at(text: str, at: int, free: int) -> Span | None:
    """The address around an at-sign whose local part starts at free or later."""
    domain = _DOMAIN.match(text, at + 1)
    if not domain:
        return None
    start = at
    while start > free and text[start - 1] in _LOCAL_SET:
        start -= 1
    return (start, domain.end()) if start < at else None


def run_start(text: str, at: int, floor: int) -> int:
    """The first digit of the run of digits with single separators that holds the digit at this place."""
    while at > floor:
        if text[at - 1] in _DIGITS:
            at -= 1
        elif text[at - 1] in " -" and at - 2 >= floor and text[at - 2] in _DIGITS:
            at -= 2
        else:
            break
    return at


def card_digits(run: str) -> bool:
    digits = run.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def ips_in(text: str, chain: re.Match) -> Iterator[Span]:
    """Each four parts of a chain of dotted numbers, from the left."""
    parts = chain.group().split(".")
    place = chain.start()
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            yield place, place + size
        place += size + 1


def phone_at(text: str, at: int) -> Span | None:
    tail = _PHONE_TAIL.match(text, at + 2)
    if not tail:
        return None
    end = tail.end()
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end - at >= 4 else None


def spans_of(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """All spans of one text by kind, each list in order of start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    email_free = ip_free = card_free = phone_free = account_free = 0
    value_end = value_digit = 0  # the run of value characters seen last: its end, and the place after its last digit
    ats: list[int] = []
    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == DIGIT:
            if at >= card_free:
                run = _RUN.match(text, run_start(text, at, card_free))
                card_free = run.end()
                if run.end() - run.start() >= 13 and card_digits(run.group()):
                    out["card"].append(run.span())
        elif kind == DOT:
            if at >= ip_free and at and text[at - 1] in _DIGITS:
                start = at - 1
                while start > ip_free and text[start - 1] in _DIGITS:
                    start -= 1
                chain = _DOTTED.match(text, start)
                ip_free = chain.end()
                out["ip"].extend(ips_in(text, chain))
        elif kind == PLUS:
            if at >= phone_free and (found := phone_at(text, at)):
                phone_free = found[1]
                if 9 <= sum(c in _DIGITS for c in text[found[0] : found[1]]) <= 15:
                    out["phone"].append(found)
        elif kind == AT:
            if found := email_at(text, at, email_free):
                email_free = found[1]
                out["email"].append(found)
            else:
                ats.append(at)
        elif kind == SCHEME:
            start = at
            while start and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            authority = _AUTHORITY.match(text, at + 3)
            if start < at and authority and ("@" in authority.group() or _DOTTED.fullmatch(authority.group())):
                out["url"].append((start, authority.end()))
        elif at >= account_free and not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalnum():
            gap = _GAP.match(text, last + 1)
            start = gap.end()
            if 0 < start - last - 1 <= MAX_GAP:
                if start >= value_end and (value := _VALUE.match(text, start)):
                    digits = _LAST_DIGIT.match(text, start, value.end())
                    value_end, value_digit = value.end(), digits.end() if digits else start
                # A cue inside a run without digits shares its end, so a run is read once.
                if value_end - start >= LEAST_VALUE and value_digit > start:
                    account_free = value_end
                    out["account"].append((start, value_end))
    for at in ats:
        if not (at and (text[at - 1].isalnum() or text[at - 1] in "._-@")):
            name = _HANDLE.match(text, at + 1)
            if name and text[name.end() : name.end() + 1] not in ("@",):
                out["handle"].append((at, name.end()))
    return out


def digest_text(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by ``[KIND]``; overlapping spans become one, named after the first."""
    order = sorted((a, -b, k) for k, own in spans.items() for a, b in own)
    parts, done = [], 0
    for a, b, kind in order:
        b = -b
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(parts) + text[done:] if parts else text


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the keep columns, ``found`` (array of kind, start, end in code points, end exclusive), ``base`` and
    ``spans`` (the spans written as kind:start:end, base kinds or all) and ``redacted``. One scan, no shuffle."""
    return _scan(docs, text, keep, ("base", "spans", "n_email", "n_ip", "n_card", "n_phone", "redacted", "found"))


def _scan(docs: DataFrame, text: str, keep: tuple[str, ...], want: tuple[str, ...]) -> DataFrame:
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))
    types = {"base": "string", "spans": "string", "redacted": "string", "found": "array<struct<kind:string,start:int,end:int>>"}
    arrow = {"string": pa.string(), "long": pa.int64(), types["found"]: pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))}
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(", ".join(f"{w} {types.get(w, 'long')}" for w in want)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for b in ts.slices(batches, "text"):
            rows: list[dict] = []
            for value in b.column("text").to_pylist():
                value = value or ""
                spans = spans_of(value, automaton)
                row = {f"n_{k}": len(spans[k]) for k in BASE_KINDS}
                row |= {"base": digest_text(spans, BASE_KINDS), "spans": digest_text(spans, KINDS)}
                if "redacted" in want:
                    row["redacted"] = redacted(value, spans)
                if "found" in want:
                    row["found"] = [{"kind": k, "start": s, "end": e} for k in KINDS for s, e in spans[k]]
                rows.append(row)
            made = [pa.array([r[w] for r in rows], arrow[types.get(w, "long")]) for w in want]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], *want])

    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *want)


def pii_digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, counts of the base kinds, ``base_sha256`` of the base spans, ``spans``."""
    found = _scan(docs, text, (key,), ("base", "spans", "n_email", "n_ip", "n_card", "n_phone"))
    return found.select(key, "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows of docs with personal data replaced; length, where docs has it, is set to the new number of code points.

    A null text stays null. Rows keep their columns and order of columns.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{text}`").isNull().alias("absent"))
    found = _scan(row, "text", ("row", "absent"), ("redacted",))
    new = F.when(~F.col("absent"), F.col("redacted"))
    cells = {text: new} | ({length: F.when(F.col("absent"), F.col("row").getField(length)).otherwise(F.length("redacted").cast(docs.schema[length].dataType))} if length in names else {})
    return found.select(*[(cells[c] if c in cells else F.col("row").getField(c)).alias(c) for c in names])
