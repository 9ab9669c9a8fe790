"""Token ids of whole texts by a public word-BPE tokenizer, with a bounded memo of words.

The tokenizer normalizes a text (composed letters, lower case), cuts it into runs of letters, single digits, runs of signs and a few
English endings, and splits each of these by its model. Here Python cuts, and the model sees each distinct word once, as most words of
a corpus recur. That holds for plain characters, whose lower case and composed form are beyond doubt; pieces between white space that
have any other character go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

MEMO_ENTRIES = 600_000

#: Separators of str.split() that the tokenizer does not treat as white space.
_ODD = re.compile(r"[\x1c-\x1f]")


def _plain_characters() -> list[str]:
    """Characters that are composed already, and whose lower case is a plain character."""
    ranges = (range(0x21, 0x7F), range(0xA1, 0x250), range(0x2010, 0x2028), range(0x2030, 0x203B), range(0x20AC, 0x20AD))
    known = {chr(c) for r in ranges for c in r}
    kept = {c for c in known if unicodedata.normalize("NFC", c) == c and unicodedata.category(c)[0] != "C" and len(c.lower()) == 1}
    return sorted(c for c in kept if c.lower() in kept)


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


_PLAIN = _plain_characters()
_LETTERS, _NUMBERS = _class("L"), _class("N")
_NOT_PLAIN = re.compile(f"[^ \\t-\\r{''.join(re.escape(c) for c in _PLAIN)}]")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed value: the tokenizer's own rule
_PARTS = re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_ASCII_PARTS = re.compile(rf"[a-z]+|{_ENDINGS}|[0-9]|[^\sa-z0-9]+", re.ASCII)


class PieceTokenizer:
    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _PLAIN}
        self._limit = memo_entries
        self._parts: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = self._whole.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _part(self, part: str) -> bytes:
        """The ids of a part that the memo lacks."""
        tokens = self._model.tokenize(part if part.isascii() else part.translate(self._letters))
        made = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(part) <= 64:
            if len(self._parts) >= self._limit:
                self._parts.clear()
            self._parts[part] = made
        return made

    def _plain(self, text: str) -> bytes:
        memo, miss, cut = self._parts, self._part, _ASCII_PARTS if text.isascii() else _PARTS
        return b"".join([memo.get(p) or miss(p) for p in cut.findall(text.lower())])

    def _piece(self, piece: str) -> bytes:
        if not _NOT_PLAIN.search(piece):
            return self._plain(piece)
        made = self._encode(piece)
        if len(piece) <= 64:
            if len(self._pieces) >= self._limit:
                self._pieces.clear()
            self._pieces[piece] = made
        return made

    def packed_ids(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit numbers."""
        if not _NOT_PLAIN.search(text):
            return self._plain(text)
        if _ODD.search(text):
            return self._encode(text)
        memo, miss = self._pieces, self._piece
        return b"".join([memo.get(p) or miss(p) for p in text.split()])


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One per Python worker."""
    return PieceTokenizer(path)
