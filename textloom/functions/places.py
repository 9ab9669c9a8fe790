"""Places of pieces within texts, in time proportional to the texts: overlaps by a prefix function, searches in one pass.

These are the helpers that tasks call for one document at a time; all places count code points.
"""

from __future__ import annotations

import ahocorasick


def overlap_length(a: str, b: str, cap: int | None = None) -> int:
    """The largest n, at most cap, for which the last n characters of a are the first n of b; 0 if none.

    b is run through by its prefix function, so the time is that of reading both ends once.
    """
    most = min(len(a), len(b)) if cap is None else min(len(a), len(b), cap)
    if not most:
        return 0
    tail, head = a[len(a) - most :], b[:most]
    begin = tail.find(head[0])
    if begin < 0:
        return 0
    falls, k = [0] * most, 0
    for i in range(1, most):
        while k and head[i] != head[k]:
            k = falls[k - 1]
        k += head[i] == head[k]
        falls[i] = k
    k = 0
    for c in tail[begin:]:
        while k and (k == most or c != head[k]):
            k = falls[k - 1]
        k += c == head[k]
    return k


def last_places(text: str, pieces: list[str]) -> dict[str, int]:
    """Where each piece that the text holds begins last; the text is read once for all pieces."""
    known = ahocorasick.Automaton()
    for x in pieces:
        if x:
            known.add_word(x, x)
    found: dict[str, int] = {}
    if len(known):
        known.make_automaton()
        for end, x in known.iter(text):
            found[x] = end - len(x) + 1
    return found


def located(text: str, pieces: list[str], overlap: int | None = 0) -> list[int]:
    """Where each piece begins, found one after another.

    A search begins overlap characters before the last end, or at 0; a piece that isn't found from there on is taken to begin
    there. With overlap None it is the overlap of the first two pieces. Searches that succeed move forward; the first that
    fails makes one pass over the text for the last places of all pieces still to come, so that no later one runs to the end in vain.
    """
    if overlap is None:
        overlap = overlap_length(pieces[0], pieces[1]) if len(pieces) > 1 else 0
    at, starts, last = 0, [], None
    for i, x in enumerate(pieces):
        found = text.find(x, at) if last is None or not x or last.get(x, -1) >= at else -1
        if found < 0 and last is None:
            last = last_places(text, pieces[i + 1 :])
        start = at if found < 0 else found
        starts.append(start)
        at = max(0, start + len(x) - overlap)
    return starts


def merged(pieces: list[str | None], cap: int, gap: str = "\n\n") -> str | None:
    """Texts appended in turn: an overlap with the last cap characters is left out, else gap goes between. Nulls are left out.

    Only those last characters are kept beside the list of parts, which is joined once.
    """
    own = [x for x in pieces if x is not None]
    if not own:
        return None
    out, tail = [own[0]], own[0][-cap:]
    for x in own[1:]:
        n = overlap_length(tail, x, cap)
        part = x[n:] if n else gap + x
        out.append(part)
        tail = part[-cap:] if len(part) >= cap else (tail + part)[-cap:]
    return "".join(out)
