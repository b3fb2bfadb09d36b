"""Fuzzy matching: atoms, the alignment scorer over whole batches, and match positions.

The score of a pattern in a text is the best over all ways to find its characters in order:
each match counts, places after separators, at word starts or humps and directly after the
last match count more, gaps between matches cost an opening and each further character.
One prefix maximum a pattern character makes this a few array operations a batch.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

from ..request import has_upper

MATCH, OPEN, EXTEND = 16, 4, 1
AFTER_SEPARATOR, AFTER_OTHER, HUMP, CONSECUTIVE = 10, 8, 6, 5
NONE = -(1 << 29)


@dataclass(frozen=True)
class Atom:
    text: str
    kind: str = "fuzzy"  # fuzzy, exact, prefix, suffix, whole
    negative: bool = False
    folded: bool = True
    plain: bool = True  # accents of the text don't count


@cache
def unaccented() -> dict[int, int]:
    """Latin letters that Unicode names "... LETTER x WITH ..." to their x."""
    out = {}
    for code in range(0xC0, 0x2185):
        m = re.match(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH ", unicodedata.name(chr(code), ""))
        if m:
            out[code] = ord(m[2].lower() if m[1] == "SMALL" else m[2])
    return out


def atoms(pattern: str) -> list[Atom]:
    """``'w`` exact, ``^w`` prefix, ``w$`` suffix, ``!w`` without; else fuzzy.

    A backslash takes the meaning from these signs and joins words at a space.  Case counts
    in an atom with upper case, accents in one with an accent.
    """
    out = []
    for word in re.findall(r"(?:\\\s|\S)+", pattern):
        negative = word.startswith("!")
        body = word.removeprefix("!")
        kind = {"'": "exact", "^": "prefix"}.get(body[:1], "fuzzy")
        if kind != "fuzzy" or re.match(r"\\['^]" if negative else r"\\[!'^]", body):
            body = body[1:]
        if body.endswith("\\$"):
            body = body[:-2] + "$"
        elif body.endswith("$"):
            kind, body = ("suffix" if kind == "fuzzy" else "whole"), body[:-1]
        body = body.replace("\\ ", " ")
        if body:
            kind = "exact" if negative and kind == "fuzzy" else kind
            out.append(Atom(body, kind, negative, not has_upper(body), body.translate(unaccented()) == body))
    return out


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros((len(texts), max(1, int(sizes.max(initial=1)))), dtype=np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out, sizes


def _fold(texts: list[str]) -> list[str]:
    lowered = [t.lower() for t in texts]
    return [low if len(low) == len(t) else "".join(c.lower()[:1] for c in t) for t, low in zip(texts, lowered, strict=True)]


def _seen(texts: list[str], folded: list[str], atom: Atom) -> list[str]:
    """The texts as an atom compares them."""
    these = folded if atom.folded else texts
    return [t if t.isascii() else t.translate(unaccented()) for t in these] if atom.plain else these


def bonuses(texts: list[str]) -> np.ndarray:
    """What a match at each place adds."""
    codes, _ = _matrix(texts)
    ascii_codes = np.minimum(codes, 127)
    kinds = np.zeros(128, dtype=np.int8)  # 0 other, 1 lower or wide, 2 upper, 3 digit, 4 slash
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[47], kinds[127] = 1, 2, 3, 4, 1
    now = kinds[ascii_codes]
    before = np.full_like(now, 4)
    before[:, 1:] = now[:, :-1]
    out = np.zeros(codes.shape, dtype=np.int32)
    out[(before == 1) & (now == 2)] = HUMP
    out[(before == 0) & (now > 0) & (now < 4)] = AFTER_OTHER
    out[(before == 4) & (now != 4)] = AFTER_SEPARATOR
    return out


def _fuzzy(codes: np.ndarray, bonus: np.ndarray, pattern: str) -> np.ndarray:
    n, width = codes.shape
    place = np.arange(width, dtype=np.int32)
    best = None
    for k, c in enumerate(pattern):
        hit = codes == ord(c)
        if best is None:
            now = np.where(hit, MATCH + 2 * bonus, NONE)
        else:
            direct = np.full((n, width), NONE, dtype=np.int32)
            direct[:, 1:] = best[:, :-1] + MATCH + np.maximum(bonus, CONSECUTIVE)[:, 1:]
            gapped = np.full((n, width), NONE, dtype=np.int32)
            if width > 2:  # a gap of g characters costs OPEN + (g - 1) EXTEND
                reach = np.maximum.accumulate(best + EXTEND * place, axis=1)
                gapped[:, 2:] = reach[:, :-2] - EXTEND * place[2:] - OPEN + 2 * EXTEND + MATCH + bonus[:, 2:]
            now = np.where(hit, np.maximum(direct, gapped), NONE)
        best = np.maximum(now, NONE).astype(np.int32)  # sums of NONE stay in range
    return best.max(axis=1).astype(np.int64)


def _literal(text: str, bonus: np.ndarray, atom: Atom) -> int:
    size, best, at = len(atom.text), NONE, -1
    if atom.kind in ("prefix", "whole"):
        starts = [0] if text.startswith(atom.text) and (atom.kind == "prefix" or text == atom.text) else []
    elif atom.kind == "suffix":
        starts = [len(text) - size] if text.endswith(atom.text) else []
    else:
        starts = []
        while (at := text.find(atom.text, at + 1)) >= 0:
            starts.append(at)
    for s in starts:
        best = max(best, size * MATCH + 2 * int(bonus[s]) + int(np.maximum(bonus[s + 1 : s + size], CONSECUTIVE).sum()))
    return best


def scores(texts: list[str], pattern: str) -> np.ndarray:
    """The score of each text; -1 where it doesn't match.  A pattern without atoms matches all with 0."""
    out = np.zeros(len(texts), dtype=np.int64)
    found = atoms(pattern)
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    for a in range(0, len(order), 2048):  # texts of like length share a matrix
        rows = order[a : a + 2048]
        part = [texts[k] for k in rows]
        folded, bonus = _fold(part), bonuses(part)
        total = np.zeros(len(part), dtype=np.int64)
        for atom in found:
            these = _seen(part, folded, atom)
            if atom.kind == "fuzzy" and not atom.negative:
                value = _fuzzy(_matrix(these)[0], bonus, atom.text)
            else:
                value = np.array([_literal(t, bonus[k], atom) for k, t in enumerate(these)], dtype=np.int64)
            if atom.negative:
                total[value > NONE // 2] = NONE
            else:
                total = np.where(value > NONE // 2, total + value, NONE)
            total = np.maximum(total, NONE)
        out[rows] = np.where(total > NONE // 2, total, -1)
    return out


def positions(text: str, pattern: str) -> list[int]:
    """Places of the matched characters of the best alignment, sorted; empty if any atom fails."""
    found: set[int] = set()
    folded, bonus = _fold([text])[0], bonuses([text])[0].tolist()
    for atom in atoms(pattern):
        t = _seen([text], [folded], atom)[0]
        if atom.negative:
            continue
        if atom.kind != "fuzzy":
            at = 0 if atom.kind in ("prefix", "whole") else len(t) - len(atom.text) if atom.kind == "suffix" else t.find(atom.text)
            if at < 0 or t[at : at + len(atom.text)] != atom.text:
                return []
            found |= set(range(at, at + len(atom.text)))
            continue
        rows: list[dict[int, tuple[int, int]]] = []  # place: (score, place before)
        for k, c in enumerate(atom.text):
            row: dict[int, tuple[int, int]] = {}
            far = None  # the best place before a gap: (score + EXTEND place, place)
            for i, x in enumerate(t):
                if k and i > 1 and (before := rows[-1].get(i - 2)):
                    far = max(far or (before[0] + EXTEND * (i - 2), i - 2), (before[0] + EXTEND * (i - 2), i - 2))
                if x != c:
                    continue
                if k == 0:
                    row[i] = (MATCH + 2 * bonus[i], -1)
                    continue
                options = [(near[0] + MATCH + max(bonus[i], CONSECUTIVE), i - 1)] if (near := rows[-1].get(i - 1)) else []
                if far:
                    options.append((far[0] - EXTEND * (i - 2) + MATCH + bonus[i] - OPEN, far[1]))
                if options:
                    row[i] = max(options)
            if not row:
                return []
            rows.append(row)
        at = max(rows[-1], key=lambda i: (rows[-1][i][0], -i))
        for row in reversed(rows):
            found.add(at)
            at = row[at][1]
    return sorted(found)
