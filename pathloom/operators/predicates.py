"""Filters, atoms and quiet places as predicates that Catalyst pushes to the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower, basename, extension, is_dir
from ..functions.fuzzy import Atom, unaccented
from ..request import Filters

#: Parts of paths that are quiet unless configured otherwise.
QUIET = ("/Library/", "/.")


def meta_predicate(filters: Filters) -> Column:
    out = F.lit(True)
    if filters.changed_after is not None:
        out = out & (F.col("mtime") >= filters.changed_after)
    if filters.min_size is not None:
        out = out & (F.col("size") >= filters.min_size)
    if filters.max_size is not None:
        out = out & (F.col("size") <= filters.max_size)
    return out


def predicate(filters: Filters) -> Column:
    """Directories alone or not at all; one of the extensions; all path parts; time and size."""
    out = meta_predicate(filters) & (is_dir(F.col("path")) if filters.dirs_only else ~is_dir(F.col("path")))
    if filters.exts:
        out = out & ascii_lower(extension(F.col("path"))).isin(*filters.exts)
    for term in filters.path_terms:
        out = out & F.contains(ascii_lower(F.col("path")), F.lit(term))
    return out


def scoped(rows: DataFrame, filters: Filters, *, always: bool = True) -> DataFrame:
    """Filename modes always filter; content and semantic ones only if some filter was given."""
    return rows.where(predicate(filters)) if always or not filters.is_empty() else rows


def quiet(patterns: tuple[str, ...] = QUIET, path: str = "path") -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.col(path), F.lit(p)) for p in patterns), F.lit(False))


def subsequence(text: str) -> str:
    """A Java pattern for the characters of ``text`` in order; each skip stops at the next one, so nothing is tried twice."""
    def inside(c: str) -> str:
        return f"\\{c}" if c in "\\]^-[&" else c

    return "(?s)" + re.escape(text[0]) + "".join(f"[^{inside(c)}]*+{re.escape(c)}" for c in text[1:])


def atom_predicate(atom: Atom, path: str = "path") -> Column:
    """Membership of one atom, without its score."""
    c, text = (F.lower(F.col(path)), atom.text.lower()) if atom.folded else (F.col(path), atom.text)

    def found(seen: Column) -> Column:
        if atom.kind == "fuzzy" and not atom.negative:
            return seen.rlike(subsequence(text))
        return {"prefix": F.startswith, "suffix": F.endswith, "whole": lambda a, b: a == b}.get(atom.kind, F.contains)(seen, F.lit(text))

    hit = found(c)
    if atom.plain:  # only texts beyond ASCII have accents to take off
        wide = F.octet_length(F.col(path)) > F.char_length(F.col(path))
        marks = unaccented()
        hit = hit | (wide & found(F.translate(c, "".join(map(chr, marks)), "".join(map(chr, marks.values())))))
    return ~hit if atom.negative else hit


def glob_to_regex(glob: str) -> str:
    """A Java pattern of a glob: ``*`` and ``?`` stop at slashes only in no case, ``**/`` is any folders, ``{a,b}`` either."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", at + 2)
            if end < 0:
                raise ValueError(f"invalid glob: {glob}")
            body = glob[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        else:
            out += re.escape(c)
        at += 1
    if depth:
        raise ValueError(f"invalid glob: {glob}")
    return out


def exclude_regex(patterns: list[str] | tuple[str, ...]) -> str | None:
    """One pattern for paths that any exclude names, or that lie below such a path."""
    each = [f"(?:.*/)?{glob_to_regex(p)}(?:/.*)?" for p in patterns]
    return "^(?:" + "|".join(each) + ")/?$" if each else None


def not_excluded(rows: DataFrame, patterns: list[str] | tuple[str, ...]) -> DataFrame:
    found = exclude_regex(patterns)
    return rows.where(~F.col("path").rlike(found)) if found else rows


def has_name(path: str = "path") -> Column:
    return basename(F.col(path)) != ""
