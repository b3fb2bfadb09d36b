"""Scalar functions over paths, sizes and times, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..request import KINDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def is_dir(path: Column) -> Column:
    return F.endswith(path, F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def path_name(path: Column) -> Column:
    """The last component; a directory's keeps its slash."""
    return F.regexp_extract(path, "([^/]*/?)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*?)[^/]*/?$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the last component, if anything precedes it."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def kind_of(ext: Column) -> Column:
    out = None
    for kind, exts in KINDS.items():
        fits = ascii_lower(ext).isin(exts)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def kind_label(path: Column) -> Column:
    ext = extension(path)
    return F.when(is_dir(path), "DIR").when(ext == "", "FILE").otherwise(F.upper(ext))


def badge(path: Column) -> Column:
    return F.substring(kind_label(path), 1, 4)


def human_size(size: Column) -> Column:
    def shown(unit: float, name: str) -> Column:
        return F.format_string(f"%.1f {name}", size / F.lit(unit))

    return F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1_000_000, shown(1e3, "KB")).when(size < 1_000_000_000, shown(1e6, "MB")).otherwise(shown(1e9, "GB"))


def human_age(seconds: Column) -> Column:
    def shown(unit: int, name: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(name))

    return F.when(seconds < 60, "just now").when(seconds < 3600, shown(60, "m")).when(seconds < 86_400, shown(3600, "h")).when(seconds < 31_536_000, shown(86_400, "d")).otherwise(shown(31_536_000, "y"))


def row_age(mtime: Column, now: int) -> Column:
    return F.when(mtime > 0, human_age(F.lit(now) - mtime))


def shorten_home(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(F.startswith(path, F.lit(home.rstrip("/") + "/")), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 1 << 30))).otherwise(path)


def score_bar(score: Column, full: str = "▰", empty: str = "▱") -> Column:
    cells = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 5).cast("int")
    return F.concat(F.repeat(F.lit(full), cells), F.repeat(F.lit(empty), F.lit(5) - cells))


def gauge_cells(done: Column, total: Column, width: int) -> Column:
    return F.when(total <= 0, F.lit(0)).otherwise(F.least(F.floor(done * width / total), F.lit(width))).cast("long")


def clip_chars(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…")))


def percent_label(score: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 100), F.lit("% match"))


def snippet(text: Column, line: Column, most: int = 160) -> Column:
    """A line of a text, trimmed and cut; null if blank or past the end."""
    body = F.regexp_replace(F.try_element_at(F.split(text, "\n"), line.cast("int")), r"^\s+|\s+$", "")
    return F.when(body != "", F.substring(body, 1, most))


def first_match(text: Column, pattern: str) -> Column:
    """(start, end) of the first match in characters from 0, null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.char_length(F.regexp_substr(text, F.lit(pattern)))).alias("end")))


def preview(text: Column, line: int | None, before: int = 6, count: int = 40, head: int = 100) -> Column:
    """Lines around a hit, or the first ones."""
    rows = F.split(text, "\n")
    return F.slice(rows, 1, head) if line is None else F.slice(rows, max(1, line - before + 1), count)
