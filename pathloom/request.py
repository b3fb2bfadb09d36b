"""Query text to a request: mode, filters and pattern.  Pure Python, but for the check of patterns where a JVM runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException

# Modes, their prefixes, and the extensions of each kind.
MODES = {"=": "calc", ">": "content", "?": "semantic"}
KINDS = {
    "image": "png jpg jpeg gif webp tif tiff bmp heic svg ico".split(),
    "video": "mp4 mov mkv avi webm m4v".split(),
    "audio": "mp3 wav flac m4a aac ogg".split(),
    "doc": "pdf doc docx xls xlsx ppt pptx pages key numbers md txt rtf".split(),
    "code": "rs py js ts tsx jsx go c h cpp hpp java rb sh swift kt lua sql html css toml yaml yml json".split(),
    "app": ["app"],
    "archive": "zip tar gz tgz bz2 xz 7z rar dmg".split(),
}
SECONDS = {"m": 60, "h": 3600, "d": 86_400, "w": 604_800}
SIZES = (("gb", 10**9), ("mb", 10**6), ("kb", 10**3), ("b", 1))
LONG_MAX = (1 << 63) - 1

DURATION = re.compile(r"([+-]?\d+)([mhdw])")
NUMBER = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity)", re.IGNORECASE)
#: Parts of a pattern that the two dialects write or read differently, and single characters.
PART = re.compile(r"\\(?:[xu]\{[0-9A-Fa-f]+\}|U[0-9A-Fa-f]{8}|[pP]\{\^?\w+\}|.)|\[:\^?[a-z]+:\]|\[\^?\]?|\(\?P?<\w+>|\(\?[imsux-]*[:)]|\(\?|[*+?}]\+|--|~~|.", re.DOTALL)
# Letters that may follow a backslash, and the ASCII classes by name.
ESCAPES = "aftnrvxuUdDsSwWpPbBAz"
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": r"\x20-~", "punct": "!-/:-@\\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": r"\w", "xdigit": "0-9A-Fa-f",
}


class InvalidPattern(ValueError):
    """A pattern that no regular expression engine of the linear kind takes."""


@dataclass(frozen=True)
class Filters:
    exts: tuple[str, ...] = ()
    path_terms: tuple[str, ...] = ()
    dirs_only: bool = False
    changed_after: int | None = None
    min_size: int | None = None
    max_size: int | None = None

    def is_empty(self) -> bool:
        return self == Filters()


@dataclass(frozen=True)
class Request:
    mode: str
    pattern: str
    filters: Filters = field(default_factory=Filters)

    @property
    def path_intent(self) -> bool:
        """Whether the query is about places, which quiet ones then are too."""
        return "/" in self.pattern or bool(self.filters.path_terms) or self.filters.dirs_only


def parse_duration(text: str) -> int | None:
    m = DURATION.fullmatch(text)
    seconds = int(m[1]) * SECONDS[m[2]] if m else None
    return seconds if seconds is not None and abs(seconds) <= LONG_MAX else None


def parse_size(text: str) -> int | None:
    text = text.lower()
    unit = next(((s, f) for s, f in SIZES if text.endswith(s)), ("", 1))
    number = text.removesuffix(unit[0])
    if not NUMBER.fullmatch(number) or float(number) < 0:
        return None
    return int(min(float(number) * unit[1], float(LONG_MAX)) if float(number) * unit[1] < LONG_MAX else LONG_MAX)


def kind_for_ext(ext: str) -> str | None:
    return next((kind for kind, exts in KINDS.items() if ext.lower() in exts), None)


def parse_filters(query: str, now: int) -> tuple[Filters, str]:
    """(filters, rest); without any filter the rest is the query as it came, else its words joined by single spaces."""
    exts: list[str] = []
    terms: list[str] = []
    values: dict[str, int] = {}
    dirs, rest = False, []
    for token in query.split():
        name, colon, value = token.partition(":")
        if not colon:
            rest.append(token)
        elif name == "ext":
            exts += [value.lstrip(".").lower()] if value.lstrip(".") else []
        elif name == "path":
            terms += [ascii_lower(value)] if value else []
        elif name == "kind" and value.lower() in KINDS:
            exts += KINDS[value.lower()]
        elif name == "changed" and (seconds := parse_duration(value)) is not None:
            values["changed_after"] = max(-LONG_MAX, min(LONG_MAX, now - seconds))
        elif name == "larger" and (size := parse_size(value)) is not None:
            values["min_size"] = size
        elif name == "smaller" and (size := parse_size(value)) is not None:
            values["max_size"] = size
        elif name == "dir" and not value:
            dirs = True
        else:
            rest.append(token)
    filters = Filters(tuple(exts), tuple(terms), dirs, **values)
    return (filters, query) if filters.is_empty() else (filters, " ".join(rest))


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def parse(text: str, now: int, *, regex: bool = False, script: bool = False, lines: bool = False) -> Request:
    """A request of an interactive query, a ``script`` one (no regex, ``=`` is text) or one over ``lines`` (prefixes are text)."""
    first = text[:1]
    mode = "fuzzy" if lines or not (first and first in MODES) or (script and first == "=") else MODES[first]
    if mode == "calc":
        return Request("calc", text[1:].strip())
    if mode == "fuzzy":
        filters, rest = parse_filters(text, now)
        return Request("regex" if regex and not script else "fuzzy", rest, filters)
    filters, rest = parse_filters(text[1:].lstrip(), now)
    return Request(mode, rest, filters)


def has_upper(pattern: str) -> bool:
    return any(c.isupper() for c in pattern)


def _escape(part: str) -> str:
    """An escape sequence as Java writes it."""
    name = part[3:-1]
    if part[1] in "pP" and len(name) > 2:
        return f"\\{part[1]}{{Is{name.removeprefix('Is')}}}"
    if part[1] == "U" or part[:3] == r"\u{":
        return rf"\x{{{name if part[2] == '{' else part[2:]}}}"
    return r"\x0B" if part == r"\v" else part


def translated(pattern: str) -> str:
    """The pattern in Java's dialect, without the flags of its case; refuses what a linear engine can't run."""
    out, depth, flags = [], 0, set()
    for m in PART.finditer(pattern):
        part = m[0]
        if part[0] == "\\":
            if part == "\\" or (part[1].isascii() and part[1].isalnum() and part[1] not in ESCAPES):
                raise InvalidPattern(f"invalid pattern: {pattern}")
            flags |= {"U"} if part[1] in "dDsSwWbB" else set()
            part = _escape(part)
        elif depth and part.startswith("[:"):
            name = part[2:-2].lstrip("^")
            if name not in CLASSES:
                raise InvalidPattern(f"invalid pattern: {pattern}")
            part = f"[{'^' * (part[2] == '^')}{CLASSES[name]}]"
        elif part[0] == "[":
            depth += 1
            part = part.replace("]", "\\]") if not part.startswith("[:") else part
        elif part == "]" and depth:
            depth -= 1
        elif depth and part in ("--", "~~"):
            raise InvalidPattern(f"invalid pattern: {pattern}")
        elif not depth and (part == "(?" or part[0] in "*+?}" and len(part) > 1):
            raise InvalidPattern(f"invalid pattern: {pattern}")
        elif not depth and part.startswith("(?") and part.endswith(">"):
            part = "("  # names aren't used
        elif not depth and part in ".^$":
            flags.add("d")
        out.append(part)
    return "".join([f"(?{''.join(sorted(flags))})" if flags else "", *out])


def java_pattern(pattern: str) -> str:
    """A checked pattern for ``rlike`` with smart case: case counts only if the pattern has an upper-case character.

    Java's own compiler judges it where a session runs, else Python's.  Word, digit and space
    classes are those of Unicode; a dot stops at line feeds alone.
    """
    found = translated(pattern)
    try:
        if SparkContext._jvm is not None:
            SparkContext._jvm.java.util.regex.Pattern.compile(found)
        else:
            re.compile(re.sub(r"\\[pP](\{\w+\}|\w)|\\z|\\A|\\x\{\w+\}|^\(\?[Ud]+\)", "x", found))
    except (re.error, Py4JJavaError, PySparkException) as e:
        raise InvalidPattern(f"invalid pattern: {pattern}") from e
    if has_upper(pattern):
        return found
    return f"(?iu{found[2:]}" if re.match(r"\(\?[Ud]+\)", found) else f"(?iu){found}"
