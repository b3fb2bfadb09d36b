"""The calculator: + - * / % ^ (right associative), unary minus, parentheses, doubles."""

from __future__ import annotations

import math
import re

import pandas as pd

TOKEN = re.compile(r"[ \t\n\r\f]*(?:([0-9]+\.?[0-9]*|\.[0-9]+)|([-+*/%^()]))")


class _Bad(Exception):
    pass


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip(" \t\n\r\f")
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise _Bad
        out.append(m[1] or m[2])
        at = m.end()
    return out


def _divided(a: float, b: float) -> float:
    if b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
    return a / b


def _powered(a: float, b: float) -> float:
    try:
        value = math.pow(a, b)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan
    return value


#: Binding powers: (left, right); the power binds tighter than a minus before it.
BINDING = {"+": (1, 2), "-": (1, 2), "*": (3, 4), "/": (3, 4), "%": (3, 4), "^": (8, 7)}
MINUS = 6
APPLY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": _divided,
    "%": lambda a, b: math.nan if b == 0 or math.isinf(a) else math.fmod(a, b),
    "^": _powered,
}


def evaluate(text: str) -> float | None:
    """The value, or None if the text isn't one whole expression or the value isn't finite."""
    try:
        value = _value(_tokens(text))
        return value if math.isfinite(value) else None
    except _Bad:
        return None


def _value(tokens: list[str]) -> float:
    """Operands and waiting operators on two stacks, so that nothing is too deep; ``~`` is a minus before an operand."""
    values: list[float] = []
    waiting: list[str] = []

    def applied(least: int) -> None:
        while waiting and waiting[-1] != "(" and least < (MINUS if waiting[-1] == "~" else BINDING[waiting[-1]][1]):
            op, right = waiting.pop(), values.pop()
            values.append(-right if op == "~" else APPLY[op](values.pop(), right))

    operand = True
    for token in tokens:
        if operand:
            if token in "(-":
                waiting.append("~" if token == "-" else token)
                continue
            if token in BINDING or token == ")":
                raise _Bad
            values.append(float(token))
            operand = False
        elif token == ")":
            applied(0)
            if not waiting:
                raise _Bad
            waiting.pop()
        elif token in BINDING:
            applied(BINDING[token][0])
            waiting.append(token)
            operand = True
        else:
            raise _Bad
    if operand:
        raise _Bad
    applied(0)
    if waiting:
        raise _Bad
    return values[0]


def shown(value: float) -> str:
    """Whole numbers plainly, others with up to ten decimals."""
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return f"{value:.10f}".rstrip("0").rstrip(".")


def shown_values(texts: pd.Series) -> pd.Series:
    """The value of each text as it is shown, null where it has none; each distinct text is evaluated once."""
    values = {t: None if (v := evaluate(t)) is None else shown(v) for t in texts.dropna().unique()}
    return texts.map(values).astype(object)
