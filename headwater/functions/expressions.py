"""Compiler of written regression equations to Spark columns, so that the optimiser sees plain arithmetic.

expr := term (+|- term)*; term := unary (*|/ unary)*; unary := -|+ unary | power; power := primary (^ unary)?;
primary := number | name | function(expr, ...) | (expr). ^ binds to the right and closer than a sign before it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(.))")
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "max": lambda *x: F.greatest(*x),
    "exp": lambda x: F.exp(x),
    "logn": lambda x, base: F.log(x) / F.log(base),
}


class EquationError(ValueError):
    """The text isn't an equation of this grammar."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        number, name, other = m.groups()
        out.append(("number", number) if number else ("name", name) if name else ("sign", other))
        at = m.end()
    return out


def compile_expression(text: str, variable: Callable[[str], Column] = F.col) -> Column:
    """A column for the expression; variable(name) gives that of a name. The name e is Euler's number."""
    rest = tokens(text)

    def peek() -> str | None:
        return rest[0][1] if rest and rest[0][0] == "sign" else None

    def take(sign: str) -> None:
        if peek() != sign:
            raise EquationError(f"{sign} expected in {text!r}")
        rest.pop(0)

    def expr() -> Column:
        left = term()
        while peek() in ("+", "-"):
            sign = rest.pop(0)[1]
            right = term()
            left = left + right if sign == "+" else left - right
        return left

    def term() -> Column:
        left = unary()
        while peek() in ("*", "/"):
            sign = rest.pop(0)[1]
            right = unary()
            left = left * right if sign == "*" else left / right
        return left

    def unary() -> Column:
        if peek() in ("+", "-"):
            return -unary() if rest.pop(0)[1] == "-" else unary()
        return power()

    def power() -> Column:
        base = primary()
        if peek() == "^":
            rest.pop(0)
            return F.pow(base, unary())
        return base

    def primary() -> Column:
        if not rest:
            raise EquationError(f"{text!r} ends early")
        if peek() == "(":
            take("(")
            inner = expr()
            take(")")
            return inner
        kind, word = rest.pop(0)
        if kind == "number":
            return F.lit(float(word))
        if kind != "name":
            raise EquationError(f"{word!r} isn't expected in {text!r}")
        if peek() != "(":
            return F.lit(math.e) if word == "e" else variable(word)
        if word.lower() not in FUNCTIONS:
            raise EquationError(f"{word!r} is no function")
        take("(")
        args = [expr()]
        while peek() == ",":
            take(",")
            args.append(expr())
        take(")")
        return FUNCTIONS[word.lower()](*args)

    out = expr()
    if rest:
        raise EquationError(f"{rest[0][1]!r} isn't expected in {text!r}")
    return out


def variables(text: str) -> list[str]:
    """Names in order of appearance, without functions and e."""
    found = tokens(text)
    names = [w for i, (k, w) in enumerate(found) if k == "name" and w != "e" and not (i + 1 < len(found) and found[i + 1] == ("sign", "("))]
    return list(dict.fromkeys(names))
