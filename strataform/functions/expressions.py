"""A small expression language for fields, turned into Columns.

Names nx ny x y w h r theta t are columns, pi and e constants. + - * / and ^ (to the right); a sign binds more tightly
than ^, so -2^2 is 4. Division by zero gives null. Functions: those of FUNCTIONS.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIABLES = ("nx", "ny", "x", "y", "w", "h", "r", "theta", "t")
CONSTANTS = {"pi": math.pi, "e": math.e}
MOST = 1024
_many = lambda f: lambda *a: a[0] if len(a) == 1 else f(*a)
FUNCTIONS = {
    **{n: getattr(F, n) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "atan2", "exp", "sqrt", "abs", "floor", "ceil", "tanh", "sinh", "cosh")},
    "log": F.ln, "sign": F.signum, "pow": F.pow, "min": _many(F.least), "max": _many(F.greatest), "round": lambda v: F.floor(v + 0.5),
    "hypot": lambda *a: F.sqrt(sum((v * v for v in a), F.lit(0.0))),
}
_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>[-+*/^(),]))")


class ExpressionError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at column {at + 1}")
        self.column = at + 1


class _Reader:
    def __init__(self, text: str):
        self.items, at = [], 0
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if not found:
                raise ExpressionError("unexpected character", at + len(text[at:]) - len(text[at:].lstrip()))
            self.items.append((found.lastgroup, found[found.lastgroup], found.start(found.lastgroup)))
            at = found.end()
        self.items.append(("end", "", len(text)))
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        kind, text, _ = self.items[self.at]
        if kind == "op" and text in wanted:
            self.at += 1
            return text
        return None

    def fail(self, message: str):
        raise ExpressionError(message, self.items[self.at][2])

    def sum(self) -> Column:
        left = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            left = left + right if op == "+" else left - right
        return left

    def product(self) -> Column:
        left = self.power()
        while op := self.take("*", "/"):
            right = self.power()
            left = left * right if op == "*" else F.try_divide(left, right)
        return left

    def power(self) -> Column:
        base = self.signed()
        return F.pow(base, self.power()) if self.take("^") else base

    def signed(self) -> Column:
        if op := self.take("+", "-"):
            inner = self.signed()
            return -inner if op == "-" else inner
        return self.atom()

    def atom(self) -> Column:
        kind, text, _ = self.items[self.at]
        if kind == "num":
            self.at += 1
            return F.lit(float(text.replace("_", "")))
        if kind == "name":
            self.at += 1
            if self.take("("):
                if text not in FUNCTIONS:
                    self.at -= 2
                    self.fail(f"unknown function {text}")
                args = [self.sum()]
                while self.take(","):
                    args.append(self.sum())
                if not self.take(")"):
                    self.fail("missing )")
                return FUNCTIONS[text](*args)
            if text in CONSTANTS:
                return F.lit(CONSTANTS[text])
            if text in VARIABLES:
                return F.col(text).cast("double")
            self.at -= 1
            self.fail(f"unknown name {text}")
        if self.take("("):
            inner = self.sum()
            if not self.take(")"):
                self.fail("missing )")
            return inner
        return self.fail("a value is missing")


def compile_field(text: str) -> Column:
    """The Column that an expression stands for; ExpressionError, with the column of the text, if it has none."""
    if not text.strip() or len(text) > MOST:
        raise ExpressionError("empty" if not text.strip() else f"longer than {MOST} characters", 0)
    reader = _Reader(text)
    out = reader.sum()
    if reader.items[reader.at][0] != "end":
        reader.fail("unexpected text")
    return out
