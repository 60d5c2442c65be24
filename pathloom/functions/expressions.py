"""Mathematical expressions in LaTeX or plain notation: a parser to a small tree and a test of equality.

Without a computer algebra system two expressions count as equal if they agree, within a
relative 1e-9, at several fixed points of all their variables. Equal expressions always
pass; different ones of the usual size practically never do.
"""

from __future__ import annotations

import cmath
import hashlib
import math
import re
from collections.abc import Callable

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(\\[a-zA-Z]+|\\.)|(\*\*|[a-zA-Z]|[^\s\w]))")
_FUNCTIONS: dict[str, Callable[[complex], complex]] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "exp": cmath.exp, "log": cmath.log, "ln": cmath.log,
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan,
    "cot": lambda z: 1 / cmath.tan(z), "sec": lambda z: 1 / cmath.cos(z), "csc": lambda z: 1 / cmath.sin(z), "coth": lambda z: 1 / cmath.tanh(z), "sech": lambda z: 1 / cmath.cosh(z), "csch": lambda z: 1 / cmath.sinh(z),
}
_PLAIN_WORDS = sorted([*_FUNCTIONS, "sqrt", "pi"], key=len, reverse=True)
_IGNORED = {"\\left", "\\right", "\\,", "\\;", "\\!", "\\:", "\\ ", "\\quad", "\\displaystyle"}
#: Exponents above this are not computed.
MOST_POWER = 1000


class NotAnExpression(ValueError):
    """The text is no expression of this grammar."""


def _tokens(text: str) -> list[str]:
    for w in _PLAIN_WORDS:  # function names without a backslash
        text = re.sub(rf"(?<![\\a-zA-Z]){w}(?![a-z])", rf"\\{w} ", text)
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NotAnExpression(text)
        at = m.end()
        t = m[1] or m[2] or m[3]
        if t not in _IGNORED:
            out.append(t)
    return out


class _Parser:
    """Recursive descent: sums of products of signed powers; juxtaposition multiplies."""

    def __init__(self, text: str):
        self.t, self.i, self.names = _tokens(text), 0, set()

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or want is not None and t != want:
            raise NotAnExpression(f"{want} expected")
        self.i += 1
        return t

    def whole(self):
        tree = self.sum()
        if self.peek():
            raise NotAnExpression(f"rest from {self.peek()}")
        return tree

    def sum(self):
        tree = self.product()
        while self.peek() in ("+", "-"):
            tree = (self.take(), tree, self.product())
        return tree

    def product(self):
        tree = self.signed()
        while True:
            t = self.peek()
            if t in ("*", "\\cdot", "\\times"):
                self.take()
                tree = ("*", tree, self.signed())
            elif t in ("/", "\\div"):
                self.take()
                tree = ("/", tree, self.signed())
            elif t and (t[0].isalnum() or t in ("(", "{", "[") or t[0] == "\\" and t not in ("\\}", "\\]", "\\)", "\\cup", "\\cap", "\\in", "\\le", "\\ge", "\\leq", "\\geq", "\\neq")):
                tree = ("*", tree, self.power())
            else:
                return tree

    def signed(self):
        if self.peek() in ("+", "-"):
            sign = self.take()
            return ("neg", self.signed()) if sign == "-" else self.signed()
        return self.power()

    def power(self):
        tree = self.atom()
        while self.peek() == "!":
            self.take()
            tree = ("!", tree)
        if self.peek() in ("^", "**"):
            self.take()
            return ("^", tree, self.argument())
        return tree

    def argument(self):
        """An exponent or macro argument: a braced group or one symbol."""
        if self.peek() == "{":
            return self.group()
        if self.peek() == "-":
            self.take()
            return ("neg", self.argument())
        t = self.peek()
        if t and t[0].isdigit() and len(t) > 1 and self.i and self.t[self.i - 1] != "^" and "." not in t:
            self.t[self.i] = t[1:]
            return ("num", float(t[0]))
        return self.atom()

    def group(self):
        close = {"{": "}", "(": ")", "[": "]", "\\{": "\\}", "\\(": "\\)", "\\[": "\\]"}[self.take()]
        tree = self.sum()
        self.take(close)
        return tree

    def atom(self):
        t = self.peek()
        if not t:
            raise NotAnExpression("end")
        if t in ("{", "(", "[", "\\{", "\\(", "\\["):
            return self.group()
        self.take()
        if t[0].isdigit() or t[0] == ".":
            return ("num", float(t))
        if t == "|":
            tree = self.sum()
            self.take("|")
            return ("abs", tree)
        if t in ("\\frac", "\\dfrac", "\\tfrac"):
            return ("/", self.argument(), self.argument())
        if t == "\\binom":
            return ("binom", self.argument(), self.argument())
        if t == "\\sqrt":
            root = ("num", 2.0)
            if self.peek() == "[":
                root = self.group()
            return ("^", self.argument(), ("/", ("num", 1.0), root))
        if t == "\\pi" or t == "π":
            return ("num", math.pi)
        if t == "\\infty":
            return ("num", math.inf)
        if t[0] == "\\" and t[1:] in _FUNCTIONS:
            power = None
            if self.peek() == "^":
                self.take()
                power = self.argument()
            inner = self.group() if self.peek() in ("(", "{") else self.power()
            tree = ("fn", t[1:], inner)
            return tree if power is None else ("^", tree, power)
        if t[0] == "\\" and t[1:].isalpha() or t.isalpha():
            name = t.lstrip("\\")
            if self.peek() == "_":
                self.take()
                name += "_" + repr(self.argument())
            self.names.add(name)
            return ("var", name)
        raise NotAnExpression(t)


def parse(text: str) -> tuple[tuple, frozenset[str]]:
    """(tree, names of the variables). Raises NotAnExpression."""
    p = _Parser(text)
    try:
        tree = p.whole()
    except (IndexError, KeyError, RecursionError) as e:
        raise NotAnExpression(text) from e
    return tree, frozenset(p.names)


def value(tree: tuple, at: dict[str, complex]) -> complex:
    """The value of a tree with variables ``at``."""
    op, *args = tree
    if op == "num":
        return args[0]
    if op == "var":
        return at[args[0]]
    if op == "fn":
        return _FUNCTIONS[args[0]](value(args[1], at))
    x = value(args[0], at)
    if op == "neg":
        return -x
    if op == "abs":
        return abs(x)
    if op == "!":
        if abs(complex(x).imag) > 0 or x.real > 170:
            raise NotAnExpression("factorial")
        return math.gamma(x.real + 1)
    y = value(args[1], at)
    if op == "+":
        return x + y
    if op == "-":
        return x - y
    if op == "*":
        return x * y
    if op == "/":
        return x / y
    if op == "binom":
        return float(math.comb(round(complex(x).real), round(complex(y).real)))
    if abs(y) > MOST_POWER:
        raise NotAnExpression("power")
    return complex(x) ** y if complex(x).real < 0 or isinstance(x, complex) or isinstance(y, complex) else x**y


def points(names: frozenset[str], n: int = 3) -> list[dict[str, complex]]:
    """Fixed sample points; "i" is the imaginary unit and "e" Euler's number."""
    out = []
    for k in range(n):
        at = {v: 0.5 + 2 * int(hashlib.sha256(f"{v}|{k}".encode()).hexdigest()[:8], 16) / 2**32 for v in names}
        at.update({v: c for v, c in (("i", 1j), ("e", math.e)) if v in names})
        out.append(at)
    return out


def close(x: complex, y: complex, rel: float = 1e-9, absolute: float = 1e-8) -> bool:
    """Equal within a relative or an absolute tolerance; infinities only to themselves."""
    if x == y:
        return True
    try:
        d = abs(x - y)
    except OverflowError:
        return False
    return d <= max(rel * max(abs(x), abs(y)), absolute) and math.isfinite(d)


def equal(a: str, b: str) -> bool:
    """Both texts are expressions with the same values. Raises NotAnExpression if one isn't."""
    (x, p), (y, q) = parse(a), parse(b)
    return trees_equal(x, y, p | q)


def trees_equal(x: tuple, y: tuple, names: frozenset[str]) -> bool:
    decided = 0
    for at in points(names):
        try:
            u, v = value(x, at), value(y, at)
        except (ArithmeticError, ValueError):
            continue
        decided += 1
        if not close(u, v):
            return False
    return decided > 0


def ratio_is_integer(a: str, b: str) -> bool:
    """The values of two expressions are in one fixed whole-number ratio (either way) other than 0."""
    (x, p), (y, q) = parse(a), parse(b)
    ratios = []
    for at in points(p | q):
        try:
            ratios.append(value(x, at) / value(y, at))
        except (ArithmeticError, ValueError):
            continue
    if not ratios or not all(close(r, ratios[0]) for r in ratios):
        return False
    r = ratios[0]
    return any(abs(z) > 0.5 and close(z, round(complex(z).real)) for z in (r, 1 / r if r else 0))


__all__ = ["NotAnExpression", "close", "equal", "parse", "points", "ratio_is_integer", "trees_equal", "value"]
