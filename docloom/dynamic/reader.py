"""A tolerant JSON reader. Whatever goes beyond strict JSON is read and noted as a lint of some level; what can't be
understood is noted as BAD, and what ends the reading as FATAL."""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass, field

from docloom.errors import JsonError

#: Levels of strictness, in order.
STRICT, OK, NAN_INF, JSONC, JSON5, BAD, FATAL = range(7)
LEVELS = ("STRICT", "OK", "NAN_INF", "JSONC", "JSON5", "BAD", "FATAL")
DEEPEST = 512
#: Reading, evaluating and writing so deep a document takes several frames a level.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
SPACE = re.compile(r"[ \t\r\n]+")
OTHER_SPACE = re.compile(r"[\s\ufeff\u2028\u2029]+")
NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
STRICT_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
NAME = re.compile(r"[^\W\d][\w$]*|[$][\w$]*")
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
WORDS = {"true": True, "false": False, "null": None}
#: Words that other languages write, and at what level they are read.
OTHER_WORDS = {"NaN": (math.nan, NAN_INF), "Infinity": (math.inf, NAN_INF), "True": (True, BAD), "False": (False, BAD), "None": (None, BAD), "nan": (math.nan, BAD), "inf": (math.inf, BAD), "undefined": (None, BAD)}


@dataclass
class Lint:
    level: int
    at: int
    message: str


@dataclass
class Reader:
    text: str
    at: int = 0
    lints: list = field(default_factory=list)
    comments: list = field(default_factory=list)
    #: Where each node (by the keys that lead to it) begins, a pair at its key.
    places: dict = field(default_factory=dict)
    path: tuple = ()

    def note(self, level: int, message: str) -> None:
        self.lints.append(Lint(level, self.at, message))
        if level == FATAL:
            raise JsonError(f"{message} (position {self.at})")

    def skip(self) -> None:
        """White space and comments."""
        text = self.text
        while self.at < len(text):
            if m := SPACE.match(text, self.at):
                self.at = m.end()
            elif m := OTHER_SPACE.match(text, self.at):
                self.note(JSON5, "white space beyond blank, tab and line ends")
                self.at = m.end()
            elif text.startswith("//", self.at) or text[self.at] == "#":
                self.note(JSONC if text[self.at] == "/" else BAD, "a comment")
                end = text.find("\n", self.at)
                end = len(text) if end < 0 else end
                self.comments.append((self.at, text[self.at : end]))
                self.at = end
            elif text.startswith("/*", self.at):
                self.note(JSONC, "a comment")
                end = text.find("*/", self.at + 2)
                if end < 0:
                    self.note(BAD, "a comment that doesn't end")
                    end = len(text)
                self.comments.append((self.at, text[self.at : end + 2]))
                self.at = min(len(text), end + 2)
            else:
                return

    def value(self, depth: int = 0):
        self.skip()
        if self.at >= len(self.text):
            self.note(FATAL, "no value")
        c = self.text[self.at]
        if c in "[{":
            if depth >= DEEPEST:
                self.note(FATAL, f"more than {DEEPEST} levels")
            return self.array(depth) if c == "[" else self.object(depth)
        if c in "\"'`":
            return self.string()
        if m := NUMBER.match(self.text, self.at):
            return self.number(m)
        sign = c if c in "+-" else ""
        m = NAME.match(self.text, self.at + len(sign))
        if m and not sign and m[0] in WORDS:
            self.at = m.end()
            return WORDS[m[0]]
        if m and m[0] in OTHER_WORDS:
            found, level = OTHER_WORDS[m[0]]
            if sign == "+":
                self.note(JSON5, "a leading plus")
            self.note(level, f"the word {m[0]}")
            self.at = m.end()
            return -found if sign == "-" else found
        self.note(BAD, f"something that is no value: {c!r}")
        if c in "]},:":
            return None
        self.note(FATAL, f"a value can't begin with {c!r}")
        return None

    def number(self, m: re.Match):
        text = m[0]
        self.at = m.end()
        if not STRICT_NUMBER.fullmatch(text):
            self.note(JSON5 if not re.fullmatch(r"-?0\d+", text) else BAD, f"the number {text}")
        digits = text.lstrip("+-")
        if digits[:2].lower() == "0x":
            n = int(digits, 16) * (-1 if text[0] == "-" else 1)
            if not -(2**63) <= n < 2**63:
                self.note(FATAL, "a hexadecimal number beyond 64 bits")
            return n
        n = int(text) if digits.isdigit() else float(text)
        if isinstance(n, int) and not -(2**63) <= n < 2**63:
            n = float(n)
        if self.text[self.at : self.at + 1] == "/" and (d := NUMBER.match(self.text, self.at + 1)):
            self.note(BAD, "a fraction")
            self.at = d.end()
            under = float(d[0])
            n = n / under if under else math.copysign(math.inf, n) if n else math.nan
        return n

    def string(self) -> str:
        quote, text = self.text[self.at], self.text
        if quote == "'":
            self.note(JSON5, "single quotes")
        elif quote == "`":
            self.note(BAD, "backticks")
        self.at += 1
        out, stop = [], re.compile(r"[\\\n\r\x00-\x1f]|" + quote)
        while True:
            m = stop.search(text, self.at)
            if not m:
                out.append(text[self.at :])
                self.at = len(text)
                self.note(BAD, "a string that doesn't end")
                return "".join(out)
            out.append(text[self.at : m.start()])
            self.at = m.end()
            c = m[0]
            if c == quote:
                return "".join(out)
            if c in "\n\r":
                self.note(BAD, "a line end in a string")
                out.append(c)
            elif c != "\\":
                self.note(OK, "a control character in a string")
                out.append(c)
            else:
                out.append(self.escape(quote))

    def escape(self, quote: str) -> str:
        text, c = self.text, self.text[self.at : self.at + 1]
        self.at += 1
        if c in ESCAPES and c:
            return ESCAPES[c]
        if c == "u" and (m := re.compile(r"[0-9a-fA-F]{4}").match(text, self.at)):
            self.at = m.end()
            n = int(m[0], 16)
            if 0xD800 <= n < 0xDC00 and (low := re.compile(r"\\u([dD][c-fC-F][0-9a-fA-F]{2})").match(text, self.at)):
                self.at = low.end()
                n = 0x10000 + (n - 0xD800 << 10) + int(low[1], 16) - 0xDC00
            return chr(n)
        if c == "x" and (m := re.compile(r"[0-9a-fA-F]{2}").match(text, self.at)):
            self.note(JSON5, "a \\x escape")
            self.at = m.end()
            return chr(int(m[0], 16))
        if c in ("\n", "\r"):
            self.note(JSON5, "an escaped line end")
            if c == "\r" and text[self.at : self.at + 1] == "\n":
                self.at += 1
            return ""
        if c in ("'", quote, "v", "0"):
            self.note(JSON5, f"the escape \\{c}")
            return {"v": "\v", "0": "\0"}.get(c, c)
        self.note(BAD, f"the escape \\{c}")
        return c

    def key(self) -> str:
        c = self.text[self.at]
        if c in "\"'`":
            return self.string()
        if m := NAME.match(self.text, self.at):
            self.note(JSON5, f"the unquoted key {m[0]}")
            self.at = m.end()
            return m[0]
        if m := re.compile(r"[^\s:,\]}\"']+").match(self.text, self.at):
            self.note(BAD, f"the unquoted key {m[0]}")
            self.at = m.end()
            return m[0]
        self.note(FATAL, f"a key can't begin with {c!r}")
        return ""

    def items(self, close: str, wrong: str, depth: int):
        """Steps through a container; yields before each element."""
        self.at += 1
        some, comma = False, False
        while True:
            self.skip()
            if self.at >= len(self.text):
                self.note(BAD, f"{close} is missing at the end")
                return
            c = self.text[self.at]
            if c in (close, wrong):
                if c == wrong:
                    self.note(BAD, f"{wrong} instead of {close}")
                if comma:
                    self.note(JSON5, "a comma after the last element")
                self.at += 1
                return
            if c == ",":
                self.note(BAD, "a comma without an element before it") if comma or not some else None
                comma = True
                self.at += 1
                continue
            if some and not comma:
                self.note(BAD, "a comma is missing")
            some, comma = True, False
            yield

    def array(self, depth: int) -> list:
        out = []
        above = self.path
        for _ in self.items("]", "}", depth):
            self.path = (*above, len(out))
            self.places[self.path] = self.at
            out.append(self.value(depth + 1))
        self.path = above
        return out

    def object(self, depth: int) -> dict:
        out = {}
        above = self.path
        for _ in self.items("}", "]", depth):
            at = self.at
            k = self.key()
            self.path = (*above, k)
            self.places[self.path] = at
            self.skip()
            if self.text[self.at : self.at + 1] == ":":
                self.at += 1
            else:
                self.note(BAD, "a colon is missing")
            if k in out:
                self.note(BAD, f"the key {k!r} twice")
            out[k] = self.value(depth + 1)
        self.path = above
        return out


def read(text: str) -> tuple[object, list[Lint], list]:
    """A document, its lints, and its comments; raises JsonError only if nothing can be read."""
    r = Reader(text)
    if not text.strip():
        r.note(FATAL, "no text")
    value = r.value()
    r.skip()
    if r.at < len(text):
        r.note(BAD, "text after the document")
    return value, r.lints, r.comments


def read_commented(text: str) -> tuple[object, list, dict]:
    """A document, its comments (place and text), and the places of its nodes."""
    r = Reader(text)
    r.skip()
    r.places[()] = r.at
    value = r.value()
    r.skip()
    return value, r.comments, r.places


def parse(text: str, level: int = JSON5):
    """A document; lints above the level are errors."""
    value, lints, _ = read(text)
    for lint in lints:
        if lint.level > level:
            raise JsonError(f"{lint.message} (position {lint.at})")
    return value


def parse_lines(text: str, level: int = JSON5) -> list:
    """JSON Lines: one document a line."""
    return [parse(line, level) for line in text.splitlines() if line.strip()]


def parse_number(text: str):
    """A string as JSON5 has numbers, or the string itself."""
    t = text.strip()
    if m := NUMBER.fullmatch(t):
        r = Reader(t)
        try:
            return r.number(m)
        except JsonError:
            return text
    found = {"NaN": math.nan, "Infinity": math.inf, "+Infinity": math.inf, "-Infinity": -math.inf}
    return found.get(t, text)


def embedded(text: str, starts: str = '"[{') -> list[tuple[int, int, object]]:
    """All JSON values in a text that begin with one of the characters: start, end, value."""
    out, at = [], 0
    while at < len(text):
        if text[at] in starts:
            r = Reader(text, at)
            try:
                value = r.value()
                if not any(x.level >= BAD for x in r.lints):
                    out.append((at, r.at, value))
                    at = r.at
                    continue
            except JsonError:
                pass
        at += 1
    return out
