"""Patterns of the search dialect as Java patterns for ``rlike`` and its relatives.

The dialect is a linear-time one: no look-around, no back-references, Unicode
classes, ``$`` only at the very end of a line, no literal line feed.  Java's
engine backtracks, so what it would accept beyond the dialect is refused here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Always on: Unicode classes, and only the line feed ends a line.
FLAGS = "dU"
#: The ASCII classes by name.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Long names of general categories.
CATEGORIES = {
    "letter": "L", "cased_letter": "LC", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "titlecase_letter": "Lt", "modifier_letter": "Lm", "other_letter": "Lo",
    "mark": "M", "nonspacing_mark": "Mn", "spacing_mark": "Mc", "enclosing_mark": "Me", "number": "N", "decimal_number": "Nd", "letter_number": "Nl", "other_number": "No",
    "punctuation": "P", "connector_punctuation": "Pc", "dash_punctuation": "Pd", "open_punctuation": "Ps", "close_punctuation": "Pe", "initial_punctuation": "Pi",
    "final_punctuation": "Pf", "other_punctuation": "Po", "symbol": "S", "math_symbol": "Sm", "currency_symbol": "Sc", "modifier_symbol": "Sk", "other_symbol": "So",
    "separator": "Z", "space_separator": "Zs", "line_separator": "Zl", "paragraph_separator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "private_use": "Co",
}
SHORT = {v.lower(): v for v in CATEGORIES.values()}
BINARY_PROPERTIES = {"alphabetic", "ideographic", "lowercase", "uppercase", "titlecase", "white_space", "join_control", "assigned"}


class BadPattern(ValueError):
    """The pattern is not one of the dialect."""


@dataclass(frozen=True)
class Compiled:
    """A Java pattern, and whether the source had an upper-case literal."""

    java: str
    upper: bool


class _Translator:
    def __init__(self, source: str):
        self.s, self.i, self.out, self.upper, self.depth = source, 0, [], False, 0

    def fail(self, why: str):
        raise BadPattern(f"{why} at {self.i} in {self.s!r}")

    def run(self) -> str:
        s = self.s
        atoms = [0]  # start in ``out`` of what a quantifier would repeat, by group depth
        quantified = [False]
        while self.i < len(s):
            c = s[self.i]
            if c in "*+?" or c == "{":
                self._quantifier(atoms, quantified)
                continue
            if c == "(":
                atoms[-1], quantified[-1] = len(self.out), False
                if self._open():
                    atoms.append(-1)
                    quantified.append(False)
                else:
                    atoms[-1] = -1
                continue
            if c == ")":
                if len(atoms) == 1:
                    self.fail("unopened group")
                atoms.pop()
                quantified.pop()
                quantified[-1] = False
                self.out.append(")")
                self.i += 1
                continue
            if c == "|":
                atoms[-1], quantified[-1] = -1, False
                self.out.append("|")
                self.i += 1
                continue
            atoms[-1], quantified[-1] = len(self.out), False
            if c == "\\":
                self.out.append(self._escape(False))
            elif c == "[":
                self.out.append(self._class())
            else:
                self._literal(c)
                self.i += 1
        if len(atoms) > 1:
            self.fail("unclosed group")
        return "".join(self.out)

    def _literal(self, c: str):
        if c == "\n":
            self.fail("a literal line feed is not allowed")
        self.upper |= c.isupper()
        self.out.append(c if c in ".^$ #" or c.isalnum() or ord(c) > 127 or c in "_-,:;!@%&='\"<>/~`" else "\\" + c if not c.isspace() else c)

    def _quantifier(self, atoms, quantified):
        if atoms[-1] == -1 or not self.out and atoms[-1] == 0:
            self.fail("repetition of nothing")
        m = re.compile(r"[*+?]|\{\s*\d+\s*(?:,\s*\d*\s*)?\}").match(self.s, self.i)
        if not m:
            self.fail("malformed repetition")
        token = re.sub(r"\s", "", m[0])
        if token[0] == "{" and (b := re.match(r"\{(\d+),(\d+)\}", token)) and int(b[1]) > int(b[2]):
            self.fail("repetition bounds out of order")
        self.i = m.end()
        lazy = self.s[self.i : self.i + 1] == "?"
        self.i += lazy
        if quantified[-1]:
            self.out.insert(atoms[-1], "(?:")
            self.out.append(")")
        self.out.append(token + "?" * lazy)
        quantified[-1] = True

    def _open(self) -> bool:
        """Handles an opening parenthesis; False for a flag setting, which is no group."""
        s, i = self.s, self.i
        if s[i + 1 : i + 2] != "?":
            self.out.append("(")
            self.i += 1
            return True
        if m := re.compile(r"\(\?P?<([A-Za-z_][\w.\[\]]*)>").match(s, i):
            self.out.append("(")  # names are of no use to a search
            self.i = m.end()
            return True
        if m := re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])").match(s, i):
            on, off, end = m[1], (m[2] or "")[1:], m[3]
            if not on and not off and end == ")":
                self.fail("empty flags")
            if set(on + off) - set("imsxuR") or "u" in off:
                self.fail("unsupported flag")
            on, off = (re.sub("[uR]", "", x) for x in (on, off))
            self.i = m.end()
            if not on and not off:
                if end == ":":
                    self.out.append("(?:")
                    return True
                return False
            self.out.append(f"(?{on}{'-' if off else ''}{off}{end}")
            return end == ":"
        self.fail("look-around and other group forms are not supported")

    def _escape(self, in_class: bool) -> str:
        s, i = self.s, self.i
        if i + 1 >= len(s):
            self.fail("escape at the end")
        c = s[i + 1]
        self.i += 2
        if c in "dwsDWS" or c in "trf":
            return "\\" + c
        if c == "n":
            self.fail("a literal line feed is not allowed")
        if c == "v":
            return r"\x0B"
        if c == "a":
            return r"\x07"
        if c in "xuU":
            return self._code(c)
        if c in "pP":
            return self._property(c == "P")
        if not in_class:
            if c == "b":
                if m := re.compile(r"\{(start|end|start-half|end-half)\}").match(s, self.i):
                    self.i = m.end()
                    return {"start": r"(?<!\w)(?=\w)", "end": r"(?<=\w)(?!\w)", "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}[m[1]]
                return r"\b"
            if c in "BAz":
                return "\\" + c
            if c == "<":
                return r"(?<!\w)(?=\w)"
            if c == ">":
                return r"(?<=\w)(?!\w)"
        if c.isalnum():
            self.fail(f"unrecognised escape \\{c}")
        return "\\" + c if ord(c) < 128 else c

    def _code(self, kind: str) -> str:
        m = re.compile(r"\{([0-9A-Fa-f]{1,8})\}").match(self.s, self.i) or re.compile(rf"([0-9A-Fa-f]{{{ {'x': 2, 'u': 4, 'U': 8}[kind] }}})").match(self.s, self.i)
        if not m:
            self.fail("malformed code point")
        n = int(m[1], 16)
        if n > 0x10FFFF or n == 10:
            self.fail("code point not allowed")
        self.i = m.end()
        self.upper |= chr(n).isupper()
        return f"\\x{{{n:X}}}"

    def _property(self, negated: bool) -> str:
        m = re.compile(r"\{(\^?)([^}]+)\}|([A-Za-z])").match(self.s, self.i)
        if not m:
            self.fail("malformed property")
        self.i = m.end()
        negated ^= m[1] == "^"
        name = m[2] or m[3]
        field, _, value = name.partition("!=") if "!=" in name else name.partition("=") if "=" in name else name.partition(":")
        negated ^= "!=" in name
        key = re.sub(r"[\s-]", "_", (value or field)).strip("_").lower()
        kind = re.sub(r"[\s_-]", "", field).lower() if value else ""
        if kind in ("", "gc", "generalcategory") and (key in CATEGORIES or key in SHORT):
            body = CATEGORIES.get(key) or SHORT[key]
        elif not kind and key == "any":
            return r"[^\x00-\x{10FFFF}]" if negated else r"[\x00-\x{10FFFF}]"
        elif not kind and key == "ascii":
            return r"[^\x00-\x7F]" if negated else r"[\x00-\x7F]"
        elif not kind and key in BINARY_PROPERTIES:
            body = "Is" + key
        elif kind in ("", "sc", "script", "scx", "scriptextensions"):
            body = "Is" + key
        else:
            self.fail("unknown property")
        return f"\\{'P' if negated else 'p'}{{{body}}}"

    def _class(self) -> str:
        s = self.s
        self.i += 1
        out = "["
        if s[self.i : self.i + 1] == "^":
            out += "^"
            self.i += 1
        first = True
        while True:
            if self.i >= len(s):
                self.fail("unclosed class")
            c = s[self.i]
            if c == "]" and not first:
                self.i += 1
                return out + "]"
            if c == "[":
                if m := re.compile(r"\[:(\^?)([a-z]+):\]").match(s, self.i):
                    if m[2] not in POSIX:
                        self.fail("unknown class")
                    out += f"[{m[1]}{POSIX[m[2]]}]"
                    self.i = m.end()
                else:
                    out += self._class()
            elif s.startswith("&&", self.i):
                out += "&&"
                self.i += 2
            elif s.startswith("--", self.i) and not first and s[self.i + 2 : self.i + 3] == "[":
                self.i += 2
                inner = self._class()
                out += "&&" + ("[" + inner[2:] if inner.startswith("[^") else "[^" + inner[1:])
            elif s.startswith("~~", self.i):
                self.fail("symmetric difference is not supported")
            elif c == "\\":
                out += self._escape(True)
            elif c == "\n":
                self.fail("a literal line feed is not allowed")
            else:
                self.upper |= c.isupper()
                out += "\\" + c if c in "]^&~#" or c.isspace() else c
                self.i += 1
            first = False


def quote(text: str) -> str:
    """A literal as a pattern."""
    if "\n" in text:
        raise BadPattern("a literal line feed is not allowed")
    return re.sub(r"([\\.^$|?*+()\[\]{}#&~\s-])", r"\\\1", text)


def translate(pattern: str) -> Compiled:
    """One pattern of the dialect as Java source, without flags."""
    t = _Translator(pattern)
    java = t.run()
    return Compiled(java, t.upper)


def compile_patterns(patterns: list[str], fixed: bool = False, ignore_case: bool = False, smart_case: bool = False, word: bool = False) -> str:
    """The alternation of ``patterns`` under the search options, as one Java pattern."""
    if not patterns:
        raise BadPattern("no pattern")
    parts = [Compiled(quote(p), any(c.isupper() for c in p)) if fixed else translate(p) for p in patterns]
    fold = ignore_case or smart_case and not any(p.upper for p in parts)
    body = "|".join(f"(?:{p.java})" for p in parts) if len(parts) > 1 else parts[0].java
    if word:
        body = rf"(?<!\w)(?:{body})(?!\w)"
    return f"(?{FLAGS}{'i' if fold else ''}){body}"


def plain_literal(patterns: list[str], fixed: bool = False, ignore_case: bool = False, smart_case: bool = False, word: bool = False) -> str | None:
    """The one literal that a search is for, if a substring test can stand in for the pattern."""
    if len(patterns) != 1 or ignore_case or word or (smart_case and not any(c.isupper() for c in patterns[0])):
        return None
    p = patterns[0]
    return p if p and (fixed or re.fullmatch(r"[\w ,:;!@%&='\"<>/~`-]+", p)) and "\n" not in p else None


def needed_literal(patterns: list[str], fixed: bool = False, ignore_case: bool = False, smart_case: bool = False, word: bool = False) -> str | None:
    """The longest literal that every match holds, as far as it is plain to see; None if there is none.

    Only literals outside groups and classes count, and such as nothing makes optional.
    """
    if len(patterns) != 1 or ignore_case or smart_case and not any(c.isupper() for c in patterns[0]):
        return None
    p = patterns[0]
    if fixed:
        return p or None
    runs, run, i, depth = [], "", 0, 0
    while i < len(p):
        c, step = p[i], 1
        literal = None
        if c == "\\":
            step = 2
            if i + 1 < len(p) and not p[i + 1].isalnum() and p[i + 1] not in "<>":
                literal = p[i + 1]
            elif p[i + 1 : i + 2] in ("p", "P", "x", "u", "U"):  # the escape goes on
                return max(runs, key=len, default=None) if depth else None
        elif c == "|" and not depth:
            return None
        elif c == "(":
            if p.startswith("(?", i) and not p.startswith("(?:", i):
                return None  # flags change what follows
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "[":
            step = _class_end(p, i) - i
        elif c not in ".^$*+?{}|":
            literal = c
        behind = p[i + step : i + step + 1]
        if depth or literal is None or behind in ("*", "?", "{"):
            runs.append(run)
            run = ""
            if c == "{":  # a count
                step = max(1, p.find("}", i) + 1 - i)
        elif behind == "+":
            runs.append(run + literal)
            run = ""
        else:
            run += literal
        i += step
    return max([*runs, run], key=len) or None


def _class_end(p: str, i: int) -> int:
    """Where the class that opens at ``i`` ends."""
    depth = 0
    k = i
    while k < len(p):
        if p[k] == "\\":
            k += 1
        elif p[k] == "[":
            depth += 1
            if p[k + 1 : k + 2] == "^":
                k += 1
            if p[k + 1 : k + 2] == "]":
                k += 1
        elif p[k] == "]":
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return len(p)
