"""Shell globs as patterns, with exclusions and last-match-wins precedence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadGlob(ValueError):
    """The glob does not compile."""


def glob_to_regex(glob: str) -> str:
    """A whole-string pattern, the same for Python and Java; ``*`` and ``?`` cross slashes."""
    out, i, n, open_ = [], 0, len(glob), 0
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            stars = j - i
            before, after = i == 0 or glob[i - 1] == "/", j == n or glob[j] == "/"
            if stars == 2 and before and after:
                if j == n and i == 0:
                    out.append(".*")
                elif j == n:
                    out[-1:] = ["/.*"]
                elif i == 0:
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out[-1:] = ["(?:/|/.*/)"]
                    j += 1
            else:
                out.append(".*")
            i = j
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            negated = glob[j : j + 1] in ("!", "^")
            j += negated
            k = j + 1 if glob[j : j + 1] == "]" else j
            end = glob.find("]", k)
            if end < 0:
                raise BadGlob(f"unclosed class in {glob!r}")
            body = glob[j:end]
            for lo, hi in re.findall(r"(.)-(.)", body):
                if lo > hi:
                    raise BadGlob(f"invalid range in {glob!r}")
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\[\]\\^&~|])', r'\\\1', body)}]")
            i = end
        elif c == "{":
            open_ += 1
            out.append("(?:")
        elif c == "}":
            if not open_:
                raise BadGlob(f"unopened alternation in {glob!r}")
            open_ -= 1
            out.append(")")
        elif c == "," and open_:
            out.append("|")
        elif c == "\\":
            i += 1
            if i >= n:
                raise BadGlob(f"dangling escape in {glob!r}")
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_/" else c)
        i += 1
    if open_:
        raise BadGlob(f"unclosed alternation in {glob!r}")
    return "(?s)" + "".join(out)


def split_rule(rule: str) -> tuple[bool, str]:
    """(keeps, glob): a leading ``!`` excludes, ``\\!`` is a literal one."""
    if rule.startswith("!"):
        return False, rule[1:]
    return True, rule[1:] if rule.startswith("\\!") else rule


@dataclass
class Globs:
    """An ordered list of rules; the last rule that matches decides.

    Without a match a path is kept unless some rule keeps (a whitelist).  A
    rule without a slash also judges the last part of the path.
    """

    rules: list[str]
    keeps: list[bool] = field(init=False)
    patterns: list[str] = field(init=False)
    by_name: list[bool] = field(init=False)

    def __post_init__(self):
        split = [split_rule(r) for r in self.rules]
        globs = [g[2:] if g.startswith("./") else g for _, g in split]
        self.keeps = [k for k, _ in split]
        self.patterns = [glob_to_regex(g) for g in globs]
        self.by_name = ["/" not in g for g in globs]
        self._compiled = [re.compile(p) for p in self.patterns]

    @staticmethod
    def spellings(path: str) -> list[str]:
        """The path, and without what leads it: ``./``, ``/`` and ``../``."""
        while path.startswith("./"):
            path = path[2:].lstrip("/")
        bare = re.sub(r"^(?:/|\.\./|\./)+", "", path)
        return [path] if bare == path else [path, bare]

    def last(self, path: str) -> int:
        """The index of the last rule that matches, -1 if none does."""
        names = self.spellings(path)
        for k in range(len(self.rules) - 1, -1, -1):
            tried = names + ([names[0].rsplit("/", 1)[-1]] if self.by_name[k] else [])
            if any(self._compiled[k].fullmatch(x) for x in tried):
                return k
        return -1

    def match(self, path: str) -> bool:
        k = self.last(path)
        return self.keeps[k] if k >= 0 else not any(self.keeps)

    def column(self, path: Column) -> Column:
        """The same verdict as one expression."""
        if not self.rules:
            return F.lit(True)
        bare = F.regexp_replace(path, r"^(?:\./+)+", "")
        stripped = F.regexp_replace(bare, r"^(?:/|\.\./|\./)+", "")
        name = F.element_at(F.split(bare, "/"), -1)
        verdict = None
        for k in range(len(self.rules) - 1, -1, -1):
            whole = F.lit(f"^(?:{self.patterns[k]})$")
            test = F.rlike(bare, whole) | F.rlike(stripped, whole)
            if self.by_name[k]:
                test = test | F.rlike(name, whole)
            verdict = F.when(test, F.lit(self.keeps[k])) if verdict is None else verdict.when(test, F.lit(self.keeps[k]))
        return verdict.otherwise(F.lit(not any(self.keeps)))


def archive_globs_match(globs: Globs, relative: str) -> bool:
    """An archive's path below the named folder: rules with a slash judge it whole, others its last part."""
    name = relative.rsplit("/", 1)[-1]
    for k in range(len(globs.rules) - 1, -1, -1):
        if globs._compiled[k].fullmatch(name if globs.by_name[k] else relative):
            return globs.keeps[k]
    return not any(globs.keeps)
