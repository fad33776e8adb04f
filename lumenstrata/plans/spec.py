"""One run as data: what the command line says, checked."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.escapes import parse_size
from ..functions.globs import Globs
from ..operators.lines import Match

CHOICES = {"color": ("auto", "always", "never"), "escape": ("auto", "always", "never"), "inflate": ("auto", "stream", "whole")}


class Usage(ValueError):
    """The command line can't be run."""


@dataclass
class SearchSpec:
    patterns: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    fixed: bool = False
    invert: bool = False
    text: bool = False
    max_count: int | None = None
    crlf: bool = False
    line_numbers: bool = True
    after: int | None = None
    before: int | None = None
    context: int | None = None
    only_matching: bool = False
    spaced: bool = False
    count: bool = False
    files: bool = False
    quiet: bool = False
    json: bool = False
    color: str = "auto"
    escape: str = "auto"
    globs: list[str] = field(default_factory=list)
    archive_globs: list[str] = field(default_factory=list)
    list_members: bool = False
    separator: str = ":"
    sort: bool = True
    jobs: int | None = None
    turbo: bool = False
    nice: int | None = 10
    drop_cache: bool = True
    load_limit: float | None = None
    show: str | None = None
    warnings: list[str] = field(default_factory=list)
    #: Matches are shown in colour, so where they stand is asked for.
    painted: bool = False

    @property
    def mode(self) -> str:
        """quiet before files before count before json."""
        return "list" if self.list_members else "quiet" if self.quiet else "files" if self.files else "count" if self.count else "json" if self.json else "lines"

    @property
    def lines_before(self) -> int:
        return self.before if self.before is not None else self.context or 0

    @property
    def lines_after(self) -> int:
        return self.after if self.after is not None else self.context or 0

    @property
    def what(self) -> str:
        """What of the lines the reader has to find."""
        if self.max_count == 0:
            return "none"
        if self.mode in ("lines", "json"):
            return "whole" if self.lines_before or self.lines_after else "lines"
        return "count" if self.mode == "count" else "first"

    @property
    def spans(self) -> bool:
        return not self.invert and (self.mode == "json" or self.painted and self.mode == "lines" or self.only_matching)

    @property
    def match(self) -> Match:
        return Match(tuple(self.patterns), self.fixed, self.ignore_case, self.smart_case, self.word, self.invert, self.crlf)


_SWITCHES = {
    "-w": ("word", True), "-F": ("fixed", True), "-v": ("invert", True), "-a": ("text", True), "--crlf": ("crlf", True), "-n": ("line_numbers", True), "-N": ("line_numbers", False),
    "-o": ("only_matching", True), "--spaced": ("spaced", True), "-c": ("count", True), "-l": ("files", True), "-q": ("quiet", True), "--json": ("json", True), "-T": ("list_members", True),
    "--list-members": ("list_members", True), "--no-sort": ("sort", False), "--turbo": ("turbo", True), "--no-nice": ("nice", None), "--no-drop-cache": ("drop_cache", False),
    "--examples": ("show", "examples"), "-h": ("show", "help"), "--help": ("show", "help"), "-V": ("show", "version"), "--version": ("show", "version"),
}
_VALUES = {
    "-e": "pattern", "-m": "max_count", "-A": "after", "--after": "after", "--after-context": "after", "-B": "before", "--before": "before", "--before-context": "before", "-C": "context",
    "--context": "context", "--color": "color", "--escape": "escape", "-g": "globs", "--glob": "globs", "--archive-glob": "archive_globs", "--archive-sep": "separator", "-j": "jobs",
    "--jobs": "jobs", "--nice": "nice", "--inflate": "inflate", "--inflate-budget": "inflate_budget", "--load-limit": "load_limit",
}


def _number(flag: str, value: str, kind=int):
    try:
        n = kind(value)
    except ValueError:
        raise Usage(f"{flag}: {value!r} is no number") from None
    if n < 0 or n != n:
        raise Usage(f"{flag}: {value!r} is out of range")
    return n


def _split(args: list[str]):
    """Flags with their values, then positionals; ``--`` ends the flags, short switches may be joined."""
    i, rest = 0, False
    while i < len(args):
        a = args[i]
        i += 1
        if rest or a == "-" or not a.startswith("-"):
            yield None, a
        elif a == "--":
            rest = True
        elif a.startswith("--"):
            name, eq, value = a.partition("=")
            if name in _SWITCHES and not eq:
                yield name, None
            elif name in _VALUES:
                if not eq:
                    if i == len(args):
                        raise Usage(f"{name} needs a value")
                    value = args[i]
                    i += 1
                yield name, value
            else:
                raise Usage(f"unknown option {a}")
        else:
            k = 1
            while k < len(a):
                name = "-" + a[k]
                k += 1
                if name in _SWITCHES or name in ("-i", "-S"):
                    yield name, None
                elif name in _VALUES:
                    value = a[k:].removeprefix("=")
                    if k == len(a):
                        if i == len(args):
                            raise Usage(f"{name} needs a value")
                        value = args[i]
                        i += 1
                    yield name, value
                    break
                else:
                    raise Usage(f"unknown option {name}")


def parse(args: list[str]) -> SearchSpec:
    s, positional = SearchSpec(), []
    for name, value in _split(args):
        if name is None:
            positional.append(value)
        elif name in ("-i", "-S"):
            s.ignore_case, s.smart_case = name == "-i", name == "-S"
        elif name in _SWITCHES:
            setattr(s, *_SWITCHES[name])
        else:
            what = _VALUES[name]
            if what == "pattern":
                s.patterns.append(value)
            elif what in ("globs", "archive_globs"):
                getattr(s, what).append(value)
            elif what in ("max_count", "after", "before", "context", "jobs", "nice"):
                setattr(s, what, _number(name, value))
            elif what == "load_limit":
                s.load_limit = _number(name, value, float)
            elif what == "separator":
                if len(value) != 1:
                    raise Usage("--archive-sep takes one character")
                s.separator = value
            elif what == "inflate_budget":
                try:
                    parse_size(value)
                except ValueError as e:
                    raise Usage(f"{name}: {e}") from None
                s.warnings.append(f"{name} does nothing any more")
            else:
                if value not in CHOICES[what]:
                    raise Usage(f"{name} is one of {', '.join(CHOICES[what])}")
                if what == "inflate":
                    s.warnings.append(f"{name} does nothing any more")
                else:
                    setattr(s, what, value)
    if s.show:
        return s
    if s.list_members and (s.quiet or s.files or s.count or s.json):
        raise Usage("-T goes with none of -q, -l, -c and --json")
    if s.spaced and (s.quiet or s.files or s.count or s.json or s.list_members):
        raise Usage("--spaced goes with lines only")
    if not s.patterns and not s.list_members:
        if not positional:
            raise Usage("no pattern")
        s.patterns.append(positional.pop(0))
    s.paths = positional
    if not s.paths:
        raise Usage("no path")
    if not s.list_members:
        s.match.java  # noqa: B018  a bad pattern is found here
    Globs(s.globs)
    Globs(s.archive_globs)
    return s
