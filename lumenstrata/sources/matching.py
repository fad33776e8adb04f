"""What a search wants of the lines of an input, found while they are cut.

Lines without a match never leave the reader unless they may be context.  A
search that only asks whether or how often gets one row a member, and stops
matching where the answer is known; the rest of the input is then only drained,
as the verdict says whether it was readable to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.automaton import Many, Matcher, matcher_of

if TYPE_CHECKING:
    from .walk import Lines


@dataclass(frozen=True)
class Wanted:
    """``what``: lines that match; whole: all lines, told apart; count; first: whether there is one; none."""

    patterns: tuple[str, ...] = ()
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    invert: bool = False
    crlf: bool = False
    what: str = "lines"
    #: Where the matches stand in their lines, or how many there are, is asked for too.
    spans: bool = False
    limit: int | None = None
    #: One answer for all members of an input.
    together: bool = False

    @classmethod
    def read(cls, d: dict | None) -> Wanted | None:
        return cls(**{**d, "patterns": tuple(d["patterns"])}) if d else None

    def written(self) -> dict:
        return asdict(self)


@lru_cache(maxsize=16)
def matcher(patterns: tuple[str, ...], fixed: bool, ignore_case: bool, smart_case: bool, word: bool) -> Matcher | Many:
    return matcher_of(list(patterns), fixed, ignore_case, smart_case, word)


class Selection:
    """The search of one input."""

    def __init__(self, wanted: Wanted):
        self.w = wanted
        self.matcher = matcher(wanted.patterns, wanted.fixed, wanted.ignore_case, wanted.smart_case, wanted.word) if wanted.what != "none" else None
        self.done = wanted.what == "none"
        self.lines = self.matches = 0

    def member(self) -> None:
        """A further member begins."""
        self.lines = self.matches = 0
        self.done = self.done and (self.w.together or self.w.what == "none")

    def take(self, block: Lines) -> Lines | None:
        """The lines of a block that are wanted, with ``hits``, and ``spans`` of hits; None if none is."""
        w = self.w
        bodies = block.lines
        if w.crlf:
            bodies = pc.if_else(pc.ends_with(bodies, b"\r"), pc.binary_slice(bodies, 0, -1), bodies)
        hits = self.matcher.hits(bodies) != w.invert
        if w.what == "whole":
            spans = self._spans(bodies, np.flatnonzero(hits), len(block))
            return block.told(hits, spans)
        at = np.flatnonzero(hits)
        if w.what == "first":
            at = at[:1]
        elif w.limit is not None:
            at = at[: w.limit - self.lines]
        self.lines += len(at)
        self.done = self.done or w.what == "first" and len(at) > 0 or w.limit is not None and self.lines >= w.limit
        if not len(at):
            return None
        if w.what == "first":
            self.matches += 1
            return None
        spans = self._spans(bodies.take(pa.array(at)), np.arange(len(at)), len(at))
        if w.what == "count":
            self.matches += len(spans.values) // 2 if spans is not None else len(at)
            return None
        return block.taken(at).told(np.ones(len(at), bool), spans)

    def _spans(self, bodies: pa.Array, at: np.ndarray, n: int) -> pa.ListArray | None:
        """Spans of the lines at ``at``, nothing for the others."""
        if not self.w.spans or self.w.invert:
            return None
        found = self.matcher.spans(bodies.take(pa.array(at)))
        if len(at) == n:
            return found
        sizes = np.zeros(n + 1, np.int64)
        sizes[at + 1] = found.value_lengths().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), found.values)

    def counted(self, index: int) -> Iterator[tuple]:
        """What a member's lines come to, where they were only counted."""
        if self.w.what in ("count", "first") and self.lines:
            yield "hits", index, self.lines, self.matches
