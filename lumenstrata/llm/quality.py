"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the raw
measurements and one failure bit per rule; policies are versioned masks over
those bits, so a policy change or an ablation re-reads the ledger and never
the text.

Defined results: a null or empty text has no words (all measurements 0, the
``few_words`` bit set); repeated rows and ids are judged row by row; extra
columns are kept, whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_text

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_CONTINUATION = bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()  # for bytes, white space is exactly space and \t to \r
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    covered = 0
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) < len(grams):
        end = 0
        for i, g in enumerate(grams):
            if counts[g] > 1:
                covered += i + 3 - max(end, i)
                end = i + 3
    return (
        len(words), len(joined.translate(None, _CONTINUATION)), len(text.translate(None, _NOT_SYMBOLS)),
        len(lines) - len(set(lines)), covered, len(lines), text.count(b"!"),
    )


@dataclass(frozen=True)
class Rule:
    """A named failure test over the measurements; ``bit`` never changes once published."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "long_words", "word_chars > 12 * n_words"),
    Rule(5, "short_words", "10 * word_chars < 20 * n_words"),
    Rule(6, "shouting", "2 * n_bangs > n_words"),
)
BASE_BITS = 0b11
#: Policy version -> mask of the rules that reject.
POLICIES = {1: BASE_BITS, 2: 0b1111111}
CURRENT_POLICY = 2


def evaluate_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the measurements and ``rule_bits`` (bit set: that rule fails) to every row.

    Names that ``df`` already has get a trailing underscore in the result.
    """
    names = fresh(df.columns, *MEASURES, "rule_bits")

    def make():
        return lambda texts, _: list(map(list, zip(*map(measure, texts)))) if texts else [[] for _ in MEASURES]

    out = map_text(df, [(n, T.LongType()) for n in names[:-1]], text, make)
    return out.withColumn(names[-1], rule_bits(dict(zip(MEASURES, names)), rules))


def rule_bits(names: dict[str, str] | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits as one expression over the measurement columns."""
    import re

    total = F.lit(0).cast("long")
    for r in rules:
        test = re.sub(r"[a-z_]+", lambda m: f"`{(names or {}).get(m[0], m[0])}`", r.fails)
        total = total + F.when(F.expr(test), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def passes(bits: Column, version: int = CURRENT_POLICY) -> Column:
    """The verdict of one policy version."""
    return bits.bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablation(ledger: DataFrame, version: int = CURRENT_POLICY, bits: str = "rule_bits") -> DataFrame:
    """For every rule of a policy: documents that fail it, that fail only it, and that would pass without it.

    One pass: rows are counted by their masked bits (at most 2**rules groups,
    combined before the shuffle), the rest is bit arithmetic over those counts.
    """
    mask = POLICIES[version]
    groups = ledger.groupBy(F.col(bits).bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("m")) for r in RULES if mask >> r.bit & 1))
    each = groups.select("b", "n", F.explode(rules).alias("r"))
    hit = F.col("b").bitwiseAND(F.col("r.m")) != 0
    zero = F.lit(0).cast("long")
    return each.groupBy(F.lit(version).alias("policy"), F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("r.m"), F.col("n")).otherwise(zero)).alias("n_failed_alone"),
        F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not(F.col("r.m"))) == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )
