"""Names, lines and sizes as they are shown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a terminal must not get raw, in valid text.
UNSAFE = "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\u202A-\\u202E\\u2066-\\u2069"
_UNSAFE = re.compile(f"[{UNSAFE}]|\r(?!\n)")
MAX_NAME = 1024


def one_line(name: Column) -> Column:
    """A member's or archive's name without line breaks."""
    return F.replace(F.replace(name, F.lit("\n"), F.lit("\\x0a")), F.lit("\r"), F.lit("\\x0d"))


def _shown(char: str) -> str:
    """One unsafe character: a byte in hexadecimal, what needs more by its code point."""
    return f"\\x{ord(char):02x}" if ord(char) < 0x80 else f"\\u{{{ord(char):x}}}"


def escape_text(text: str) -> str:
    """Control characters of valid text by number; tabs, line feeds and CR LF stay."""
    return _UNSAFE.sub(lambda m: _shown(m[0]), text)


def escape_bytes(data: bytes) -> bytes:
    """The same for bytes: invalid UTF-8 passes, but for stray control bytes 0x80 to 0x9F."""
    text = escape_text(data.decode("utf-8", "surrogateescape"))
    text = re.sub("[\udc80-\udc9f]", lambda m: f"\\x{ord(m[0]) - 0xDC00:02x}", text)
    return text.encode("utf-8", "surrogateescape")


def escape_json(text: str) -> str:
    """JSON output on a terminal: DEL, C1 and direction controls as JSON escapes."""
    return re.sub("[\x7f-\x9f‪-‮⁦-⁩]", lambda m: f"\\u{ord(m[0]):04x}", text)


@F.pandas_udf(T.BinaryType())
def escape_lines(lines: pd.Series) -> pd.Series:
    """Whole lines for a terminal; Arrow batches, as no built-in function works on invalid UTF-8."""
    return lines.map(lambda x: None if x is None else escape_bytes(bytes(x)))


def escape_column(text: Column) -> Column:
    """Valid text for a terminal with built-in functions: each unsafe character between its neighbours by its number."""
    pieces = F.split(text, f"(?<=[{UNSAFE}])|(?=[{UNSAFE}])|(?<=\\r)(?!\\n)|(?=\\r(?!\\n))", -1)
    shown = F.transform(
        pieces,
        lambda p: F.when(F.rlike(p, F.lit("^[\\x00-\\x08\\x0B-\\x1F\\x7F]$")), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(p))), 2, "0")))
        .when(F.rlike(p, F.lit(f"^[{UNSAFE}]$")), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(p))), F.lit("}"))).otherwise(p),
    )
    return F.array_join(shown, "")


def truncate_name(name: str, limit: int = MAX_NAME) -> str:
    """At most ``limit`` bytes, cut between characters, with an ellipsis where cut."""
    data = name.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return name
    return data[:limit].decode("utf-8", "ignore") + "…"


def truncate_column(name: Column, limit: int = MAX_NAME) -> Column:
    """The same as an expression: the longest prefix of characters within ``limit`` bytes."""
    cut = F.encode(name, "UTF-8")
    prefix = F.expr("array(0, 1, 2, 3)")
    # drop the bytes of a character that the cut went through: at most three
    tries = F.transform(prefix, lambda k: F.substring(cut, F.lit(1), F.lit(limit) - k))
    whole = F.element_at(F.filter(tries, lambda b: F.is_valid_utf8(b)), 1)
    return F.when(F.octet_length(name) <= limit, name).otherwise(F.concat(F.decode(whole, "UTF-8"), F.lit("…")))


def parse_size(text: str) -> int:
    """A byte count with an optional K, M or G."""
    m = re.fullmatch(r"(\d+)([KMGkmg]?)", text.strip())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]
