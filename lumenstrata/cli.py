"""Command line: ``python -m lumenstrata.cli PATTERN PATH...``; exit codes 0 (found), 1 (not found), 2 (something was not read)."""

from __future__ import annotations

import os
import sys

from pyspark.errors import PySparkException

from .functions.escapes import escape_text
from .functions.globs import BadGlob
from .functions.regex_dialect import BadPattern
from .plans.search import search
from .plans.spec import Usage, parse
from .render import one_line_message, output
from .sources.resolve import STDIN

VERSION = "1.0"
HELP = """usage: lumenstrata [options] PATTERN PATH...
       lumenstrata [options] -e PATTERN [-e PATTERN] PATH...
       lumenstrata -T [options] PATH...

Searches the lines of files, compressed files and the members of tar and zip
archives; formats are told by content.

matching   -e PATTERN  -i  -S  -w  -F  -v  -a  --crlf  -m N
output     -n  -N  -A N  -B N  -C N  -o  --spaced  -c  -l  -q  --json
           --color WHEN  --escape WHEN  --archive-sep CHAR  --no-sort
selection  -g GLOB  --archive-glob GLOB  -T
running    -j N  --turbo  --nice N  --no-nice  --no-drop-cache  --load-limit N
           --inflate MODE  --inflate-budget SIZE (accepted, without effect)
other      --examples  -h  -V

exit code  0 a match and all was read; 1 no match and all was read; 2 something
           was not read
"""
EXAMPLES = """Lines with NEEDLE in all archives of a folder:
  lumenstrata NEEDLE logs/
Error lines with two lines before and one after, in error logs only:
  lumenstrata -B 2 -A 1 -g '*error*' ' 5[0-9][0-9] ' logs/
How often each member has it:
  lumenstrata -c NEEDLE logs/web.tgz
The members of an archive:
  lumenstrata -T logs/web.tgz
A window of time, as a pattern:
  lumenstrata '^2026-08-24T(0[89]|1[0-5]):' logs/
Anything but debug lines, the first three of each member:
  lumenstrata -v -m 3 DEBUG logs/app.zip
"""


def say(text: str) -> None:
    try:
        print(f"lumenstrata: {escape_text(one_line_message(text))}", file=sys.stderr)
    except OSError:
        pass  # a closed error stream changes no verdict


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        spec = parse(list(sys.argv[1:] if argv is None else argv))
    except (Usage, BadPattern, BadGlob) as e:
        say(str(e))
        return 2
    if sys.stdout is None:
        say("STDOUT_CLOSED: standard output is closed")
        return 2
    if sys.stdin is None and STDIN in spec.paths:
        say("STDIN_CLOSED: standard input is closed")
        return 2
    out, run = sys.stdout.buffer, None
    try:
        if spec.show:
            out.write({"help": HELP, "examples": EXAMPLES, "version": f"lumenstrata {VERSION}\n"}[spec.show].encode())
            out.flush()
            return 0
        for w in spec.warnings:
            say(w)
        spark = spark or _session(spec)
        terminal = out.isatty() if hasattr(out, "isatty") else False
        escape = spec.escape == "always" or spec.escape == "auto" and terminal
        spec.painted = color = spec.color == "always" or spec.color == "auto" and terminal
        run = search(spark, spec)
        lost = False
        chunks = output(run, escape, raw_names=spec.escape == "never", color=color)
        try:
            for chunk in chunks:
                out.write(chunk)
                if not chunk:
                    out.flush()
            out.flush()
        except BrokenPipeError:
            run.segments.cancel()  # nobody reads on: the inputs need not be read either
            os.dup2(os.open(os.devnull, os.O_WRONLY), 1)
            for _, message in run.resolved.errors:
                say(message)
            return 2 if run.resolved.errors or run.told_errors else 0  # what was written counts
        except OSError as e:
            say(f"WRITE_FAILED: the output could not be written: {e.strerror}")
            lost = True
        verdict = run.verdict()
        for _, message in verdict["errors"]:
            say(message)
        for r in run.diagnostics().orderBy("item_index", "member_index").toLocalIterator():
            say(f"{r['archive']}: {r['message']}")
        return 2 if lost else verdict["exit_code"]
    except PySparkException as e:  # a task was lost for good: what was told stands, and not all was read
        say(f"WORKER_DIED: an input was not walked to its end: {str(e).splitlines()[0]}")
        return 2
    except OSError as e:
        say(str(e))
        return 2
    finally:
        if run is not None:
            run.close()


def _session(spec):
    from pyspark.sql import SparkSession

    cores = "*" if spec.turbo and spec.jobs is None else max(1, spec.jobs or 1)
    return SparkSession.builder.master(f"local[{cores}]").appName("lumenstrata").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()


if __name__ == "__main__":
    sys.exit(main())
