"""Paths to inputs, in order: files as they are, folders by their regular files, each file once.

A path with a scheme (``hdfs://``, ``s3a://``, ``file://``) is looked up in the file system that Spark has for it.
"""

from __future__ import annotations

import os
import re
import stat
import sys
import tempfile
import uuid
from dataclasses import dataclass, field

from ..functions.globs import Globs, archive_globs_match

STDIN = "-"


@dataclass
class Item:
    """One input: its place in the order, its absolute path, how it is shown and what else it is called."""

    index: int
    path: str
    display: str
    aliases: list[str] = field(default_factory=list)
    named: bool = True
    size: int | None = None

    @property
    def remote(self) -> bool:
        return has_scheme(self.path)

    def names(self) -> list[str]:
        """Its names as globs judge them: relative to the working folder where they are below it."""
        if self.remote:
            return [self.display, *self.aliases]
        short = [os.path.relpath(os.path.abspath(p)) for p in (self.display, *self.aliases)]
        return [p if s.startswith("..") else s for p, s in zip((self.display, *self.aliases), short)]


@dataclass
class Resolved:
    items: list[Item] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)


def has_scheme(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def _remote(spark, path: str) -> tuple[list[tuple[str, int]] | None, bool]:
    """(path, length) of the files at or below a path with a scheme, and whether it is a folder; None if there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None, False
    own = fs.getFileStatus(at)
    if own.isFile():
        return [(own.getPath().toString(), own.getLen())], False
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen()))
    return sorted(found), True


def _walk(top: str, errors: list[tuple[str, str]]) -> list[str]:
    """Regular files below a folder by path; links are followed, loops and broken links are errors."""
    out: list[str] = []

    def visit(folder: str, above: tuple):
        try:
            own = os.stat(folder)
            names = sorted(os.listdir(folder))
        except OSError as e:
            errors.append(("WALK_ERROR", f"{folder}: {e.strerror}"))
            return
        identity = (own.st_dev, own.st_ino)
        if identity in above:
            errors.append(("WALK_ERROR", f"{folder}: the link leads back to a folder above it"))
            return
        for name in names:
            path = os.path.join(folder, name)
            try:
                mode = os.stat(path).st_mode
            except OSError as e:
                errors.append(("WALK_ERROR", f"{path}: {e.strerror}"))
                continue
            if stat.S_ISDIR(mode):
                visit(path, (*above, identity))
            elif stat.S_ISREG(mode):
                out.append(path)

    visit(top, ())
    return sorted(out)


def resolve(paths: list[str], archive_globs: list[str] | None = None, spark=None) -> Resolved:
    """Inputs and errors of the named paths.  Archive globs judge what folders hold, never named files."""
    out, seen = Resolved(), {}
    globs = Globs(archive_globs) if archive_globs else None
    walked = kept = False

    def add(path: str, named: bool):
        try:
            st = os.stat(path)
            identity = (st.st_dev, st.st_ino)
        except OSError:
            st, identity = None, None
        if identity is not None and identity in seen:
            first = seen[identity]
            if path != first.display and path not in first.aliases:
                first.aliases.append(path)
            return
        item = Item(len(out.items), os.path.abspath(path), path, [], named, st.st_size if st and stat.S_ISREG(st.st_mode) else None)
        out.items.append(item)
        if identity is not None:
            seen[identity] = item

    for path in paths:
        if path == STDIN:
            if not any(i.path == STDIN for i in out.items):
                out.items.append(Item(len(out.items), STDIN, "<stdin>"))
        elif has_scheme(path):
            files, folder = _remote(spark, path)
            if files is None:
                out.errors.append(("PATH_MISSING", f"{path}: no such file or folder"))
            elif folder and not files:
                out.errors.append(("EMPTY_DIR", f"{path}: no files in it"))
            walked |= folder and bool(files)
            inside = re.sub(r"^[^:]+:/+", "", path).rstrip("/") + "/"
            for name, length in files or ():
                if folder and globs is not None and not archive_globs_match(globs, name.partition(inside)[2]):
                    continue
                kept |= folder
                if name not in seen:
                    seen[name] = item = Item(len(out.items), name, name if folder else path, [], not folder, length)
                    out.items.append(item)
        elif not os.path.exists(path):
            out.errors.append(("PATH_MISSING", f"{path}: no such file or folder"))
        elif os.path.isdir(path):
            before = len(out.errors)
            files = _walk(path, out.errors)
            if not files and len(out.errors) == before:
                out.errors.append(("EMPTY_DIR", f"{path}: no files in it"))
            walked |= bool(files)
            for f in files:
                if globs is None or archive_globs_match(globs, os.path.relpath(f, path)):
                    kept = True
                    add(f, False)
        else:
            add(path, True)
    if globs is not None and walked and not kept:
        out.errors.append(("ARCHIVE_GLOB_EMPTY", "the archive globs leave no file of any folder"))
    return out


def spool_stdin(folder: str | None = None) -> str:
    """Standard input as a file below ``folder``, which all tasks see; the caller removes it."""
    data = iter(lambda: sys.stdin.buffer.read(1 << 20), b"")
    if folder and has_scheme(folder) and not folder.startswith("file:"):
        from .ranged import created

        path = f"{folder}/stdin-{uuid.uuid4().hex}"
        with created(path) as f:
            for chunk in data:
                f.write(chunk)
        return path
    if folder:
        folder = re.sub("^file:/+", "/", folder)
        os.makedirs(folder, exist_ok=True)
    fd, path = tempfile.mkstemp(prefix="stdin-", dir=folder)
    with os.fdopen(fd, "wb") as f:
        for chunk in data:
            f.write(chunk)
    return path
