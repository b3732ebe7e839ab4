"""Directory snapshots: a bounded, filtered walk on the driver, bodies read by the executors' tasks.

The walk lists names and sizes only. It follows no symlinks, skips special files, applies the
include, exclude, sensitive, default and .gitignore rules, and aborts when a budget is exceeded.
"""

from __future__ import annotations

import fnmatch
import os
import re
import stat
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.hashing import format_mtime, source_uri


class DiscoveryError(RuntimeError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Options:
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    allow_sensitive: bool = False
    max_file_bytes: int = formats.FILE_BYTES_DEFAULT
    max_files: int = formats.FILES_DEFAULT
    max_bytes: int = formats.SOURCE_BYTES_DEFAULT
    max_entries: int = formats.ENTRIES_MAX
    max_directories: int = formats.DIRECTORIES_MAX
    max_depth: int = formats.DEPTH_MAX
    max_entries_per_directory: int = formats.ENTRIES_PER_DIRECTORY

    def __post_init__(self):
        for value, most in ((self.max_file_bytes, formats.FILE_BYTES_MAX), (self.max_files, formats.FILES_MAX), (self.max_bytes, formats.SOURCE_BYTES_MAX)):
            if not 1 <= value <= most:
                raise ValueError("limit out of range")


class Ignore:
    """Patterns in .gitignore syntax, relative to a directory; the last one that matches decides."""

    def __init__(self, lines: list[str], base: str = ""):
        self.base, self.rules = base, []
        for line in lines:
            line = line.rstrip("\r\n")
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            body = line[negated:]
            only_dir = body.endswith("/")
            body = body.rstrip("/") if only_dir else body
            anchored = "/" in body
            body = body.lstrip("/")
            if body:
                self.rules.append((re.compile(self._regex(body, anchored), re.S), negated, only_dir))

    @staticmethod
    def _regex(glob: str, anchored: bool) -> str:
        out, i = ("" if anchored else "(?:.*/)?"), 0
        while i < len(glob):
            c = glob[i]
            if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("/**", i) and i + 3 == len(glob):
                out, i = out + "/.+", i + 3
            elif c == "*":
                while i + 1 < len(glob) and glob[i + 1] == "*":
                    i += 1
                out, i = out + (".*" if glob == "**" else "[^/]*"), i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and "]" in glob[i + 2 :]:
                end = glob.index("]", i + 2)
                inner = glob[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif c == "\\" and i + 1 < len(glob):
                out, i = out + re.escape(glob[i + 1]), i + 2
            else:
                out, i = out + re.escape(c), i + 1
        return out + r"\Z"

    def matched(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: whitelisted; None: no pattern."""
        if self.base:
            if not path.startswith(self.base + "/"):
                return None
            path = path[len(self.base) + 1 :]
        for rx, negated, only_dir in reversed(self.rules):
            if (is_dir or not only_dir) and rx.match(path):
                return not negated
        return None


def default_excluded(path: str, is_dir: bool) -> bool:
    name = path.rsplit("/", 1)[-1]
    return name.startswith(".") or (is_dir and name in formats.EXCLUDED_DIRECTORIES)


def sensitive(path: str) -> bool:
    parts = path.split("/")
    name = parts[-1]
    extension = name.rpartition(".")[2] if "." in name[1:] else None
    return any(p in formats.SENSITIVE_DIRECTORIES for p in parts) or name.startswith(".env.") or name in formats.SENSITIVE_NAMES or extension in formats.SENSITIVE_EXTENSIONS


def path_rules(path: Column) -> dict[str, Column]:
    """The rules above, and the chunk kind, as columns of a path of a file."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    kinds = F.create_map(*[F.lit(x) for kv in formats.EXTENSIONS.items() for x in kv])
    folders = F.slice(parts, 1, F.size(parts) - 1)
    among = lambda values: F.array(*[F.lit(v) for v in values])
    hidden = F.exists(parts, lambda p: p.startswith(".")) | F.arrays_overlap(folders, among(formats.EXCLUDED_DIRECTORIES))
    secret = F.arrays_overlap(parts, among(formats.SENSITIVE_DIRECTORIES)) | name.startswith(".env.") | name.isin(*formats.SENSITIVE_NAMES) | extension.isin(*formats.SENSITIVE_EXTENSIONS)
    return {"kind": kinds[extension], "default_excluded": hidden, "sensitive": secret}


@dataclass
class Walk:
    files: list[tuple] = field(default_factory=list)  # (key, size, mtime_ns)
    issues: list[tuple] = field(default_factory=list)  # (key, code, detail)
    total: int = 0


_FOLDER = os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW


def open_root(root: str) -> int:
    """A descriptor of the root folder, opened name by name from / on, none of which may be a link."""
    top = os.open("/", _FOLDER)
    try:
        return open_below(top, [p for p in os.path.abspath(root).split("/") if p], _FOLDER)
    except OSError as error:
        raise DiscoveryError("root_unreadable", root) from error
    finally:
        os.close(top)


def open_below(folder: int, parts: list, flags: int) -> int:
    """A descriptor of what parts name below an open folder, each opened relative to the one before and never
    through a link, so that a folder that is replaced by a link meanwhile leads nowhere else."""
    held = os.dup(folder)
    for k, name in enumerate(parts):
        try:
            following = os.open(name, flags if k == len(parts) - 1 else _FOLDER, dir_fd=held)
        finally:
            os.close(held)
        held = following
    return held


def may_match_below(pattern: str, folder: str) -> bool:
    """Whether a path below folder can match an include, name by name; ** stands for any names."""

    def fits(names: list[str], parts: list[str]) -> bool:
        if not parts or not names:
            return bool(names)
        return names[0] == "**" or (fnmatch.fnmatchcase(parts[0], names[0]) and fits(names[1:], parts[1:]))

    return fits([n for n in pattern.split("/") if n], folder.split("/"))


def walk(root: str, options: Options = Options()) -> Walk:
    """Names of a tree's documents, in byte order. Folders are opened relative to their parents' descriptors."""
    out, seen = Walk(), [0, 0]
    excludes, includes = Ignore(list(options.excludes)), Ignore(list(options.includes))

    def left_out(path: str, is_dir: bool, stack: list[Ignore]) -> bool:
        """The first rule that holds decides; then the innermost .gitignore with an opinion."""
        wanted = bool(includes.matched(path, is_dir)) or (is_dir and any(may_match_below(p, path) for p in options.includes))
        rules = (
            (excludes.matched(path, is_dir), True),
            (options.includes and not wanted, True),
            (sensitive(path) and not (wanted and options.allow_sensitive), True),
            (wanted, False),
            (default_excluded(path, is_dir), True),
        )
        opinions = (m for s in reversed(stack) if (m := s.matched(path, is_dir)) is not None)
        return next((verdict for holds, verdict in rules if holds), next(opinions, False))

    def ignore_file(folder: int, relative: str) -> list[Ignore]:
        try:
            fd = os.open(".gitignore", os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=folder)
        except OSError:
            return []
        with os.fdopen(fd, encoding="utf-8", errors="surrogateescape") as f:
            info = os.fstat(f.fileno())
            if not stat.S_ISREG(info.st_mode):
                return []
            if info.st_size > 1 << 20:
                raise DiscoveryError("ignore_file_too_large", relative)
            return [Ignore(f.readlines(), relative)]

    def visit(folder: int, relative: str, depth: int, stack: list[Ignore]) -> None:
        if depth > options.max_depth:
            raise DiscoveryError("depth_budget", relative)
        seen[1] += 1
        if seen[1] > options.max_directories:
            raise DiscoveryError("directory_budget", relative)
        before = os.fstat(folder)
        names = sorted(map(os.fsencode, os.listdir(folder)))
        if len(names) > options.max_entries_per_directory:
            raise DiscoveryError("directory_entries_budget", relative)
        seen[0] += len(names)
        if seen[0] > options.max_entries:
            raise DiscoveryError("entry_budget", relative)
        stack = [*stack, *ignore_file(folder, relative)]
        after = os.fstat(folder)
        if (before.st_dev, before.st_ino, before.st_mtime_ns) != (after.st_dev, after.st_ino, after.st_mtime_ns):
            raise DiscoveryError("directory_changed", relative)
        for raw in names:
            name = os.fsdecode(raw)
            path = f"{relative}/{name}" if relative else name
            try:
                info = os.stat(name, dir_fd=folder, follow_symlinks=False)
            except OSError:
                out.issues.append((os.fsencode(path), "unreadable", "the entry can't be read"))
                continue
            is_dir = stat.S_ISDIR(info.st_mode)
            if not (is_dir or stat.S_ISREG(info.st_mode)) or name == ".gitignore" or left_out(path, is_dir, stack):
                continue
            if is_dir:
                try:
                    inner = os.open(name, _FOLDER, dir_fd=folder)
                except OSError as error:  # no folder any more, or not to be read
                    raise DiscoveryError("directory_unreadable", path) from error
                try:
                    visit(inner, path, depth + 1, stack)
                finally:
                    os.close(inner)
            elif formats.chunk_kind(path):
                if info.st_size > options.max_file_bytes:
                    out.issues.append((os.fsencode(path), "oversize", f"{info.st_size} bytes"))
                    continue
                out.total += info.st_size
                if len(out.files) >= options.max_files or out.total > options.max_bytes:
                    raise DiscoveryError("source_budget", path)
                out.files.append((os.fsencode(path), info.st_size, info.st_mtime_ns))

    top = open_root(root)
    try:
        visit(top, "", 0, [])
    finally:
        os.close(top)
    out.files.sort()
    out.issues.sort()
    return out


def estimate(root: str, options: Options = Options()) -> dict:
    w = walk(root, options)
    return {"files": len(w.files), "bytes": w.total, "skipped": len(w.issues)}


FILES = "connector_key binary, source_uri string, title string, chunk_kind string, body binary, source_updated_at string"
FAILURES = "connector_key binary, code string, detail string"


def observe(spark: SparkSession, root: str, options: Options = Options(), estimated: dict | None = None) -> DataFrame:
    """A row for each file below root: a document, or with code and detail a failure. Bodies are read in tasks; a file
    that changed, vanished, is no UTF-8 or holds NUL is a failure. Every reading of the frame reads the files again, so
    documents and failures belong together only within one; Engine.ingest stages one.

    The root must be a path that all executors see. estimated is what estimate() gave: a tree that has grown
    beyond it since is refused."""
    from ..functions.hashing import display_title

    found = walk(root, options)
    if estimated is not None and (len(found.files) > estimated["files"] or found.total > estimated["bytes"]):
        raise DiscoveryError("estimate_exceeded", f"{len(found.files)} files of {found.total} bytes")
    listed = spark.createDataFrame(found.files, "connector_key binary, size long, mtime_ns long")

    def read(batches):
        for pdf in batches:
            out, top = [], open_root(root)
            for key, size, mtime in pdf.itertuples(index=False):
                key = bytes(key)
                body, code = _read(top, key, size, mtime)
                out.append((key, source_uri(key), display_title(key), formats.chunk_kind(os.fsdecode(key)), body, format_mtime(mtime), code))
            os.close(top)
            yield pd.DataFrame(out, columns=["connector_key", "source_uri", "title", "chunk_kind", "body", "source_updated_at", "code"])

    read_rows = listed.repartition(max(1, min(len(found.files), spark.sparkContext.defaultParallelism))).mapInPandas(read, FILES + ", code string")
    observed = read_rows.withColumn("detail", F.when(F.col("code").isNotNull(), F.concat(F.lit("the file is "), "code")))
    return observed.unionByName(spark.createDataFrame(found.issues, FAILURES), allowMissingColumns=True)


def split(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of one reading."""
    return observed.where("code IS NULL").drop("code", "detail"), observed.where("code IS NOT NULL").select("connector_key", "code", "detail")


def _read(top: int, key: bytes, size: int, mtime: int) -> tuple[bytes | None, str | None]:
    for _ in range(2):  # once more if it changes meanwhile
        try:
            fd = open_below(top, key.split(b"/"), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
            with os.fdopen(fd, "rb") as f:
                body = f.read()
                info = os.fstat(f.fileno())
        except OSError:
            return None, "unreadable"
        if (info.st_size, info.st_mtime_ns) == (len(body), mtime) and len(body) == size:
            break
        size, mtime = info.st_size, info.st_mtime_ns
    else:
        return None, "unstable"
    if b"\0" in body:
        return None, "nul_content"
    try:
        body.decode("utf-8")
    except UnicodeDecodeError:
        return None, "invalid_utf8"
    return body, None


def table_corpus(rows: DataFrame, source: str, key: str, body: str) -> DataFrame:
    """A text table as documents of a snapshot: the key is <source>/<key>.txt."""
    path = F.concat_ws("/", F.col(source), F.concat(F.col(key).cast("string"), F.lit(".txt")))
    return rows.select(
        path.cast("binary").alias("connector_key"), F.concat(F.lit("repo://"), path).alias("source_uri"), F.concat(F.col(key).cast("string"), F.lit(".txt")).alias("title"),
        F.lit("plain-text").alias("chunk_kind"), F.col(body).cast("binary").alias("body"), F.lit(None).cast("string").alias("source_updated_at"),
    )
