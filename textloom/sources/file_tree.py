"""Trees of whole files as a Spark data source: ``spark.read.format("filetree").load(root)``.

Columns: ``path, size, modified`` and, unless the option ``content`` is ``false``, ``content`` (UTF-8, bad
bytes replaced) and ``error`` (why a file could not be read; its content is then null). Every file
below the root is a row, hidden and empty ones included.

The plan divides the tree into folders, so that tasks list and read them; the driver lists folders
only until there are enough, and never holds names of files. Filters on ``path`` (ends with, starts
with, equals, and their negations) and the options ``extensions``, ``scope``, ``ignore`` and
``ignoreDirs`` (JSON lists) keep folders from being walked and files from being opened. As a stream,
``spark.readStream.format("filetree")`` gives files by the time of their last change: those changed
since the batch before, up to ``settleMs`` before now.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, Not, StringEndsWith, StringStartsWith,
)

HELD_CHARS = 8 << 20  # contents that a task holds before it hands them on
FILES_EACH = 1_000  # files of one folder that a task reads, where the plan has counted them
FOLDERS_EACH = 4  # folders planned for each wanted partition
FORMAT = "filetree"
PLAIN = "path string, size bigint, modified timestamp"
WHOLE = PLAIN + ", content string, error string"
FIELDS = pa.schema(
    [("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.string()), ("error", pa.string())]
)


def file_system(uri: str, cache: dict):
    """pyarrow file system and path in it for a Hadoop-style URI (one client per file system and task)."""
    from pyarrow import fs as pafs

    if uri.startswith("file:") or ":" not in uri:
        fs = cache.setdefault("file", pafs.LocalFileSystem())
        return fs, "/" + uri.removeprefix("file:").lstrip("/")
    u = uri.replace("s3a://", "s3://", 1)
    scheme, rest = u.split("://", 1)
    authority, _, path = rest.partition("/")
    key = f"{scheme}://{authority}"
    if key not in cache:
        cache[key] = pafs.FileSystem.from_uri(key + "/")[0]
    return cache[key], (f"{authority}/{path}" if scheme in ("s3", "gs", "gcs") else "/" + path)


def shown(uri: str) -> str:
    """The path of a URI as rows show it: local files without their scheme."""
    return re.sub(r"^file:(//)?", "", uri)


@dataclass
class Wanted:
    """What of a tree is wanted; all conditions hold together, a list is met by any of its entries."""

    ends: list[tuple[str, ...]] = field(default_factory=list)
    begins: list[tuple[str, ...]] = field(default_factory=list)
    not_ends: list[str] = field(default_factory=list)
    not_begins: list[str] = field(default_factory=list)
    equal: list[str] = field(default_factory=list)
    not_equal: list[str] = field(default_factory=list)
    skip_dirs: frozenset = frozenset()
    since: int | None = None  # microseconds, exclusive
    upto: int | None = None

    def file(self, path: str, changed: int) -> bool:
        return (
            all(path.endswith(e) for e in self.ends) and all(path.startswith(b) for b in self.begins)
            and not path.endswith(tuple(self.not_ends)) and not path.startswith(tuple(self.not_begins))
            and all(path == e for e in self.equal) and path not in self.not_equal
            and (self.since is None or changed > self.since) and (self.upto is None or changed <= self.upto)
        )

    def folder(self, path: str, name: str) -> bool:
        """Whether a folder can hold a wanted file."""
        below = path + "/"
        meets = lambda b: below.startswith(b) or b.startswith(below)
        return (
            name not in self.skip_dirs and not below.startswith(tuple(self.not_begins))
            and all(any(map(meets, b)) for b in self.begins) and all(e.startswith(below) for e in self.equal)
        )

    def push(self, f: Filter) -> bool:
        """Take a filter over if it is exactly one of those above."""
        inner = f.child if isinstance(f, Not) else f
        lists = {
            (StringEndsWith, False): self.ends, (StringStartsWith, False): self.begins, (EqualTo, False): self.equal,
            (StringEndsWith, True): self.not_ends, (StringStartsWith, True): self.not_begins, (EqualTo, True): self.not_equal,
        }
        target = lists.get((type(inner), isinstance(f, Not)))
        if target is None or inner.attribute != ("path",) or not isinstance(inner.value, str):
            return False
        target.append((inner.value,) if target is self.ends or target is self.begins else inner.value)
        return True


@dataclass
class Piece(InputPartition):
    """A folder with all below it, or only its own files; of these the share ``k`` of ``m`` by a hash of the path."""

    uri: str
    below: bool
    k: int
    m: int
    wanted: Wanted


class _Tree:
    def __init__(self, options: dict):
        names = lambda key: json.loads(options.get(key) or "[]")
        root = (options.get("path") or "").rstrip("/") or "/"
        self.root = root if ":" in root else f"file:{root}"
        self.whole = (options.get("content") or "true").lower() != "false"
        self.partitions = int(options.get("partitions") or 64)
        self.settle = int(options.get("settleMs") or 0)
        self.wanted = Wanted(not_begins=names("ignore"), skip_dirs=frozenset(names("ignoreDirs")))
        if options.get("extensions"):
            self.wanted.ends.append(tuple(names("extensions")))
        if options.get("scope"):
            self.wanted.begins.append(tuple(names("scope")))

    def plan(self, wanted: Wanted) -> list[Piece]:
        """Folders level by level until there are FOLDERS_EACH for each partition; of folders listed on the way
        only the numbers of files are kept."""
        from pyarrow.fs import FileSelector, FileType

        cache: dict = {}
        pieces, level = [], [self.root]
        while level and len(level) < FOLDERS_EACH * self.partitions:
            inside = []
            for uri in level:
                fs, path = file_system(uri, cache)
                files = 0
                for info in fs.get_file_info(FileSelector(path, allow_not_found=True)):
                    child = f"{uri.rstrip('/')}/{info.base_name}"
                    if info.type != FileType.Directory:
                        files += 1
                    elif wanted.folder(shown(child), info.base_name):
                        inside.append(child)
                m = -(-files // FILES_EACH)
                pieces += [Piece(uri, False, k, m, wanted) for k in range(m)]
            level = inside
        m = FOLDERS_EACH if len(level) < 2 * FOLDERS_EACH * self.partitions else 1  # one deep folder may hold most files
        return pieces + [Piece(uri, True, k, m, wanted) for uri in level for k in range(m)]

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        cache: dict = {}
        fields = FIELDS if self.whole else pa.schema(list(FIELDS)[:3])
        rows, held, level = [], 0, [piece.uri]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
        while level:
            uri = level.pop()
            fs, folder = file_system(uri, cache)
            for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
                child = f"{uri.rstrip('/')}/{info.base_name}"
                path = shown(child)
                if info.type == FileType.Directory:
                    if piece.below and piece.wanted.folder(path, info.base_name):
                        level.append(child)
                    continue
                changed = (info.mtime_ns or 0) // 1000
                if zlib.crc32(path.encode()) % piece.m != piece.k or not piece.wanted.file(path, changed):
                    continue
                content, error = _content(fs, info) if self.whole else (None, None)
                size = int(info.size) if info.type == FileType.File else None
                rows.append((path, size, changed, content, error)[: len(fields)])
                held += len(content or "") + 200
                if held >= HELD_CHARS:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()


def _content(fs, info) -> tuple[str | None, str | None]:
    try:
        with fs.open_input_stream(info.path) as h:
            return h.read().decode("utf-8", errors="replace"), None
    except (OSError, pa.ArrowException) as e:
        return None, f"{type(e).__name__}: {e}"


class FileTreeReader(DataSourceReader):
    def __init__(self, tree: _Tree):
        self.tree, self.wanted = tree, tree.wanted

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return iter([f for f in filters if not self.wanted.push(f)])

    def partitions(self) -> list[Piece]:
        return self.tree.plan(self.wanted) or [Piece(self.tree.root, False, 0, 1, self.wanted)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(partition)


class FileTreeStream(DataSourceStreamReader):
    """Files by the time of their last change; an offset is a time, so that nothing is listed for it. A file that
    comes late with an old time is not seen."""

    def __init__(self, tree: _Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        return {"upto": time.time_ns() // 1000 - 1000 * self.tree.settle}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        w = self.tree.wanted
        changed = Wanted(**(vars(w) | {"since": start["upto"], "upto": end["upto"]}))
        return self.tree.plan(changed)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(partition)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return WHOLE if _Tree(self.options).whole else PLAIN

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(_Tree(self.options))

    def streamReader(self, schema) -> FileTreeStream:
        return FileTreeStream(_Tree(self.options))


def use_file_trees(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)


def file_tree(spark: SparkSession, root: str, stream: bool = False, **options) -> DataFrame:
    """The tree below ``root`` with options given as Python values."""
    use_file_trees(spark)
    reader = (spark.readStream if stream else spark.read).format(FORMAT)
    given = {k: v for k, v in options.items() if v is not None}
    for key, value in ({"partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)} | given).items():
        reader = reader.option(key, json.dumps(list(value)) if isinstance(value, (list, tuple, set, frozenset)) else str(value))
    return reader.load(root)
