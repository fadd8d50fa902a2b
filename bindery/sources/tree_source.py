"""Directory trees as a data source: ``spark.read.format("bindery_tree")``.

The reader plans its own partitions. It opens directories from the roots downwards until
there are enough to share out, at most ``PLAN_ENTRIES`` entries, and each partition walks its
share in its task; a directory with more entries than that is left to a task whole. Nothing of
the tree but that frontier passes through the driver.

Filters are pushed into the walk. Those on ``workspace``, ``folder`` and ``path`` keep whole
directories from being listed, those on ``size_bytes`` keep files from being opened. Ignore rules come
the same way, as a filter on the column ``rules``: ``rules = '<text of rules_text>'``. Directories
they ignore are never entered, and a file above its workspace's size limit is listed with no
content. Spark tests every pushed filter once more on the rows, so a filter can only save work.

Options: ``starts``, a JSON list of ``[workspace, root, path]``, or a path to load as the only
root; ``content``, "true" to read what the files hold; ``partitions``, how many to plan. Roots
are local paths, ``file:`` URIs, or URIs of any store pyarrow has a file system for, and
every executor must be able to read them. Links and special files are left out of local trees.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from bindery.sources.folders import folders

SOURCE = "bindery_tree"
SCHEMA = "workspace string, root string, folder string, path string, size_bytes bigint, content binary, rules string"
PUSHDOWN_CONF = "spark.sql.python.filterPushdown.enabled"
PLAN_ENTRIES = 20_000
FOLDERS_PER_PARTITION = 8
BATCH_ROWS = 10_000
BATCH_BYTES = 4 << 20


def _python_regex(pattern: str) -> re.Pattern:
    """A pattern written for Java: the end of the text is \\z there, and code points have braces."""

    def translate(m: re.Match) -> str:
        return m.group(1) or (re.escape(chr(int(m.group(2), 16))) if m.group(2) else r"\Z")

    return re.compile(re.sub(r"(\\\\)|\\x\{([0-9A-Fa-f]+)\}|\\z", translate, pattern))


class WalkRules:
    """Rules of each workspace as the walk needs them; ``rules_text`` writes them.

    Rules Python has no pattern for are left to the test that Spark makes of every file.
    """

    def __init__(self, text: str | None):
        spec = json.loads(text) if text else {"sets": [], "of": {}}
        self.of = spec["of"]
        self.sets = [self._read(s) for s in spec["sets"]]

    @staticmethod
    def _read(spec: dict) -> tuple:
        try:
            segment = spec.get("ignore_regex")
            segment = segment and _python_regex(segment)
        except re.error:
            segment = None
        try:
            rules = [(r["negated"], r["dir_only"], _python_regex(r["pattern"])) for r in spec.get("rules") or []]
        except re.error:
            rules = []
        return segment, rules, spec.get("max_file_size_kb") or 0

    def _set(self, workspace: str) -> tuple | None:
        at = self.of.get(workspace)
        return None if at is None else self.sets[at]

    def ignores(self, workspace: str, folder: str) -> bool:
        """Whether a directory whose parents are entered is not.

        The walk asks of a directory what it asks of a file, so rules for directories alone
        do not bring one back; a directory they exclude has only excluded files.
        """
        own = self._set(workspace)
        if own is None or not folder:
            return False
        segment, rules, _ = own
        folder = folder.replace("\\", "/")
        if segment is not None and segment.search(folder):
            return True
        by_any = as_file = False
        for negated, dir_only, pattern in rules:
            if pattern.search(folder):
                by_any = not negated
                as_file = as_file if dir_only else not negated
        return by_any or as_file

    def reads(self, workspace: str, size: int) -> bool:
        own = self._set(workspace)
        return own is None or own[2] <= 0 or size <= own[2] * 1024


def rules_text(rules: DataFrame) -> str:
    """Rules of workspaces (``workspace, rules`` of ``compiled_rules``) as the text to filter by.

    Equal rules of many workspaces are named once. This brings all of them to the driver,
    so it is for a table of measured size.
    """
    kept = F.struct("rules.ignore_regex", "rules.max_file_size_kb", F.col("rules.rules").alias("rules"))
    by_set: dict[str, int] = {}
    of = {r["workspace"]: by_set.setdefault(r["own"], len(by_set)) for r in rules.select("workspace", F.to_json(kept).alias("own")).collect()}
    return json.dumps({"sets": [json.loads(s) for s in by_set], "of": of}, sort_keys=True)


def _says(f: ds.Filter, value) -> bool:
    """Whether a value passes a pushed filter; filters of other kinds pass everything."""
    if isinstance(f, ds.Not):
        return not _says(f.child, value) if _known(f.child) else True
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return value == f.value
    if isinstance(f, ds.In):
        return value in f.value
    if isinstance(f, ds.LessThan):
        return value < f.value
    if isinstance(f, ds.LessThanOrEqual):
        return value <= f.value
    if isinstance(f, ds.GreaterThan):
        return value > f.value
    if isinstance(f, ds.GreaterThanOrEqual):
        return value >= f.value
    if isinstance(f, ds.StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, ds.StringEndsWith):
        return value.endswith(f.value)
    if isinstance(f, ds.StringContains):
        return f.value in value
    return True


_KNOWN = (
    ds.EqualTo, ds.EqualNullSafe, ds.In, ds.LessThan, ds.LessThanOrEqual, ds.GreaterThan, ds.GreaterThanOrEqual,
    ds.StringStartsWith, ds.StringEndsWith, ds.StringContains,
)


def _known(f: ds.Filter) -> bool:
    return _known(f.child) if isinstance(f, ds.Not) else isinstance(f, _KNOWN)


def _column(f: ds.Filter) -> str | None:
    while isinstance(f, ds.Not):
        f = f.child
    found = getattr(f, "attribute", None)
    return found[0] if found and len(found) == 1 else None


def _closes(f: ds.Filter, column: str, folder: str) -> bool:
    """Whether no file below a directory can pass a filter on ``folder`` or ``path``.

    ``folder`` is the directory as its files name it, "/a/b/"; every ``folder`` below starts with it,
    and every ``path`` with it less the first slash.
    """
    start = folder if column == "folder" else folder[1:]
    if isinstance(f, ds.Not):
        inner = f.child
        if isinstance(inner, ds.StringStartsWith):
            return start.startswith(inner.value)
        return isinstance(inner, ds.StringContains) and inner.value in start
    if isinstance(f, ds.StringStartsWith):
        return not (start.startswith(f.value) or f.value.startswith(start))
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return not str(f.value).startswith(start)
    return isinstance(f, ds.In) and not any(str(v).startswith(start) for v in f.value)


@dataclass
class Share(ds.InputPartition):
    """What one task walks: directories, its part of very large ones, and files that planning met on its way."""

    value: int
    dirs: list[tuple[str, str, str]]
    files: list[tuple[str, str, str, int]]
    parts: list[tuple[str, str, str]]
    of: int


class TreeReader(ds.DataSourceReader):
    def __init__(self, starts: list, content: bool, wanted: int):
        self.starts, self.content, self.wanted = starts, content, max(1, wanted)
        self.pushed: list[tuple[str, ds.Filter]] = []
        self.rules: str | None = None

    def pushFilters(self, filters):
        for f in filters:
            column = _column(f)
            if column == "rules" and isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
                self.rules = f.value
            elif column in ("workspace", "folder", "path", "size_bytes") and _known(f):
                self.pushed.append((column, f))
            yield f

    def _enters(self, rules: WalkRules, workspace: str, folder: str) -> bool:
        if rules.ignores(workspace, folder):
            return False
        named = f"/{folder}/" if folder else "/"
        return not any(column in ("folder", "path") and _closes(f, column, named) for column, f in self.pushed)

    def _passes(self, workspace: str, path: str, size: int) -> bool:
        folder = path.rpartition("/")[0]
        values = {"workspace": workspace, "folder": f"/{folder}/" if folder else "/", "path": path, "size_bytes": size}
        return all(_says(f, values[column]) for column, f in self.pushed)

    def _children(self, rules: WalkRules, workspace: str, root: str, folder: str) -> Iterator[tuple[str, bool, int]]:
        for name, is_dir, size in folders(root).entries(folder):
            path = f"{folder}/{name}" if folder else name
            if self._enters(rules, workspace, path) if is_dir else self._passes(workspace, path, size):
                yield path, is_dir, size

    def partitions(self):
        """Opens directories breadth first until there are enough to share out."""
        rules, dirs, files, seen = WalkRules(self.rules), deque(), [], 0
        for workspace, root, path in self.starts:
            if not all(_says(f, workspace) for column, f in self.pushed if column == "workspace"):
                continue
            kind = folders(root).kind(path)
            if kind and kind[0] and self._enters(rules, workspace, path):
                dirs.append((workspace, root, path))
            elif kind and not kind[0] and self._passes(workspace, path, kind[1]):
                files.append((workspace, root, path, kind[1]))
        shut = []
        while dirs and len(dirs) + len(shut) < self.wanted * FOLDERS_PER_PARTITION and seen < PLAN_ENTRIES:
            workspace, root, folder = dirs.popleft()
            found, whole = [], True
            for child in self._children(rules, workspace, root, folder):
                found.append(child)
                if seen + len(found) > PLAN_ENTRIES:
                    whole = False
                    break
            seen += len(found)
            if whole:
                dirs.extend((workspace, root, path) for path, is_dir, _ in found if is_dir)
                files.extend((workspace, root, path, size) for path, is_dir, size in found if not is_dir)
            else:
                shut.append((workspace, root, folder))
        shares = [Share(n, [], [], shut, self.wanted) for n in range(self.wanted)]
        # Neighbours are often of like size; a hash of the name parts them.
        deal = lambda item: zlib.crc32(json.dumps(item).encode()) % self.wanted
        for item in dirs:
            shares[deal(item)].dirs.append(item)
        for item in files:
            shares[deal(item[:3])].files.append(item)
        return [s for s in shares if s.dirs or s.files or s.parts] or shares[:1]

    def _walk(self, rules: WalkRules, share: Share) -> Iterator[tuple[str, str, str, int]]:
        yield from share.files
        waiting_in = {(workspace, root): [] for workspace, root, _ in (*share.dirs, *share.parts)}
        for workspace, root, start in share.dirs:
            waiting_in[workspace, root].append(start)
        for workspace, root, start in share.parts:
            for path, is_dir, size in self._children(rules, workspace, root, start):
                if zlib.crc32(path.encode("utf-8", "surrogateescape")) % share.of != share.value:
                    continue
                if is_dir:
                    waiting_in[workspace, root].append(path)
                else:
                    yield workspace, root, path, size
        for (workspace, root), waiting in waiting_in.items():
            while waiting:
                folder = waiting.pop()
                for path, is_dir, size in self._children(rules, workspace, root, folder):
                    if is_dir:
                        waiting.append(path)
                    else:
                        yield workspace, root, path, size

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rules, rows, held = WalkRules(self.rules), [], 0
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        names = ["workspace", "root", "folder", "path", "size_bytes", "content", "rules"]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for workspace, root, path, size in self._walk(rules, partition):
            folder = path.rpartition("/")[0]
            content = folders(root).read(path) if self.content and rules.reads(workspace, size) else None
            rows.append((workspace, root, f"/{folder}/" if folder else "/", path, size, content, self.rules))
            held += len(content or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class TreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        given = self.options.get("starts")
        starts = json.loads(given) if given else [["", self.options["path"], ""]]
        return TreeReader([tuple(s) for s in starts], self.options.get("content", "false").lower() == "true", int(self.options.get("partitions", "32")))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and lets Spark push filters into it."""
    spark.conf.set(PUSHDOWN_CONF, "true")
    spark.dataSource.register(TreeSource)


def scan_tree(spark: SparkSession, starts: list[tuple[str, str, str]], rules: str | None = None, *, content: bool = False, partitions: int | None = None) -> DataFrame:
    """``workspace, root, folder, path, size_bytes, content`` of the files below some starting points.

    ``starts`` holds ``(workspace, root, path)``, ``rules`` the text of ``rules_text``.
    """
    register(spark)
    reader = spark.read.format(SOURCE).option("starts", json.dumps(starts)).option("content", str(content).lower())
    found = reader.option("partitions", str(partitions or 4 * spark.sparkContext.defaultParallelism)).load()
    if rules is not None:
        found = found.where(found["rules"] == rules)
    return found.drop("rules")
