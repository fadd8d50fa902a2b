"""Delivery in two phases: ``documents.write.format("bindery_delivery").save(path)``.

Takes rows ``workspace, name, content``. Every task writes what it gets into a folder of its
own below ``path`` and tells in a list beside it, workspace by workspace, what was written and
what failed; its commit message is the name of that folder. When all tasks are done the
driver puts the names into one manifest, and that is the commit: readers only look at folders
a manifest names, so attempts that were lost, repeated or aborted leave no trace in any result.
A workspace that cannot be written fails alone, with the reason; others are delivered. If a task
fails for good, the run has no manifest and delivers nothing.

A target is a class that says how contents become files. ``files`` writes each content to a
file of its name below a folder of its workspace, ``jsonl`` writes lines of JSON; another is
given as ``module:Class``. Rows come best sorted by workspace, as ``deliver_documents`` has them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Protocol
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from bindery.operators.joins import join_dimension
from bindery.sinks import DELIVERED, FAILED
from bindery.sources.folders import folders

SINK = "bindery_delivery"
MANIFESTS = "manifests"
OUTCOMES = "outcomes.jsonl"
LINES_BYTES = 8 << 20
NOT_WRITTEN = "nothing was written"
OUTCOME_TYPE = "workspace string, parts bigint, bytes bigint, failure string, place string"


class Target(Protocol):
    """How the contents of a task become files below its folder. Errors of the store are OSErrors."""

    def __init__(self, base: str, folder: str): ...

    def put(self, workspace: str, name: str, content: bytes) -> None:
        """Writes one content, or holds it until ``end``."""

    def end(self) -> None:
        """Writes what is held; called when a workspace's contents end."""


def workspace_folder(workspace: str) -> str:
    """A name for the workspace's folder that neither stores nor URIs read anything into."""
    return "w=" + quote(workspace, safe="").replace("%", "=")


class FilesTarget:
    """One file for each content, of its name, below a folder for its workspace."""

    def __init__(self, base: str, folder: str):
        self.place, self.folder = folders(base), folder

    def put(self, workspace: str, name: str, content: bytes) -> None:
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise OSError(f"{name!r} is no name of a file below its workspace")
        self.place.write(f"{self.folder}/{workspace_folder(workspace)}/{name}", content)

    def end(self) -> None:
        pass


class JsonLinesTarget:
    """Lines of JSON with ``workspace``, ``name`` and ``content``, in files of bounded size."""

    def __init__(self, base: str, folder: str):
        self.place, self.folder = folders(base), folder
        self.lines: list[bytes] = []
        self.size = self.files = 0

    def put(self, workspace: str, name: str, content: bytes) -> None:
        line = {"workspace": workspace, "name": name, "content": content.decode("utf-8", "replace")}
        self.lines.append(json.dumps(line, ensure_ascii=False).encode())
        self.size += len(self.lines[-1])
        if self.size >= LINES_BYTES:
            self.end()

    def end(self) -> None:
        lines, self.lines, self.size = self.lines, [], 0
        if lines:
            self.place.write(f"{self.folder}/lines-{self.files:06d}.jsonl", b"\n".join(lines) + b"\n")
            self.files += 1


TARGETS: dict[str, type[Target]] = {"files": FilesTarget, "jsonl": JsonLinesTarget}


def target_class(name: str) -> type[Target]:
    if name in TARGETS:
        return TARGETS[name]
    module, _, cls = name.partition(":")
    if not cls:
        raise ValueError(f"no target {name!r}; there are {', '.join(TARGETS)}, or give module:Class")
    return getattr(import_module(module), cls)


@dataclass
class Written(ds.WriterCommitMessage):
    """What a task tells the driver: the folder it wrote."""

    folder: str


class DeliveryWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, target: str):
        target_class(target)
        self.path, self.target, self.run = path, target, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        folder = f"run-{self.run}/task-{context.partitionId():06d}-{context.taskAttemptId()}"
        target, told = target_class(self.target)(self.path, folder), []
        current, parts, size, failure = None, 0, 0, None

        def close() -> None:
            nonlocal failure
            if current is None:
                return
            if failure is None:
                try:
                    target.end()
                except OSError as error:
                    failure = str(error)
            told.append(json.dumps({"workspace": current, "parts": parts, "bytes": size, "failure": failure, "place": f"{folder}/{workspace_folder(current)}"}, ensure_ascii=False))

        for batch in iterator:
            for workspace, name, content in zip(*(c.to_pylist() for c in (batch["workspace"], batch["name"], batch["content"]))):
                workspace, content = workspace or "", content.encode() if isinstance(content, str) else content or b""
                if workspace != current:
                    close()
                    current, parts, size, failure = workspace, 0, 0, None
                if failure is None:
                    try:
                        target.put(workspace, name or "", content)
                        parts, size = parts + 1, size + len(content)
                    except OSError as error:
                        failure = str(error)
        close()
        folders(self.path).write(f"{folder}/{OUTCOMES}", "".join(f"{line}\n" for line in told).encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        manifest = {"target": self.target, "folders": sorted(m.folder for m in messages if m is not None)}
        folders(self.path).write(f"{MANIFESTS}/{self.run}.json", json.dumps(manifest).encode())

    def abort(self, messages: list[Written | None]) -> None:
        folders(self.path).remove(f"run-{self.run}")


class DeliverySink(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def schema(self) -> str:
        return "workspace string, name string, content string"

    def writer(self, schema, overwrite: bool) -> DeliveryWriter:
        if overwrite:
            raise ValueError("a delivery adds to what was delivered before; use mode append")
        return DeliveryWriter(self.options["path"], self.options.get("target", "files"))


def deliver_documents(chunks: DataFrame, path: str, *, target: str = "files") -> DataFrame:
    """Writes rows ``workspace, name, content`` to a target and gives ``delivery_report`` of the path.

    Rows are spread by range over workspace and name, so a large workspace fills many folders.
    """
    spark = chunks.sparkSession
    spark.dataSource.register(DeliverySink)
    rows = chunks.select("workspace", "name", "content").repartitionByRange("workspace", "name").sortWithinPartitions("workspace", "name")
    rows.write.format(SINK).option("target", target).mode("append").save(path)
    return delivery_report(spark, path)


def committed(path: str) -> list[dict]:
    """The manifests below a path: target and task folders, one entry per finished run."""
    place = folders(path)
    if not any(name == MANIFESTS for name, _, _ in place.entries("")):
        return []
    return [json.loads(place.read(f"{MANIFESTS}/{name}")) for name, _, _ in sorted(place.entries(MANIFESTS))]


def delivery_report(spark: SparkSession, path: str) -> DataFrame:
    """``workspace, parts, bytes, failure, place``: what the committed runs wrote, per task."""
    lists = [f"{path.rstrip('/')}/{folder}/{OUTCOMES}" for run in committed(path) for folder in run["folders"]]
    return spark.read.schema(OUTCOME_TYPE).json(lists) if lists else spark.createDataFrame([], OUTCOME_TYPE)


def written_outcomes(outcomes: DataFrame, report: DataFrame) -> DataFrame:
    """``delivery_outcomes`` after the write: a pack is delivered only if all it holds was written."""
    seen = report.groupBy("workspace").agg(F.min("failure").alias("_failure"), F.sum("parts").alias("_parts"))
    joined = outcomes.join(seen, "workspace", "left")
    broken = F.when(F.col("outcome") == DELIVERED, F.coalesce("_failure", F.when(F.coalesce("_parts", F.lit(0)) == 0, F.lit(NOT_WRITTEN))))
    return joined.select(
        "workspace", F.when(broken.isNotNull(), F.lit(FAILED)).otherwise(F.col("outcome")).alias("outcome"), F.coalesce(broken, "detail").alias("detail")
    )


def delivered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``workspace, name, content`` of the committed runs of the target ``jsonl``."""
    schema = "workspace string, name string, content string"
    lists = [f"{path.rstrip('/')}/{folder}/lines-*.jsonl" for run in committed(path) if run["target"] == "jsonl" for folder in run["folders"] if _holds_lines(path, folder)]
    return spark.read.schema(schema).json(lists) if lists else spark.createDataFrame([], schema)


def _holds_lines(path: str, folder: str) -> bool:
    return any(name.startswith("lines-") for name, _, _ in folders(path).entries(folder))


def delivered_files(spark: SparkSession, path: str) -> DataFrame:
    """``workspace, name, content`` of the committed runs of the target ``files``, which no name may hide from Spark."""
    schema = "workspace string, name string, content string"
    held = [f"{path.rstrip('/')}/{folder}" for run in committed(path) if run["target"] == "files" for folder in run["folders"]]
    if not held:
        return spark.createDataFrame([], schema)
    pattern = r"(run-[^/]*/task-[^/]*/w=[^/]*)/(.*)\z"
    parts = [F.regexp_extract("path", pattern, n) for n in (1, 2)]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(held)
    read = read.select(parts[0].alias("place"), parts[1].alias("name"), F.col("content").cast("string").alias("content")).where(F.col("place") != "")
    places = delivery_report(spark, path).select("workspace", "place")
    return join_dimension(read, places, ["place"], spread_by=["name"], how="inner").select("workspace", "name", "content")


def delivered_roots(report: DataFrame, path: str) -> DataFrame:
    """``workspace, root``: the folders that the target ``files`` filled, as ``list_tree`` takes them."""
    return report.where(F.col("parts") > 0).select("workspace", F.concat(F.lit(path.rstrip("/") + "/"), "place").alias("root"))
