"""A versioned key-value store of Parquet runs under a manifest of atomic edits.

* Runs are immutable folders of their own names, sorted by key, with Parquet's filters on the key, so a point read opens
  only runs whose range holds it and row groups that may.
* An edit is written aside and renamed to the next number, which fails if another writer was first; it is then tried again
  on top of that writer's edit. What is not a whole edit is ignored. A version is the fold of the first n edits.
* Writes go to a log folder first (``write``); the log's operations are flushed to a run once their size reaches the
  threshold. The edit that adds the run names the log parts that it covers, so a crash between loses and repeats nothing.
* Reads of a version stay valid while the files it names exist; ``vacuum`` is separate.

The manifest is small and is read by the driver through Spark's file systems, each edit once.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold, manifest

SCHEMA = "seq long, op string, k string, v string"
FILE = "number long, level int, min_key string, max_key string, bytes long"
THRESHOLD = 64 << 20


class Conflict(RuntimeError):
    """Another writer removed what this edit builds on."""


class Strategy(Protocol):
    """Picks files (number, level, min_key, max_key, bytes) to merge: number, output_level, bottom_most of each; none if idle."""

    def pick(self, files: DataFrame) -> DataFrame: ...


class Leveled:
    def __init__(self, trigger: int = 4, budget: int = 4):
        self.trigger, self.budget = trigger, budget

    def pick(self, files: DataFrame) -> DataFrame:
        return manifest.pick_leveled(files, self.trigger, self.budget)


class SizeTiered:
    def __init__(self, min_run: int = 4, ratio: float = 1.5):
        self.min_run, self.ratio = min_run, ratio

    def pick(self, files: DataFrame) -> DataFrame:
        return manifest.pick_tiered(files, self.min_run, self.ratio)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, as the session names it; a temporary one in local tests only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="runefold-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, path: str, threshold: int = THRESHOLD):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._seen: dict[str, dict | None] = {}

    # the manifest

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _edit_names(self) -> list[str]:
        return [n for n in self._names("manifest") if n.endswith(".json")]

    def _edits(self, names: list[str] | None = None) -> list[dict]:
        """All whole edits in order; each file is read once."""
        names = self._edit_names() if names is None else names
        for name in names:
            if name not in self._seen:
                try:
                    edit = json.loads(self._read(f"{self.path}/manifest/{name}"))
                    self._seen[name] = edit if isinstance(edit, dict) and {"added", "deleted"} <= edit.keys() else None
                except ValueError:  # torn: it was never committed
                    self._seen[name] = None
        return [self._seen[n] for n in names if self._seen[n] is not None]

    def _commit(self, make: Callable[[list[dict]], dict]) -> int:
        """Write the edit that ``make`` gives for the edits so far; returns the version."""
        while True:
            names = self._edit_names()  # the edit builds on these, and takes the number after them
            edits = self._edits(names)
            edit = make(edits)
            number = 1 + max((int(n[:-5]) for n in names), default=-1)
            aside = self._path(f"{self.path}/manifest/{uuid.uuid4().hex}.tmp")
            stream = self._fs.create(aside, False)
            try:
                stream.write(bytearray(json.dumps(edit).encode()))
            finally:
                stream.close()
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(aside, self._path(f"{self.path}/manifest/{number:08d}.json"), none)
                return len(edits) + 1
            except Py4JJavaError as error:
                self._fs.delete(aside, False)
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise

    @staticmethod
    def _numbered(edits: list[dict], file: dict) -> dict:
        return file | {"number": 1 + max((f["number"] for e in edits for f in e["added"]), default=0)}

    @staticmethod
    def _live(edits: list[dict]) -> dict[int, dict]:
        live: dict[int, dict] = {}
        for edit in edits:  # deletes come before adds
            for n in edit["deleted"]:
                live.pop(n, None)
            for f in edit["added"]:
                live[f["number"]] = f
        return live

    def version(self) -> int:
        return len(self._edits())

    def files(self, version: int | None = None) -> list[dict]:
        """Files of a version, newest data first."""
        return sorted(self._live(self._edits()[:version]).values(), key=lambda f: -f["max_seq"])

    def file_table(self) -> DataFrame:
        rows = [(f["number"], f["level"], f["min_key"], f["max_key"], f["bytes"]) for f in self.files()]
        return self.spark.createDataFrame(rows, FILE)

    # runs

    def _write(self, rows: DataFrame, level: int) -> dict | None:
        name = uuid.uuid4().hex
        at = f"{self.path}/runs/{name}"
        key = F.when(F.col("k").isNull(), F.raise_error(F.lit("a key is null"))).otherwise(F.col("k")).alias("k")
        rows = rows.select("seq", "op", key, "v").repartitionByRange("k").sortWithinPartitions("k")
        rows.write.option("parquet.bloom.filter.enabled#k", "true").parquet(at)
        made = self.spark.read.schema(SCHEMA).parquet(at)
        n, lo, hi, seq = made.agg(F.count(F.lit(1)), F.min("k"), F.max("k"), F.max("seq")).first()
        if not n:
            self._fs.delete(self._path(at), True)
            return None
        size = self._fs.getContentSummary(self._path(at)).getLength()
        return {"name": name, "level": level, "min_key": lo, "max_key": hi, "max_seq": seq, "entries": n, "bytes": size}

    def flush(self, rows: DataFrame, **marks) -> int:
        """Add one run of the newest operation of each key; returns the version. Without operations there is no run."""
        made = self._write(fold.newest(rows), 0)
        return self._commit(lambda edits: {"added": [self._numbered(edits, made)] if made else [], "deleted": [], **marks})

    def applied_batches(self, source: str) -> set[int]:
        return {e["batch"] for e in self._edits() if e.get("source") == source}

    # the log

    def write(self, rows: DataFrame) -> int | None:
        """Append operations (seq, op, k, v) to the log; flushes it once it is large enough, and then returns the version."""
        rows.select("seq", "op", "k", "v").write.parquet(f"{self.path}/log/{uuid.uuid4().hex}")
        return self.flush_log() if self.memtable_size() >= self.threshold else None

    def _parts(self) -> list[str]:
        """Parts of the log that no run covers; a part without its success mark was never whole."""
        covered = {p for e in self._edits() for p in e.get("log", [])}
        return [n for n in self._names("log") if n not in covered and self._fs.exists(self._path(f"{self.path}/log/{n}/_SUCCESS"))]

    def memtable(self) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/log/{n}" for n in parts]) if parts else self.spark.createDataFrame([], SCHEMA)

    def memtable_size(self) -> int:
        return self.memtable().agg(F.coalesce(F.sum(fold.entry_size()), F.lit(0))).first()[0]

    def flush_log(self) -> int | None:
        """One run of all that the log holds; nothing to do if it is empty."""
        parts = self._parts()
        return self.flush(self.memtable(), log=parts) if parts else None

    # reads

    def entries(self, version: int | None = None, key: str | None = None) -> DataFrame:
        """Entries of a version; with ``key``, of the runs whose range holds it. The newest version includes the log."""
        files = [f for f in self.files(version) if key is None or f["min_key"] <= key <= f["max_key"]]
        rows = self.memtable() if version is None else self.spark.createDataFrame([], SCHEMA)
        if files:
            rows = rows.union(self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/runs/{f['name']}" for f in files]))
        return rows if key is None else rows.where(F.col("k") == key)

    def read(self, version: int | None = None) -> DataFrame:
        return fold.live(self.entries(version))

    def get(self, key: str, version: int | None = None) -> DataFrame:
        return fold.live(self.entries(version, key))

    # compaction

    def _merge(self, numbers: list[int], level: int, bottom: bool) -> int:
        live = {f["number"]: f for f in self.files()}
        inputs = [live[n] for n in numbers]
        runs = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/runs/{f['name']}" for f in inputs])
        made = self._write(fold.merge(runs, bottom), level)
        if made:
            made["max_seq"] = max(f["max_seq"] for f in inputs)

        def edit(edits: list[dict]) -> dict:
            if not set(numbers) <= self._live(edits).keys():
                raise Conflict("an input was compacted by another writer")
            return {"added": [self._numbered(edits, made)] if made else [], "deleted": numbers}

        return self._commit(edit)

    def compact(self, level: int = 1) -> int:
        """Merge all runs into one; the result is the bottom, so tombstones go."""
        files = self.files()
        return self._merge([f["number"] for f in files], level, True) if files else self.version()

    def compact_once(self, strategy: Strategy) -> bool:
        """Whether there was anything to do."""
        if not self.files():
            return False
        picked = strategy.pick(self.file_table()).collect()  # files of one merge
        if not picked:
            return False
        self._merge([r["number"] for r in picked], picked[0]["output_level"], picked[0]["bottom_most"])
        return True

    def compact_all(self, strategy: Strategy) -> int:
        """Compact until the strategy is idle; returns how often."""
        times = 0
        while self.compact_once(strategy):
            times += 1
        return times

    def space(self) -> int:
        """Bytes of the live runs."""
        return sum(f["bytes"] for f in self.files())

    def vacuum(self) -> list[int]:
        """Remove runs that the latest version does not name, what failed writers left, and log parts that runs cover."""
        edits = self._edits()
        live = self._live(edits)
        keep = {f["name"] for f in live.values()}
        for name in self._names("runs"):
            if name not in keep:
                self._fs.delete(self._path(f"{self.path}/runs/{name}"), True)
        for part in {p for e in edits for p in e.get("log", [])} & set(self._names("log")):
            self._fs.delete(self._path(f"{self.path}/log/{part}"), True)
        for name in self._names("manifest"):
            if name.endswith(".tmp"):
                self._fs.delete(self._path(f"{self.path}/manifest/{name}"), False)
        return sorted({f["number"] for e in edits for f in e["added"]} - live.keys())

    # copies

    def adopt(self) -> int:
        """Take runs that no edit names into the manifest, at level 0: a folder written without one becomes a store."""
        known = {f["name"] for e in self._edits() for f in e["added"]}
        found = []
        for name in self._names("runs"):
            at = f"{self.path}/runs/{name}"
            if name not in known and self._fs.exists(self._path(f"{at}/_SUCCESS")):
                n, lo, hi, seq = self.spark.read.schema(SCHEMA).parquet(at).agg(F.count(F.lit(1)), F.min("k"), F.max("k"), F.max("seq")).first()
                size = self._fs.getContentSummary(self._path(at)).getLength()
                if n:
                    found.append({"name": name, "level": 0, "min_key": lo, "max_key": hi, "max_seq": seq, "entries": n, "bytes": size})

        def edit(edits: list[dict]) -> dict:
            first = self._numbered(edits, {})["number"]
            return {"added": [f | {"number": first + i} for i, f in enumerate(found)], "deleted": []}

        return self._commit(edit)

    def snapshot(self, path: str) -> None:
        """Copy the live runs to a new root; what is in the log is flushed first."""
        self.flush_log()
        for f in self.files():
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(f"{self.path}/runs/{f['name']}"), self._fs, self._path(f"{path}/runs/{f['name']}"), False, self._conf)

    def restore(self, path: str) -> int:
        """Replace all that is here by the runs of a snapshot."""
        self._fs.delete(self._path(self.path), True)
        self._seen.clear()
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(f"{path}/runs"), self._fs, self._path(f"{self.path}/runs"), False, self._conf)
        return self.adopt()
