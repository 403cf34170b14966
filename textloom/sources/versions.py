"""Tables with versions, a pointer to the current one, and stages that know what they were made of.

A version is written to a folder of its own; then a small pointer file is replaced by renaming, which
is all that readers look at. A crash between the two leaves the former version in place. A reader that
has resolved the pointer keeps its version, whatever is published after.

A stage's manifest lists the files that it read (path, length, time of change), the digests of the
stages before it and its settings. A stage is made again where its manifest differs, and so are the
stages after it, whose manifests hold its digest.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT.json"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_json(spark: SparkSession, path: str):
    """The value of a small JSON file, null if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def replace_json(spark: SparkSession, path: str, value) -> None:
    """Write a small JSON file beside its place, then rename it there: readers see the former one or the new one."""
    jvm = spark._jvm
    beside = f"{path}.{uuid.uuid4().hex}"
    p, fs = _path(spark, beside)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    finally:
        stream.close()
    target, _ = _path(spark, path)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(p, target, over)


@dataclass
class Versions:
    """A table's versions under ``root``."""

    spark: SparkSession
    root: str

    def history(self) -> list[dict]:
        """What the pointer says, the current version first: dictionaries with ``path`` and what was noted."""
        return read_json(self.spark, f"{self.root}/{POINTER}") or []

    def current(self) -> str:
        """The path of the current version, to read now and later: nothing that is published afterwards changes it.

        Where the current version's files are gone or were never complete, the former one's.
        """
        for version in self.history():
            if exists(self.spark, f"{version['path']}/_SUCCESS"):
                return version["path"]
        raise FileNotFoundError(f"no complete version under {self.root}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current())

    def new(self) -> str:
        return f"{self.root}/v-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> str:
        """A new version's path, complete but not current."""
        path = self.new()
        df.write.mode("overwrite").parquet(path)
        return path

    def publish(self, path: str, keep: int = 2, hold: set[str] = frozenset(), **notes) -> str:
        """Make a written version current; of former ones ``keep - 1`` and those in ``hold`` stay, for readers and to fall back to."""
        if not exists(self.spark, f"{path}/_SUCCESS"):
            raise FileNotFoundError(f"{path} is not complete")
        before = [v for v in self.history() if v["path"] != path]
        stay = [v for i, v in enumerate(before) if i < keep - 1 or v["path"] in hold]
        replace_json(self.spark, f"{self.root}/{POINTER}", [{"path": path, **notes}, *stay])
        for old in before:
            if old not in stay:
                delete(self.spark, old["path"])
        return path

    def put(self, df: DataFrame, keep: int = 2, **notes) -> DataFrame:
        return self.spark.read.parquet(self.publish(self.write(df), keep, **notes))

    def roll_back(self) -> str:
        """Make the former version current again."""
        now, *before = self.history()
        if not before:
            raise FileNotFoundError(f"no former version under {self.root}")
        replace_json(self.spark, f"{self.root}/{POINTER}", [*before, now])
        return self.current()


def read_first(spark: SparkSession, *roots: str) -> DataFrame:
    """The table of the first of these places that has a current or plain complete version: newer layouts first, older ones after."""
    for root in roots:
        if exists(spark, f"{root}/{POINTER}"):
            return Versions(spark, root).read()
        if exists(spark, f"{root}/_SUCCESS"):
            return spark.read.parquet(root)
    raise FileNotFoundError(f"none of {list(roots)} holds a table")


def content(df: DataFrame) -> list:
    """[rows, sums of row hashes] of a frame that comes from no files."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes])
    r = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.pmod(h, F.lit(1_000_003)))).first()
    return [r[0], str(r[1]), r[2]]


def origin(df: DataFrame) -> dict:
    """What a frame is made of: its files with length and time of change, or without files its content."""
    spark, found = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        p, fs = _path(spark, name)
        status = fs.getFileStatus(p)
        found.append([name, status.getLen(), status.getModificationTime()])
    return {"files": found} if found else {"content": content(df)}


@dataclass
class Stages:
    """Stages of a build under ``root``. ``made`` names those that this run made, ``seconds`` says how long each took.

    ``publish`` notes the paths of all stages in one pointer, so that readers get tables of the same build.
    """

    spark: SparkSession
    root: str
    made: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    _digests: dict[str, str] = field(default_factory=dict)

    def _stage(self, name: str, write: Callable[[str], None], inputs, after, settings) -> str:
        began = time.perf_counter()
        own = asdict(settings) if is_dataclass(settings) else settings
        manifest = {
            "stage": name, "settings": json.loads(json.dumps(own, sort_keys=True, default=str)),
            "inputs": [origin(df) for df in inputs], "after": {x: self._digests[x] for x in after},
        }
        digest = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
        table, self._digests[name] = Versions(self.spark, f"{self.root}/{name}"), digest
        now = next(iter(table.history()), {})
        if now.get("digest") == digest and exists(self.spark, f"{now['path']}/_SUCCESS"):
            self.paths[name] = now["path"]
        else:
            path = table.new()
            write(path)
            self.paths[name] = table.publish(path, hold=set(published(self.spark, self.root).values()), digest=digest, manifest=manifest)
            self.made.append(name)
        self.seconds[name] = time.perf_counter() - began
        return self.paths[name]

    def stage(self, name: str, make: Callable[[], DataFrame], inputs: tuple[DataFrame, ...] = (), after: tuple[str, ...] = (), settings=None) -> DataFrame:
        """The stage's table: as it stands, or made again where the origin of its inputs, the stages before it or its settings differ.

        inputs: frames from outside that ``make`` reads; after: names of earlier stages that it reads.
        """
        return self.spark.read.parquet(self._stage(name, lambda path: make().write.mode("overwrite").parquet(path), inputs, after, settings))

    def folder(self, name: str, write: Callable[[str], None], inputs: tuple[DataFrame, ...] = (), after: tuple[str, ...] = (), settings=None) -> str:
        """Like ``stage`` for what writes itself to a folder of several tables; the folder's path."""

        def whole(path: str) -> None:
            write(path)
            if not exists(self.spark, f"{path}/_SUCCESS"):
                p, fs = _path(self.spark, f"{path}/_SUCCESS")
                fs.create(p, True).close()

        return self._stage(name, whole, inputs, after, settings)

    def publish(self) -> None:
        replace_json(self.spark, f"{self.root}/{POINTER}", self.paths)


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """Stage -> path of the build that was published last; empty without one."""
    return read_json(spark, f"{root}/{POINTER}") or {}
