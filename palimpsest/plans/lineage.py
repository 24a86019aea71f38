"""Cutting lineage, scratch folders and versioned manifests, all in the folder the cluster names."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []
_ONCE: dict[tuple[str, str, str], DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, where it is unset, a fresh local folder that is then set.

    Off local mode a folder of the driver's machine is not seen by the
    executors, so the setting is asked for instead.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, shared by all executors; deleted by `release` or at the end of the session."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def release() -> None:
    """Delete every scratch folder handed out so far; results not yet read from them are lost."""
    _ONCE.clear()
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be reached any more
            return


atexit.register(release)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(frame: DataFrame, eager: bool = True) -> DataFrame:
    """`frame` checkpointed in the shared folder: a lost executor costs no recomputation."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame read back from a scratch table, for results that several stages read."""
    path = scratch(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def once(spark: SparkSession, base: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` gives, written when it is first asked for in this session under (`base`, `name`) and read by all later users."""
    key = (spark.sparkContext.applicationId, base, name)
    if key not in _ONCE:
        _ONCE[key] = written(build(), name)
    return _ONCE[key]


class Manifests:
    """Numbered JSON manifests in `path`; the highest number holds, so a reader sees the old state or the new one.

    A manifest appears under its number by one rename and is never changed; older
    ones are deleted only after that.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.spark, self.path, self._path = spark, path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json"))
        return sorted(int(s.getPath().getName()[9:-5]) for s in found or ())

    def read(self) -> dict | None:
        while versions := self._versions():
            at = self._path(f"{self.path}/manifest-{versions[-1]:012d}.json")
            if not self._fs.exists(at):
                continue  # replaced since it was listed
            stream = self._fs.open(at)
            try:
                return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return None

    def write(self, state: dict) -> None:
        versions = self._versions()
        at = self._path(f"{self.path}/manifest-{(versions[-1] if versions else 0) + 1:012d}.json")
        new = self._path(f"{self.path}/new-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if not self._fs.rename(new, at):
            raise RuntimeError(f"another writer has committed {at.getName()} meanwhile")
        for v in versions:
            self._fs.delete(self._path(f"{self.path}/manifest-{v:012d}.json"), False)

    def delete(self, name: str) -> None:
        """Delete a file or folder beside the manifests."""
        self._fs.delete(self._path(f"{self.path}/{name}"), True)
