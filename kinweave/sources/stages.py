"""Stage results that later runs find again.

A stage is a table, or a folder such as a saved model, made from files,
earlier stages and settings.  Its fingerprint covers all of these, so a changed
setting or input file makes a new stage and the same ones find the old.

Data is written into a folder of its own, and the stage counts as made only when its
manifest is put in place with one rename that never replaces another.  The manifest lists
the data files with their sizes; a run that was lost leaves a folder without a manifest, and a manifest whose
files are not all there is passed over, so torn writes are made again.  Of two
runs that make the same stage at once, the first to put its manifest is read by both.

Only listings of files go through the driver: one name, size and time per file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.ml.param import Params
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Stage:
    """What later stages depend on; ``path`` is the data folder, ``df`` its table if it is one."""

    name: str
    fingerprint: str
    path: str | None = None
    df: DataFrame | None = None
    reused: bool = False


def described(value):
    """Settings as JSON values; Spark ML stages by class and the parameters that were set."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, dict):
        return {str(k): described(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))}
    if isinstance(value, list | tuple):
        return [described(v) for v in value]
    if isinstance(value, Params):
        # default seeds differ between Python processes, so defaults stay out
        chosen = {p.name: described(value.getOrDefault(p)) for p in value.params if value.isSet(p)}
        return {"class": type(value).__qualname__, "set": described(chosen)}
    if is_dataclass(value) and not isinstance(value, type):
        return {"class": type(value).__qualname__, "set": described(asdict(value))}
    raise TypeError(f"{type(value).__name__} has no description that is the same in every run")


def digest(value) -> str:
    return hashlib.sha256(json.dumps(described(value), sort_keys=True).encode()).hexdigest()


class StageStore:
    """Stages below ``folder``, which all executors must reach.

    ``version`` is part of every fingerprint: raise it when the code that makes the stages changes.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str = "1"):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self.used: dict[str, set[str]] = {}

    # ---- files --------------------------------------------------------------------------------------

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """Name below ``path``, size and time of every file, in order of name; empty if there is none."""
        fs = self._fs(path)
        root = self._path(path)
        if not fs.exists(root):
            return []
        base = fs.getFileStatus(root).getPath().toString()
        found, it = [], fs.listFiles(root, True)
        while it.hasNext():
            s = it.next()
            found.append((s.getPath().toString()[len(base):], s.getLen(), s.getModificationTime()))
        return sorted(f for f in found if not f[0].endswith(".crc"))

    def _read(self, path: str) -> dict | None:
        """The manifest at ``path``; None if there is none or it can not be read."""
        if not self._fs(path).exists(self._path(path)):
            return None
        lines = self.spark.read.option("wholetext", "true").text(path).collect()  # one row
        try:
            return json.loads(lines[0].value)
        except (IndexError, ValueError):
            return None

    def _place(self, manifest: dict, path: str) -> None:
        """Put the manifest with one rename, unless a readable one is there."""
        fs, part = self._fs(path), f"{path}.{uuid.uuid4().hex}"
        out = fs.create(self._path(part), False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._found(path) is None:  # none, or torn
            fs.delete(self._path(path), False)
            if fs.rename(self._path(part), self._path(path)):
                return
        fs.delete(self._path(part), False)

    def _found(self, path: str) -> dict | None:
        """The manifest at ``path`` if all its files are there with their sizes."""
        manifest = self._read(path)
        if not manifest or not {"data", "files"} <= manifest.keys():
            return None
        there = [[n, size] for n, size, _ in self.files(manifest["data"])]
        return manifest if there == manifest["files"] else None

    # ---- stages -------------------------------------------------------------------------------------

    def source(self, name: str, path: str, read: Callable[[str], DataFrame] | None = None) -> Stage:
        """Input files, by name, size and time of change; ``read`` gives their table, parquet by default."""
        files = self.files(path)
        if not files:
            raise FileNotFoundError(path)
        df = self.spark.read.parquet(path) if read is None else read(path)
        return Stage(name, digest([path, files]), path, df, True)

    def folder_of(self, name: str, make: Callable[[str], None], inputs: Sequence[Stage] = (), settings=None) -> Stage:
        """A folder that ``make(path)`` writes, unless the same one was committed before."""
        return self._stage(name, make, inputs, settings, None)

    def table(self, name: str, make: Callable[[], DataFrame], inputs: Sequence[Stage] = (), settings=None) -> Stage:
        """The table that ``make()`` gives, written as parquet, unless the same one was committed before."""
        schema = {}

        def write(path: str) -> None:
            df = make()
            schema["json"] = df.schema.json()
            df.write.parquet(path)

        return self._stage(name, write, inputs, settings, schema)

    def _stage(self, name: str, write: Callable[[str], None], inputs: Sequence[Stage], settings, schema: dict | None) -> Stage:
        mark = digest([self.version, name, settings, [s.fingerprint for s in inputs]])
        self.used.setdefault(name, set()).add(mark)
        at = f"{self.folder}/{name}/{mark}/{MANIFEST}"
        manifest = self._found(at)
        reused = manifest is not None
        if not reused:
            data = f"{self.folder}/{name}/{mark}/data-{uuid.uuid4().hex}"
            write(data)
            files = [[n, size] for n, size, _ in self.files(data)]
            self._place({"data": data, "files": files, "settings": described(settings), **({"schema": schema["json"]} if schema else {})}, at)
            manifest = self._found(at)  # another run's, if that was first
            if manifest is None:
                raise OSError(f"stage {name} was written but can not be read: {at}")
        df = None
        if schema is not None:
            df = self.spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(manifest["data"])
        return Stage(name, mark, manifest["data"], df, reused)

    def prune(self) -> list[str]:
        """Remove what this store's stages have under other fingerprints, and return the folders.

        Only names that this store has used are looked at.  Do not call it while another run writes there.
        """
        gone = []
        for name, marks in self.used.items():
            root = f"{self.folder}/{name}"
            for s in self._fs(root).listStatus(self._path(root)):
                if s.getPath().getName() not in marks:
                    gone.append(s.getPath().toString())
                    self._fs(root).delete(s.getPath(), True)
        return gone
