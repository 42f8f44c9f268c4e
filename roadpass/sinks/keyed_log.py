"""A keyed table kept as a log of deltas, for writers that come often with few rows.

Each append writes its own rows to a folder of its own and then commits a manifest, a small
file that names the live folders; readers see the folders of one manifest and take the newest
row of each key. The commit is a rename that fails when the version exists, so writers that
race try again with the next version, and a writer that dies before its commit leaves
a folder nobody reads. Batches that a writer has committed are noted in the manifest: a
replay changes nothing. Compaction merges the folders of one size class into one of the
next, so a row is rewritten about as often as there are classes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 4


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    # Folder and its size class, oldest first.
    folders: tuple[tuple[str, int], ...] = ()
    # The last batch that each writer has committed.
    applied: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"folders": self.folders, "applied": self.applied})


class KeyedLog:
    """``schema`` is a DDL text; rows with equal ``keys`` are told apart by ``newest``, the
    largest of which is the row's state. With ``gone``, a boolean column, such a state says
    that the key has no row. ``partition`` names columns to store folders by."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        keys: Sequence[str],
        newest: Sequence[str],
        gone: str | None = None,
        partition: Sequence[str] = (),
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.newest, self.gone, self.partition = list(keys), list(newest), gone, list(partition)
        self.names = spark.createDataFrame([], schema).columns

    # Manifests

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifest")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The given or the last manifest; an empty one before the first commit."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Manifest()
        (text,) = self.spark.read.text(self._name(version), wholetext=True).first()
        parsed = json.loads(text)
        return Manifest(version, tuple(map(tuple, parsed["folders"])), parsed["applied"])

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self, manifest: Manifest) -> bool:
        """Whether the manifest became its version; no when another writer was first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target, draft = self._hadoop(self._name(manifest.version)), self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs = target.getFileSystem(conf)
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(manifest.text().encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), no_options)
        except Py4JJavaError as e:
            if fs.exists(target):
                fs.delete(draft, False)
                return False
            raise e
        return True

    # Writing

    def write_delta(self, rows: DataFrame) -> str:
        """Store rows in a new folder that no manifest names yet."""
        folder = f"deltas/delta={uuid.uuid4().hex}"
        writer = rows.select(*self.names).write
        (writer.partitionBy(*self.partition) if self.partition else writer).parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame, writer: str = "", batch_id: int | None = None) -> int:
        """Add rows and return the version that holds them. A batch that its writer has
        committed before is left out."""
        if batch_id is not None and self._holds(now := self.manifest(), writer, batch_id):
            return now.version
        folder = self.write_delta(rows)
        while True:
            now = self.manifest()
            if batch_id is not None and self._holds(now, writer, batch_id):
                return now.version
            applied = now.applied if batch_id is None else {**now.applied, writer: batch_id}
            new = Manifest(now.version + 1, (*now.folders, (folder, 0)), applied)
            if self._commit(new):
                return new.version

    @staticmethod
    def _holds(manifest: Manifest, writer: str, batch_id: int) -> bool:
        return manifest.applied.get(writer, -1) >= batch_id

    def compact(self, fan_in: int = FAN_IN) -> int:
        """Merge size classes that hold ``fan_in`` folders, from the smallest on; returns how
        many folders were merged."""
        merged = 0
        while True:
            now = self.manifest()
            classes = sorted({c for _, c in now.folders})
            full = next((c for c in classes if sum(k == c for _, k in now.folders) >= fan_in), None)
            if full is None:
                return merged
            old = [f for f, c in now.folders if c == full]
            # States that say a key is gone stay, since older classes may hold the key.
            new = self.write_delta(self._newest(self._rows(old)))
            while True:
                live = [f for f, _ in now.folders]
                if any(f not in live for f in old):
                    break
                at = live.index(old[0])
                folders = [x for x in now.folders if x[0] not in old]
                folders.insert(min(at, len(folders)), (new, full + 1))
                if self._commit(Manifest(now.version + 1, tuple(folders), now.applied)):
                    merged += len(old)
                    break
                now = self.manifest()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove manifests but the last ``keep`` and the folders that only they name. No writer
        may be at work, since folders of uncommitted writes go too."""
        versions = self.versions()
        live = {f for v in versions[-keep:] for f, _ in self.manifest(v).folders}
        conf = self.spark._jsc.hadoopConfiguration()
        root = self._hadoop(f"{self.path}/deltas")
        fs = root.getFileSystem(conf)
        for version in versions[:-keep]:
            fs.delete(self._hadoop(self._name(version)), False)
        gone = [n for n in (s.getPath().getName() for s in fs.listStatus(root)) if f"deltas/{n}" not in live]
        for name in gone:
            fs.delete(self._hadoop(f"{self.path}/deltas/{name}"), True)
        return gone

    # Reading

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/deltas")
        return reader.parquet(*(f"{self.path}/{f}" for f in folders)).select(*self.names)

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [n for n in self.names if n not in self.keys]
        last = F.max_by(F.struct(*values), F.struct(*self.newest)).alias("last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "last.*").select(*self.names)

    def rows(self, version: int | None = None) -> DataFrame:
        """All live rows, outdated states of a key among them."""
        return self._rows([f for f, _ in self.manifest(version).folders])

    def read(self, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The newest row of each key at a version; of the keys in ``only`` if it is given."""
        rows = self.rows(version)
        if only is not None:
            rows = rows.join(only.select(*self.keys).distinct(), self.keys, "left_semi")
        found = self._newest(rows)
        return found.where(~F.col(self.gone)).drop(self.gone) if self.gone else found
