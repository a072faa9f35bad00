"""Versioned tables: an append-only log of snapshots, published by one atomic step, with rollback and review notes.

A table is a folder. ``data/<name>`` holds Parquet parts that Spark wrote, ``log/<number>.json``
one entry a version. A publish writes its part first, whatever its partitions, and then adds the
entry of the next number, which succeeds only where no such entry exists: readers see all of a
publish or nothing, and of two publishers that meet one takes the number and the other
the next. Nothing is changed or deleted afterwards; a rollback is an entry that names an older
version.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW = 200
_DIGITS = 12


class Entry(NamedTuple):
    """One version: what it did, the part it added or the version it went back to, and its remark."""

    version: int
    kind: str
    part: str | None
    target: int | None
    remark: str | None


class VersionedTable:
    """A table of documents keyed by ``key``, in ``folder`` of a file system that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    # --- the log ---

    def entries(self) -> list[Entry]:
        """All versions in order."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/log")))
        return [Entry(**json.loads(self._read(f"{self.folder}/log/{n}"))) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _claim(self, entry: Entry) -> bool:
        """Add the entry as a whole, or return False where its number is taken.

        The text is written beside the log and moved to its name. Distributed file systems refuse to move onto a file; of a
        local one, whose move would replace it, a hard link is asked, which fails likewise.
        """
        draft = self._path(f"{self.folder}/.drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry._asdict()).encode()))
        out.close()
        name = f"{self.folder}/log/{entry.version:0{_DIGITS}d}.json"
        if self._fs.getUri().getScheme() != "file":
            return not self._fs.exists(self._path(name)) and self._fs.rename(draft, self._path(name))
        nio = self._jvm.java.nio.file
        place = lambda p: nio.Path.of(self._path(str(p)).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
        try:
            nio.Files.createLink(place(name), place(draft))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def _commit(self, kind: str, part: str | None = None, target: int | None = None, remark: str | None = None) -> int:
        """Add an entry under the next free number."""
        version = self.head() + 1
        while not self._claim(Entry(version, kind, part, target, remark)):
            version += 1
        return version

    def head(self) -> int:
        """The number of the newest version, 0 for an empty table."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/log"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def _parts(self, version: int) -> list[str]:
        """The parts that make up a version, oldest first."""
        own: dict[int, list[str]] = {0: []}
        for e in self.entries():
            if e.version <= version:
                before = own[e.version - 1]
                own[e.version] = own[e.target] if e.kind == "rollback" else before + [e.part] if e.kind == "publish" else before
        if version not in own:
            raise ValueError(f"no version {version}")
        return own[version]

    # --- writing ---

    def publish(self, rows: DataFrame, keys: DataFrame | None = None, remark: str | None = None) -> int:
        """Replace the documents of ``rows``; documents of ``keys`` without rows are removed. Returns the version."""
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{part}/rows")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/data/{part}/rows").select(self.key)
        (own.unionByName(keys.select(self.key)) if keys is not None else own).distinct().write.parquet(f"{self.folder}/data/{part}/keys")
        return self._commit("publish", part, remark=remark)

    def remove(self, keys: DataFrame, schema, remark: str | None = None) -> int:
        return self.publish(self.spark.createDataFrame([], schema), keys, remark)

    def rollback(self, version: int, remark: str | None = None) -> int:
        """A new version with the documents of an older one."""
        if not 1 <= version <= self.head():
            raise ValueError(f"no version {version}")
        return self._commit("rollback", target=version, remark=remark)

    def restore(self, keys: DataFrame, version: int, remark: str | None = None) -> int:
        """A new version in which the documents of ``keys`` are as they were at an older one, or absent if they were."""
        wanted = keys.select(self.key).distinct()
        return self.publish(self.read(version).join(wanted, self.key, "left_semi"), wanted, remark)

    def note(self, notes: DataFrame, remark: str | None = None) -> int:
        """Append review notes: key, reviewer, section_id, issue_type, original, corrected, rationale and ambiguity_flags."""
        part = uuid.uuid4().hex
        short = lambda c: F.substring(c, 1, PREVIEW).alias(c)
        flags = F.coalesce("ambiguity_flags", F.array().cast("array<string>")).alias("ambiguity_flags")
        notes.select(self.key, "reviewer", "section_id", "issue_type", short("original"), short("corrected"), "rationale", flags).write.parquet(f"{self.folder}/data/{part}/notes")
        return self._commit("notes", part, remark=remark)

    # --- reading ---

    def _stacked(self, parts: list[str], what: str) -> DataFrame:
        place = F.col("_metadata.file_path")
        number = F.coalesce(*[F.when(place.contains(f"/data/{p}/"), F.lit(k)) for k, p in enumerate(parts)])
        return self.spark.read.parquet(*[f"{self.folder}/data/{p}/{what}" for p in parts]).withColumn("_part", number)

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version, the newest by default: each from the last part that names it."""
        parts = self._parts(self.head() if version is None else version)
        if not parts:
            raise ValueError("the version has no documents")
        last = self._stacked(parts, "keys").groupBy(self.key).agg(F.max("_part").alias("_part"))
        return self._stacked(parts, "rows").join(last, [self.key, "_part"]).drop("_part")

    def notes(self) -> DataFrame:
        """All review notes with the version that added them."""
        found = [e for e in self.entries() if e.kind == "notes"]
        version = F.element_at(F.array(*[F.lit(e.version) for e in found]), F.col("_part") + 1)
        return self._stacked([e.part for e in found], "notes").withColumn("version", version).drop("_part")

    def history(self) -> DataFrame:
        """(version, kind, target, remark) of every version."""
        rows = [(e.version, e.kind, e.target, e.remark) for e in self.entries()]
        return self.spark.createDataFrame(rows, "version int, kind string, target int, remark string")


def content_digest(column: str) -> Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)
