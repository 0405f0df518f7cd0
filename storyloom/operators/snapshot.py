"""Snapshots of a corpus: writing with an atomic pointer, totals, content roots, and checks as queries that must be empty.

Pointers and manifests go through Hadoop's file systems, as tables do, so a root may be on any of them. A new pointer is
written beside the old one and renamed over it, which those file systems that can rename do in one step.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")
HASH = re.compile(r"[0-9a-f]{64}")
MOST_POINTER_BYTES = 64 * 1024
MOST_MANIFEST_BYTES = 8 << 20


class SnapshotError(ValueError):
    """A snapshot or its pointer is not what it should be."""


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(pack, rows) of several tables; an aggregation each, no row leaves its executor but the counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("pack"), "rows")
        out = one if out is None else out.unionAll(one)
    if out is None:
        raise ValueError("no tables")
    return out


def row_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of a table that does not depend on the order of its rows, repeats included."""
    each = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
    number = F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum(number), F.lit(0)).cast("string"), 256).alias("digest"))


def content_root(parts: dict[str, str]) -> str:
    """One hash over named part hashes, in canonical form: sorted keys, no blanks."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class _Files:
    """The file system of a root, through the session's Hadoop."""

    def __init__(self, root: str):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise SnapshotError("there is no session")
        self.gateway = spark.sparkContext._gateway
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.at = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.fs.Path(name)

    def status(self, name: str):
        """The state of a file, of a link itself and not of what it leads to; None if there is none."""
        context = self.fs.FileContext.getFileContext(self.at.getUri(), self.conf)
        try:
            return context.getFileLinkStatus(self.at.makeQualified(self.path(name)))
        except Exception:
            return None

    def read(self, name: str, most: int) -> bytes:
        size = self.at.getFileStatus(self.path(name)).getLen()
        if size > most:
            raise SnapshotError(f"{name} is too large")
        stream = self.at.open(self.path(name))
        try:
            return bytes(stream.readNBytes(int(size)))
        finally:
            stream.close()

    def put(self, name: str, data: bytes) -> None:
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.at.create(self.path(beside), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        over = getattr(self.fs, "Options$Rename")
        how = self.gateway.new_array(over, 1)
        how[0] = over.OVERWRITE
        context = self.fs.FileContext.getFileContext(self.at.getUri(), self.conf)
        context.rename(self.at.makeQualified(self.path(beside)), self.at.makeQualified(self.path(name)), how)

    def folders(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.at.listStatus(self.path(name)) if s.isDirectory()]


def _json(value: dict) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True).encode()


def write(tables: dict[str, DataFrame], root: str, snapshot_id: str) -> str:
    """Write tables as snapshot ``snapshot_id`` under ``root`` and point ``current.json`` to it; returns the data version."""
    if not ID.fullmatch(snapshot_id) or ".." in snapshot_id:
        raise SnapshotError(f"not a snapshot id: {snapshot_id!r}")
    parts = {}
    for name, df in tables.items():
        path = f"{root}/{snapshot_id}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        parts[name] = row_digest(df.sparkSession.read.parquet(path)).first()["digest"]
    version = content_root(parts)
    put_json(f"{root}/{snapshot_id}/manifest.json", {"snapshot_id": snapshot_id, "data_version": version, "parts": parts, "written": int(time.time())})
    put_json(f"{root}/current.json", {"snapshot_id": snapshot_id, "data_version": version})
    return version


def put_json(path: str, value: dict) -> None:
    """Write beside the target, then rename over it."""
    _Files(path.rsplit("/", 1)[0]).put(path, _json(value))


def current(root: str) -> dict:
    """The pointer: a small regular file with a valid id and version."""
    path, files = f"{root}/current.json", _Files(root)
    status = files.status(path)
    if status is None or status.isSymlink() or not status.isFile():
        raise SnapshotError("no pointer")
    try:
        value = json.loads(files.read(path, MOST_POINTER_BYTES))
        good = ID.fullmatch(value["snapshot_id"]) and HASH.fullmatch(value["data_version"])
    except SnapshotError:
        raise
    except Exception as e:  # also what the file system says of an altered file
        raise SnapshotError("the pointer can't be read") from e
    if not good:
        raise SnapshotError("the pointer is not valid")
    return value


def safe_path(root: str, relative: str) -> str:
    """A path below ``root``; anything that leads out of it is refused."""
    parts = relative.split("/")
    if not relative or relative.startswith("/") or "\\" in relative or any(p in ("", ".", "..") for p in parts):
        raise SnapshotError(f"not a safe path: {relative!r}")
    files, at = _Files(root), root.rstrip("/")
    for p in parts:
        at = f"{at}/{p}"
        status = files.status(at)
        if status is not None and status.isSymlink():
            raise SnapshotError(f"leads out of the snapshot: {relative!r}")
    return at


def manifest(root: str, snapshot_id: str, version: str | None = None) -> dict:
    """The manifest of a snapshot; its parts must give its version, and that which is asked for."""
    path = safe_path(root, f"{snapshot_id}/manifest.json")
    try:
        value = json.loads(_Files(root).read(path, MOST_MANIFEST_BYTES))
        parts = value["parts"]
        good = value["snapshot_id"] == snapshot_id and all(ID.fullmatch(n) and HASH.fullmatch(h) for n, h in parts.items())
    except SnapshotError:
        raise
    except Exception as e:
        raise SnapshotError(f"the manifest of {snapshot_id} can't be read") from e
    if not good or content_root(parts) != value["data_version"] or version not in (None, value["data_version"]):
        raise SnapshotError("the manifest is not of this version")
    return value


def load(spark: SparkSession, root: str, check: bool = True, tries: int = 3) -> dict[str, DataFrame]:
    """The tables of the current snapshot; with ``check`` their digests and the root must agree.

    If the pointer moves on in the meantime, the tables it points to then are loaded instead, so none are mixed.
    """
    for _ in range(tries):
        pointer = current(root)
        parts = manifest(root, pointer["snapshot_id"], pointer["data_version"])["parts"]
        out = {}
        for name, digest in parts.items():
            out[name] = spark.read.parquet(f"{root}/{pointer['snapshot_id']}/{name}.parquet")
            if check and row_digest(out[name]).first()["digest"] != digest:
                raise SnapshotError(f"{name} was altered")
        if current(root) == pointer:
            return out
    raise SnapshotError("the pointer keeps moving")


def snapshots(root: str) -> list[dict]:
    """All complete snapshots, the current one first, then by id."""
    now, files = current(root)["snapshot_id"], _Files(root)
    found = [x for x in files.folders(root) if files.status(f"{root}/{x}/manifest.json") is not None]
    return [{"snapshot_id": x, "active": x == now} for x in sorted(found, key=lambda x: (x != now, x))]


def activate(root: str, snapshot_id: str) -> None:
    """Point to another complete snapshot, whose manifest is sound."""
    put_json(f"{root}/current.json", {"snapshot_id": snapshot_id, "data_version": manifest(root, snapshot_id)["data_version"]})


def delete(root: str, snapshot_id: str) -> None:
    """Remove a snapshot that is not the current one; its manifest goes first, so it is incomplete from then on."""
    if current(root)["snapshot_id"] == snapshot_id:
        raise SnapshotError("the current snapshot can't be deleted")
    files = _Files(root)
    files.at.delete(files.path(safe_path(root, f"{snapshot_id}/manifest.json")), False)
    files.at.delete(files.path(safe_path(root, snapshot_id)), True)


def problems(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(problem, id): what a sound corpus has none of: repeated ids, wrong line counts, orphan lines, dangling links."""
    counted = lines.groupBy("document_id").agg(F.countDistinct("line_number").alias("n"))
    say = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("document_id").alias("id"))
    repeated = documents.groupBy("document_id").count().where("count > 1")
    wrong = documents.join(counted, "document_id", "left").where("coalesce(n, 0) != line_count")
    orphan = counted.join(documents.select("document_id"), "document_id", "left_anti")
    ids = documents.select("document_id").distinct()
    links = documents.select(F.explode(F.array("previous_document_id", "next_document_id")).alias("document_id")).where("document_id IS NOT NULL").distinct()
    dangling = links.join(ids, "document_id", "left_anti")
    return say(repeated, "repeated id").unionAll(say(wrong, "line count")).unionAll(say(orphan, "orphan lines")).unionAll(say(dangling, "dangling link"))


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that are required and not present."""
    return required.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def newest_common(names: list[DataFrame], name: str = "name", date: str = "date") -> DataFrame:
    """The newest entry all catalogues have: latest date, then greatest name."""
    common = names[0].select(name, date)
    for other in names[1:]:
        common = common.intersect(other.select(name, date))
    return common.orderBy(F.desc(date), F.desc(name)).limit(1)
