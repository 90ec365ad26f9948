"""Writing: append, overwrite and keyed merge of Parquet tables.

A table is a folder. Every write puts its files into a new folder of its own, ``d-`` and a random name,
and then commits by creating ``_v00000001`` and so on, which lists the files of that version; a version
number is created once only, so of two writers that want the same number one gets it and the other goes
on from what the first has committed: an append or overwrite takes the next number, a merge starts over
from the new rows. Nobody else's files are ever overwritten, a failed job leaves the table as it was,
and a reader sees one version whole. (The file system must create a file exclusively, as HDFS and local
ones do.) ``vacuum`` removes files that no recent version lists.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Times a merge starts over before it gives up.
ATTEMPTS = 20


class IncompatibleSchema(ValueError):
    """A column that the target doesn't have."""


class RepeatedKey(ValueError):
    """Rows to be merged share a key, so which of them counts isn't said."""


class Conflict(RuntimeError):
    """Others committed again and again while a merge ran."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names() if (m := re.fullmatch(r"_v(\d{8,})", n)))

    def version(self) -> int:
        """The current version; 0 if the table has none yet."""
        return max(self.versions(), default=0)

    def _files(self, version: int) -> list[str]:
        """The files of a version, below the table's folder."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/_v{version:08d}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _commit(self, version: int, files: list[str]) -> bool:
        """Makes ``files`` the table's, if no one has that version yet."""
        fs, path = self._fs()
        ready, place = path(f"{self.path}/_t-{uuid.uuid4().hex}"), path(f"{self.path}/_v{version:08d}")
        text = "\n".join(files).encode()
        stream = fs.create(ready, False)
        try:
            stream.write(bytearray(text))
        finally:
            stream.close()
        try:  # a whole file under a name that must be new
            claim = fs.create(path(f"{self.path}/_c{version:08d}"), False)
            claim.close()
        except Exception as e:
            fs.delete(ready, False)
            if "Exist" in str(e):
                return False
            raise
        return bool(fs.rename(ready, place))

    def _claimed(self) -> int:
        """The highest number that a writer has taken, committed or not."""
        return max((int(m[1]) for n in self._names() if (m := re.fullmatch(r"_[vc](\d{8,})", n))), default=0)

    def _written(self, rows: DataFrame) -> list[str]:
        """Writes rows into a new folder; its files."""
        fs, path = self._fs()
        folder = f"d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(path(f"{self.path}/{folder}")) if s.getPath().getName().endswith(".parquet"))

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current version, or of an older one."""
        version = self.version() if version is None else version
        if not version:
            raise FileNotFoundError(self.path)
        return self._read(self._files(version))

    def exists(self) -> bool:
        return self.version() > 0

    def overwrite(self, rows: DataFrame) -> None:
        files = self._written(rows)
        while not self._commit(self._claimed() + 1, files):
            pass

    def append(self, rows: DataFrame) -> None:
        version = self.version()
        if version:
            target = self.read(version).schema
            check_columns(rows, target)
            rows = fitted(rows, target)
        files = self._written(rows)
        self._commit_over(lambda base: [*base, *files])

    def _commit_over(self, change, base: int | None = None) -> bool:
        """Commits ``change`` of the current files; with ``base``, only while that is the current version."""
        while True:
            claimed = self._claimed()
            version = self.version()
            if version < claimed:  # taken but not yet written: that writer is between two small steps, or gone
                self._settle(claimed)
                continue
            if base is not None and version != base:
                return False
            if self._commit(version + 1, change(self._files(version) if version else [])):
                return True

    def _settle(self, claimed: int) -> None:
        """Waits for a writer that has a number; a number that stays empty becomes a copy of the version before."""
        import time

        for _ in range(100):
            if self.version() >= claimed:
                return
            time.sleep(0.1)
        fs, path = self._fs()
        files = self._files(self.version()) if self.version() else []
        stream = fs.create(path(f"{self.path}/_v{claimed:08d}"), False)
        stream.write(bytearray("\n".join(files).encode()))
        stream.close()

    def merge(self, rows: DataFrame, keys: list[str]) -> None:
        """Rows with a key of the table change the columns that they have in its row; others are added.

        Null keys match null keys. Rows that share a key are refused, as which counts isn't said; a key
        that the table has repeatedly changes all its rows. Only files that hold a written key are
        written anew.
        """
        if not keys:
            raise ValueError("a merge needs keys")
        if rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise RepeatedKey(f"rows to be merged share a key of {keys}")
        for _ in range(ATTEMPTS):
            version = self.version()
            if not version:
                files = self._written(rows)
                if self._commit_over(lambda base, files=files: files, 0):
                    return
                continue
            base = self._files(version)
            target = self._read(base)
            check_columns(rows, target.schema)
            place = F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2))
            held = target.select(*keys, place.alias("__file"))
            touched = {r[0] for r in _matching(held, rows, keys, "left_semi").select("__file").distinct().collect()}  # names of files
            old = self._read(sorted(touched)) if touched else target.limit(0)
            files = self._written(merged(old, rows, keys))
            rest = [f for f in base if f not in touched]
            if self._commit_over(lambda _, rest=rest, files=files: [*rest, *files], version):
                return
        raise Conflict(self.path)

    def vacuum(self, keep: int = 2) -> int:
        """Removes what only versions before the last ``keep`` list, and those; the number of things removed.

        To be run while no one writes, or reads an older version.
        """
        fs, path = self._fs()
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        live = {f.split("/")[0] for v in kept for f in self._files(v)}
        gone = [n for n in self._names() if (n.startswith("d-") and n not in live) or n.startswith("_t-") or ((m := re.fullmatch(r"_[vc](\d{8,})", n)) and kept and int(m[1]) < kept[0])]
        for n in gone:
            fs.delete(path(f"{self.path}/{n}"), True)
        return len(gone)

    def write(self, rows: DataFrame, mode: str = "append", keys: list[str] | None = None) -> None:
        """By mode; keys make it a merge, which can't go with overwrite."""
        if keys and mode == "overwrite":
            raise ValueError("a merge can't overwrite the table")
        if keys:
            self.merge(rows, keys)
        elif mode == "overwrite":
            self.overwrite(rows)
        elif mode == "append":
            self.append(rows)
        else:
            raise ValueError(f"no such mode: {mode}")


def write_table(spark: SparkSession, path: str, rows: DataFrame, options: dict[str, str] | None = None, mode: str = "append") -> None:
    """Writes by options: write.typeMapping, write.complexAsJson, merge.byColumn (or merge.byColumn1 ...), batch.size.

    ``batch.size`` is the most rows of one file; Spark writes its own batches inside.
    """
    options = options or {}
    if options.get("write.typeMapping"):
        rows = mapped_types(rows, options["write.typeMapping"])
    if options.get("write.complexAsJson", "").lower() == "true":
        rows = complex_as_json(rows)
    keys = [c.strip() for k, v in sorted(options.items()) if re.fullmatch(r"merge\.byColumns?\d*", k) for c in v.split(",") if c.strip()]
    size = int(options.get("batch.size", 0))
    if size < 0:
        raise ValueError("a batch has one row or more")
    name, before = "spark.sql.files.maxRecordsPerFile", spark.conf.get("spark.sql.files.maxRecordsPerFile")
    try:
        if size:
            spark.conf.set(name, str(size))
        VersionedTable(spark, path).write(rows, mode, keys or None)
    finally:
        spark.conf.set(name, before)


def insert_into(spark: SparkSession, path: str, columns: list[str], values: list[tuple]) -> None:
    """A prepared INSERT: rows of values for named columns of a table, cast to its types; others are null."""
    table = VersionedTable(spark, path)
    target = {f.name.lower(): f for f in table.read().schema.fields}
    unknown = [c for c in columns if c.lower() not in target]
    if unknown:
        raise IncompatibleSchema(f"the target has no columns {unknown}")
    if any(len(v) != len(columns) for v in values):
        raise ValueError("a row needs a value for each column")
    marks = ", ".join(f"({', '.join('?' for _ in columns)})" for _ in values)
    names = ", ".join(f"`{c}`" for c in columns)
    rows = spark.sql(f"SELECT * FROM VALUES {marks} AS t({names})", args=[v for row in values for v in row])
    table.append(rows)


def check_columns(rows: DataFrame, target: T.StructType) -> None:
    """Every column must be in the target, in whatever case."""
    known = {f.name.lower() for f in target.fields}
    extra = [c for c in rows.columns if c.lower() not in known]
    if extra:
        raise IncompatibleSchema(f"the target has no columns {extra}")


def fitted(rows: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its order and types; missing ones are null."""
    own = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{own[f.name.lower()]}`") if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields])


def _matching(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """``left`` joined to the keys of ``right``; null keys match."""
    other = right.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)])
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & left[k].eqNullSafe(other[f"__{i}"])
    return left.join(other, condition, kind)


def merged(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a merge: its rows, with the columns that a written row of their key has, and new rows."""
    check_columns(rows, target.schema)
    given = {c.lower() for c in rows.columns}
    written = fitted(rows, target.schema)
    names = target.columns
    new = written.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], F.lit(True).alias("__hit"))
    number = {c.lower(): i for i, c in enumerate(names)}
    condition = F.lit(True)
    for k in keys:
        condition = condition & target[k].eqNullSafe(new[f"__{number[k.lower()]}"])
    changed = target.join(new, condition, "left").select(*[(F.when(F.col("__hit"), F.col(f"__{i}")).otherwise(target[c]) if c.lower() in given else target[c]).alias(c) for i, c in enumerate(names)])
    return changed.unionByName(_matching(written, target, keys, "left_anti"))


def mapped_types(rows: DataFrame, mapping: str) -> DataFrame:
    """Casts by a text of the form ``FROM:TO;FROM:TO`` over Spark's type names."""
    pairs = dict(p.split(":", 1) for p in mapping.replace(" ", "").split(";") if p)
    return rows.select(*[F.col(f"`{c}`").cast(pairs[kind]).alias(c) if kind in pairs else F.col(f"`{c}`") for c, kind in rows.dtypes])


def complex_as_json(rows: DataFrame) -> DataFrame:
    """Structs, maps and arrays as JSON text."""
    return rows.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)) else F.col(f"`{f.name}`") for f in rows.schema.fields])
