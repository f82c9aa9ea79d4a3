"""Release archives (ZIP) as a Spark data source.

``read_table`` of one release table has an input partition per archive
member: planning reads only the archives' directories (their last bytes),
a task seeks to its member and streams it, so memory does not depend on
the archive's size and the nine tables of a month unpack side by side.
Only the allow-listed columns leave the source, by canonical name and as
strings. Files are reached through the file system that the path's scheme
names (``file``, ``hdfs``, ``s3``, ``gs``, ``abfs``), in the tasks too.

Members are recognised as their publisher writes them: punctuation and
case of the name do not count, a table's prefix begins it and the
competence with ``.csv`` ends it. Absolute names and names with ``..``
are never read. An archive with two members for a table, or without a
required one, is refused before anything is read.

``land_releases`` writes the tables as Parquet, partitioned by
competence, so that later plans split them and read only their columns.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package
from .release import (MEMBER_PREFIXES, OPTIONAL_TABLES, TABLE_FIELDS, MissingColumnsError, chosen_headers)

MANIFEST_SCHEMA = ("archive string, member string, table_name string, competencia string, "
                   "bytes long, status string")
ARCHIVE_NAME = re.compile(r"BASE_DE_DADOS_CNES_([0-9]{6})\.ZIP", re.IGNORECASE)
BATCH_ROWS = 8192


class ArchiveError(ValueError):
    pass


def base_name(path: str) -> str:
    return path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]


def competence_of(archive: str) -> str | None:
    m = ARCHIVE_NAME.fullmatch(base_name(archive))
    return m.group(1) if m else None


def safe_name(name: str) -> bool:
    path = PurePosixPath(name.replace("\\", "/"))
    return not (path.is_absolute() or ".." in path.parts or re.match(r"[A-Za-z]:", name))


def tables_of_member(name: str, competence: str) -> list[str]:
    """Tables whose prefix begins the name (letters, digits and points only) and whose competence ends it."""
    plain = re.sub(r"[^a-z0-9.]", "", base_name(name).casefold())
    return [t for t, prefix in MEMBER_PREFIXES.items() if plain.startswith(prefix) and plain.endswith(f"{competence}.csv")]


def open_seekable(path: str):
    """A file for random access on whatever file system the path names."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        # file:/x, as Spark writes local paths, is file:///x
        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def members(archive: str) -> list[dict]:
    """One record for the archive, one per (member, table) and one per unsafe member: a read of its directory."""
    competence = competence_of(archive)
    if competence is None:
        return [{"archive": archive, "member": None, "table_name": None, "competencia": None, "bytes": 0,
                 "status": "archive_name_rejected"}]
    out = [{"archive": archive, "member": None, "table_name": None, "competencia": competence, "bytes": 0, "status": "archive"}]
    with open_seekable(archive) as f, zipfile.ZipFile(f) as z:
        for info in z.infolist():
            record = {"archive": archive, "member": info.filename, "competencia": competence, "bytes": info.file_size}
            if info.is_dir():
                continue
            if not safe_name(info.filename):
                out.append({**record, "table_name": None, "status": "unsafe_name"})
                continue
            out += [{**record, "table_name": t, "status": "ok"} for t in tables_of_member(info.filename, competence)]
    return out


class Member(InputPartition):
    def __init__(self, archive: str, member: str, competence: str):
        super().__init__(None)
        self.archive, self.member, self.competence = archive, member, competence


class ReleaseReader(DataSourceReader):
    def __init__(self, archives: list[str], table: str | None):
        self.archives, self.table = archives, table

    def partitions(self) -> Sequence[InputPartition]:
        found = [m for a in self.archives for m in members(a) if m["status"] == "ok" and m["table_name"] == self.table]
        # never empty: Spark would read one partition without a member
        return [Member(m["archive"], m["member"], m["competencia"]) for m in found] or [Member("", "", "")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.archive:
            return
        with open_seekable(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, encoding="latin-1", newline=""), delimiter=";", quotechar='"')
            where = f"{base_name(partition.archive)}/{partition.member}"
            header = next(rows, None)
            if header is None:
                raise MissingColumnsError(f"no header: {where}")
            chosen = chosen_headers(header, TABLE_FIELDS[self.table], where)
            at = [header.index(h) for h in chosen.values()]
            for number, row in enumerate(rows, 2):
                if not row:
                    continue
                if len(row) != len(header):
                    raise ArchiveError(f"{where}: row {number} has {len(row)} fields, the header {len(header)}")
                # an empty field is no value, as in Spark's own reader
                yield (partition.competence, *[row[i] or None for i in at])


class ReleaseArchives(DataSource):
    """``format("release_archive")`` with options ``archives`` (JSON list of paths) and ``table``."""

    @classmethod
    def name(cls) -> str:
        return "release_archive"

    def schema(self) -> str:
        return ", ".join(["competencia string", *[f"`{c}` string" for c in TABLE_FIELDS[self.options["table"]]]])

    def reader(self, schema) -> DataSourceReader:
        return ReleaseReader(json.loads(self.options["archives"]), self.options["table"])


class AnnualReader(DataSourceReader):
    def __init__(self, archives: list[str], columns: list[str]):
        self.archives, self.columns = archives, columns

    def partitions(self) -> Sequence[InputPartition]:
        return [Member(a, only_csv(a), "") for a in self.archives]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open_seekable(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, encoding="latin-1", newline=""), delimiter=";", quotechar='"')
            header = next(rows, [])
            missing = [c for c in self.columns if c not in header]
            if missing:
                raise MissingColumnsError(f"{partition.archive}: no column {', '.join(missing)}")
            at = [header.index(c) for c in self.columns]
            for row in rows:
                if row:
                    yield tuple(row[i] if i < len(row) else None for i in at)


class AnnualArchives(DataSource):
    """``format("annual_archive")``: ZIPs of exactly one CSV; the first one's header gives the columns."""

    @classmethod
    def name(cls) -> str:
        return "annual_archive"

    def _columns(self) -> list[str]:
        first = json.loads(self.options["archives"])[0]
        with open_seekable(first) as f, zipfile.ZipFile(f) as z, z.open(only_csv(first)) as raw:
            return next(csv.reader(io.TextIOWrapper(raw, encoding="latin-1", newline=""), delimiter=";", quotechar='"'), [])

    def schema(self) -> str:
        return ", ".join(f"`{c.replace('`', '``')}` string" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return AnnualReader(json.loads(self.options["archives"]), schema.fieldNames())


def only_csv(archive: str) -> str:
    with open_seekable(archive) as f, zipfile.ZipFile(f) as z:
        found = [i.filename for i in z.infolist() if not i.is_dir() and safe_name(i.filename) and i.filename.casefold().endswith(".csv")]
    if len(found) != 1:
        raise ArchiveError(f"{archive}: {len(found)} CSV members instead of one")
    return found[0]


def manifest(spark: SparkSession, archives: Sequence[str]) -> DataFrame:
    """One row per (member, table) of all archives; their directories are read in tasks."""
    ship_package(spark)
    sc = spark.sparkContext
    paths = spark.createDataFrame([(a,) for a in archives], "archive string") \
        .repartition(max(1, min(len(archives), 4 * sc.defaultParallelism)))

    def run(frames):
        import pandas as pd
        for frame in frames:
            rows = [m for a in frame["archive"] for m in members(a)]
            yield pd.DataFrame(rows, columns=["archive", "member", "table_name", "competencia", "bytes", "status"])

    return paths.mapInPandas(run, MANIFEST_SCHEMA)


def manifest_problems(rows: DataFrame) -> DataFrame:
    """Per archive: missing required tables, tables with more than one member, refused names."""
    required = F.array(*[F.lit(t) for t in sorted(set(MEMBER_PREFIXES) - OPTIONAL_TABLES)])
    empty = F.array().cast("array<string>")
    ok, refused = F.col("status") == "ok", ~F.col("status").isin("ok", "archive")
    per = rows.groupBy("archive", "competencia", "table_name").agg(
        F.count_if(ok).alias("n"), F.collect_set(F.when(refused, F.col("status"))).alias("refused"))
    found = per.groupBy("archive", "competencia").agg(
        F.collect_set(F.when(F.col("n") > 0, F.col("table_name"))).alias("_tables"),
        F.collect_set(F.when(F.col("n") > 1, F.col("table_name"))).alias("duplicadas"),
        F.array_distinct(F.flatten(F.collect_list("refused"))).alias("rejeicoes"))
    return found.select("archive", "competencia", F.array_sort(F.array_except(required, "_tables")).alias("faltando"),
                        F.array_sort(F.coalesce("duplicadas", empty)).alias("duplicadas"),
                        F.array_sort(F.coalesce("rejeicoes", empty)).alias("rejeicoes"))


def check_archives(spark: SparkSession, archives: Sequence[str], max_bytes: int | None = None) -> DataFrame:
    """The manifest, written once; ArchiveError for names that are no release, missing or duplicate tables, or too many bytes."""
    from ..session import materialize
    rows = materialize(manifest(spark, archives), "manifest")
    problems = [r.asDict() for r in manifest_problems(rows).where(
        (F.size("faltando") > 0) | (F.size("duplicadas") > 0) | F.array_contains("rejeicoes", "archive_name_rejected")).collect()]
    if problems:  # one row per archive
        raise ArchiveError(f"invalid release archives: {problems}")
    if max_bytes is not None:
        large = rows.where("status = 'ok'").groupBy("archive").agg(F.sum("bytes").alias("n")).where(F.col("n") > max_bytes).collect()
        if large:
            raise ArchiveError(f"archives with more than {max_bytes} bytes of tables: {[r.archive for r in large]}")
    return rows


def read_table(spark: SparkSession, archives: Sequence[str], table: str) -> DataFrame:
    """``competencia`` and the canonical columns of one release table, straight from the archives."""
    ship_package(spark)
    spark.dataSource.register(ReleaseArchives)
    return spark.read.format("release_archive").option("archives", json.dumps(list(archives))).option("table", table).load()


def read_annual(spark: SparkSession, archives: Sequence[str]) -> DataFrame:
    """All columns (strings) of annual archives that hold exactly one CSV each."""
    ship_package(spark)
    spark.dataSource.register(AnnualArchives)
    return spark.read.format("annual_archive").option("archives", json.dumps(list(archives))).load()


def land_releases(spark: SparkSession, archives: Sequence[str], landing: str,
                  max_bytes: int | None = None) -> dict[str, DataFrame]:
    """Check the archives, write their tables below ``landing`` and return them, read back.

    A table is overwritten for exactly the competences that came, so a
    repeated run leaves the same rows.
    """
    found = check_archives(spark, archives, max_bytes)
    present = {r.table_name for r in found.where("status = 'ok'").select("table_name").distinct().collect()}  # nine at most
    tables = {}
    for table in TABLE_FIELDS:
        if table in present:
            path = f"{landing.rstrip('/')}/{table}"
            rows = read_table(spark, archives, table)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("competencia").parquet(path)
            tables[table] = landed(spark, landing, table)
    return tables


def landed(spark: SparkSession, landing: str, table: str) -> DataFrame:
    schema = ", ".join([*[f"`{c}` string" for c in TABLE_FIELDS[table]], "competencia string"])
    return spark.read.schema(schema).parquet(f"{landing.rstrip('/')}/{table}")


def landed_tables(tables: Mapping[str, DataFrame], competences: Sequence[str]) -> dict[str, DataFrame]:
    """The landed tables of some competences (partition pruning)."""
    return {t: df.where(F.col("competencia").isin(list(competences))) for t, df in tables.items()}
