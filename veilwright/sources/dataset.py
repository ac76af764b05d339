"""Where tables come from and where results go.

A dataset names databases and tables and hands out DataFrames. Three kinds: folders of
files, databases of Spark's catalog, and a JDBC server read in key ranges.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import SchemaError


class Dataset:
    def databases(self) -> list[str]:
        raise NotImplementedError

    def has_table(self, database: str, table: str) -> bool:
        raise NotImplementedError

    def is_base_table(self, database: str, table: str) -> bool:
        return True

    def table(self, database: str, table: str) -> DataFrame:
        raise NotImplementedError

    def overlay(self, database: str, table: str) -> dict:
        """Lengths, keys and other facts that the stored format does not keep."""
        return {}

    def layout(self, database: str, table: str) -> tuple:
        """Format and partition columns that a rewritten table keeps; empty for plain parquet."""
        return ()

    def enter(self, spark: SparkSession, database: str) -> None:
        """Make the database's tables visible to SQL steps."""

    def leave(self, spark: SparkSession, database: str) -> None:
        """Undo `enter`: the next database's steps must not see this one's tables."""


class Tables(Dataset):
    """DataFrames by database and table name."""

    def __init__(self, tables: dict[str, dict[str, DataFrame]], overlays: dict | None = None):
        self._tables = tables
        self._overlays = overlays or {}

    def databases(self):
        return sorted(self._tables)

    def has_table(self, database, table):
        return table in self._tables.get(database, {})

    def table(self, database, table):
        return self._tables[database][table]

    def overlay(self, database, table):
        return self._overlays.get(database, {}).get(table, {})

    def enter(self, spark, database):
        for name, frame in self._tables[database].items():
            frame.createOrReplaceTempView(name)

    def leave(self, spark, database):
        for name in self._tables[database]:
            spark.catalog.dropTempView(name)


class Folder(Dataset):
    """`root/<database>/<table>` folders or `<table>.parquet` files, in any format Spark reads."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", overlays: dict | None = None, **options):
        self._spark, self._root, self._format, self._options = spark, root.rstrip("/"), fmt, options
        self._overlays = overlays or {}

    def _children(self, path: str) -> list[str]:
        jvm = self._spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return []
        names = [status.getPath().getName() for status in files.listStatus(hadoop)]
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def databases(self):
        return self._children(self._root)

    def _path(self, database: str, table: str) -> str | None:
        present = self._children(f"{self._root}/{database}")
        for name in (table, f"{table}.{self._format}"):
            if name in present:
                return f"{self._root}/{database}/{name}"
        return None

    def has_table(self, database, table):
        return self._path(database, table) is not None

    def layout(self, database, table):
        partitions, path = [], self._path(database, table)
        while folders := [n for n in self._children(path) if "=" in n]:
            partitions.append(folders[0].split("=", 1)[0])
            path = f"{path}/{folders[0]}"
        kept = self._format if self._format in ("parquet", "orc", "json", "avro") else "parquet"
        return () if kept == "parquet" and not partitions else (kept, tuple(partitions))

    def table(self, database, table):
        return self._spark.read.format(self._format).options(**self._options).load(self._path(database, table))

    def overlay(self, database, table):
        return self._overlays.get(database, {}).get(table, {})

    def enter(self, spark, database):
        for name in self._children(f"{self._root}/{database}"):
            table = os.path.splitext(name)[0]
            self.table(database, table).createOrReplaceTempView(table)

    def leave(self, spark, database):
        for name in self._children(f"{self._root}/{database}"):
            spark.catalog.dropTempView(os.path.splitext(name)[0])


class Catalog(Dataset):
    """Databases and tables of the session catalog."""

    def __init__(self, spark: SparkSession, overlays: dict | None = None):
        self._spark = spark
        self._overlays = overlays or {}

    def databases(self):
        return sorted(d.name for d in self._spark.catalog.listDatabases())

    def has_table(self, database, table):
        return self._spark.catalog.tableExists(f"`{database}`.`{table}`")

    def is_base_table(self, database, table):
        return self._spark.catalog.getTable(f"`{database}`.`{table}`").tableType != "VIEW"

    def table(self, database, table):
        return self._spark.table(f"`{database}`.`{table}`")

    def overlay(self, database, table):
        return self._overlays.get(database, {}).get(table, {})

    def enter(self, spark, database):
        self._before = spark.catalog.currentDatabase()
        spark.catalog.setCurrentDatabase(database)

    def leave(self, spark, database):
        spark.catalog.setCurrentDatabase(self._before)


class Jdbc(Dataset):
    """Tables of a SQL server, read in parallel ranges of one numeric key column.

    `ranges[database][table]` gives (column, lower, upper, partitions). A table without them would be read by one task
    alone, so it is refused. Needs the driver's jar on the classpath, so reading is not exercised by the tests.
    """

    def __init__(self, spark: SparkSession, url: str, tables: dict[str, list[str]], ranges: dict, overlays=None, **options):
        self._spark, self._url, self._names, self._ranges, self._options = spark, url, tables, ranges, options
        self._overlays = overlays or {}

    def databases(self):
        return sorted(self._names)

    def has_table(self, database, table):
        return table in self._names.get(database, [])

    def table(self, database, table):
        if table not in self._ranges.get(database, {}):
            raise SchemaError(f"{database}.{table}: a JDBC table needs a key column with bounds and a number of partitions")
        column, lower, upper, partitions = self._ranges[database][table]
        reader = self._spark.read.format("jdbc").options(url=self._url, dbtable=f"{database}.{table}", **self._options)
        return reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        ).load()

    def overlay(self, database, table):
        return self._overlays.get(database, {}).get(table, {})


def matches_database(rule: dict, name: str) -> bool:
    """Exact name, or a pattern that must cover the whole name."""
    if rule.get("name"):
        return rule["name"] == name
    return re.fullmatch(rule["namePattern"], name) is not None


def match_databases(rules: list[dict], names: list[str], reserved: tuple[str, ...] = ()) -> list[tuple[dict, str]]:
    from ..errors import PolicyError

    matched: list[tuple[dict, str]] = []
    seen: set[str] = set()
    for rule in rules:
        hits = [name for name in sorted(names) if matches_database(rule, name)]
        if not hits and not rule.get("optional"):
            raise SchemaError("a database entry matches nothing")
        for name in hits:
            if name in seen or name in reserved:
                raise PolicyError("a database is matched twice or reserved")
            seen.add(name)
            matched.append((rule, name))
    return matched


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write to a new place; a table is never overwritten while it is read."""
    df.write.format(fmt).mode("errorifexists").save(path)


def truncated(df: DataFrame) -> DataFrame:
    """The table's schema without its rows."""
    return df.limit(0)
