"""SQLite catalogs as a Spark data source, read by rowid ranges and written by keyed batches."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

TABLE = "justinmetadata"
#: Rows of a statement in deletes and updates.
DELETE_BATCH, UPDATE_BATCH = 12_321, 1000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def table_columns(path: str, table: str = TABLE) -> list[tuple[str, str]]:
    """(name, declared type) of each column."""
    with _connect(path) as c:
        return [(r[1], (r[2] or "").upper()) for r in c.execute(f"PRAGMA table_info({quoted(table)})")]


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.table, self.parts = options.get("table", TABLE), int(options.get("partitions", 8))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Equality, ranges, IN and IS NOT NULL on single columns become SQL."""
        ops = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
        for f in filters:
            column = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and type(f) in ops:
                self.where.append((f"{column} {ops[type(f)]} ?", [f.value]))
            elif column and isinstance(f, In):
                self.where.append((f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif column and isinstance(f, IsNotNull):
                self.where.append((f"{column} IS NOT NULL", []))
            else:
                yield f

    def partitions(self) -> list[Range]:
        with _connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(x, min(x + step - 1, high)) for x in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        names = ", ".join("rowid" if f.name == "rowid" else quoted(f.name) for f in self.schema)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(w for w, _ in self.where)])
        args = [part.low, part.high, *(a for _, v in self.where for a in v)]
        kinds = [f.dataType for f in self.schema]
        with _connect(self.path) as c:
            for row in c.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {where}", args):
                yield tuple(map(_value, row, kinds))


def _value(v, kind):
    if v is None or isinstance(kind, BinaryType):
        return v
    if isinstance(kind, StringType):
        return v if isinstance(v, str) else v.decode(errors="replace") if isinstance(v, bytes) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    try:
        return int(v) if isinstance(kind, LongType) else float(v)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_catalog").option("path", ...)``; options table, columns (comma-separated: only these are
    read), partitions. The row identity comes as ``rowid``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_catalog"

    def schema(self) -> StructType:
        wanted = [x.strip() for x in self.options.get("columns", "").split(",") if x.strip()]
        kind = lambda t: LongType() if "INT" in t else DoubleType() if any(x in t for x in ("REAL", "FLOA", "DOUB")) else BinaryType() if "BLOB" in t else StringType()
        have = dict(table_columns(self.options["path"], self.options.get("table", TABLE)))
        names = [n for n in (wanted or have) if n in have and n.lower() != "rowid"]
        return StructType([StructField("rowid", LongType()), *(StructField(n, kind(have[n])) for n in names)])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_catalog(spark: SparkSession, path: str, table: str = TABLE, columns: tuple[str, ...] = (), partitions: int = 8) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; a reader that can push filters fails without
    spark.dataSource.register(SqliteSource)
    r = spark.read.format("sqlite_catalog").option("path", path).option("table", table).option("partitions", str(partitions))
    return (r.option("columns", ",".join(columns)) if columns else r).load()


def delete_rows(path: str, ids: DataFrame, key: str = "rowid", table: str = TABLE) -> int:
    """Deletes by id in batches, ids streaming through the driver a partition at a time (the file has one writer)."""
    return _batched(path, ids.select(key), DELETE_BATCH, lambda n: f"DELETE FROM {quoted(table)} WHERE rowid IN ({', '.join('?' * n)})", flat=True)


def set_column(path: str, updates: DataFrame, column: str, key: str = "rowid", table: str = TABLE) -> int:
    """Writes (key, value) into one column, added as text if the table lacks it; returns how many rows were found."""
    with sqlite3.connect(path) as c:
        if column not in dict(table_columns(path, table)):
            c.execute(f"ALTER TABLE {quoted(table)} ADD COLUMN {quoted(column)} TEXT")
    return _batched(path, updates.select("value", key), UPDATE_BATCH, lambda _: f"UPDATE {quoted(table)} SET {quoted(column)} = ? WHERE rowid = ?", flat=False)


def _batched(path: str, rows: DataFrame, size: int, sql, flat: bool) -> int:
    done, batch = 0, []
    with sqlite3.connect(path) as c:
        c.execute("PRAGMA journal_mode=WAL")
        most = c.getlimit(sqlite3.SQLITE_LIMIT_VARIABLE_NUMBER)

        def flush() -> int:
            if flat:
                return c.execute(sql(len(batch)), [r[0] for r in batch]).rowcount
            return c.executemany(sql(1), [tuple(r) for r in batch]).rowcount

        for r in rows.toLocalIterator():
            batch.append(r)
            if len(batch) == min(size, most):
                done += flush()
                batch = []
        if batch:
            done += flush()
    return done


def write_catalog(df: DataFrame, path: str, table: str = TABLE) -> None:
    """A new SQLite catalog with these rows (``rowid`` kept), streaming through the driver a partition at a time."""
    kind = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    names = [c for c in df.columns if c != "rowid"]
    kinds = dict(df.dtypes)
    with sqlite3.connect(path) as c:
        c.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(n)} {kind.get(kinds[n], 'TEXT')}' for n in names)})")
        sql = f"INSERT INTO {quoted(table)} (rowid, {', '.join(map(quoted, names))}) VALUES ({', '.join('?' * (len(names) + 1))})"
        plain = df.select("rowid", *(df[n] if kinds[n] in kind or kinds[n] == "string" else df[n].cast("string") for n in names))
        c.executemany(sql, (tuple(r) for r in plain.toLocalIterator()))
