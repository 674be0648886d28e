"""Tables: Parquet folders in versions, with the DML and metadata of a small database.

A change never touches the files that a reader may hold: it writes new files beside the
old ones and then a new catalog (one small file, complete once its folder has _SUCCESS),
which a store opened on the same folder reads. A folder has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {
    "INT": T.IntegerType(),
    "FLOAT": T.DoubleType(),
    "BOOL": T.BooleanType(),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "POINT": T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]),
}
ENGINES = ("HEAP", "SEQUENTIAL")
RESERVED = "Sys"
#: Folders of files that inserts may add to a table before all its rows are written anew.
MOST_PARTS = 16


class TableError(ValueError):
    """A statement that the tables cannot carry out."""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than cores over all cores, before work that costs more than moving it.

    A large table has splits enough and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    length: int | None = None
    primary: bool = False

    def field(self) -> T.StructField:
        meta = {"kind": self.kind} | ({"length": self.length} if self.length else {}) | ({"primary": True} if self.primary else {})
        return T.StructField(self.name, TYPES[self.kind], True, meta)


@dataclass
class Table:
    name: str
    columns: tuple[ColumnSpec, ...]
    engine: str
    data: DataFrame
    indexes: dict[str, dict] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    version: str = ""  # another one after every change of rows
    saved: dict[str, list[str]] = field(default_factory=dict)  # index: the version it was built of, its folder
    attached: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])


class Store:
    """Named tables under a folder, or in memory without one.

    ``attach`` adds any DataFrame as a table; it is no part of the catalog until rows of it change.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.tables: dict[str, Table] = {}
        self.plugins: dict[str, dict] = {}
        self.turn = 0
        if folder:
            self._open()

    def _listed(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().toString() for f in found or ())

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _open(self) -> None:
        done = self._listed("catalog/*/_SUCCESS")
        if not done:
            return
        last = done[-1].rsplit("/", 1)[0]
        self.turn = int(last.rsplit("/", 1)[1])
        state = json.loads(self.spark.read.text(last).first()[0])
        self.plugins = state["plugins"]
        for t in state["tables"]:
            columns = tuple(ColumnSpec(**c) for c in t.pop("columns"))
            made = Table(columns=columns, data=None, **t)
            made.data = self._read(made)
            self.tables[made.name] = made

    def commit(self) -> None:
        """Write the catalog; the one before it stays until the next."""
        if not self.folder:
            return
        keep = ("name", "engine", "indexes", "parts", "version", "saved")
        tables = [{k: getattr(t, k) for k in keep} | {"columns": [asdict(c) for c in t.columns]} for t in self.tables.values() if not t.attached]
        state = json.dumps({"plugins": self.plugins, "tables": tables})
        self.turn += 1
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/catalog/{self.turn:012d}")
        for old in self._listed("catalog/*")[:-2]:
            self._delete(old)

    def vacuum(self) -> int:
        """Delete the files of former versions, dropped tables and indexes; only while no reader holds them."""
        if not self.folder:
            return 0
        held = {p.rsplit("/", 1)[1] for t in self.tables.values() for p in [*t.parts, *(f for _, f in t.saved.values())]}
        gone = [f for f in self._listed("tables/*/*") + self._listed("indexes/*/*") if f.rsplit("/", 1)[1] not in held]
        for f in gone:
            self._delete(f)
        return len(gone)

    def attach(self, name: str, data: DataFrame) -> None:
        kinds = {"int": "INT", "bigint": "INT", "smallint": "INT", "tinyint": "INT", "double": "FLOAT", "float": "FLOAT", "boolean": "BOOL"}
        columns = tuple(ColumnSpec(f.name, kinds.get(f.dataType.simpleString(), "POINT" if f.dataType == TYPES["POINT"] else "TEXT")) for f in data.schema)
        self.tables[name] = Table(name, columns, "HEAP", data, attached=True)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise TableError(f"no table {name}")
        return self.tables[name]

    def frame(self, name: str) -> DataFrame:
        return self.system(name) if name.startswith(RESERVED) else self.table(name).data

    def create(self, name: str, columns: Sequence[ColumnSpec], engine: str = "HEAP") -> None:
        names = [c.name for c in columns]
        if name in self.tables or name.startswith(RESERVED):
            raise TableError(f"table {name} exists or is reserved")
        if len(set(names)) < len(names) or not names:
            raise TableError("column names must be there and differ")
        if engine not in ENGINES:
            raise TableError(f"engine {engine} is none of {ENGINES}")
        made = Table(name, tuple(columns), engine, None, version=uuid.uuid4().hex)
        made.data = self._read(made)
        self.tables[name] = made
        self.commit()

    def drop(self, name: str) -> None:
        self.table(name)
        del self.tables[name]
        self.commit()

    def _read(self, t: Table) -> DataFrame:
        return self.spark.read.schema(t.schema()).parquet(*t.parts) if t.parts else self.spark.createDataFrame([], t.schema())

    def _typed(self, t: Table, data: DataFrame) -> DataFrame:
        data = data.select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in t.schema()))
        if t.engine == "SEQUENTIAL":  # each part in order of the first column, for min/max pruning
            data = data.repartitionByRange(t.columns[0].name).sortWithinPartitions(t.columns[0].name)
        return data

    def _written(self, t: Table, data: DataFrame) -> str:
        path = f"{self.folder}/tables/{t.name}/{uuid.uuid4().hex}"
        self._typed(t, data).write.parquet(path)
        return path

    def _swap(self, t: Table, data: DataFrame) -> None:
        if self.folder:
            t.parts, t.attached = [self._written(t, data)], False
            t.data = self._read(t)
        else:
            t.data = self._typed(t, data)
        t.version = uuid.uuid4().hex
        self.commit()

    def _add(self, t: Table, rows: DataFrame) -> None:
        """Files beside those that are there; a table of many parts is written anew."""
        if not self.folder or t.attached or len(t.parts) >= MOST_PARTS:
            return self._swap(t, t.data.unionByName(rows))
        t.parts = [*t.parts, self._written(t, rows)]
        t.data, t.version = self._read(t), uuid.uuid4().hex
        return self.commit()

    def insert(self, name: str, rows: Sequence[Sequence], columns: Sequence[str] | None = None) -> int:
        """Append rows; ``columns`` may come in any order but all of them must."""
        t = self.table(name)
        names = [c.name for c in t.columns]
        order = list(columns or names)
        if sorted(order) != sorted(names) or any(len(r) != len(order) for r in rows):
            raise TableError("an INSERT gives a value for every column")
        made = []
        for row in rows:
            values = dict(zip(order, row, strict=True))
            made.append(tuple(self._checked(c, values[c.name]) for c in t.columns))
        self._add(t, self.spark.createDataFrame(made, t.schema()))
        return len(made)

    @staticmethod
    def _checked(c: ColumnSpec, v):
        fits = {"INT": lambda: type(v) is int and -(1 << 31) <= v < 1 << 31, "FLOAT": lambda: type(v) is float, "BOOL": lambda: type(v) is bool, "TEXT": lambda: type(v) is str, "VARCHAR": lambda: type(v) is str and (c.length is None or len(v) <= c.length), "POINT": lambda: len(v) == 2}
        if v is not None and not fits[c.kind]():
            raise TableError(f"{v!r} is no {c.kind}{f'({c.length})' if c.length else ''} for {c.name}")
        return v

    def append(self, name: str, data: DataFrame) -> None:
        self._add(self.table(name), data)

    def delete(self, name: str, where: Column | None = None) -> int:
        t = self.table(name)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        gone = t.data.filter(hit).count()
        self._swap(t, t.data.filter(~hit))
        return gone

    def update(self, name: str, changes: dict[str, Column], where: Column | None = None) -> int:
        t = self.table(name)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        changed = t.data.filter(hit).count()
        self._swap(t, updated(t.data, changes, hit))
        return changed

    def create_index(self, name: str, table: str, column: str, kind: str, **options) -> None:
        t = self.table(table)
        if column not in t.data.columns:
            raise TableError(f"no column {column} in {table}")
        if any(name in x.indexes for x in self.tables.values()):
            raise TableError(f"index {name} exists")
        t.indexes[name] = {"column": column, "kind": kind} | options
        self.commit()

    def drop_index(self, name: str) -> None:
        owner = next((t for t in self.tables.values() if name in t.indexes), None)
        if owner is None:
            raise TableError(f"no index {name}")
        del owner.indexes[name]
        owner.saved.pop(name, None)
        self.commit()

    def system(self, name: str) -> DataFrame:
        """SysTables, SysColumns, SysIndexes, SysPlugins, SysTypes, SysPluginIndexes."""
        tables = sorted(self.tables.values(), key=lambda t: t.name)
        indexes = [(n, t.name, i["column"], i["kind"]) for t in tables for n, i in sorted(t.indexes.items())]
        scalar = ("BTREE", "HASH", "RTREE")
        rows = {
            "SysTables": ([(t.name, t.engine, len(t.columns)) for t in tables], "name string, engine string, columns int"),
            "SysColumns": ([(t.name, k, c.name, c.kind, c.length, c.primary) for t in tables for k, c in enumerate(t.columns)], "table_name string, position int, name string, type string, length int, primary_key boolean"),
            "SysIndexes": ([i for i in indexes if i[3] in scalar], "name string, table_name string, column_name string, kind string"),
            "SysPluginIndexes": ([i for i in indexes if i[3] not in scalar], "name string, table_name string, column_name string, algorithm string"),
            "SysPlugins": ([(n, str(o)) for n, o in sorted(self.plugins.items())], "name string, options string"),
            "SysTypes": ([(k, t.simpleString()) for k, t in TYPES.items()], "name string, spark_type string"),
        }
        if name not in rows:
            raise TableError(f"no system table {name}")
        return self.spark.createDataFrame(*rows[name])


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def deleted(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true (null keeps a row)."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def updated(df: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in df.columns))
