"""MetaTable: a table of subjects or observations on Parquet snapshots, with pushed-down reads and atomic changes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.errors import SchemaError
from tomolake.operators import frames
from tomolake.plans.predicate import predicate
from tomolake.storage import Store, snapshot

KINDS = {"int32": "int", "int64": "bigint", "int16": "smallint", "uint8": "smallint", "uint16": "int", "float32": "float", "float64": "double", "bool": "boolean", "str": "string", "object": "string"}


def spark_type(kind) -> str:
    name = getattr(kind, "__name__", None) or str(kind)
    if name.startswith(("U", "<U", "S", "string")) or name == "str":
        return "string"
    if name in KINDS:
        return KINDS[name]
    if name in KINDS.values():
        return name
    raise SchemaError(f"unknown column type {kind!r}")


def check_columns(names: Sequence[str], keys: Sequence[str]) -> None:
    for n in names:
        if "\0" in n:
            raise SchemaError(f"a column name holds a NUL: {n!r}")
        if n in keys:
            raise SchemaError(f"column {n!r} clashes with an index column")


class MetaTable:
    """``uri``/_table.json names the current snapshot; every change writes another and renames the manifest."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri, self.store = spark, uri.rstrip("/"), Store(spark)
        m = self.store.read_json(f"{self.uri}/_table.json")
        self.keys: list[str] = m["keys"]
        self._snap: str = m["snapshot"]

    @classmethod
    def create(cls, spark: SparkSession, uri: str, schema: dict[str, object] | DataFrame, keys: Sequence[str] = (frames.SUBJECT, frames.OBS)) -> MetaTable:
        """An empty table of the columns of ``schema``, or one with the rows of a DataFrame."""
        if isinstance(schema, dict):
            check_columns(list(schema), keys)
            ddl = ", ".join([*(f"`{k}` string" for k in keys), *(f"`{k}` {spark_type(v)}" for k, v in schema.items())])
            df = spark.createDataFrame([], ddl)
        else:
            df = schema
            if missing := [k for k in keys if k not in df.columns]:
                raise SchemaError(f"index columns {missing} are missing")
        df = df.select(*keys, *(c for c in df.columns if c not in keys))
        rel = snapshot(df.repartitionByRange(*keys).sortWithinPartitions(*keys) if not isinstance(schema, dict) else df, uri.rstrip("/"), "rows")
        Store(spark).write_json(f"{uri.rstrip('/')}/_table.json", {"keys": list(keys), "snapshot": rel})
        return cls(spark, uri)

    @classmethod
    def from_pandas(cls, spark: SparkSession, uri: str, pdf: pd.DataFrame, keys: Sequence[str] = (frames.SUBJECT, frames.OBS)) -> MetaTable:
        return cls.create(spark, uri, spark.createDataFrame(pdf), keys)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/{self._snap}")

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def __len__(self) -> int:
        return self.df.count()

    def read(self, columns: Sequence[str] | None = None, value_filter: str | None = None, include_index: bool = True) -> DataFrame:
        """Projection and predicate, both pushed to the scan; index columns first."""
        df = self.df
        if value_filter:
            df = df.where(predicate(value_filter, df.columns))
        if unknown := [c for c in columns or [] if c not in df.columns]:
            raise SchemaError(f"unknown columns {unknown}")
        names = [c for c in (columns if columns is not None else df.columns) if c not in self.keys]
        return df.select(*(self.keys if include_index else []), *names)

    def _swap(self, df: DataFrame) -> None:
        rel = snapshot(df, self.uri, "rows")
        self.store.write_json(f"{self.uri}/_table.json", {"keys": self.keys, "snapshot": rel})
        self._snap = rel

    def add_column(self, name: str, dtype, fill=None) -> None:
        check_columns([name], self.keys)
        self._swap(frames.add_column(self.df, name, spark_type(dtype), fill))

    def drop_column(self, name: str) -> None:
        self._swap(frames.drop_column(self.df, name, self.keys))

    def update(self, rows: DataFrame | pd.DataFrame, columns: Sequence[str] | None = None) -> None:
        """Upsert by the index columns; columns that ``rows`` lacks, or that are not among ``columns``, keep their values, new rows have nulls there."""
        delta = self.spark.createDataFrame(rows) if isinstance(rows, pd.DataFrame) else rows
        if missing := [k for k in self.keys if k not in delta.columns]:
            raise SchemaError(f"index columns {missing} are missing")
        if columns is not None:
            if unknown := [c for c in columns if c not in delta.columns]:
                raise SchemaError(f"unknown columns {unknown}")
            delta = delta.select(*self.keys, *(c for c in columns if c not in self.keys))
        self._swap(frames.upsert(self.df, delta, *self.keys))

    def delete(self, condition: str) -> None:
        df = self.df
        self._swap(frames.delete(df, predicate(condition, df.columns)))

    def append(self, rows: DataFrame) -> None:
        self._swap(frames.append(self.df, rows))

    def row(self, key: str, value: str) -> DataFrame:
        return self.df.where(F.col(key) == value)
