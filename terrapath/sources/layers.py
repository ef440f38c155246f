"""Layers as tables: read whatever is given, write and list by name."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


def as_layer(spark: SparkSession, x: DataFrame | str | None, optional: bool = False) -> DataFrame | None:
    """A table passes through, a path is read; None only where optional."""
    if isinstance(x, DataFrame):
        return x
    if isinstance(x, str):
        return spark.read.parquet(x)
    if x is None and optional:
        return None
    raise TypeError(f"a table or a path is needed, not {type(x).__name__}")


class Store(Protocol):
    def write(self, layer: str, df: DataFrame) -> str: ...
    def read(self, layer: str) -> DataFrame: ...
    def names(self) -> list[str]: ...


class FolderStore:
    """A folder of Parquet tables, one per layer; writing replaces, a missing folder has no layers."""

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, layer: str, df: DataFrame) -> str:
        path = f"{self.path}/{layer}"
        df.write.mode("overwrite").partitionBy(*self.partition_by).parquet(path)
        return path

    def read(self, layer: str) -> DataFrame:
        if layer not in self.names():
            raise KeyError(f"no layer {layer!r} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{layer}")

    def names(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def read_known(self, known: Sequence[str]) -> dict[str, DataFrame]:
        """The layers of `known` that exist; at least one must."""
        found = [n for n in known if n in self.names()]
        if not found:
            raise FileNotFoundError(f"none of {', '.join(known)} in {self.path}")
        return {n: self.read(n) for n in found}


class JdbcStore:
    """Layers as tables of a database schema; geometry columns hold WKB."""

    def __init__(self, spark: SparkSession, url: str, schema: str = "public", properties: dict | None = None):
        self.spark, self.url, self.schema, self.properties = spark, url, schema, properties or {}

    def ensure_schema_sql(self) -> str:
        return f'CREATE SCHEMA IF NOT EXISTS "{self.schema}"'

    def index_sql(self, layer: str, geometry: str = "geom") -> str:
        return f'CREATE INDEX IF NOT EXISTS "{layer}_{geometry}_idx" ON "{self.schema}"."{layer}" USING GIST ("{geometry}")'

    def list_sql(self) -> str:
        return f"(SELECT table_name FROM information_schema.tables WHERE table_schema = '{self.schema}') t"

    def execute(self, statement: str) -> None:
        """Run DDL through the JVM's driver manager."""
        jvm = self.spark.sparkContext._jvm
        props = jvm.java.util.Properties()
        for k, v in self.properties.items():
            props.setProperty(k, str(v))
        connection = jvm.java.sql.DriverManager.getConnection(self.url, props)
        try:
            connection.createStatement().execute(statement)
        finally:
            connection.close()

    def write(self, layer: str, df: DataFrame) -> str:
        self.execute(self.ensure_schema_sql())
        name = f'"{self.schema}"."{layer}"'
        df.write.jdbc(self.url, name, mode="overwrite", properties=self.properties)
        if "geom" in df.columns:
            self.execute(self.index_sql(layer))
        return name

    def read(self, layer: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, f'"{self.schema}"."{layer}"', properties=self.properties)

    def names(self) -> list[str]:
        return sorted(r[0] for r in self.spark.read.jdbc(self.url, self.list_sql(), properties=self.properties).collect())
