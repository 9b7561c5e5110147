"""The catalog: tables, keys and unique indexes, kept as one JSON file beside the data.

Files are reached through Hadoop's file system, so tables may lie on any store Spark can write.
The catalog is written to a new file that then takes the old one's place. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quarry.types import EngineType, storage_field


@dataclass
class Index:
    name: str
    column: str


@dataclass
class Table:
    name: str
    columns: list[tuple[str, EngineType]]
    key: list[str]
    folder: str
    indexes: list[Index] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([storage_field(n, t) for n, t in self.columns])

    def place(self, column: str) -> int:
        return [n for n, _ in self.columns].index(column)


class Store:
    """Files under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        self._gateway = spark.sparkContext._gateway
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def make(self) -> None:
        self._fs.mkdirs(self._at(""))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        new = f"{name}.{uuid.uuid4().hex}.new"
        stream = self._fs.create(self._at(new), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._gateway.new_array(self._rename, 1)
        options[0] = self._rename.OVERWRITE
        self._context.rename(self._at(new), self._at(name), options)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Catalog:
    FILE = "catalog.json"

    def __init__(self, store: Store):
        self.store = store
        self.tables: dict[str, Table] = {}
        if store.exists(self.FILE):
            for t in json.loads(store.read(self.FILE))["tables"]:
                columns = [(n, EngineType(**k)) for n, k in t["columns"]]
                self.tables[t["name"]] = Table(t["name"], columns, t["key"], t["folder"], [Index(**i) for i in t["indexes"]])
        else:
            store.make()
            self.save()

    def save(self) -> None:
        told = [{"name": t.name, "columns": [[n, asdict(k)] for n, k in t.columns], "key": t.key, "folder": t.folder, "indexes": [asdict(i) for i in t.indexes]} for t in self.tables.values()]
        self.store.write(self.FILE, json.dumps({"tables": told}, indent=1))

    def index(self, name: str) -> Table | None:
        return next((t for t in self.tables.values() if any(i.name == name for i in t.indexes)), None)
