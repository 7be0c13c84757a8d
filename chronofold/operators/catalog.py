"""Storages and their metadata: names and ids are unique, dropped ids are never used again."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("array", "hash", "masstree", "sequential")
MAX_NAME = 60
MAX_STORAGES = 1 << 16
ALIVE, DROPPED = "EXISTS", "MARKED_FOR_DEATH"


class StorageError(ValueError):
    """Base of catalogue errors."""


class NameEmpty(StorageError):
    """A storage needs a name."""


class NameTooLong(StorageError):
    """Names have at most MAX_NAME characters."""


class AlreadyExists(StorageError):
    """The name is in use."""


class NotFound(StorageError):
    """No storage has the name or id."""


class TooMany(StorageError):
    """All ids are used up."""


@dataclass
class Storage:
    id: int
    name: str
    kind: str
    schema: StructType
    state: str = ALIVE
    root: str = ""


@dataclass
class Catalog:
    """A registry of storages."""

    storages: list[Storage] = field(default_factory=list)

    def create(self, name: str, kind: str, schema: StructType) -> Storage:
        if not name:
            raise NameEmpty("empty name")
        if len(name) > MAX_NAME:
            raise NameTooLong(name)
        if kind not in KINDS:
            raise StorageError(f"no such kind: {kind}")
        if self.exists(name):
            raise AlreadyExists(name)
        if len(self.storages) + 1 >= MAX_STORAGES:
            raise TooMany(name)
        made = Storage(len(self.storages) + 1, name, kind, schema)
        self.storages.append(made)
        return made

    def drop(self, name: str) -> None:
        self.get(name).state = DROPPED

    def exists(self, name: str) -> bool:
        return any(s.name == name and s.state == ALIVE for s in self.storages)

    def get(self, name: str) -> Storage:
        for s in self.storages:
            if s.name == name and s.state == ALIVE:
                return s
        raise NotFound(name)

    def listing(self, spark: SparkSession) -> DataFrame:
        """(id, name, kind, state, columns) of all storages."""
        rows = [(s.id, s.name, s.kind, s.state, ",".join(s.schema.names)) for s in self.storages]
        return spark.createDataFrame(rows, "id long, name string, kind string, state string, columns string")

    def empty(self, spark: SparkSession, name: str) -> DataFrame:
        """A storage without records."""
        return spark.createDataFrame([], self.get(name).schema)


def live_rows(log: DataFrame, catalog: DataFrame, storage: str) -> DataFrame:
    """Log rows of storages that are not dropped."""
    return log.join(catalog.where(F.col("state") == ALIVE).select(F.col("name").alias(storage)), storage, "left_semi")
