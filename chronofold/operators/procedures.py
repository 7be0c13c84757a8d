"""Procedures by name: the registry through which callers run units of work."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MAX_NAME = 60
Procedure = Callable[..., DataFrame]


class ProcedureError(ValueError):
    """Base of the registry's errors."""


class ProcedureNameTooLong(ProcedureError):
    """Names have 1 to MAX_NAME bytes."""


class ProcedureAlreadyExists(ProcedureError):
    """The name is in use."""


class ProcedureNotFound(ProcedureError):
    """No procedure has the name."""


class RegistryStarted(ProcedureError):
    """Procedures for all nodes are registered before the registry starts."""


@dataclass
class Procedures:
    """Procedures of all nodes, and of single ones, which come first."""

    shared: dict[str, Procedure] = field(default_factory=dict)
    local: dict[int, dict[str, Procedure]] = field(default_factory=dict)
    started: bool = False

    def register(self, name: str, procedure: Procedure) -> None:
        """For all nodes, before ``start``."""
        if self.started:
            raise RegistryStarted(name)
        self._add(self.shared, name, procedure)

    def register_local(self, node: int, name: str, procedure: Procedure) -> None:
        """For one node, at any time."""
        self._add(self.local.setdefault(node, {}), name, procedure)

    def _add(self, known: dict[str, Procedure], name: str, procedure: Procedure) -> None:
        if not 0 < len(name.encode()) <= MAX_NAME:
            raise ProcedureNameTooLong(name)
        if name in known:
            raise ProcedureAlreadyExists(name)
        known[name] = procedure

    def start(self) -> None:
        self.started = True

    def find(self, name: str, node: int = 0) -> Procedure:
        found = self.local.get(node, {}).get(name) or self.shared.get(name)
        if found is None:
            raise ProcedureNotFound(name)
        return found

    def run(self, spark: SparkSession, name: str, *arguments: Any, node: int = 0) -> DataFrame:
        return self.find(name, node)(spark, *arguments)
