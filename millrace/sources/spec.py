"""The description of one dataset."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.types import StructType

from millrace.functions.schema import to_struct

# Formats whose data is not addressed by a path.
PATHLESS_FORMATS = frozenset({"jdbc", "kafka", "rate"})


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset lives and how to read or write it.

    ``schema`` may be declared in any form ``to_struct`` accepts, under the key
    ``schema`` or ``schema_definition``. ``mode`` is ``None`` unless given. ``rebalance``
    is the number of shuffle partitions that a value of ``partition_by`` is dealt out
    over before a write; 0 or ``False`` writes without a shuffle. ``sort_by`` are columns that each
    written file is sorted by. ``versioned``, ``run_id`` and ``violations`` are explained at
    ``write_dataset``, ``malformed`` at ``read_dataset``. Descriptive keys (tags, description,
    source system) are allowed in the mapping and have no effect here.
    """

    format: str
    path: str | list[str] | None = None
    schema: StructType | None = None
    options: dict[str, Any] = field(default_factory=dict)
    mode: str | None = None
    partition_by: tuple[str, ...] = ()
    rebalance: int = 4
    predicates: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    versioned: bool = False
    run_id: str | None = None
    violations: str | None = None
    malformed: bool = False

    @classmethod
    def of(cls, entry: Mapping[str, Any] | DatasetSpec) -> DatasetSpec:
        if isinstance(entry, DatasetSpec):
            return entry
        kind, path = entry.get("format"), entry.get("path")
        if not kind:
            raise ValueError("a dataset needs 'format'")
        if not path and kind.lower() not in PATHLESS_FORMATS:
            raise ValueError(f"a {kind} dataset needs 'path'")
        return cls(
            format=kind,
            path=_path(path),
            schema=declared_schema(entry),
            options=dict(entry.get("options") or {}),
            mode=entry.get("mode") or None,
            partition_by=_names(entry.get("partition_by")),
            rebalance=cls.rebalance if entry.get("rebalance", True) is True else int(entry["rebalance"] or 0),
            predicates=_names(entry.get("predicates")),
            sort_by=_names(entry.get("sort_by")),
            versioned=bool(entry.get("versioned")),
            run_id=str(entry["run_id"]) if entry.get("run_id") is not None else None,
            violations=entry.get("violations") or None,
            malformed=bool(entry.get("malformed")),
        )._checked()

    def _checked(self) -> DatasetSpec:
        if self.violations not in (None, "reject", "fail"):
            raise ValueError(f"'violations' is 'reject' or 'fail', not {self.violations!r}")
        if self.malformed and (self.format.lower() not in ("csv", "json") or self.schema is None):
            raise ValueError("'malformed' needs a csv or json dataset with a declared schema")
        if self.versioned or self.run_id:
            if not isinstance(self.path, str) or self.format.lower() in PATHLESS_FORMATS:
                raise ValueError("'versioned' and 'run_id' need one path")
            if self.versioned and self.run_id:
                raise ValueError("a dataset has versions or runs, not both")
            allowed = "overwrite" if self.versioned else "append"
            if (self.mode or allowed).lower() != allowed:
                raise ValueError(f"a {'versioned dataset' if self.versioned else 'run'} takes the mode {allowed!r}, not {self.mode!r}")
        return self

    def option(self, name: str) -> Any:
        """The value of an option, whatever the case of its name, or ``None``."""
        return next((value for key, value in self.options.items() if key.lower() == name.lower()), None)

    @property
    def save_mode(self) -> str:
        """The mode of a batch write."""
        return self.mode or "errorifexists"

    @property
    def paths(self) -> list[str]:
        if not self.path:
            return []
        return [self.path] if isinstance(self.path, str) else list(self.path)


def declared_schema(entry: Mapping[str, Any]) -> StructType | None:
    """The schema a description declares under either of its keys, or ``None``."""
    return to_struct(entry.get("schema") or entry.get("schema_definition"))


def _path(value: Any) -> str | list[str] | None:
    if not value:
        return None
    if isinstance(value, (str, os.PathLike)):
        return os.fspath(value)
    return [os.fspath(part) for part in value]


def _names(value: Any) -> tuple[str, ...]:
    if not value:
        return ()
    return (value,) if isinstance(value, str) else tuple(value)
