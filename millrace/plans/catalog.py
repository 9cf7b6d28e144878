"""Named datasets."""

from __future__ import annotations

import copy
import weakref
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.operators.checks import required_field_violations
from millrace.operators.columns import quoted
from millrace.sources.files import read_dataset
from millrace.sources.spec import declared_schema


# For each session, which catalog published a view last, and the rows it showed.
_PUBLISHED: weakref.WeakKeyDictionary[SparkSession, dict[str, tuple[DatasetCatalog, DataFrame]]] = (
    weakref.WeakKeyDictionary()
)


class DatasetCatalog:
    """A set of dataset descriptions, usable as Spark temporary views.

    Registering keeps the description only. The scan is set up when the dataset
    is first used, because listing the files of a large one takes time and a
    job's output may not exist yet. Names are any texts. Each catalog has its own
    set of them; the views belong to the session, where a later catalog's view
    replaces an earlier one's. Views and tables of the user's own are left alone.
    """

    def __init__(self, spark: SparkSession, datasets: Mapping[str, Mapping[str, Any]] | None = None):
        self._spark = spark
        self._entries: dict[str, dict[str, Any]] = {}
        if datasets:
            self.load(datasets)

    def load(self, datasets: Mapping[str, Mapping[str, Any]]) -> None:
        """Replace all entries by ``datasets``."""
        for entry in datasets.values():
            declared_schema(entry)
        self.clear()
        for dataset_id, entry in datasets.items():
            self.register(dataset_id, entry)

    def register(self, dataset_id: str, metadata: Mapping[str, Any]) -> None:
        """Add an entry, or replace the one of that name."""
        declared_schema(metadata)
        self._drop_view(dataset_id)
        self._entries[dataset_id] = copy.deepcopy(dict(metadata))

    def metadata(self, dataset_id: str) -> dict[str, Any] | None:
        """The entry as it was registered, or ``None``."""
        entry = self._entries.get(dataset_id)
        return copy.deepcopy(entry)

    def schema(self, dataset_id: str) -> StructType | None:
        """The declared schema, or ``None`` if there is no such entry or none is declared."""
        entry = self._entries.get(dataset_id)
        return declared_schema(entry) if entry else None

    def ids(self) -> list[str]:
        """The names in the order they were registered."""
        return list(self._entries)

    def clear(self) -> None:
        """Drop all entries and their views."""
        for dataset_id in self._entries:
            self._drop_view(dataset_id)
        self._entries.clear()

    def table(self, dataset_id: str) -> DataFrame:
        """The dataset, scanned with its declared schema.

        It is also published as the temporary view ``dataset_id``, so that
        ``spark.table`` and SQL find it; a name with other signs than letters,
        digits and underscores stands in backticks there. Raises if the session
        has a table or view of that name which is not a catalog's.
        """
        if dataset_id not in self._entries:
            raise KeyError(f"no dataset {dataset_id!r}")
        rows, published = read_dataset(self._spark, self._entries[dataset_id]), self._published()
        name = quoted(dataset_id)
        if dataset_id.lower() not in published and self._spark.catalog.tableExists(name):
            raise ValueError(f"the session has a table or view {dataset_id!r} of its own")
        rows.createOrReplaceTempView(name)
        published[dataset_id.lower()] = (self, rows)
        return rows

    def violations(self, dataset_id: str) -> DataFrame:
        """Nulls in the required fields of the dataset."""
        return required_field_violations(self.table(dataset_id), self.schema(dataset_id))

    def resolve(self, spec: Mapping[str, Any]) -> dict[str, Any]:
        """``spec`` with its ``dataset_id`` replaced by that entry.

        Keys in ``spec`` win; options are merged one by one, whatever the case of
        their names.
        """
        dataset_id = spec.get("dataset_id")
        if dataset_id not in self._entries:
            raise KeyError(f"no dataset {dataset_id!r}")
        entry, own = self.metadata(dataset_id), {k: v for k, v in spec.items() if k != "dataset_id"}
        given = dict(own.get("options") or {})
        named = {key.lower() for key in given}
        kept = {k: v for k, v in (entry.get("options") or {}).items() if k.lower() not in named}
        return {**entry, **own, "options": {**kept, **given}}

    def _published(self) -> dict[str, tuple[DatasetCatalog, DataFrame]]:
        return _PUBLISHED.setdefault(self._spark, {})

    def _drop_view(self, dataset_id: str) -> None:
        """Drop the view if this catalog published it last and it still shows the same rows."""
        owner, rows = self._published().get(dataset_id.lower(), (None, None))
        if owner is not self:
            return
        del self._published()[dataset_id.lower()]
        name = quoted(dataset_id)
        if self._spark.catalog.tableExists(name) and self._spark.table(name).sameSemantics(rows):
            self._spark.catalog.dropTempView(dataset_id)
