"""Where a lake keeps its tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lake:
    """Folder layout below one root on any Hadoop file system."""

    root: str

    def _at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def bronze(self) -> str:
        return self._at("bronze")

    @property
    def ledger(self) -> str:
        return self._at("ledger")

    @property
    def dead_letters(self) -> str:
        return self._at("dead_letters")

    @property
    def batch_counts(self) -> str:
        return self._at("batch_counts")

    @property
    def batch_metrics(self) -> str:
        return self._at("batch_metrics")

    @property
    def batch_inputs(self) -> str:
        return self._at("batch_inputs")

    @property
    def runs(self) -> str:
        return self._at("warehouse/runs")

    @property
    def published(self) -> str:
        return self._at("warehouse/published")

    @property
    def reports(self) -> str:
        return self._at("warehouse/reports")

    def table(self, run_id: str, schema: str, name: str) -> str:
        return f"{self.runs}/{run_id}/{schema}/{name}"
