"""Answers: a status, rows, and what is known of their freshness, completeness and origin."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exit code of each status.
EXIT_CODES = {"ok": 0, "no_result": 1, "ambiguous": 1, "stale": 3, "unsupported": 3, "invalid_request": 2, "failed": 4}
#: Status of each selector state.
STATE_STATUS = {"complete": "ok", "partial": "stale", "no_result": "no_result"}
RETRYABLE = frozenset({"stale_source_snapshot", "stale_configuration_input", "missing_workspace_manifest", "stale_effective_configuration"})


@dataclass(frozen=True)
class Problem:
    code: str
    message: str

    @property
    def retryable(self) -> bool:
        return self.code in RETRYABLE


@dataclass
class Answer:
    status: str
    rows: DataFrame | None = None
    metadata: dict[str, object] = field(default_factory=dict)
    problems: list[Problem] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.status]

    def envelope(self) -> dict[str, object]:
        """The answer as plain data; only this brings its rows to the driver, and callers bound them first."""
        rows = [r.asDict(recursive=True) for r in self.rows.collect()] if self.rows is not None else None
        problems = [{"code": p.code, "message": p.message, "retryable": p.retryable} for p in self.problems]
        return {"schema_version": 1, "status": self.status, "result": rows, "metadata": self.metadata, "problems": problems}


def refused(code: str, message: str, status: str = "invalid_request") -> Answer:
    return Answer(status, problems=[Problem(code, message)])


def by_count(rows: DataFrame, many: str = "ok") -> Answer:
    """ok, no_result, or `many` for two rows and more; looks at two rows."""
    n = len(rows.limit(2).collect())
    return Answer("no_result" if not n else "ok" if n == 1 else many, rows)


def freshness_rollup() -> Column:
    """stale if any row is, else unknown if any is, else fresh."""
    return F.when(F.bool_or(F.col("freshness") == "stale"), "stale").when(F.bool_or(F.col("freshness") == "unknown"), "unknown").otherwise("fresh")


def state_rollup() -> Column:
    """no_result for no row, complete if all rows are fresh and complete, else partial."""
    whole = F.bool_and((F.col("freshness") == "fresh") & (F.col("completeness") == "complete"))
    return F.when(F.count("*") == 0, "no_result").when(whole, "complete").otherwise("partial")


def any_ok(statuses: list[str]) -> str:
    return "ok" if "ok" in statuses else "no_result"


def support(negotiations: list[tuple[bool, str]]) -> str:
    """Of (required, status) pairs: unsupported, partial or complete."""
    if any(required and status != "supported" for required, status in negotiations):
        return "unsupported"
    return "partial" if any(status != "supported" for _, status in negotiations) else "complete"
