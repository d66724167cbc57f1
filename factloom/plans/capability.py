"""Capabilities: named DataFrame functions that refine candidates under a budget."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from factloom.answer import STATE_STATUS, Answer, refused, state_rollup, support
from factloom.operators import postings
from factloom.plans.kql import Plan, Step, Value, run

MOST_CANDIDATES, MOST_NODES, MOST_BYTES, MOST_MILLIS = 1000, 10_000, 16 << 20, 30_000


class CapabilityError(ValueError):
    pass


@dataclass(frozen=True)
class Budget:
    candidates: int = MOST_CANDIDATES
    nodes: int = MOST_NODES
    octets: int = 1 << 20
    millis: int = 5_000

    def checked(self) -> Budget:
        for name, value, most in (("candidates", self.candidates, MOST_CANDIDATES), ("nodes", self.nodes, MOST_NODES), ("octets", self.octets, MOST_BYTES), ("millis", self.millis, MOST_MILLIS)):
            if not 1 <= value <= most:
                raise CapabilityError(f"budget {name} must be 1 to {most}")
        return self


@dataclass(frozen=True)
class Capability:
    """parameters: name to (type, required). run(facts, candidates, arguments) gives rows with symbol_id and completeness."""

    name: str
    version: int
    parameters: Mapping[str, tuple[str, bool]]
    run: Callable[[Mapping[str, DataFrame], DataFrame, Mapping[str, object]], DataFrame]
    provider: str = "builtin"


def arguments(capability: Capability, given: list[tuple[str, Value]]) -> dict[str, object]:
    out: dict[str, object] = {}
    for name, value in given:
        if name not in capability.parameters:
            raise CapabilityError(f"{capability.name} takes no `{name}`")
        if name in out:
            raise CapabilityError(f"two values for `{name}`")
        if capability.parameters[name][0] != value.type:
            raise CapabilityError(f"`{name}` takes a {capability.parameters[name][0]}")
        out[name] = value.value
    for name, (_, required) in capability.parameters.items():
        if required and name not in out:
            raise CapabilityError(f"no value for `{name}`")
    return out


def direct_hierarchy(facts: Mapping[str, DataFrame], candidates: DataFrame, given: Mapping[str, object]) -> DataFrame:
    """Candidates that are direct subtypes of `target`."""
    near = facts["hierarchy_edges"].where(F.col("supertype") == given["target"]).select(F.col("subtype").alias("symbol_id"))
    return candidates.join(near, "symbol_id", "left_semi").select("symbol_id", "completeness")


def resolved_applications(facts: Mapping[str, DataFrame], candidates: DataFrame, given: Mapping[str, object]) -> DataFrame:
    """Candidates that an application of `target` names as its subject."""
    carried = facts["applications"].where(F.col("target") == given["target"]).select(F.col("subject").alias("symbol_id"))
    return candidates.join(carried, "symbol_id", "left_semi").select("symbol_id", "completeness")


BUILTIN = (
    Capability("hierarchy.direct", 1, {"target": ("symbol-id", True)}, direct_hierarchy),
    Capability("applications.resolved_target", 1, {"target": ("symbol-id", True)}, resolved_applications),
)


def _within(candidates: DataFrame, budget: Budget) -> None:
    """Refuse candidates beyond the budget; at most one row more than it is looked at."""
    units = F.count_distinct("source_unit_id") if "source_unit_id" in candidates.columns else F.lit(0)
    told = candidates.limit(budget.candidates + 1).agg(F.count("*").alias("n"), units.alias("units")).first()
    if told.n > budget.candidates:
        raise CapabilityError("candidate input exceeds the budget")
    if told.units > budget.nodes:
        raise CapabilityError("source input exceeds the budget")


def _answered(capability: Capability, rows: DataFrame, candidates: DataFrame, budget: Budget) -> list[Row]:
    """At most one row more than the budget; a response without the asked columns, or naming units that no candidate has, is refused."""
    if lacks := {"symbol_id", "completeness"} - set(rows.columns):
        raise CapabilityError(f"{capability.name}: response without {', '.join(sorted(lacks))}")
    found = rows.limit(budget.candidates + 1).collect()
    if any(r.symbol_id is None or r.completeness is None for r in found):
        raise CapabilityError(f"{capability.name}: response with nulls")
    if "source_unit_id" in rows.columns and "source_unit_id" in candidates.columns:
        units = {r.source_unit_id for r in candidates.select("source_unit_id").distinct().collect()}
        if any(r.source_unit_id not in units for r in found):
            raise CapabilityError(f"{capability.name}: response outside the candidates' source units")
    return found


def _answered_all(capability: Capability, rows: DataFrame, candidates: DataFrame) -> str:
    """The state of a response of any size, checked as _answered does, where the rows lie."""
    if lacks := {"symbol_id", "completeness"} - set(rows.columns):
        raise CapabilityError(f"{capability.name}: response without {', '.join(sorted(lacks))}")
    nulls = F.col("symbol_id").isNull() | F.col("completeness").isNull()
    told = rows.agg(F.count("*").alias("n"), F.count_if(nulls).alias("nulls"), F.count_if(F.col("completeness") != "complete").alias("partial")).first()
    if told.nulls:
        raise CapabilityError(f"{capability.name}: response with nulls")
    if "source_unit_id" in rows.columns and "source_unit_id" in candidates.columns and not rows.join(candidates.select("source_unit_id").distinct(), "source_unit_id", "left_anti").isEmpty():
        raise CapabilityError(f"{capability.name}: response outside the candidates' source units")
    return "no_result" if not told.n else "partial" if told.partial else "complete"


def _given(capability: Capability, step: Step, plan: Plan) -> dict[str, object]:
    return arguments(capability, [(n, plan.arguments[str(v.value)] if v.type == "parameter" else v) for n, v in step.arguments])


def execute(capability: Capability, facts: Mapping[str, DataFrame], candidates: DataFrame, given: dict[str, object], budget: Budget) -> tuple[str, list[str]]:
    """(state, symbol ids sorted) under the budget; the jobs are cancelled at the deadline.

    More candidates or source units than the budget are refused before the capability runs, never cut.
    """
    budget.checked()
    spark = candidates.sparkSession
    tag = f"capability-{uuid.uuid4().hex}"
    timer = threading.Timer(budget.millis / 1000, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    began = time.monotonic()
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        _within(candidates, budget)
        rows = _answered(capability, capability.run(facts, candidates, given), candidates, budget)
    except CapabilityError:
        raise
    except Exception as e:
        if time.monotonic() - began >= budget.millis / 1000:
            raise CapabilityError("deadline exceeded") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    if len(rows) > budget.candidates:
        raise CapabilityError("candidate budget exceeded")
    if sum(len(r.symbol_id.encode()) for r in rows) > budget.octets:
        raise CapabilityError("byte budget exceeded")
    state = "partial" if any(r.completeness != "complete" for r in rows) else "complete"
    return state, sorted({r.symbol_id for r in rows})


@dataclass
class Capabilities:
    offered: list[Capability] = field(default_factory=lambda: list(BUILTIN))

    def negotiate(self, name: str, version: int) -> tuple[str, list[str], list[int]]:
        """(status, providers, versions there are)."""
        versions = sorted({c.version for c in self.offered if c.name == name})
        providers = sorted({c.provider for c in self.offered if (c.name, c.version) == (name, version)})
        return "supported" if providers else "incompatible_version" if versions else "missing", providers, versions

    def refine(self, plan: Plan, facts: Mapping[str, DataFrame], versions: Mapping[str, int] | None = None, required: tuple[str, ...] = (), budget: Budget | None = None) -> Answer:
        """Run a plan and then its steps on the truncated rows; a required capability that is missing refuses first."""
        wanted = self._wanted(plan, versions, required)
        if wanted is None:
            return refused("unsupported_capability", "a required capability is not offered", "unsupported")
        rows, state = run(plan)
        overall = state.first().state
        for step, capability in wanted:
            if not capability:
                overall = "partial"
                continue
            told, ids = execute(capability, facts, rows, _given(capability, step, plan), budget or Budget())
            answered = rows.sparkSession.range(1).select(F.explode(F.array(*(F.lit(i) for i in ids)) if ids else F.array().cast("array<string>")).alias("symbol_id"))
            rows = postings.retained(rows, answered)
            overall = "no_result" if not ids else "partial" if "partial" in (told, overall) else overall
        return Answer(STATE_STATUS[overall], rows, {"state": overall})

    def refine_all(self, plan: Plan, facts: Mapping[str, DataFrame], versions: Mapping[str, int] | None = None, required: tuple[str, ...] = ()) -> Answer:
        """Run a plan and then its steps on all its rows, as joins that bring none to the driver.

        The limit and budgets bound one answer; a job over a whole catalog has neither, so nothing is cut or refused for its size.
        """
        wanted = self._wanted(plan, versions, required)
        if wanted is None:
            return refused("unsupported_capability", "a required capability is not offered", "unsupported")
        rows = plan.rows
        overall = rows.agg(state_rollup().alias("state")).first().state
        for step, capability in wanted:
            if not capability:
                overall = "partial"
                continue
            answered = capability.run(facts, rows, _given(capability, step, plan))
            told = _answered_all(capability, answered, rows)
            rows = postings.retained(rows, answered)
            overall = "no_result" if told == "no_result" else "partial" if "partial" in (told, overall) else overall
        return Answer(STATE_STATUS[overall], rows, {"state": overall})

    def _wanted(self, plan: Plan, versions: Mapping[str, int] | None, required: tuple[str, ...]) -> list[tuple[Step, Capability | None]] | None:
        """Each step with the capability offered for it, if any; None if a required one is not."""
        asked = [(s, s.name, (versions or {}).get(s.name, 1)) for s in plan.steps]
        if support([(name in required, self.negotiate(name, version)[0]) for _, name, version in asked]) == "unsupported":
            return None
        return [(s, next((c for c in self.offered if (c.name, c.version) == (name, version)), None)) for s, name, version in asked]
