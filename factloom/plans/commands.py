"""The commands of a workspace: list, describe, and run by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from factloom.answer import Answer, refused
from factloom.operators import freshness
from factloom.plans import kql, packages
from factloom.plans.capability import Budget, Capabilities, CapabilityError
from factloom.sources.workspace import Settings


def available(root: str, registry: packages.Registry) -> list[str]:
    """Names of workspace commands and then of packages' commands, each part in order."""
    own = [p.stem for p in packages.commands(root)]
    return own + sorted(f"{p.id}.{c}" for p in registry.packages.values() for c in p.commands)


def describe(root: str, name: str, registry: packages.Registry, offered: Capabilities | None = None) -> dict[str, object]:
    """Parameters and plan of a command, and what its packages need against what is offered. Reads no index."""
    program, used = packages.load(root, name, registry)
    offered = offered or Capabilities()
    needs = registry.needs(used)
    told = packages.describe(program, needs)
    return told | {"packages": sorted(used), "negotiations": [{"name": n.name, "version": n.version, "status": offered.negotiate(n.name, n.version)[0]} for n in needs]}


def run(
    root: str, name: str, values: Mapping[str, str], registry: packages.Registry, facts: Mapping[str, DataFrame], current: DataFrame | None = None,
    states: DataFrame | None = None, settings: Settings | None = None, offered: Capabilities | None = None, budget: Budget | None = None,
) -> Answer:
    """Load, bind, negotiate, compile, run, refine and gate a command; a missing requirement refuses before any read."""
    offered = offered or Capabilities()
    try:
        program, used = packages.load(root, name, registry)
        bound = kql.bind(program, values)
    except (kql.QueryError, packages.PackageError) as e:
        return refused("invalid_query", str(e))
    needs = registry.needs(used)
    lacking = [n.name for n in needs if n.required and offered.negotiate(n.name, n.version)[0] != "supported"]
    if lacking:
        return refused("unsupported_capability", f"{lacking[0]} is not offered", "unsupported")
    try:
        plan = kql.compile(program, facts, bound)
        versions = {n.name: n.version for n in needs}
        required = tuple(n.name for n in needs if n.required)
        answer = offered.refine(plan, facts, versions, required, budget) if program.steps else kql.answer(plan)
    except (kql.QueryError, CapabilityError) as e:
        return refused("invalid_query", str(e))
    if current is not None:
        answer = freshness.gate(answer, facts["source_units"], current, states, (settings or Settings()).freshness_strategy)
    return answer
