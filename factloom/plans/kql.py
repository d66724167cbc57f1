"""The bounded query language: text to a typed program, bound parameters, and a DataFrame plan.

    command <name>(<parameter>: <type>, ...) {
      from applies(<symbol>) | from subtype_of(<symbol>) | from implements(<symbol>)
      where <term> [and <term>] ...
      using capability <name>(<argument>=<value>, ...)
      return symbol
      limit <n>
    }
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.answer import STATE_STATUS, Answer, state_rollup
from factloom.functions.values import DOTTED, matches
from factloom.operators import postings

MOST_RESULTS = 1000
TYPES = ("symbol-id", "qualified-symbol", "component-id", "string", "integer")
KINDS = ("class", "interface", "method", "function")
LANGUAGES = ("kotlin", "java")


class QueryError(ValueError):
    """A query that cannot be read, bound or planned."""


@dataclass(frozen=True)
class Value:
    """A literal of one of TYPES, or (type 'parameter') a parameter's name."""

    type: str
    value: str | int


@dataclass(frozen=True)
class Step:
    name: str
    arguments: tuple[tuple[str, Value], ...]


@dataclass(frozen=True)
class Program:
    name: str
    parameters: tuple[tuple[str, str], ...]
    relation: str  # applies or subtype_of
    symbol: Value
    where: tuple[tuple[str, Value], ...]
    steps: tuple[Step, ...]
    limit: int


def _quoted(text: str) -> str:
    text = text.strip()
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        raise QueryError(f"not a quoted string: {text}")
    return text[1:-1]


def _called(text: str, name: str) -> str | None:
    return text[len(name) + 1 : -1] if text.startswith(f"{name}(") and text.endswith(")") else None


def _literal(text: str, allowed: tuple[str, ...]) -> Value:
    if text.startswith("$"):
        return Value("parameter", text[1:])
    for kind in ("symbol-id", "qualified-symbol", "component-id"):
        if kind in allowed and (inner := _called(text, kind)) is not None:
            return Value(kind, _quoted(inner))
    if "string" in allowed and text.startswith('"'):
        return Value("string", _quoted(text))
    if "integer" in allowed and re.fullmatch(r"[+-]?\d+", text) and -(2**63) <= int(text) < 2**63:
        return Value("integer", int(text))
    raise QueryError(f"cannot read value `{text}`")


def _term(text: str) -> tuple[str, Value]:
    left, equals, right = text.partition(" == ")
    if not equals:
        raise QueryError(f"no ` == ` in condition `{text}`")
    if left in ("kind", "language"):
        if right not in (KINDS if left == "kind" else LANGUAGES):
            raise QueryError(f"no such {left}: `{right}`")
        return left, Value("string", right)
    if left == "component":
        return left, _literal(right, ()) if right.startswith("$") else Value("component-id", _quoted(right))
    if left == "qualified-name-prefix":
        return left, _literal(right, ()) if right.startswith("$") else Value("string", _quoted(right))
    raise QueryError(f"no such condition: `{left}`")


def _named(text: str, sign: str, what: str) -> tuple[str, str]:
    name, found, rest = text.strip().partition(sign)
    if not found or not matches(DOTTED, name.strip()) or "." in name:
        raise QueryError(f"{what}: expected a plain lower-case name and `{sign}` in `{text.strip()}`")
    return name.strip(), rest.strip()


def parse(text: str) -> Program:
    lines = [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]
    head = re.fullmatch(r"command ([^(]*)\((.*)\) \{", lines[0]) if lines else None
    if not head or lines[-1] != "}":
        raise QueryError("a query is `command <name>(<parameters>) {`, statements, and `}`")
    if not matches(DOTTED, head[1]):
        raise QueryError(f"bad command name `{head[1]}`")
    parameters = tuple(_named(p, ":", "parameters") for p in head[2].split(",")) if head[2].strip() else ()
    if bad := [t for _, t in parameters if t not in TYPES]:
        raise QueryError(f"no such type: `{bad[0]}`")
    start: tuple[str, Value] | None = None
    where: list[tuple[str, Value]] = []
    steps: list[Step] = []
    limit = None
    for line in lines[1:-1]:
        relation = next((r for r in ("applies", "subtype_of", "implements") if _called(line, f"from {r}") is not None), None)
        if relation:
            if start:
                raise QueryError("a second starting relation")
            symbol = _literal(_called(line, f"from {relation}") or "", ("symbol-id", "qualified-symbol"))
            start = ("applies" if relation == "applies" else "subtype_of", symbol)
        elif line.startswith("where "):
            where += [_term(t) for t in line[6:].split(" and ")]
        elif line.startswith("using capability "):
            name, opened, rest = line[17:].partition("(")
            if not opened or not rest.endswith(")") or not matches(DOTTED, name):
                raise QueryError(f"bad capability step `{line}`")
            pairs = [_named(a, "=", "capability arguments") for a in rest[:-1].split(",")] if rest[:-1].strip() else []
            steps.append(Step(name, tuple((n, _literal(v, ("symbol-id", "component-id", "string", "integer"))) for n, v in pairs)))
        elif line.startswith("limit "):
            if not re.fullmatch(r"\+?\d+", line[6:]) or int(line[6:]) >= 2**32:
                raise QueryError(f"bad limit `{line[6:]}`")
            limit = int(line[6:])
        elif line != "return symbol":
            raise QueryError(f"cannot read `{line}`")
    if not start:
        raise QueryError("no starting relation")
    if limit is None:
        raise QueryError("no limit")
    return Program(head[1], parameters, start[0], start[1], tuple(where), tuple(steps), limit)


def bind(program: Program, values: Mapping[str, str]) -> dict[str, Value]:
    declared = dict(program.parameters)
    if unknown := sorted(set(values) - set(declared)):
        raise QueryError(f"`{unknown[0]}` is no parameter of {program.name}")
    out = {}
    for name, kind in program.parameters:
        if name not in values:
            raise QueryError(f"no value for `{name}`")
        value: str | int = values[name]
        if kind == "integer":
            if not re.fullmatch(r"\+?\d+", str(value)) or int(value) >= 2**32:
                raise QueryError(f"`{name}` takes a whole number")
            value = int(value)
        out[name] = Value(kind, value)
    return out


def _value(value: Value, bound: Mapping[str, Value], kinds: tuple[str, ...]) -> Value:
    if value.type != "parameter":
        return value
    found = bound.get(str(value.value))
    if found is None:
        raise QueryError(f"no value for `{value.value}`")
    if found.type not in kinds:
        raise QueryError(f"`{value.value}` is a {found.type}, not a {' or '.join(kinds)}")
    return found


def resolve_name(locators: DataFrame, name: str) -> str:
    """The one id of a qualified name; an unknown dotted name is taken as a JVM type not indexed yet."""
    found = [r.symbol_id for r in postings.qualified(locators, name).limit(2).collect()]
    if len(found) == 1:
        return found[0]
    if found:
        raise QueryError(f"several symbols are named `{name}`")
    if "." in name:
        return f"jvm:type:{name}"
    raise QueryError(f"no symbol is named `{name}`")


@dataclass
class Plan:
    """A compiled query: rows are all matches in order; posting says which index they start from."""

    rows: DataFrame
    posting: tuple[str, str]
    limit: int
    steps: tuple[Step, ...] = ()
    arguments: dict[str, Value] = field(default_factory=dict)


def select(facts: Mapping[str, DataFrame], applied: list[str] | None = None, subtype_of: list[str] | None = None, predicates: list[F.Column] | None = None) -> Plan:
    """A bounded selection: it starts from a posting, hierarchy before annotation, the lowest symbol first.

    Of several supertypes only the lowest counts; further annotations are filters. Without a posting it is refused.
    """
    predicates = list(predicates or [])
    if subtype_of:
        seed = min(subtype_of)
        rows, posting = postings.subtypes(facts["hierarchy_edges"], facts["symbols"], seed), ("hierarchy", seed)
        predicates += [postings.applied(a) for a in applied or []]
    elif applied:
        seed = min(applied)
        rows, posting = postings.with_applied(facts["symbols"], facts["source_units"], seed), ("applied_symbol", seed)
        predicates += [postings.applied(a) for a in applied if a != seed]
    else:
        raise QueryError("a selection must start from a posting")
    return Plan(rows.where(postings.every(*predicates)), posting, MOST_RESULTS)


def compile(program: Program, facts: Mapping[str, DataFrame], bound: Mapping[str, Value]) -> Plan:  # noqa: A001
    if not 1 <= program.limit <= MOST_RESULTS:
        raise QueryError(f"limit must be 1 to {MOST_RESULTS}")
    symbol = _value(program.symbol, bound, ("symbol-id", "qualified-symbol"))
    start = str(symbol.value) if symbol.type == "symbol-id" else resolve_name(facts["symbol_locators"], str(symbol.value))
    makers: dict[str, Callable[[str], F.Column]] = {"kind": postings.kind, "language": postings.language, "component": postings.component, "qualified-name-prefix": postings.prefix}
    kinds = {"component": ("component-id",), "qualified-name-prefix": ("string",)}
    predicates = [makers[name](str(_value(value, bound, kinds.get(name, ("string",))).value)) for name, value in program.where]
    key = "applied" if program.relation == "applies" else "subtype_of"
    plan = select(facts, **{key: [start]}, predicates=predicates)
    return Plan(plan.rows, plan.posting, program.limit, program.steps, dict(bound))


def run(plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(the first rows by unit, place and id; one row state, truncated): more rows than the limit make it partial."""
    ordered = plan.rows.orderBy(*postings.UNIT_ORDER)
    rows, more = postings.limited(ordered, plan.limit)
    state = plan.rows.agg(state_rollup().alias("state")).crossJoin(more)
    return rows, state.select(F.when(F.col("truncated"), "partial").otherwise(F.col("state")).alias("state"), "truncated")


def answer(plan: Plan) -> Answer:
    rows, state = run(plan)
    found = state.first()
    return Answer(STATE_STATUS[found.state], rows, {"state": found.state, "truncated": found.truncated, "posting": plan.posting})


def query(text: str, facts: Mapping[str, DataFrame], values: Mapping[str, str] | None = None) -> Answer:
    program = parse(text)
    return answer(compile(program, facts, bind(program, values or {})))
