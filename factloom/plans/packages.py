"""Query packages: manifests, a registry of their exports, macros, and the commands of a workspace."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from factloom.functions.values import CAPABILITY, DOTTED, SEMVER, matches
from factloom.plans.kql import Program, QueryError, parse

MANIFEST_FORMAT, CORE = 1, "^1"


class PackageError(ValueError):
    pass


@dataclass(frozen=True)
class Need:
    name: str
    version: int
    required: bool


@dataclass(frozen=True)
class Package:
    id: str
    version: str
    macros: tuple[str, ...] = ()
    commands: tuple[str, ...] = ()
    needs: tuple[Need, ...] = ()
    folder: Path | None = None

    @property
    def digest(self) -> str:
        plain = [MANIFEST_FORMAT, CORE, self.id, self.version, list(self.macros), list(self.commands), [[n.name, n.version, n.required] for n in self.needs]]
        return "sha256:" + hashlib.sha256(json.dumps(plain).encode()).hexdigest()


_KEYS = {"": {"format", "requires_core", "id", "version", "exports", "capabilities"}, "exports": {"macros", "commands"}, "capabilities": {"name", "version", "required"}}


def _known(data: object, where: str) -> dict:
    if not isinstance(data, dict):
        raise PackageError(f"{where or 'manifest'} must be a table")
    if unknown := set(data) - _KEYS[where]:
        raise PackageError(f"unknown key {min(unknown)}")
    return data


def _names(values: object, label: str) -> tuple[str, ...]:
    if not isinstance(values, list) or not all(isinstance(v, str) and matches(DOTTED, v) for v in values):
        raise PackageError(f"bad name in {label}")
    if len(set(values)) < len(values):
        raise PackageError(f"a name comes twice in {label}")
    return tuple(values)


def manifest(data: dict, folder: Path | None = None) -> Package:
    """A checked package from its manifest's data."""
    _known(data, "")
    if data.get("format") != MANIFEST_FORMAT:
        raise PackageError(f"unknown manifest format, this engine reads {MANIFEST_FORMAT}")
    if data.get("requires_core") != CORE:
        raise PackageError(f"made for another engine, this one is {CORE}")
    if not isinstance(data.get("id"), str) or not matches(DOTTED, data["id"]):
        raise PackageError(f"bad package id {data.get('id')!r}")
    if not isinstance(data.get("version"), str) or not matches(SEMVER, data["version"]):
        raise PackageError(f"bad package version {data.get('version')!r}")
    exports = _known(data.get("exports", {}), "exports")
    needs = []
    for raw in data.get("capabilities", []):
        raw = _known(raw, "capabilities")
        name, version = raw.get("name"), raw.get("version")
        if not isinstance(name, str) or not matches(CAPABILITY, name):
            raise PackageError(f"bad capability name {name!r}")
        if name in {n.name for n in needs}:
            raise PackageError(f"capability {name} comes twice")
        if type(version) is not int or version < 1:
            raise PackageError(f"capability {name} needs a version from 1 on")
        needs.append(Need(name, version, bool(raw.get("required", False))))
    return Package(data["id"], data["version"], _names(exports.get("macros", []), "exports.macros"), _names(exports.get("commands", []), "exports.commands"), tuple(needs), folder)


@dataclass
class Registry:
    """Packages by id; built-in ones cannot be replaced."""

    packages: dict[str, Package] = field(default_factory=dict)

    def add(self, package: Package) -> None:
        if package.id in self.packages:
            raise PackageError(f"a second package {package.id}")
        self.packages[package.id] = package

    def load(self, root: str, own: str = ".factloom") -> Registry:
        """Every folder under <root>/<own>/query-packages, by name; each must hold a package of its own name."""
        base = Path(root) / own / "query-packages"
        for folder in sorted(p for p in base.iterdir() if p.is_dir()) if base.is_dir() else []:
            path = folder / "package.toml"
            if not path.is_file():
                raise PackageError(f"no package.toml in {folder}")
            try:
                package = manifest(tomllib.loads(path.read_text(encoding="utf-8")), folder)
            except tomllib.TOMLDecodeError as e:
                raise PackageError(f"{path}: {e}") from e
            if folder.name != package.id:
                raise PackageError(f"{folder} holds the package {package.id}")
            self.add(package)
        return self

    def resolve(self, name: str, kind: str) -> tuple[Package, str]:
        """(package, export) of a qualified macro or command: the longest package id that exports it."""
        found = [p for p in self.packages.values() if name.startswith(p.id + ".") and name[len(p.id) + 1 :] in getattr(p, kind)]
        if not found:
            raise PackageError(f"no package exports {name}")
        best = max(found, key=lambda p: len(p.id))
        return best, name[len(best.id) + 1 :]

    def needs(self, ids: set[str]) -> list[Need]:
        """What the packages need, each (name, version) once, required if one of them requires it."""
        merged: dict[tuple[str, int], bool] = {}
        for package in self.packages.values():
            for need in package.needs if package.id in ids else ():
                merged[need.name, need.version] = merged.get((need.name, need.version), False) or need.required
        return [Need(n, v, r) for (n, v), r in sorted(merged.items())]


_MACRO = re.compile(r"from ([a-z0-9-]+(?:\.[a-z0-9-]+)+)\(\)")


def expand(text: str, registry: Registry) -> tuple[str, set[str]]:
    """(text with its macro lines replaced by the macros' files, ids of the packages used)."""
    out, used = [], set()
    for line in text.splitlines():
        if found := _MACRO.fullmatch(line.strip()):
            package, name = registry.resolve(found[1], "macros")
            if package.folder is None:
                raise PackageError(f"macro `{found[1]}` has no file")
            out.append((package.folder / "macros" / f"{name}.kql").read_text(encoding="utf-8"))
            used.add(package.id)
        else:
            out.append(line)
    return "\n".join(out), used


def commands(root: str, own: str = ".factloom", suffix: str = ".kql") -> list[Path]:
    base = Path(root) / own / "queries"
    return sorted((p for p in base.iterdir() if p.suffix == suffix and p.is_file()), key=lambda p: p.stem) if base.is_dir() else []


def load(root: str, name: str, registry: Registry, own: str = ".factloom") -> tuple[Program, set[str]]:
    """A workspace command by its file's stem, or a package's exported command."""
    path = next((p for p in commands(root, own) if p.stem == name), None)
    used: set[str] = set()
    if path is None:
        package, export = registry.resolve(name, "commands")
        if package.folder is None:
            raise PackageError(f"command `{name}` has no file")
        path, used = package.folder / "commands" / f"{export}.kql", {package.id}
    text, more = expand(path.read_text(encoding="utf-8"), registry)
    program = parse(text)
    if program.name != name and not used:
        raise QueryError(f"{path} declares `{program.name}`")
    return program, used | more


def describe(program: Program, needs: list[Need]) -> dict[str, object]:
    """A query's parameters and plan without touching an index."""
    return {
        "name": program.name, "parameters": [{"name": n, "type": t} for n, t in program.parameters],
        "posting": "hierarchy" if program.relation == "subtype_of" else "applied_symbol", "limit": program.limit,
        "where": [{"field": n, "value": v.value, "parameter": v.type == "parameter"} for n, v in program.where],
        "capabilities": [s.name for s in program.steps], "requires": [{"name": n.name, "version": n.version, "required": n.required} for n in needs],
    }
