"""Typed values, names and small validators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DOTTED = r"^[a-z0-9-]+(\.[a-z0-9-]+)*$"
CAPABILITY = r"^[a-z0-9_-]+(\.[a-z0-9_-]+)*$"
SEMVER = r"^[0-9]+\.[0-9]+\.[0-9]+$"
CODE = r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"

#: Files that configure a build, by name; and by path.
CONFIGURATION_FILES = (
    "settings.gradle",
    "settings.gradle.kts",
    "build.gradle",
    "build.gradle.kts",
    "gradle.properties",
    "libs.versions.toml",
    "gradle.lockfile",
    "maven.config",
    "maven-wrapper.properties",
    "pom.xml",
    "Cargo.toml",
    "package.json",
    "package-lock.json",
    "npm-shrinkwrap.json",
    "pnpm-lock.yaml",
    "pnpm-workspace.yaml",
    "yarn.lock",
    ".yarnrc.yml",
    "bun.lock",
    "bun.lockb",
    ".npmrc",
)
CONFIGURATION_PATHS = ("gradle/wrapper/gradle-wrapper.properties",)
CONFIGURATION_SUFFIX = ".lockfile"
#: Build files that make their folder a component.
COMPONENT_FILES = ("build.gradle", "build.gradle.kts", "pom.xml", "Cargo.toml", "package.json")
#: Folders that hold no sources (the engine's own folder is added to them).
EXCLUDED_FOLDERS = (".git", ".gradle", ".idea", "build", "node_modules", "out", "target")


def matches(pattern: str, value: str) -> bool:
    return re.fullmatch(pattern.strip("^$"), value) is not None


def argument_value(kind: Column, text: Column, items: Column, flag: Column, number: Column) -> Column:
    """struct(value_kind, value_text): a string as it is, a list as compact JSON, true or false, decimal digits."""
    shown = F.when(kind == "string", text).when(kind == "string_list", F.to_json(items)).when(kind == "boolean", flag.cast("string")).when(kind == "integer", number.cast("string"))
    return F.struct(kind.alias("value_kind"), shown.alias("value_text"))


def is_configuration(path: Column, own: tuple[str, ...] = ()) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.isin(*CONFIGURATION_FILES) | name.endswith(CONFIGURATION_SUFFIX) | path.isin(*CONFIGURATION_PATHS, *own)


def language_of(path: Column) -> Column:
    return F.when(path.rlike(r"[^/]\.kts?$"), "kotlin").when(path.rlike(r"[^/]\.java$"), "java")


def is_generated(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "generated")


def excluded(path: Column, own: str = ".factloom") -> Column:
    """Whether a file lies in a folder that holds no sources."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*(F.lit(x) for x in (*EXCLUDED_FOLDERS, own))))


def slash_path(path: Column, root: Column) -> Column:
    """path relative to root with forward slashes; root itself is '.'."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    rest = F.substring(plain, F.char_length(root) + 2, F.char_length(plain))
    return F.when(plain == root, ".").otherwise(rest)


def named_strings(text: Column, name: str) -> Column:
    """All string literals given to argument `name`, as in name = ["x"] or name = "x"."""
    found = F.regexp_extract_all(text, F.lit(rf'\b{re.escape(name)}\s*=\s*(\[[^\]]*\]|"[^"]*")'), F.lit(1))
    return F.flatten(F.transform(found, lambda x: F.regexp_extract_all(x, F.lit('"([^"]*)"'), F.lit(1))))


def callable_key(package: Column, owner: Column, name: Column, parameters: Column) -> Column:
    """package/Owner.name(parameter,parameter); a constructor is named <init>; nested type names use '.'."""
    types = F.transform(parameters, lambda p: F.replace(F.replace(p, F.lit("/"), F.lit(".")), F.lit("$"), F.lit(".")))
    return F.concat(F.concat_ws(".", package, owner, F.coalesce(name, F.lit("<init>"))), F.lit("("), F.array_join(types, ","), F.lit(")"))


def package_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^\s*package\s+([A-Za-z0-9_.]+)", 1), F.lit(""))


def declared_types(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:class|interface|object|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def evidence_key(code: Column, target: Column, backend: Column, version: Column, options: Column) -> Column:
    return F.concat_ws("|", code, target, backend, version, options)
