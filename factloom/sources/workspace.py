"""Files of a workspace as tables: texts, sources, components, configuration; roots and layered settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.digest import fingerprint
from factloom.functions.text import utf8_state
from factloom.functions.values import COMPONENT_FILES, CONFIGURATION_FILES, EXCLUDED_FOLDERS, excluded, is_configuration, is_generated, language_of
from factloom.operators.ranges import deepest_component

OWN_FOLDER = ".factloom"
MOST_BYTES = 1_048_576


def files(spark: SparkSession, root: str) -> DataFrame:
    """(workspace_path, byte_size, modified, content) of all regular files outside excluded folders.

    Spark's reader passes over empty files and names that begin with a dot or an underscore; `unlisted` adds them.
    """
    plain = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(plain)
    bare = F.regexp_replace(F.col("path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    base = "/" + plain.split(":", 1)[-1].strip("/") + "/" if ":" in plain[:10] else str(Path(plain).resolve()) + "/"
    named = raw.withColumn("workspace_path", F.substring(bare, F.lit(len(base) + 1), F.char_length(bare)))
    listed = named.select("workspace_path", F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"), "content")
    own = F.col("workspace_path") == f"{OWN_FOLDER}/config.toml"
    return listed.unionByName(unlisted(spark, root)).where(own | ~excluded(F.col("workspace_path"), OWN_FOLDER))


def unlisted(spark: SparkSession, root: str) -> DataFrame:
    """The files that Spark's reader does not list, through Hadoop's file system: few beside the others, as .git and the like are
    excluded. Of one over MOST_BYTES, which is no text, no more than MOST_BYTES + 1 bytes are read."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root if ":" in root[:10] else str(Path(root).resolve()))
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    rows, folders = [], [top]
    while folders:
        for status in fs.listStatus(folders.pop()):
            path = status.getPath()
            name = path.toUri().getPath()[len(base) :]
            if status.isDirectory():
                if path.getName() not in EXCLUDED_FOLDERS:
                    folders.append(path)
            elif status.getLen() == 0 or any(part[0] in "._" for part in name.split("/")):
                stream = fs.open(path)
                try:
                    content = bytes(stream.readNBytes(MOST_BYTES + 1))
                finally:
                    stream.close()
                rows.append((name, status.getLen(), datetime.fromtimestamp(status.getModificationTime() / 1000), content))
    return spark.createDataFrame(rows, "workspace_path string, byte_size long, modified timestamp, content binary")


def texts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped): texts with their fingerprint, and files that are no text with the reason."""
    state = utf8_state(F.col("content"), MOST_BYTES)
    read = files(spark, root).withColumn("state", state)
    documents = read.where("state = 'document'").select("workspace_path", fingerprint(F.col("content")).alias("content_fp"), F.decode("content", "UTF-8").alias("content"))
    skipped = read.where("state <> 'document'").select("workspace_path", F.col("state").alias("reason"), "byte_size")
    return documents.orderBy("workspace_path"), skipped.orderBy("workspace_path")


def _build_system(name: Column) -> Column:
    return F.when(name.startswith("build.gradle"), "gradle").when(name == "pom.xml", "maven").when(name == "Cargo.toml", "cargo").when(name == "package.json", "npm").otherwise("filesystem")


def components(found: DataFrame) -> DataFrame:
    """(component_id, root, build_system, configuration_fp): folders with a build file, and the workspace itself."""
    name = F.element_at(F.split("workspace_path", "/"), -1)
    folder = F.when(F.instr("workspace_path", "/") == 0, ".").otherwise(F.regexp_extract("workspace_path", "^(.*)/[^/]*$", 1))
    built = found.where(name.isin(*COMPONENT_FILES)).select(folder.alias("root"), _build_system(name).alias("build_system"))
    built = built.groupBy("root").agg(F.min("build_system").alias("build_system"))
    whole = found.where(is_configuration(F.col("workspace_path"), (f"{OWN_FOLDER}/config.toml",))).agg(F.count("*").alias("n")).select(F.lit(".").alias("root"), F.lit("filesystem").alias("build_system"))
    roots = built.unionByName(whole.join(built.where("root = '.'"), "root", "left_anti"))
    digest = configuration_digest(found)
    return roots.crossJoin(F.broadcast(digest)).select(F.concat_ws(":", "build_system", "root").alias("component_id"), "root", "build_system", "configuration_fp")


def configuration_digest(found: DataFrame) -> DataFrame:
    """One row configuration_fp over all configuration files in order of path."""
    inputs = found.where(is_configuration(F.col("workspace_path"), (f"{OWN_FOLDER}/config.toml",)))
    entry = F.concat(F.col("workspace_path"), F.lit("\x00"), F.sha2("content", 256), F.lit("\x00"))
    listed = F.array_sort(F.collect_list(F.struct("workspace_path", entry.alias("e"))))
    return inputs.agg(fingerprint(F.array_join(F.transform(listed, lambda x: x["e"]), "")).alias("configuration_fp"))


def source_units(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Sources by extension, each with the deepest component that holds it."""
    sources = found.where(~is_configuration(F.col("workspace_path"))).withColumn("language", language_of(F.col("workspace_path"))).where("language is not null")
    rows = sources.select("workspace_path", "language", fingerprint(F.col("content")).alias("content_fp"))
    placed = deepest_component(rows, roots).join(roots.select("component_id", F.col("configuration_fp").alias("context_fp")), "component_id", "left")
    origin = F.when(is_generated(F.col("workspace_path")), "generated").otherwise("source")
    return placed.select(
        F.concat_ws(":", "component_id", "workspace_path").alias("source_unit_id"), "component_id", "workspace_path", "language", origin.alias("origin"), "content_fp", "context_fp"
    ).orderBy("workspace_path")


def workspace_root(start: str) -> Path:
    """The nearest folder with Gradle settings, else with any build file, else with .git, else start."""
    here = Path(start).resolve(strict=True)
    here = here.parent if here.is_file() else here
    settings = build = git = None
    for folder in (here, *here.parents):
        if settings is None and any((folder / n).is_file() for n in ("settings.gradle", "settings.gradle.kts")):
            settings = folder
        if git is None and (folder / ".git").is_dir():
            git = folder
        if build is None and any((folder / n).is_file() for n in CONFIGURATION_FILES):
            build = folder
    return settings or build or git or here


# --- settings ----------------------------------------------------------------------------------


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    schema_version: int = 1
    freshness_strategy: str = "fresh_only"
    artifact_cache_scope: str = "user"
    max_total: int = 4
    dependency_workers: int = 2
    source_batch_workers: int = 1
    best_effort_dependencies: bool = True


_GROUPS = {"workers": ("max_total", "dependency_workers", "source_batch_workers"), "maven": ("best_effort_dependencies",)}
_CHOICES = {"freshness_strategy": ("fresh_only", "allow_stale"), "artifact_cache_scope": ("user", "workspace")}


def _layer(settings: Settings, path: Path) -> Settings:
    try:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise SettingsError(f"{path}: {e}") from e
    flat: dict[str, object] = {}
    for name, value in data.items():
        if name in _GROUPS and isinstance(value, dict):
            if unknown := set(value) - set(_GROUPS[name]):
                raise SettingsError(f"{path}: unknown {name}.{min(unknown)}")
            flat |= value
        elif name in ("schema_version", *_CHOICES):
            flat[name] = value
        else:
            raise SettingsError(f"{path}: unknown {name}")
    for name, value in flat.items():
        want = bool if name == "best_effort_dependencies" else str if name in _CHOICES else int
        if type(value) is not want or (name in _CHOICES and value not in _CHOICES[name]):
            raise SettingsError(f"{path}: bad {name}")
    if flat.get("schema_version", 1) != 1:
        raise SettingsError(f"{path}: schema version {flat['schema_version']}, supported is 1")
    out = replace(settings, **flat)
    if "workers" in data and (min(out.max_total, out.dependency_workers, out.source_batch_workers) <= 0 or out.dependency_workers + out.source_batch_workers > out.max_total):
        raise SettingsError(f"{path}: worker counts must be positive and fit max_total")
    return out


def load_settings(root: str, shared: str | None = None) -> Settings:
    """Defaults, then the shared file, then the workspace's; later ones override only what they state."""
    settings = Settings()
    for path in (Path(shared) if shared else None, Path(root) / OWN_FOLDER / "config.toml"):
        if path and path.is_file():
            settings = _layer(settings, path)
    return settings


def init_settings(root: str) -> Path:
    """Write a workspace's settings with the defaults; never overwrites."""
    path = Path(root) / OWN_FOLDER / "config.toml"
    if path.exists():
        raise SettingsError(f"{path} exists")
    path.parent.mkdir(parents=True, exist_ok=True)
    d = Settings()
    path.write_text(
        f'schema_version = {d.schema_version}\nfreshness_strategy = "{d.freshness_strategy}"\nartifact_cache_scope = "{d.artifact_cache_scope}"\n\n'
        f"[maven]\nbest_effort_dependencies = {str(d.best_effort_dependencies).lower()}\n\n"
        f"[workers]\nmax_total = {d.max_total}\ndependency_workers = {d.dependency_workers}\nsource_batch_workers = {d.source_batch_workers}\n",
        encoding="utf-8",
    )
    (path.parent / ".gitignore").write_text("*\n!.gitignore\n!config.toml\n", encoding="utf-8")
    return path
