"""The term index over texts: search, and synchronisation with the documents that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.answer import Answer, by_count, refused
from factloom.functions.text import position, searchable, snippet, terms


def postings(term_rows: DataFrame, documents: DataFrame, term: str) -> DataFrame:
    return term_rows.where(F.col("term") == term).join(documents, "workspace_path")


def matches(term_rows: DataFrame, documents: DataFrame, term: str) -> DataFrame:
    """Every occurrence with its line, column and lines around, by path and place."""
    found = postings(term_rows, documents, term)
    spot = position(F.col("content"), F.col("start_byte"))
    return found.select(
        "workspace_path", "start_byte", "end_byte", spot["line"].alias("line"), spot["column"].alias("column"),
        snippet(F.col("content"), F.col("start_byte"), F.col("end_byte")).alias("snippet"),
    ).orderBy("workspace_path", "start_byte")


def search(term_rows: DataFrame, documents: DataFrame, term: str) -> Answer:
    if not searchable(term):
        return refused("invalid_text_query", "a term is letters, digits and underscores")
    return by_count(matches(term_rows, documents, term))


def changed_texts(indexed: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that are new or changed, paths whose indexed text no longer counts)."""
    fresh = current.join(indexed.select("workspace_path", "content_fp"), ["workspace_path", "content_fp"], "left_anti")
    gone = indexed.join(current.select("workspace_path", "content_fp"), ["workspace_path", "content_fp"], "left_anti")
    return fresh, gone.select("workspace_path")


def synchronised(indexed: DataFrame, term_rows: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, terms) as they should be: vanished texts leave, only new and changed ones are taken apart again."""
    same = current.select("workspace_path", "content_fp")
    kept = indexed.join(same, ["workspace_path", "content_fp"], "left_semi")
    fresh = current.join(indexed.select("workspace_path", "content_fp"), ["workspace_path", "content_fp"], "left_anti")
    old_terms = term_rows.join(kept.select("workspace_path"), "workspace_path", "left_semi")
    return kept.unionByName(fresh), old_terms.unionByName(terms(fresh, "workspace_path"))
