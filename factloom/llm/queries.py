"""The operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import chat, mixing, neardup, quality
from factloom.llm.chat import op7_chat
from factloom.llm.common import table
from factloom.llm.decontaminate import op9_decontamination
from factloom.llm.html_extract import op6_html
from factloom.llm.langid import op5_language_id
from factloom.llm.licenses import op4_licenses
from factloom.llm.mixing import op8_mixing
from factloom.llm.neardup import op3_near_duplicates
from factloom.llm.quality import op1_quality
from factloom.llm.token_store import op10_token_store
from factloom.llm.toxicity import op2_toxicity


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
places AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
found AS (SELECT DISTINCT rid, i, places.k, item_id FROM places JOIN windows USING (x) WHERE places.k = windows.k),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""


def word_bpe() -> str:
    """Path of the public word-level BPE vocabulary; another is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": lambda s, d: op1_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op2_toxicity": lambda s, d: op2_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op3_minhash": lambda s, d: op3_near_duplicates(table(s, d, "documents")),
        "op4_licenses": lambda s, d: op4_licenses(table(s, d, "documents")),
        "op5_language_id": lambda s, d: op5_language_id(table(s, d, "documents")),
        "op6_html": lambda s, d: op6_html(table(s, d, "pages")),
        "op7_chat": lambda s, d: op7_chat(table(s, d, "conversations")),
        "op8_mixing": lambda s, d: op8_mixing(table(s, d, "documents")),
        "op9_decontamination": lambda s, d: op9_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_token_store": lambda s, d: op10_token_store(table(s, d, "documents"), word_bpe()),
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL expresses; tests/llm holds the others against brute force."""
    return {"op1_quality": quality.oracle(), "op3_minhash": neardup.oracle(), "op7_chat": chat.oracle(), "op8_mixing": mixing.oracle(), "op9_decontamination": OP9_SQL}
