"""The queries on text corpora, and their SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import packing, repetition, tokenizing


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.encode_corpus(_documents(spark, folder), ["doc_id"])


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_corpus(_documents(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetitive(_documents(spark, folder), ["doc_id"])


def p9_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of every document."""
    return repetition.repetition(_documents(spark, folder), ["doc_id"])


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The words of every document and those in repetition, counted for rejected documents too."""
    return repetition.repetition(_documents(spark, folder), ["doc_id"]).select("doc_id", "n_words", "repeated_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_ids, p8_packed, p9_found, p9_bands, p9_shares)}


#: Each document's words, the runs of ten that start at each, and the words in runs that an earlier word starts too.
_LEADS = ", ' ', ".join(f"lead(w, {k}) OVER o" for k in range(1, 10))
_REPEATED = rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(nfc_normalize(coalesce(text, '')), '\p{{L}}+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS i, lower(unnest(ws)) AS w FROM l),
g AS (SELECT doc_id, i, hash(concat(w, ' ', {_LEADS})) AS gram, lead(w, 9) OVER o AS ninth FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, gram, min(i) AS first FROM g WHERE ninth IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT g.doc_id, g.i FROM g JOIN f ON f.doc_id = g.doc_id AND f.gram = g.gram WHERE g.ninth IS NOT NULL AND g.i > f.first),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 10)) AS k FROM r) GROUP BY doc_id),
shares AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS repeated_words FROM l LEFT JOIN c USING (doc_id))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": _REPEATED + "SELECT doc_id FROM shares WHERE n_words > 0 AND repeated_words >= 0.25 * n_words",
        "p9_shares": _REPEATED + "SELECT doc_id, n_words, repeated_words FROM shares",
    }
