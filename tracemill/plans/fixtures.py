"""Views over the driver tables in the roles of traces, predictions and events: one SQL text for any engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "traces": """
SELECT d.source AS problem_id, d.doc_id AS trace_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS candidate_index,
       d.text AS solution, CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS BIGINT) AS solution_token_count,
       coalesce(l.quality = 1, false) AS is_correct, d.lang AS condition, length(d.text) > 4000 AS hit_max_new_tokens
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "predictions": """
SELECT concat(l_returnflag, l_linestatus) AS cell, CAST(l_linenumber AS BIGINT) AS seed, l_suppkey AS problem_id,
       sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) * 2 > count(*) AS is_correct, CAST(max(l_quantity) AS BIGINT) AS output_token_count
FROM {lineitem} GROUP BY 1, 2, 3""",
    "feature_events": """
SELECT user_id AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS position,
       event_type AS feature_id, value AS activation, CAST(event_id % 7 AS BIGINT) AS token_id
FROM {events}""",
    "lengths": "SELECT user_id AS trace_id, count(*) AS length FROM {events} GROUP BY 1",
    "grid": """
SELECT l_orderkey AS problem_id, l_linenumber AS candidate_index, l_returnflag AS method, CAST(l_quantity AS BIGINT) AS tokens FROM {lineitem}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of ``sf_dir``."""
    text = VIEWS[name]
    tables = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(text: str) -> str:
    """The query with the views it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    parts = [f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used]
    body = text.strip()
    if not parts:
        return body
    return "WITH " + ", ".join(parts) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
