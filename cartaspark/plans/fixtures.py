"""Input relations derived from the standard tables, for queries and tests.

`{table}` names a table: Spark binds it to a DataFrame, DuckDB to a view.  Texts marked with two
dialects differ only in how arrays are unfolded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "sheets": """SELECT CAST(c_custkey AS STRING) AS sheet_id,
        CAST((c_custkey * 37) % 3400 AS DOUBLE) / 10 - 170 + 0.013 AS west, CAST((c_custkey * 53) % 1500 AS DOUBLE) / 10 - 75 + 0.017 AS south,
        CAST((c_custkey * 37) % 3400 AS DOUBLE) / 10 - 170 + 0.383 AS east, CAST((c_custkey * 53) % 1500 AS DOUBLE) / 10 - 75 + 0.307 AS north,
        c_mktsegment AS digest, CAST(c_nationkey AS BIGINT) AS prio FROM {customer}""",
    "retile_list": """SELECT CAST(c_custkey AS STRING) AS sheet_id FROM {customer} WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 5 = 0
        UNION ALL SELECT 'no_such_sheet' AS sheet_id""",
    "redo_boxes": """SELECT 'dummy_' || CAST(s_suppkey AS STRING) AS sheet_id,
        CAST((s_suppkey * 97) % 3400 AS DOUBLE) / 10 - 170 + 0.021 AS west, CAST((s_suppkey * 61) % 1500 AS DOUBLE) / 10 - 75 + 0.023 AS south,
        CAST((s_suppkey * 97) % 3400 AS DOUBLE) / 10 - 170 + 1.221 AS east, CAST((s_suppkey * 61) % 1500 AS DOUBLE) / 10 - 75 + 0.923 AS north
        FROM {supplier} WHERE s_suppkey % 100 < 20""",
    "bounds_old": """SELECT CAST(p_partkey AS STRING) AS sheet_id,
        '{{"type":"Point","coordinates":[' || CAST((p_partkey * 37) % 3400 AS STRING) || ',' || CAST((p_partkey * 53) % 1500 AS STRING) || ']}}' AS geom_json,
        CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS digest FROM {part} WHERE p_partkey % 7 <> 0""",
    "bounds_new": """SELECT CAST(p_partkey AS STRING) AS sheet_id,
        '{{"type":"Point","coordinates":[' || CAST((p_partkey * 37) % 3400 + CASE WHEN p_partkey % 13 = 0 THEN 5 ELSE 0 END AS STRING) || ',' || CAST((p_partkey * 53) % 1500 AS STRING) || ']}}' AS geom_json,
        CASE WHEN p_partkey % 17 = 0 THEN 'changed' WHEN p_partkey % 23 = 0 THEN NULL ELSE p_brand END AS digest FROM {part} WHERE p_partkey % 11 <> 0""",
    "delete_ids": "SELECT CAST(p_partkey AS STRING) AS sheet_id FROM {part} WHERE p_size = 7",
    "tile_store": "SELECT DISTINCT CAST(9 AS BIGINT) AS z, l_orderkey % 64 AS x, l_partkey % 64 AS y, 'new' AS payload FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber = 1",
    "tile_archive": "SELECT DISTINCT CAST(9 AS BIGINT) AS z, o_orderkey % 64 AS x, o_custkey % 64 AS y, 'old' AS payload FROM {orders} WHERE o_orderstatus <> 'P'",
    "candidates": "SELECT user_id AS sheet_id, event_id AS cand_id, (event_id * 31) % 400 AS x, (event_id * 17) % 400 AS y, event_type AS colour FROM {events}",
    "ocr_words": """SELECT o_custkey % 50 AS sheet_id, o_orderkey AS word_id, (o_orderkey * 7) % 1000 AS x, (o_orderkey * 11) % 1000 AS y,
        20 + o_orderkey % 60 AS w, 8 + o_orderkey % 12 AS h, o_orderkey % 100 AS conf FROM {orders} WHERE o_orderkey % 4 = 0""",
    "ocr_chars": """SELECT l_suppkey % 50 AS sheet_id, l_orderkey * 10 + l_linenumber AS char_id, (l_partkey * 13) % 1000 AS x, (l_orderkey * 3) % 1000 AS y,
        3 + l_partkey % 40 AS w, 4 + l_partkey % 9 AS h FROM {lineitem} WHERE l_linenumber = 1""",
    "lattice_ranges": "SELECT p_partkey AS sheet_id, (p_partkey * 29) % 4000 - 2000 AS lo, (p_partkey * 29) % 4000 - 2000 + p_partkey % 90 AS hi, CAST(25 AS BIGINT) AS step FROM {part}",
    "patches": """SELECT CAST(o_custkey AS STRING) AS sheet_id, o_orderkey AS patch, (o_orderkey * 7) % 60 AS x, (o_custkey * 11 + o_orderkey * 3) % 60 AS y,
        4 + o_orderkey % 17 AS w, 3 + o_orderkey % 13 AS h FROM {orders}""",
    "payloads": "SELECT doc_id AS sheet_id, text AS content FROM {documents}",
    "sheet_events": "SELECT event_id, ts, CAST(user_id AS STRING) AS sheet_id, event_type AS op, props FROM {events}",
}
SPARK_SQL = {
    "px": """SELECT vec_id AS sheet_id, CAST(i DIV 8 AS BIGINT) AS r, CAST(i % 8 AS BIGINT) AS c,
        CAST(floor((greatest(CAST(-0.5 AS DOUBLE), least(CAST(0.499 AS DOUBLE), CAST(v AS DOUBLE))) + 0.5) * 256) AS BIGINT) AS v
        FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, v""",
    "px16": """SELECT vec_id DIV 4 AS sheet_id, CAST(i DIV 8 + 8 * (vec_id % 4 DIV 2) AS BIGINT) AS r, CAST(i % 8 + 8 * (vec_id % 2) AS BIGINT) AS c, CASE WHEN v >= 0.02 THEN 1 ELSE 0 END AS m
        FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, v""",
}
DUCK_SQL = {
    "px": """SELECT vec_id AS sheet_id, CAST(i // 8 AS BIGINT) AS r, CAST(i % 8 AS BIGINT) AS c,
        CAST(floor((greatest(CAST(-0.5 AS DOUBLE), least(CAST(0.499 AS DOUBLE), CAST(v AS DOUBLE))) + 0.5) * 256) AS BIGINT) AS v
        FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM {embeddings}) q""",
    "px16": """SELECT vec_id // 4 AS sheet_id, CAST(i // 8 + 8 * (vec_id % 4 // 2) AS BIGINT) AS r, CAST(i % 8 + 8 * (vec_id % 2) AS BIGINT) AS c, CASE WHEN v >= 0.02 THEN 1 ELSE 0 END AS m
        FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM {embeddings}) q""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables of a folder; only the tables that it names are read."""
    text = SQL.get(name) or SPARK_SQL[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_relations(names: str, body: str) -> str:
    """DuckDB SQL: the named relations (space separated) as common table expressions, then the body."""
    views = {t: t for t in TABLES}
    made = [f"{n} AS ({(SQL.get(n) or DUCK_SQL[n]).format(**views)})" for n in names.split()]
    more = body.lstrip()
    if more.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(made)}, {more[15:]}"
    if more.upper().startswith("WITH "):
        return f"WITH {', '.join(made)}, {more[5:]}"
    return f"WITH {', '.join(made)} {more}"
