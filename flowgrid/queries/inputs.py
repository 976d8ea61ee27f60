"""Inputs of the registered queries, derived from the given tables by SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Simulations and paths: a number that grows with suppliers and customers, 20 and 3 at least.
SIM = "l_suppkey % (SELECT greatest(20, CAST(ceil(max(l_suppkey) / 5.0) AS BIGINT)) FROM lineitem)"
PATH = "o_custkey % (SELECT greatest(3, CAST(ceil(max(o_custkey) / 500.0) AS BIGINT)) FROM orders)"

#: name -> SQL.  Raster cells: r is the row (0 = south), c the column; values may be absent, never NaN.
INPUTS = {
    "cells": f"""SELECT concat('sim', CAST({SIM} AS STRING)) AS sim_name, CASE l_returnflag WHEN 'A' THEN 'ppr' WHEN 'N' THEN 'pft' ELSE 'pfv' END AS res_type,
        CAST(l_orderkey % 40 AS INT) AS r, CAST(l_partkey % 50 AS INT) AS c, max(l_extendedprice) / 1000 AS value FROM lineitem GROUP BY 1, 2, 3, 4""",
    "cells_t": f"""SELECT concat('sim', CAST({SIM} AS STRING)) AS sim_name, CAST(l_linenumber AS DOUBLE) AS t, CASE l_returnflag WHEN 'A' THEN 'ppr' WHEN 'N' THEN 'pft' ELSE 'pfv' END AS res_type,
        CAST(l_orderkey % 40 AS INT) AS r, CAST(l_partkey % 50 AS INT) AS c, max(l_extendedprice) / 1000 AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "sims": f"""SELECT concat('sim', CAST(s AS STRING)) AS sim_name, 0.5 + 0.25 * CAST(s % 4 AS DOUBLE) AS rel_th, 0.1 + 0.05 * CAST(s % 3 AS DOUBLE) AS mu,
        concat('rel', CAST(s % 5 AS STRING)) AS scenario, CASE WHEN s % 2 = 0 THEN 'null' ELSE 'ent' END AS sim_type FROM (SELECT DISTINCT {SIM} AS s FROM lineitem) l""",
    "dem": """SELECT r, c, 2000 - 25.0 * r + q / 10 AS z FROM (SELECT CAST(l_orderkey % 40 AS INT) AS r, CAST(l_partkey % 50 AS INT) AS c, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) k""",
    "particles": """SELECT concat('sim', CAST(user_id % 4 AS STRING)) AS sim_name, CAST(t AS DOUBLE) AS t, user_id AS id, user_id - user_id % 3 AS parent_id, 10 + CAST(event_id % 200 AS DOUBLE) / 8 AS x, 5 + CAST(event_id % 120 AS DOUBLE) / 4 AS y,
        500 - 7.5 * t + CAST(event_id % 11 AS DOUBLE) AS z, CAST(event_id % 5 AS DOUBLE) - 2 AS ux, CAST(event_id % 7 AS DOUBLE) - 3 AS uy, CAST(event_id % 3 AS DOUBLE) - 1 AS uz, 1 + CAST(user_id % 7 AS DOUBLE) AS m, CAST(event_id % 9 AS DOUBLE) / 4 AS h, 10 * t + CAST(event_id % 10 AS DOUBLE) AS s
        FROM (SELECT *, hour(ts) AS t, row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY event_id DESC) AS n FROM events) e WHERE n = 1""",
    "mass": """SELECT concat('sim', CAST(CAST(floor(o_custkey / 20) AS BIGINT) AS STRING)) AS sim_name, CAST(o_orderkey AS DOUBLE) AS t, o_totalprice AS total, CAST(o_orderkey % 13 AS DOUBLE) AS entrained, CAST(o_orderkey % 5 AS DOUBLE) AS detrained FROM orders""",
    "path": """SELECT path_id, i, 10.0 * i + CAST(o_orderkey % 7 AS DOUBLE) AS x, 5.0 * i + CAST(o_orderkey % 5 AS DOUBLE) AS y, 3000 - 60 * ln(1.0 + i) * 4 - CAST(o_orderkey % 3 AS DOUBLE) AS z
        FROM (SELECT o_custkey AS path_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS i FROM orders) o""",
    "thal": f"""SELECT path_id, i, 1.5 + 3.5 * i + CAST(k AS DOUBLE) / 16 AS x, 6 + 2.25 * i + 2.0 * (path_id % 3) - CAST(k AS DOUBLE) / 8 AS y, 900 - 400 * ln(1.0 + i) AS z FROM (SELECT CAST({PATH} AS INT) AS path_id, CAST(o_orderkey % 11 AS INT) AS i, max(o_orderkey % 7) AS k FROM orders GROUP BY 1, 2) o""",
    "visits": """SELECT l_orderkey AS start_id, CAST(l_partkey % 40 AS INT) AS r, CAST(l_suppkey % 50 AS INT) AS c, CAST(l_linenumber AS INT) AS visit_id, l_extendedprice / 100 AS z_delta, l_quantity / 50 AS flux, l_discount AS flux_dep, 10 + l_tax * 100 AS fp_gamma, 12 + l_tax * 50 AS sl_gamma, l_quantity * 5 AS dist FROM lineitem""",
    "edges": """SELECT l_orderkey AS start_id, CAST(l_linenumber AS BIGINT) AS parent, CAST(l_linenumber + 1 AS BIGINT) AS child FROM lineitem WHERE l_linenumber < 7""",
    "features": """SELECT s_suppkey AS feature_id, concat('area', CAST(s_suppkey AS STRING)) AS name, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE concat('g', CAST(s_nationkey AS STRING)) END AS grp, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN 'a,b' ELSE 'a, c' END AS scenario,
        CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 0.5 + CAST(s_suppkey % 4 AS DOUBLE) / 4 END AS thickness, s_suppkey AS ord FROM supplier""",
    "vertices": """SELECT s_suppkey AS feature_id, seq, CAST(s_suppkey * 7 % 38 AS DOUBLE) + dx * (2 + CAST(s_suppkey % 5 AS DOUBLE)) + 0.25 AS x, CAST(s_suppkey * 11 % 30 AS DOUBLE) + dy * (2 + CAST(s_suppkey % 4 AS DOUBLE)) + 0.25 AS y
        FROM supplier CROSS JOIN (VALUES (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.2, 1.0), (3, 0.0, 1.0)) AS corner(seq, dx, dy)""",
    "points": """SELECT event_id AS point_id, CAST(event_id % 197 AS DOUBLE) / 4 - 0.25 AS x, CAST(event_id % 163 AS DOUBLE) / 4 - 0.5 AS y FROM events""",
}


def needed(text: str) -> list[str]:
    """Derived inputs that a SQL text names, those they are made of first."""
    out: list[str] = []
    for name in INPUTS:
        if re.search(rf"\b{name}\b", text) and name not in out:
            out.append(name)
    return out


def with_inputs(body: str) -> str:
    """The SQL with its derived inputs as common table expressions."""
    names = needed(body)
    if not names:
        return body
    own = ",\n".join(f"{n} AS ({INPUTS[n]})" for n in names)
    body = body.strip()
    return f"WITH {own}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {own}\n{body}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived input as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = INPUTS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: frame(spark, sf_dir, t) for t in used})
