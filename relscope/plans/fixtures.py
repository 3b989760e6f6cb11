"""Views on the driver tables used by the registered queries and their oracles.

Each view is SQL that runs unchanged on Spark (ANSI) and DuckDB.  On the
Spark side the text is planned by Catalyst over the parquet scans, so the
views are ordinary data Spark derives from the given tables; the DuckDB oracle
inlines the same text as ``WITH`` entries.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Order key of every seeded shuffle: md5 over the seed and the pair id.
SEED = 42

# (name, body) in dependency order.  Names prefixed ``fxp_`` are helpers.
CTES: dict[str, str] = {}

CTES["fxp_base"] = """
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS pair_id,
         l_orderkey AS ok, l_linenumber AS ln, l_suppkey % 5 AS sv,
         CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN 'B'
                           WHEN 7 THEN 'D' ELSE 'C' END AS strategy,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS gold,
         l_partkey AS pk, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem"""

CTES["fxp_g"] = """
  SELECT *, CASE WHEN pk % 20 < 12 + (ln + sv) % 4 THEN gold ELSE (gold + 1) % 3 END AS guess,
         ok % 50 = 0 AS failed, ok % 97 = 1 AS two_flags, ok % 89 = 2 AS no_flag
  FROM fxp_base"""

CTES["fx_predictions"] = """
  SELECT pair_id, ln * 10 + sv AS run_id, strategy, gold AS support,
         CASE WHEN failed THEN NULL WHEN no_flag THEN 0 WHEN two_flags THEN 1
              WHEN guess = 0 THEN 1 ELSE 0 END AS pred_attack,
         CASE WHEN failed OR strategy = 'A' THEN NULL WHEN no_flag THEN 0 WHEN two_flags THEN 1
              WHEN guess = 1 THEN 1 ELSE 0 END AS pred_support,
         CASE WHEN failed OR strategy IN ('A', 'B') THEN NULL WHEN no_flag THEN 0
              WHEN guess = 2 THEN 1 ELSE 0 END AS pred_neither,
         CASE WHEN failed OR strategy <> 'D' THEN NULL ELSE (qty % 5) * CAST(0.25 AS DOUBLE) END
              AS pred_relevance
  FROM fxp_g"""

CTES["fx_ratings"] = """
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS pair_id,
         l_linenumber AS run_id,
         CASE WHEN l_orderkey % 50 = 0 THEN NULL
              ELSE (CAST(l_quantity AS BIGINT) % 5) * CAST(0.25 AS DOUBLE) END AS pred_relevance,
         CASE WHEN l_orderkey % 11 = 3 THEN NULL
              ELSE ((CAST(l_quantity AS BIGINT) + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) % 5)
                   * CAST(0.25 AS DOUBLE) END AS h1,
         CASE WHEN l_orderkey % 13 = 4 THEN NULL
              ELSE ((CAST(l_quantity AS BIGINT) + l_partkey % 2) % 5) * CAST(0.25 AS DOUBLE) END AS h2
  FROM lineitem"""

CTES["fx_pairs"] = """
  SELECT * FROM (
    SELECT concat_ws('|', conv_id, turn) AS pair_id, text AS arg1,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS arg2,
           (conv_id + turn) % 3 AS support, role AS type
    FROM conversations) t
  WHERE arg2 IS NOT NULL"""

CTES["fx_human"] = """
  SELECT doc_id, quality AS gold, 1 - toxic AS human FROM labels"""


def run_metadata_sql(src: str) -> str:
    """fx_runs metadata derived from run_id (FIXTURES.md B)."""
    return f"""
  SELECT r.*,
         CASE (r.run_id % 10) % 3 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' ELSE 'm2' END AS model,
         CASE WHEN CAST((r.run_id - r.run_id % 10) / 10 AS BIGINT) % 2 = 0 THEN 10 ELSE 0 END AS few_shot_n,
         CASE WHEN r.run_id % 10 < 3 THEN 10 ELSE 20 END AS batch_size,
         CASE WHEN CAST((r.run_id - r.run_id % 10) / 10 AS BIGINT) < 5 THEN 'WebDataset/x' ELSE 'NR_WebDataset/x' END
              AS dataset_file,
         r.run_id AS run_seq
  FROM {src} r"""


def with_clause(names, extra: dict[str, str] | None = None) -> str:
    """``WITH`` text holding the named views and everything they depend on."""
    ctes = dict(CTES)
    ctes.update(extra or {})
    order = list(ctes)
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in need:
            return
        need.add(n)
        body = ctes[n]
        for other in order:
            if other != n and other in body:
                visit(other)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({ctes[n]}\n)" for n in order if n in need]
    return "WITH " + ",\n".join(parts) + "\n"


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    for t in names:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path) or "://" in path:
            spark.read.parquet(path).createOrReplaceTempView(t)


def _tables_for(name: str) -> list[str]:
    text = with_clause([name])
    return [t for t in BASE_TABLES if f"FROM {t}" in text]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plan one fixture view over the parquet tables of ``sf_dir``."""
    register_tables(spark, sf_dir, _tables_for(name))
    return spark.sql(with_clause([name]) + f"SELECT * FROM {name}")


def predictions(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_predictions")


def ratings(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_ratings")


def pairs(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_pairs")


def human(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_human")
