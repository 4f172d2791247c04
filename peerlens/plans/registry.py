"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import written_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `fn(spark, sf_dir) -> DataFrame` under a name, with its SQL if SQL can say it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def staged(build, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered input as a written table: readers pass over it several times, as they would over stored filings."""
    return written_table(build(spark, sf_dir), build.__name__)


# Order lines with their dimensions, as every SQL counterpart below sees them.
FACTS = """
facts AS MATERIALIZED (
  SELECT n_name AS entity, r_name AS grp, n_nationkey AS nationkey, c_mktsegment AS segment,
         o_orderpriority AS channel, o_orderkey AS okey, l_suppkey AS suppkey, l_partkey AS partkey,
         CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS fy,
         CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS INTEGER) AS q,
         price * (CAST(1 AS DECIMAL(4,2)) - disc) AS value, price AS gross, price * disc AS ceded,
         price * tax AS commission,
         CASE WHEN l_returnflag = 'A' THEN price * disc ELSE 0 END AS accepted,
         CASE WHEN l_returnflag = 'R' THEN price * (CAST(1 AS DECIMAL(4,2)) - disc) ELSE 0 END AS claims,
         CASE WHEN l_linestatus <> 'O' THEN price * (CAST(1 AS DECIMAL(4,2)) - disc) ELSE 0 END AS earned,
         CASE WHEN l_linestatus = 'O' THEN price * disc ELSE 0 END AS opex,
         CASE WHEN l_returnflag = 'N' THEN price * tax ELSE 0 END AS manpower,
         CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END AS claims_reported,
         CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN qty ELSE 0 END AS claims_settled,
         qty AS quantity, l_returnflag AS returnflag, l_linestatus AS linestatus
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc,
               CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def panel_sql(keys: str, measures: str = "value") -> str:
    """WITH facts, panel: the panel at `keys` with DOUBLE measures."""
    sums = ", ".join(
        "CAST(COUNT(DISTINCT okey) AS DOUBLE) AS policies" if m == "policies" else f"CAST(SUM({m}) AS DOUBLE) AS {m}"
        for m in measures.replace(" ", "").split(",")
    )
    return f"WITH {FACTS},\npanel AS (SELECT {keys}, {sums} FROM facts GROUP BY {keys})"


def paired_sql(keys: str, measures: str = "value") -> str:
    """WITH facts, panel, pairs: each measure with the same period one year earlier (keys without fy)."""
    names = measures.replace(" ", "").split(",")
    cols = ", ".join([f"a.{k.strip()}" for k in keys.split(",")])
    on = " AND ".join([f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(",")])
    pair = ", ".join(f"a.{m}, b.{m} AS {m}_prior" for m in names)
    return (
        panel_sql(f"{keys}, fy", measures)
        + f",\npairs AS (SELECT {cols}, a.fy, {pair} FROM panel a LEFT JOIN panel b ON {on} AND b.fy = a.fy - 1)"
    )
