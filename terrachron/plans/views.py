"""The driver's tables seen as map data: parts are nodes, orders ways, customers and their groups relations, events histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "2024-01-01 00:00:00"
#: Each view as SQL that Spark and DuckDB both run; q(name) is the name of a table or view before it.
VIEWS = {
    "node_v": """SELECT p_partkey + 1 AS id, (p_partkey * 7 % 1700) / 10.0E0 - 85 AS lat, (p_partkey * 13 % 3600) / 10.0E0 - 180 AS lon,
        CAST(p_size % 5 + 1 AS INT) AS version, p_partkey % 97 AS changeset, p_name AS usr, p_brand AS brand, p_type AS kind FROM part""",
    "ref_v": """SELECT l_orderkey + 1 AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS idx,
        l_partkey + 1 AS ref FROM lineitem""",
    "way_v": """SELECT o_orderkey + 1 AS id, o_custkey + 1 AS owner, o_orderdate AS ts, o_orderstatus AS status, o_orderpriority AS priority FROM orders""",
    "member_v": """SELECT o_custkey + 1 AS rel_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS idx, o_orderkey + 1 AS ref,
        CASE WHEN o_orderstatus = 'F' THEN 'outer' WHEN o_orderstatus = 'O' THEN 'inner' ELSE '' END AS role FROM orders""",
    "node_hist": """SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version, event_type <> 'error' AS visible, event_id AS changeset, ts,
        value AS lat, value / 2 AS lon FROM events""",
    "way_hist": """SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version, o_orderkey AS key,
        TIMESTAMP '2024-01-01 00:00:00' AS base, o_orderkey % 1400 AS off_h FROM orders""",
    "change_v": """SELECT CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS action, 'node' AS type, user_id AS id, event_id, ts, value FROM events""",
    "state_v": """SELECT CAST(row_number() OVER (ORDER BY h) + 100 AS BIGINT) AS seq, h AS ts FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) x""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_views(sql: str) -> str:
    """A query with the views it names, for either engine."""
    need: list[str] = []

    def add(text):
        for name, body in VIEWS.items():
            if name in text and name not in need:
                add(body)
                if name not in need:
                    need.append(name)

    add(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"


class Tables:
    """The tables of a folder, and SQL over them and the views; names are replaced, so that no session state is left."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        import re

        text = with_views(text)
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{self.dir}/{m[2]}.parquet`", text))
