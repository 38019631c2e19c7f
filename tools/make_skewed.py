"""Write a copy of the tables in which single keys hold a third of all rows.

usage: python tools/make_skewed.py SOURCE TARGET

One part and one order hold a third of the order lines each, one customer a third of the orders, and
one user a third of the events, all of them on one day.
"""

import glob
import os
import sys

import duckdb

SKEW = {
    "lineitem": """SELECT * EXCLUDE (i) REPLACE (
        CASE WHEN i % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey,
        CASE WHEN i % 3 = 1 THEN 11 ELSE l_orderkey END AS l_orderkey)
        FROM (SELECT *, row_number() OVER () AS i FROM t)""",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 2 THEN 5 ELSE o_custkey END AS o_custkey) FROM t",
    "events": """SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
        CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-09' + to_seconds(event_id % 86400) ELSE ts END AS ts) FROM t""",
}


def make_skewed(source: str, target: str) -> None:
    os.makedirs(target, exist_ok=True)
    for path in glob.glob(f"{source}/*.parquet"):
        name = os.path.basename(path)[:-8]
        if name not in ("region", "nation", "customer", "part", *SKEW):
            continue
        query = SKEW.get(name, "SELECT * FROM t")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW t AS SELECT * FROM '{path}'")
        con.execute(f"COPY ({query}) TO '{target}/{name}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    make_skewed(*sys.argv[1:3])
