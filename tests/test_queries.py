"""Queries against their oracles, on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__
from lodestone import queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


def test_oracles(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")

    def run(name):
        df = queries.QUERIES[name](spark, SF)
        return sorted(df.columns), sorted(repr([_plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())

    wrong = []
    with ThreadPoolExecutor(4) as pool:  # small queries wait for planning more than for cores
        for (name, sql), (columns, got) in zip(queries.ORACLES.items(), pool.map(run, queries.ORACLES), strict=True):
            cur = con.execute(sql)
            cols = [c[0] for c in cur.description]
            want = sorted(repr([_plain(r[cols.index(c)]) for c in sorted(cols)]) for r in cur.fetchall())
            if sorted(cols) != columns or want != got:
                wrong.append(name)
    assert not wrong


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_conditions_list_every_item_of_an_entry(spark, tmp_path):
    """One open entry is in the labels of more items than are ever listed as candidates."""
    con = duckdb.connect()
    name = "CASE WHEN k = 7 THEN 'gear' WHEN k % 7 IN (0, 6) THEN format('x{:04d}', k) ELSE 'solid gear' END"
    con.execute(f"CREATE TABLE part AS SELECT k AS p_partkey, {name} AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, 1 AS p_size, 1.0 AS p_retailprice FROM range(200) r(k)")
    con.execute("CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-01' AS ts, k AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM range(27, 28) r(k)")
    for t in ("part", "events"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = {r["entry_id"]: r["candidates"] for r in queries.QUERIES["conditions_match"](spark, str(tmp_path)).collect()}
    items = [q for q in range(200) if q % 10 in (6, 8) and q % 7 in range(1, 6) and q % 3 != 1]
    assert len(items) > 11 and got[7] == ",".join(map(str, items))
    assert 48 in got and 28 not in got  # someone took an item from 28 before
    assert got == dict(con.execute(queries.ORACLES["conditions_match"]).fetchall())
