"""Queries over whole tables against their SQL on small tables with large and small ids."""

from collections import Counter

import pytest

from weft import showcase

TABLES = {
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(n, f"N{n}", n % 2) for n in range(3)]),
    "customer": ("c_custkey int, c_nationkey int", [(c, c % 3) for c in range(30, 50)]),
    "supplier": ("s_suppkey int, s_nationkey int", [(s, s % 3) for s in range(6)]),
    "orders": ("o_orderkey int, o_custkey int", [(o, 30 + o % 20) for o in range(1990, 2030)]),
    "lineitem": ("l_orderkey int, l_partkey int, l_suppkey int", [(o, 1, (o + k) % 6) for o in range(1990, 2030) for k in range(4)]),
    "events": ("event_id int, user_id int, event_type string", [(e, e * 7 % 90, ("click", "view")[e % 2]) for e in range(60)]),
}


@pytest.mark.parametrize("name, key, bound", [("cycle_project", "o", 2000), ("events_types", "u", 50), ("llm_demo_mid", "c", 40), ("llm_demo_tree", "c", 40)])
def test_whole_tables(spark, tmp_path, name, key, bound):
    for table, (schema, rows) in TABLES.items():
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        df.createOrReplaceTempView(table)
    found = showcase.queries()[name](spark, str(tmp_path))
    sql = spark.sql(showcase.oracle_sql()[name]).select(*found.columns)
    got = Counter(map(tuple, found.collect()))
    assert got == Counter(map(tuple, sql.collect()))
    at = found.columns.index(key)
    assert min(r[at] for r in got) < bound <= max(r[at] for r in got)
