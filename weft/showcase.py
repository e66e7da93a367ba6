"""Rules over the star-schema tables, one or more for each operator, with the SQL that says what they mean."""

from __future__ import annotations

import csv
import io
import json
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.catalog import Catalog

#: Relation: (table, source, target, cardinality).
RELATIONS = {
    "Nation_Region": ("nation", "n_nationkey", "n_regionkey", "n:1"),
    "Customer_Nation": ("customer", "c_custkey", "c_nationkey", "n:1"),
    "Supplier_Nation": ("supplier", "s_suppkey", "s_nationkey", "n:1"),
    "Order_Customer": ("orders", "o_orderkey", "o_custkey", "n:1"),
    "Item_Order": ("lineitem", "l_partkey", "l_orderkey", "m:n"),
    "Item_Supplier": ("lineitem", "l_orderkey", "l_suppkey", "m:n"),
    "Item_PartSupp": ("lineitem", "l_partkey", "l_suppkey", "m:n"),
    "Nation_Name": ("nation", "n_nationkey", "n_name", "1:1"),
    "Region_Name": ("region", "r_regionkey", "r_name", "1:1"),
    "Customer_Segment": ("customer", "c_custkey", "c_mktsegment", "n:1"),
    "Order_Status": ("orders", "o_orderkey", "o_orderstatus", "n:1"),
    "Order_Priority": ("orders", "o_orderkey", "o_orderpriority", "n:1"),
    "Part_Brand": ("part", "p_partkey", "p_brand", "n:1"),
    "Part_Name": ("part", "p_partkey", "p_name", "1:1"),
    "Part_Size": ("part", "p_partkey", "p_size", "n:1"),
    "Event_User": ("events", "event_id", "user_id", "n:1"),
    "Event_Type": ("events", "event_id", "event_type", "n:1"),
    "Doc_Lang": ("documents", "doc_id", "lang", "n:1"),
    "Label_Quality": ("labels", "doc_id", "quality", "n:1"),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog(spark)
    for name, (table, source, target, card) in RELATIONS.items():
        out.add_parquet(f"{sf_dir}/{table}.parquet", **{name: (source, target, card)})
    # the tables hold no NULL where rules look: one brand becomes NULL
    out.add("Part_BrandN", lambda: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.nullif("p_brand", F.lit("Brand#13")).alias("brand")), "p_partkey", "brand", "n:1")
    return out


def _edges(relation: str, a: str, b: str) -> str:
    """SQL of a relation; integer keys are bigints on both sides."""
    if relation == "Part_BrandN":
        return f"(SELECT CAST(p_partkey AS BIGINT) AS {a}, nullif(p_brand, 'Brand#13') AS {b} FROM part)"
    table, source, target, _ = RELATIONS[relation]
    text = target in ("n_name", "r_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "p_brand", "p_name", "event_type", "lang")
    return f"(SELECT CAST({source} AS BIGINT) AS {a}, {target if text else f'CAST({target} AS BIGINT)'} AS {b} FROM {table})"


def _join(*atoms: tuple[str, str, str]) -> str:
    """FROM clause of atoms joined on the variables they share, in this order."""
    seen: set[str] = set()
    out = ""
    for i, (relation, a, b) in enumerate(atoms):
        keys = [v for v in (a, b) if v in seen]
        out += (" JOIN " if i else "") + _edges(relation, a, b) + f" t{i}" + (f" USING ({', '.join(keys)})" if i else "")
        seen |= {a, b}
    return out


@dataclass(frozen=True)
class Example:
    rule: str
    sql: str
    ordering: str | None = None
    names: tuple[str, ...] = ()
    rewrite: bool = True

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(catalog(spark, sf_dir)).query(self.rule, self.ordering, rewrite=self.rewrite)
        return df.toDF(*self.names) if self.names else df


NR, CN, SN, OC = ("Nation_Region", "n", "r"), ("Customer_Nation", "c", "n"), ("Supplier_Nation", "s", "n"), ("Order_Customer", "o", "c")
IO, IS, IP = ("Item_Order", "p", "o"), ("Item_Supplier", "o", "s"), ("Item_PartSupp", "p", "s")


def _body(*atoms: tuple[str, str, str]) -> str:
    return ", ".join(f"{r}({a},{b})" for r, a, b in atoms)


def _count(*atoms, where: str = "", sql_where: str = "", **more) -> Example:
    return Example(
        f"Q(COUNT(*)) := {_body(*atoms)}{f' WHERE {where}' if where else ''}",
        f"SELECT count(*) AS cnt FROM {_join(*atoms)}{f' WHERE {sql_where}' if sql_where else ''}",
        names=("cnt",), **more,
    )


def _rows(head: str, *atoms, where: str = "", sql_where: str = "", **more) -> Example:
    return Example(
        f"Q({head}) := {_body(*atoms)}{f' WHERE {where}' if where else ''}",
        f"SELECT {head} FROM {_join(*atoms)}{f' WHERE {sql_where}' if sql_where else ''}",
        **more,
    )


_DEMO = json.dumps({"model": "demo", "prompt": "Name the nation.", "context_column": ["n", "name"]})
_TREE = json.dumps({"model": "demo", "prompt": "Name the pair.", "tuple_format": "FTREE", "context_column": {"r": 2, "n": 4}})

EXAMPLES: dict[str, Example] = {
    # joins and counts
    "count_chain": _count(NR, CN, OC),
    "count_chain_items": _count(NR, CN, OC, ("Item_Supplier", "o", "s")),
    "count_star": _count(CN, SN),
    "count_star_orders": _count(CN, SN, OC),
    "count_plain": _count(NR, CN, OC, rewrite=False),
    "project_chain": _rows("o, c, n", NR, CN, OC),
    "project_ordered": _rows("n, c, o", CN, OC, ordering="n,c,o"),
    # scalar predicates
    "scan_eq": _rows("o, c", OC, where="EQ(c,7)", sql_where="c = 7"),
    "scan_neq": _rows("c, n", CN, where="c <> 7 AND NEQ(n,3)", sql_where="c <> 7 AND n <> 3"),
    "scan_range": _rows("o, c", OC, where="GTE(o,100) AND o < 400 AND GT(c,3) AND c <= 900", sql_where="o >= 100 AND o < 400 AND c > 3 AND c <= 900"),
    "scan_in": _rows("c, n", CN, where="IN(n,1,2,3)", sql_where="n IN (1,2,3)"),
    "scan_not_in": _rows("c, n", CN, where="NOT_IN(n,1,2,3)", sql_where="n NOT IN (1,2,3)"),
    "scan_between": _rows("c, n", CN, where="BETWEEN(c,10,60)", sql_where="c BETWEEN 10 AND 60"),
    "string_eq": _rows("c, seg", ("Customer_Segment", "c", "seg"), where="EQ(seg,'BUILDING')", sql_where="seg = 'BUILDING'"),
    "string_range": _rows("p, brand", ("Part_Brand", "p", "brand"), where="brand >= 'Brand#2' AND LT(brand,'Brand#4')", sql_where="brand >= 'Brand#2' AND brand < 'Brand#4'"),
    "string_in": _rows("p, brand", ("Part_Brand", "p", "brand"), where="IN(brand,'Brand#11','Brand#22')", sql_where="brand IN ('Brand#11','Brand#22')"),
    "like": _rows("p, name", ("Part_Name", "p", "name"), where="LIKE(name,'l_rge%w%')", sql_where="name LIKE 'l_rge%w%'"),
    "not_like": _rows("p, name", ("Part_Name", "p", "name"), where="NOT_LIKE(name,'%widget')", sql_where="name NOT LIKE '%widget'"),
    "is_null": _rows("p, b", ("Part_BrandN", "p", "b"), where="IS_NULL(b)", sql_where="b IS NULL"),
    "is_not_null": _rows("p, b", ("Part_BrandN", "p", "b"), where="IS_NOT_NULL(b)", sql_where="b IS NOT NULL"),
    "null_not_in": _rows("p, b", ("Part_BrandN", "p", "b"), where="NOT_IN(b,'Brand#11')", sql_where="b NOT IN ('Brand#11')"),
    # boolean logic across variables
    "pred_and_or": _rows("c, n, r", CN, NR, where="EQ(n,1) OR EQ(r,2) AND LT(c,50)", sql_where="n = 1 OR (r = 2 AND c < 50)"),
    "pred_nested": _rows("c, n, r", CN, NR, where="(EQ(n,1) OR EQ(r,2)) AND (LT(c,50) OR (GT(c,80) AND c < 120))", sql_where="(n = 1 OR r = 2) AND (c < 50 OR (c > 80 AND c < 120))"),
    # attribute against attribute
    "theta_lt": _count(("Customer_Nation", "c1", "n"), ("Customer_Nation", "c2", "n"), where="LT(c1,c2)", sql_where="c1 < c2"),
    "theta_neq": _count(("Supplier_Nation", "s1", "n"), ("Supplier_Nation", "s2", "n"), where="NEQ(s1,s2)", sql_where="s1 <> s2"),
    "theta_string": _count(("Order_Status", "o", "st"), ("Order_Priority", "o", "pr"), where="LT(st,pr)", sql_where="st < pr"),
    "theta_in_or": _count(CN, SN, where="LT(c,s) OR EQ(n,3)", sql_where="c < s OR n = 3"),
    # cycles
    "cycle_triangle": _count(IO, IS, IP),
    "cycle_square": _count(OC, CN, SN, IS),
    "cycle_nway": _count(OC, CN, SN, IS, IO, IP),
    "cycle_project": _rows("o, c, s", OC, CN, SN, IS),
    # anti-joins
    "anti_semi": Example(
        "Q(COUNT(*)) := Order_Customer(o,c), Customer_Nation(c,n), Supplier_Nation(s,n) WHERE NOTEXISTS(o,s,Item_Supplier)",
        f"SELECT count(*) AS cnt FROM {_join(OC, CN, SN)} WHERE NOT EXISTS (SELECT 1 FROM {_edges('Item_Supplier', 'x', 'y')} e WHERE e.x = o AND e.y = s)",
        names=("cnt",),
    ),
    "anti_in_or": Example(
        "Q(COUNT(*)) := Order_Customer(o,c), Customer_Nation(c,n), Supplier_Nation(s,n) WHERE NOTEXISTS(o,s,Item_Supplier) AND LT(o,500) OR EQ(n,2)",
        f"SELECT count(*) AS cnt FROM {_join(OC, CN, SN)} WHERE (o < 500 AND NOT EXISTS (SELECT 1 FROM {_edges('Item_Supplier', 'x', 'y')} e WHERE e.x = o AND e.y = s)) OR n = 2",
        names=("cnt",),
    ),
    # omitted variables are existential
    "property_semi": Example(
        "Q(c, n) := Customer_Nation(c,n), Customer_Segment(c,seg) WHERE EQ(seg,'BUILDING')",
        f"SELECT c, n FROM {_edges('Customer_Nation', 'c', 'n')} t WHERE EXISTS (SELECT 1 FROM {_edges('Customer_Segment', 'x', 'seg')} e WHERE e.x = c AND seg = 'BUILDING')",
        "c,n",
    ),
    "property_exists": Example(
        "Q(COUNT(*)) := Customer_Nation(c,n), Order_Customer(o,c), Order_Status(o,st) WHERE EQ(st,'F')",
        f"SELECT count(*) AS cnt FROM {_edges('Customer_Nation', 'c', 'n')} t WHERE EXISTS (SELECT 1 FROM {_join(('Order_Customer', 'o', 'k'), ('Order_Status', 'o', 'st'))} WHERE k = c AND st = 'F')",
        "n,c", ("cnt",),
    ),
    "property_theta": Example(
        "Q(c, n) := Customer_Nation(c,n), Supplier_Nation(s,n) WHERE GT(s,c)",
        f"SELECT c, n FROM {_edges('Customer_Nation', 'c', 'n')} t WHERE EXISTS (SELECT 1 FROM {_edges('Supplier_Nation', 's', 'm')} e WHERE m = n AND s > c)",
        "n,c",
    ),
    # atoms
    "wildcard_atom": Example("Q(n, name) := Nation_Region(n,_,r), Nation_Name(n,_,name)", f"SELECT n, name FROM {_join(NR, ('Nation_Name', 'n', 'name'))}"),
    "parallel_atoms": _count(IS, ("Item_Supplier", "o", "s")),
    "self_loop": Example("Q(COUNT(*)) := Nation_Region(n,n)", "SELECT count(*) AS cnt FROM nation WHERE n_nationkey = n_regionkey", names=("cnt",)),
    # minima
    "min_numeric": Example("Q(MIN(o,c)) := Order_Customer(o,c), Customer_Nation(c,n) WHERE EQ(n,5)", f"SELECT min(o) AS min_o, min(c) AS min_c FROM {_join(OC, CN)} WHERE n = 5"),
    "min_string": Example("Q(MIN(name)) := Nation_Region(n,r), Nation_Name(n,name) WHERE GT(r,1)", f"SELECT min(name) AS min_name FROM {_join(NR, ('Nation_Name', 'n', 'name'))} WHERE r > 1"),
    "min_multi": Example(
        "Q(MIN(seg,st,n)) := Customer_Segment(c,seg), Order_Customer(o,c), Order_Status(o,st), Customer_Nation(c,n)",
        f"SELECT min(seg) AS min_seg, min(st) AS min_st, min(n) AS min_n FROM {_join(('Customer_Segment', 'c', 'seg'), OC, ('Order_Status', 'o', 'st'), CN)}",
    ),
    "min_empty": Example("Q(MIN(o)) := Order_Customer(o,c) WHERE LT(c,0)", "SELECT CAST(min(o_orderkey) AS BIGINT) AS min_o FROM orders WHERE o_custkey < 0"),
    "min_cyclic": Example("Q(MIN(o,p)) := Item_Order(p,o), Item_Supplier(o,s), Item_PartSupp(p,s)", f"SELECT min(o) AS min_o, min(p) AS min_p FROM {_join(IO, IS, IP)}"),
    "noop": Example("Q(NOOP) := Nation_Region(n,r)", f"SELECT n, r FROM {_join(NR)}"),
    # other tables
    "events_types": _rows("e, u, ty", ("Event_User", "e", "u"), ("Event_Type", "e", "ty"), where="EQ(ty,'click')", sql_where="ty = 'click'"),
    "documents_quality": _rows("d, lang, q", ("Doc_Lang", "d", "lang"), ("Label_Quality", "d", "q"), where="NEQ(lang,'en') AND EQ(q,1)", sql_where="lang <> 'en' AND q = 1"),
    # LLM map
    "llm_demo_flat": Example(
        f"Q(n, name, answer) := Nation_Name(n,name), answer = LLM_MAP({_DEMO})",
        "SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS name, 'Tuple ' || (row_number() OVER (ORDER BY n_nationkey, n_name) - 1) AS answer FROM nation",
        "n,name,answer",
    ),
    "llm_demo_mid": Example(
        f"Q(n, name, answer, c) := Nation_Name(n,name), answer = LLM_MAP({_DEMO}), Customer_Nation(c,n)",
        f"SELECT n, name, answer, c FROM (SELECT n, name, 'Tuple ' || (row_number() OVER (ORDER BY n, name) - 1) AS answer FROM {_edges('Nation_Name', 'n', 'name')} t) JOIN {_edges('Customer_Nation', 'c', 'n')} u USING (n)",
        "n,name,answer,c",
    ),
    "llm_demo_tree": Example(
        f"Q(r, n, c, answer) := Nation_Region(n,r), answer = LLM_MAP({_TREE}), Customer_Nation(c,n)",
        f"SELECT r, n, c, answer FROM (SELECT r, n, 'Tuple ' || (row_number() OVER (ORDER BY r, n) - 1) AS answer FROM {_edges('Nation_Region', 'n', 'r')} t) JOIN {_edges('Customer_Nation', 'c', 'n')} u USING (n)",
        "r,n,answer,c",
    ),
}


def _exported(kind: str, parse: Callable[[str], list[tuple]]) -> Callable[[SparkSession, str], DataFrame]:
    """Nations by a file sink of the driver, read back from the file."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tempfile.TemporaryDirectory() as folder:
            path = f"{folder}/nations"
            Engine(catalog(spark, sf_dir)).run("Q(n, name) := Nation_Name(n,name)", "n,name", f"{kind}:{path}")
            with open(path, encoding="utf-8", newline="") as f:
                rows = parse(f.read())
        return spark.createDataFrame([(int(n), name) for n, name in rows], "n long, name string")

    return run


EXPORTS = {
    "export_csv": _exported("sink_csv", lambda text: list(csv.reader(io.StringIO(text)))[1:]),
    "export_json": _exported("sink_json", lambda text: [(r["n"], r["name"]) for r in json.loads(text)]),
    "export_markdown": _exported("sink_markdown", lambda text: [tuple(c.strip() for c in line.split("|")[1:3]) for line in text.splitlines()[2:]]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in EXAMPLES.items()} | EXPORTS


def oracle_sql() -> dict[str, str]:
    files = dict.fromkeys(EXPORTS, f"SELECT n, name FROM {_edges('Nation_Name', 'n', 'name')} t")
    return {name: e.sql for name, e in EXAMPLES.items()} | files
