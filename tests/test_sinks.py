import io
import json

import pytest

from weft import AnalysisError, Catalog, Engine
from weft.cli import main, parse_args
from weft.operators.sinks import Sink, write_csv, write_json, write_markdown
from weft.sources.catalog import cardinality
from weft.sources.ingest import ingest, parse_config, split_fields

CONFIG = """# people
COLUMN,id,0,uint64_t
column,name,1,string
COLUMN,age,2,int
PROJECTION,PersonName,0,1,1:n
projection,PersonAge,0,2,n:1
"""


def test_config():
    meta = parse_config(CONFIG, "people")
    assert [(c.name, c.index, c.type) for c in meta.columns] == [("id", 0, "uint64"), ("name", 1, "string"), ("age", 2, "uint64")]
    assert meta.projections[0].relation == "PersonName"
    assert parse_config("COLUMN,a,0,int\nCOLUMN,b,1,int", "t").projections[0].relation == "default"
    for bad in ("", "COLUMN,a,0,date", "FOO,a,0", "PROJECTION,x,0,1", "COLUMN,a,zero,int", "COLUMN,a,0,int\nPROJECTION,x,0,1,2:3", "COLUMN,a"):
        with pytest.raises(AnalysisError):
            parse_config(bad, "t")


@pytest.mark.parametrize("text,card", [("1:1", "1:1"), ("n:1", "n:1"), ("1:N", "1:n"), ("n:n", "m:n"), ("m:n", "m:n")])
def test_cardinality(text, card):
    assert cardinality(text) == card


@pytest.mark.parametrize(
    "line,fields",
    [("a,b", ["a", "b"]), (' a ,"b,c"', ["a", "b,c"]), ('a, "b"', ["a", '"b"']), ('"x ""y""",z', ['x "y"', "z"]), ('a"b,c', ['a"b', "c"]), (r'"a\"b",c', ['a"b', "c"]), ("a,,", ["a", "", ""]), ('"a"b",c', ['a"b', "c"])],
)
def test_fields(line, fields):
    assert split_fields(line, ",") == fields


def test_ingest_catalog_and_cli(spark, tmp_path, capsys):
    text = tmp_path / "people.csv"
    text.write_text('# comment\n1,"Ann, B",30\n\n2,NULL,x\n3,"",5\n4\n5, Bob ,7\n')
    meta = ingest(spark, str(text), str(tmp_path / "db" / "people"), CONFIG)
    assert (meta.rows, meta.skipped, meta.fallbacks) == (4, 1, 1)
    e = Engine(Catalog(spark).add_ingested(str(tmp_path / "db")))
    assert sorted(map(tuple, e.query("Q(p,n) := PersonName(p,n)").collect())) == [(1, "Ann, B"), (2, None), (3, None), (5, "Bob")]
    assert e.query("Q(MIN(a)) := PersonAge(p,a) WHERE GT(a,0)").first()[0] == 5
    assert main([str(tmp_path / "db"), "Q(COUNT(*)) := PersonName(p,n), PersonAge(p,a)", "p,n,a", "packed", "-t", "2", "-mode", "0"], spark) == 0
    assert "tuples: 4" in capsys.readouterr().out
    assert main([str(tmp_path / "db"), "Q(COUNT(*)) := Nope(p,n)", "p,n"], spark) == 1
    assert parse_args(["r", "q", "o"]).sink == "packed"
    strict = ingest(spark, str(text), str(tmp_path / "strict" / "people"), CONFIG, strict=True)
    assert strict.rows == 4
    e = Engine(Catalog(spark).add_ingested(str(tmp_path / "strict")))
    assert e.query("Q(COUNT(*)) := PersonAge(p,a) WHERE IS_NULL(a)").first()[0] == 1


def test_text_relations(spark, tmp_path):
    edges = tmp_path / "edges.txt"
    edges.write_text("1 2\n2   3\n# no\n3\t4\n")
    assert Engine(Catalog(spark).add_text(str(edges), "E")).query("Q(COUNT(*)) := E(a,b),E(b,c)").first()[0] == 2
    assert Engine(Catalog(spark).add_line(f"{edges},E(a,_,b),n:1")).query("Q(COUNT(*)) := E(a,b)").first()[0] == 3
    with pytest.raises(AnalysisError):
        Catalog(spark).add_line("nothing")
    pipes = tmp_path / "pipes"
    pipes.write_text("1|2\n2|3\n")
    ingest(spark, str(pipes), str(tmp_path / "p" / "t"), "COLUMN,a,0,int\nCOLUMN,b,1,int")
    assert Engine(Catalog(spark).add_ingested(str(tmp_path / "p"))).query("Q(COUNT(*)) := default(a,b)").first()[0] == 2


def test_sink_specs():
    assert Sink.parse("sink_csv:/a:b") == Sink("sink_csv", "/a:b")
    assert Sink.parse("sink_json:").path is None
    for bad in ("nothing", "packed:/x"):
        with pytest.raises(AnalysisError):
            Sink.parse(bad)
    with pytest.raises(AnalysisError):
        Sink.parse("min").check("count")
    with pytest.raises(AnalysisError):
        Sink.parse("packed").check("min")
    Sink.parse("min").check("min")


def test_writers():
    rows = [(1, 'a "b", c'), (2, None), (3, "x\ny")]
    out = io.StringIO()
    assert write_csv(out, ["i", "t"], rows) == 3
    assert out.getvalue() == 'i,t\n1,"a ""b"", c"\n2,\n3,"x\ny"\n'
    out = io.StringIO()
    write_json(out, ["i", "t"], rows)
    assert json.loads(out.getvalue()) == [{"i": i, "t": t} for i, t in rows]
    out = io.StringIO()
    write_json(out, ["i"], [])
    assert json.loads(out.getvalue()) == []
    out = io.StringIO()
    write_markdown(out, ["i", "text"], [(10, "a"), (2, None)])
    assert out.getvalue() == "| i  | text |\n|----|------|\n| 10 | a    |\n| 2  |      |\n"


def test_exports(spark, tmp_path, monkeypatch):
    e = Engine(Catalog(spark).add("R", spark.createDataFrame([(1, 2)], "a long, b long"), "a", "b"))
    report = e.run("Q(b) := R(a,b)", "a,b", f"sink_csv:{tmp_path}/out/r.csv")
    assert report.rows == 1
    assert (tmp_path / "out" / "r.csv").read_text() == "a,b\n1,2\n"
    assert json.loads((tmp_path / "out" / "metrics.json").read_text())["api_calls"] == 0
    monkeypatch.setenv("WEFT_OUTPUT", f"{tmp_path}/env.json")
    e.run("Q(a,b) := R(a,b)", None, "sink_json")
    assert json.loads((tmp_path / "env.json").read_text()) == [{"a": 1, "b": 2}]
    monkeypatch.delenv("WEFT_OUTPUT")
    shown = io.StringIO()
    e.run("Q(a,b) := R(a,b)", None, "sink_markdown", preview=shown)
    assert shown.getvalue().startswith("| a | b |")
    assert e.run("Q(NOOP) := R(a,b)", None, "pnoop").rows == 0
    assert e.run("Q(MIN(a)) := R(a,b)", None, "min").value == (1,)
    assert e.run("Q(a,b) := R(a,b)").rows == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from weft.sources.storage import shared_dir

    unset = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset)))
