"""Sessions, scripts, files, the catalog, limits and rewrites."""

import gzip
import http.server
import json
import threading

import pytest
from algebra_cases import rows

from tessera.plans import rules
from tessera.plans.lexer import AlgebraError
from tessera.plans.parser import parse
from tessera.session import Limits, Session


def test_script_with_files(session, tmp_path):
    (tmp_path / "o.csv").write_text("id,who,at\n1,Ada,2026-03-01\n2,,2026-03-02\n")
    (tmp_path / "d.json").write_text(json.dumps({"data": {"items": [{"id": 1, "t": ["x", "y"]}, {"id": 2, "more": 1.5}]}}))
    got = session.script('source O from csv("o.csv") { }; source J from json("d.json") { records: "data.items" }; query { σ at > DATE \'2026-03-01\' (O) }; query { π id (μ t (J)) };', str(tmp_path))
    assert [k for k, _ in got] == ["query[0]", "query[1]"]
    assert got[0][1].to_list()[0].who is None
    assert rows(got[1][1]) == [(1,), (1,)]


def test_csv_with_schema_and_columns(session, tmp_path):
    (tmp_path / "v.csv").write_text("2026-03-01,home,3\n2026-03-02,docs,4\n")
    session.script('source V from csv("v.csv") { header: false, columns: [day, page, hits] };', str(tmp_path))
    assert rows(session.relation("γ SUM(hits) → n (V)")) == [(7.0,)]
    (tmp_path / "w.csv").write_text("a,b\n1,true\n2,maybe\n")
    session.script('source W from csv("w.csv") { schema: { a: NUMBER, b: BOOLEAN } };', str(tmp_path))
    with pytest.raises(Exception, match="no BOOLEAN"):
        session.relation("W").to_list()


def test_imports_and_privacy(session, tmp_path):
    (tmp_path / "lib.x").write_text("private Rates := [\n| c | r |\n|---|---|\n| E | 2 |\n];\nPrices := { π c, r (Rates) };\ndef twice(x: NUMBER): NUMBER := { x * 2 };")
    session.script('import "lib.x";', str(tmp_path))
    assert rows(session.relation("π twice(r) → t (Prices)")) == [(4,)]
    with pytest.raises(AlgebraError):
        session.relation("Rates").df
    (tmp_path / "loop.x").write_text('import "loop.x";')
    with pytest.raises(AlgebraError):
        session.script('import "loop.x";', str(tmp_path))


def test_logs(session, tmp_path):
    lines = '1.2.3.4 - bob [10/Oct/2026:13:02:11 +0000] "GET /a HTTP/1.1" 200 51 "-" "Mozilla"\n1.2.3.4 - - [10/Oct/2026:13:40:00 +0000] "GET /b HTTP/1.1" 404 - "x" "Mozilla"\n'
    with gzip.open(tmp_path / "access.log.gz", "wt") as f:
        f.write(lines)
    session.script(f'connection logs from log {{ path: "{tmp_path}", format: "combined" }}; source A from logs {{ table: "access.log.gz", schema: {{ host: STRING, at: TIMESTAMP, status: NUMBER, path: STRING, user: STRING }} }};')
    assert rows(session.relation("π path, status, user, s (SESSIONIZE at GAP DURATION 'PT30M' PER host AS s (A))")) == [("/a", 200, "bob", 1), ("/b", 404, None, 2)]
    assert "agent" in session.relation("logs.`access.log.gz`").df.columns


def test_gedcom(session, tmp_path):
    (tmp_path / "f.ged").write_text("0 HEAD\n1 CHAR UTF-8\n0 @I1@ INDI\n1 NAME Ann /Lee/\n1 SEX F\n1 BIRT\n2 DATE 3 MAR 1901\n2 PLAC York\n0 @I2@ INDI\n1 NAME Bo /Lee/\n1 DEAT\n2 DATE ABT 1950\n0 @F1@ FAM\n1 WIFE @I1@\n1 CHIL @I2@\n0 TRLR\n")
    session.script(f'connection g from gedcom {{ path: "{tmp_path}/f.ged" }};')
    got = {r.id: r for r in session.relation("g.individuals").to_list()}
    assert str(got["I1"].birth.date) == "1901-03-03" and got["I1"].surname == "Lee" and got["I2"].death.date is None and got["I2"].death.text == "ABT 1950"
    assert rows(session.relation("π wife, c (μ c (π wife, children → c (g.families)))")) == [("I1", "I2")]


@pytest.fixture
def server():
    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"data": [{"id": 1, "a": {"b": "x"}, "q": self.path, "t": self.headers.get("Authorization")}, {"id": 2}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            query = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["query"]
            body = json.dumps({"data": {"users": [{"id": 1, "name": query}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_http(spark, server):
    s = Session(spark, placeholders={"TOKEN": "secret"}.get)
    s.script(f'source U from http {{ url: "{server}/users", auth: bearer("${{TOKEN}}"), extract: json("$.data[*]"), paginate: {{ limit: query("limit") [default: 5] }}, schema: {{ id: NUMBER, city: STRING at "$.a.b", q: STRING, t: STRING }} }};')
    assert rows(s.relation("U")) == [(1.0, "x", "/users?limit=5", "Bearer secret"), (2.0, None, None, None)]
    s.script(f'source V from http {{ url: "{server}/v", extract: json("$.data") }};')
    assert rows(s.relation("π id, a.b → b (V)")) == [(1, "x"), (2, None)]
    # what a query asks goes into the request
    assert "limit=2" in s.relation("λ 2 (U)").to_list()[0].q
    s.script(f'source P from http {{ url: "{server}/p/{{id}}", extract: json("$.data"), schema: {{ id: in STRING as path("id") [required], q: STRING }} }};')
    assert {r.q for r in s.relation("π q (σ id = 'ab' (P))").to_list()} == {"/p/ab", None}
    with pytest.raises(AlgebraError):
        s.relation("P").df
    s.script(f'source G from http {{ url: "{server}/g", method: POST, extract: json("$.data.users"), schema: {{ id: NUMBER, name: STRING, bio: STRING at "$.more.bio" }} }};')
    assert rows(s.relation("π id, name (G)")) == [(1.0, "{ users { id name } }")]
    assert rows(s.relation("π name (G)")) == [("{ users { name } }",)]
    with pytest.raises(AlgebraError):
        s.script(f'source W from http {{ url: "{server}", method: PUT }};')


def test_catalog(session):
    session.script("T := [\n| a | b |\n|---|---|\n| 1 | x |\n| 2 | x |\n]; V := { σ a > 1 (T) }; W := { π a (V) };")
    assert rows(session.relation("π name, kind, row_count (sys.relations)")) == sorted([("T", "INL", 2), ("V", "QR", None), ("W", "QR", None)], key=repr)
    assert rows(session.relation("sys.deps('W')")) == [("T",), ("V",)]
    assert rows(session.relation("sys.impact('T')")) == [("V",), ("W",)]
    assert rows(session.relation("sys.find('b')")) == [("T", "S"), ("V", "S")]
    assert rows(session.relation("π relation, column (sys.keys)")) == [("T", "a")]
    assert rows(session.relation("sys.unused")) == [("W",)]
    assert session.relation("σ category = 'math' (sys.functions)").count() > 20
    assert session.relation("sys.catalog").count() > 10
    assert session.relation("σ query = 'W' (sys.plan)").count() == 2


def test_events_tell_the_previous_run(session):
    session.source("T", [(1,)], "a int")
    session.relation("δ (δ (T))").to_list()
    got = session.relation("sys.events").df.collect()
    assert {r.code for r in got} >= {"DIST-001", "ROWS"}


def test_relationships(session):
    session.script('C := [\n| id |\n|---|\n| 1 |\n]; O := [\n| c | n |\n|---|---|\n| 1 | 5 |\n] references { c -> C.id }; N := [\n| n |\n|---|\n| 5 |\n]; relate "numbered" O.n -> N.n;')
    assert session.join_path("C", "N") == ["c", "numbered"]
    with pytest.raises(AlgebraError):
        session.script('relate "bad" O.zzz -> C.id;')


def test_limits(spark):
    s = Session(spark, limits=Limits(input_chars=30, output_rows=2, rounds=3, sealed=True))
    s.source("T", [(i,) for i in range(5)], "a int")
    with pytest.raises(AlgebraError):
        s.relation("σ a > 1 ∧ a > 2 ∧ a > 3 ∧ a > 4 (T)")
    got = s.relation("T").to_list()
    assert len(got) == 2 and got.truncated and not s.relation("λ 2 (T)").to_list().truncated
    with pytest.raises(AlgebraError):
        s.script('env from "x";')
    offered = 'source N from generator { name: "Range", lo: "1", hi: "3" }; T := { λ 1 (N) };'
    s = Session(spark, limits=Limits(sealed=True, declarations=offered))
    assert s.relation("T").count() == 1
    with pytest.raises(AlgebraError):
        s.script('source X from csv("/etc/passwd") { schema: { line: STRING } };')


def test_parameters_are_values(session):
    session.source("T", [("a'b",), ("c",)], "a string")
    assert rows(session.relation("σ a = $x (T)").bind(x="a'b")) == [("a'b",)]
    with pytest.raises(AlgebraError):
        session.relation("σ a = $x (T)").df


def test_fluent_equals_text(session):
    session.source("T", [(1, "x", 5), (2, "x", 7), (3, "y", 1)], "id int, k string, v int")
    t = session.relation("T")
    assert rows(t.select("v > 2").aggregate("k", "SUM(v) -> s")) == rows(session.relation("γ k, SUM(v) → s (σ v > 2 (T))"))
    assert rows(t.rename("a").join(t.rename("b"), "a.k = b.k").project("a.id -> x", "b.id -> y")) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert rows(t.top(1, "v DESC", per="k")) == [(2, "x", 7), (3, "y", 1)]
    assert rows(t.union(t).difference(t.select("k = 'x'"))) == [(3, "y", 1)]
    assert t.sort("v").limit(1).to_list()[0].id == 3
    assert t.window("ROW_NUMBER()", "v", "n", per="k").count() == 3
    assert "σ" in t.select("v > 2").render() and json.loads(t.render_json())["op"] == "Relation"
    assert "Scan" in t.explain() or "Row" in t.explain()


def test_rewrites_keep_the_rows(session):
    session.source("T", [(1, 2), (2, 3), (3, 1), (1, 2)], "a int, b int")
    for text, code in {
        "σ a > 5 ∧ a < 3 (δ (T))": "PRED-004", "T × UNIT": "PROD-001", "T ∪ T": "SET-001", "T − T": "SET-001", "δ (T ∪ T)": "DIST-001", "γ a, MAX(b) → m (δ (T))": "DIST-002",
        "σ a = 1 (FIX x (π a, b (T), π x.a, T.b (x ⨝ x.b = T.a (T))))": "FIX-001", "σ g = 1 (OPTIMIZE MAXIMIZE SUM(b) SUBJECT TO SUM(b) <= 3 PER g (π a → g, b (T)))": "OPTIMIZE-001",
    }.items():
        log = []
        rules.optimize(parse(text), log)
        assert code in {c for c, _ in log}, text
        plain = Session(session.spark)
        plain.source("T", [(1, 2), (2, 3), (3, 1), (1, 2)], "a int, b int")
        from tessera.plans import lower

        unchanged = lower.Lowering(plain, {}).rel(parse(text)).named()
        assert rows(session.relation(text)) == rows(unchanged), text


def test_streams_refuse_what_needs_all_rows(session, tmp_path):
    session.spark.range(3).selectExpr("id", "timestamp_seconds(id) ts").write.parquet(str(tmp_path / "s"))
    stream = session.spark.readStream.schema("id bigint, ts timestamp").parquet(str(tmp_path / "s"))
    session.table("S", stream)
    assert session.relation("σ id > 1 (S)").df.isStreaming
    with pytest.raises(AlgebraError):
        session.relation("τ id (S)").df


def test_stateful_session_labels(session, tmp_path):
    from tessera.streaming.windows import drained, labelled

    session.spark.createDataFrame([("a", 0), ("a", 50), ("a", 200), ("b", 5)], "u string, t long").selectExpr("u", "timestamp_seconds(t) ts").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = session.spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "s"))
    got = drained(labelled(stream, "ts", 60, "u", "s"), "append")
    assert sorted((r.u, r.ts.second + 60 * r.ts.minute, r.s) for r in got.collect()) == [("a", 0, 1), ("a", 50, 1), ("a", 200, 2), ("b", 5, 1)]


def test_types_are_told_from_all_rows(session, tmp_path):
    (tmp_path / "late.csv").write_text("a,b,c,d\n" + "1,true,2024-01-02,\n" * 1500 + "x, FALSE ,2024-01-03,\n")
    session.input("Late", str(tmp_path / "late.csv"))
    kinds = dict(session.relation("Late").df.dtypes)
    assert kinds["a"] == "string" and kinds["b"] == "boolean" and kinds["c"] == "date" and kinds["d"] == "string"
    assert session.relation("σ a = 'x' (Late)").count() == 1


def test_many_components_are_numbered_in_ranges(session, monkeypatch):
    from tessera.operators import windows

    session.source("E", [(i, i + 1) for i in range(0, 60, 3)], "a int, b int")
    few = rows(session.relation("CLUSTER a, b AS label (E)"))
    monkeypatch.setattr(windows, "ONE_TASK", -1)
    assert rows(session.relation("CLUSTER a, b AS label (E)")) == few and {n for _, n in few} == set(range(1, 21))
