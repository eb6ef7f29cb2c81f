import datetime as dt
import io
from decimal import Decimal

import pytest

from pathloom import __main__ as cli
from pathloom import dbapi
from pathloom.lang.errors import BindError, GraphError
from pathloom.session import Session
from pathloom.sources.graph import PropertyGraph
from pathloom.sources.tables import shop_graph

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def shop(spark):
    return Session(spark).register(shop_graph(spark, FOLDER))


def one(session, expression, params=()):
    return session.execute(f"SELECT {expression} AS v FROM MATCH (r:Region) WHERE r.r_regionkey = 0", params).first()[0]


@pytest.mark.parametrize(("expression", "value"), [
    ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 2", -1), ("7 / 2e0", 3.5), ("1.5 + 1", Decimal("2.5")), ("1.5 + 1e0", Decimal("2.5")), ("2 * 3 - 4", 2),
    ("NULL IS NULL", True), ("NULL AND FALSE", False), ("NULL OR TRUE", True), ("TRUE XOR TRUE", False), ("NOT FALSE", True), ("1 = 1.0", True), ("2 > 1e0", True),
    ("'a' = 0x61", True), ("'a' || 1", "a1"), ("DATE '2020-01-31' + INTERVAL 1 MONTH", dt.date(2020, 2, 29)), ("DATE '2020-01-31' + INTERVAL 25 HOUR", dt.date(2020, 2, 1)),
    ("TIMESTAMP '2020-01-01 00:00:00' - INTERVAL 1 SECOND", dt.datetime(2019, 12, 31, 23, 59, 59)), ("TIME '00:10:00' - INTERVAL 20 MINUTE", dt.time(23, 50)),
    ("TIME '10:00:00+01:00' < TIME '10:00:00+00:00'", True), ("TIMESTAMP '2020-01-01 10:00:00+01:00' = TIMESTAMP '2020-01-01 09:00:00+00:00'", True),
    ("CAST(TIME '10:00:00-07:30' + INTERVAL 1 HOUR AS STRING)", "11:00:00-07:30"), ("EXTRACT(TIMEZONE_MINUTE FROM TIME '10:00:00-07:30')", -30), ("EXTRACT(SECOND FROM TIME '10:00:42')", Decimal("42.000000")),
    ("CAST('12' AS INTEGER)", 12), ("CAST('10:00:00+02:00' AS TIME WITH TIME ZONE) = TIME '08:00:00+00:00'", True), ("CAST(TIMESTAMP '2020-01-01 10:11:12' AS TIME)", dt.time(10, 11, 12)), ("CAST(1 AS STRING)", "1"),
    ("CASE 2 WHEN 1 THEN 1 WHEN 2 THEN 2.5 END", Decimal("2.5")), ("CASE WHEN NULL THEN 1 END", None), ("3 IN (1, NULL)", None), ("3 NOT IN (1, 2)", True), ("ALL_DIFFERENT(1, 2, 1)", False),
    ("ABS(-3)", 3), ("CEIL(1.2e0)", 2.0), ("FLOOR(-1.2e0)", -2.0), ("SUBSTRING('hello' FROM 2 FOR 3)", "ell"), ("JAVA_REGEXP_LIKE('hello', 'l+')", True), ("LABELS(r)", ["Region"]), ("1<-1", False),
])
def test_expressions(shop, expression, value):
    assert one(shop, expression) == value


@pytest.mark.parametrize("expression", ["1 + 'a'", "NOT 1", "TRUE > 1", "LOWER(1)", "r + 1", "nobody.x", "r < r", "CAST(r AS INTEGER)", "DATE '2020-13-01'", "TIME '10:00:00+19:00'", "EXTRACT(HOUR FROM DATE '2020-01-01')", "r.r_name AND TRUE", "SUM('a')", "COUNT(r) + r.r_regionkey", "?"])
def test_type_errors(shop, expression):
    with pytest.raises(BindError):
        one(shop, expression)


@pytest.mark.parametrize("expression", ["1 / (r.r_regionkey * 0)", "1e0 / (r.r_regionkey * 0)", "9223372036854775807 + 1 + r.r_regionkey"])
def test_run_time_errors(shop, expression):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|OVERFLOW"):
        one(shop, expression)


def test_parameters(shop):
    q = "SELECT c.c_custkey FROM MATCH (c:Customer) WHERE c.c_custkey > ? AND c.c_mktsegment <> ? ORDER BY c.c_custkey LIMIT ?"
    assert len(shop.execute(q, [10, "X", 3]).collect()) == 3
    assert one(shop, "? + ?", [1, Decimal("1.5")]) == Decimal("2.5")
    assert one(shop, "?", [dt.date(2020, 1, 1)]) == dt.date(2020, 1, 1)


def test_elements_as_values(shop):
    r = shop.execute("SELECT * FROM MATCH (n:Nation)-[e:in_region]->(r) WHERE n.n_nationkey = 3").first()
    assert r.asDict().keys() == {"n", "e", "r"} and r.n.n_name == "NATION_3" and r.n.labels == ["Nation"] and r.e.src == r.n.id and r.e.dst == r.r.id
    assert list(shop.execute("SELECT * FROM MATCH (n:Nation)-[e:in_region]->(r)").columns) == ["n", "e", "r"]
    assert cli.shown(r.n) == f"VERTEX({r.n.id})" and cli.shown(r.e) == f"EDGE({r.e.src}, {r.e.dst})"


def test_plans(shop):
    def plan(q):
        return "\n".join(r[0] for r in shop.execute("EXPLAIN " + q).collect())

    p = plan("SELECT o.o_orderkey FROM MATCH (c:Customer)-[:placed]->(o:Purchase) WHERE o.o_totalprice > 100")
    assert "GreaterThan(o_totalprice,100" in p and "customer.parquet" not in p and "c_name" not in p and "Cartesian" not in p
    assert "lineitem" not in plan("SELECT n.n_name FROM MATCH (n)-[:in_region]->(r:Region)")


def test_dangling_edges_match_nothing_unless_sound(spark):
    g = PropertyGraph("g").add_vertices("V", spark.createDataFrame([(1,), (2,)], "k long"), "k")
    g.add_edges("e", spark.createDataFrame([(1, 2), (1, 9), (None, 2)], "a long, b long"), ("V", "a"), ("V", "b"))
    assert Session(spark).register(g).execute("SELECT COUNT(*) FROM MATCH ()-[:e]->()").first()[0] == 1


def test_properties_of_different_types(spark):
    g = PropertyGraph("g").add_vertices("A", spark.createDataFrame([(1, 5)], "k long, x long"), "k").add_vertices("B", spark.createDataFrame([(1, 2.5)], "k long, x double"), "k")
    g.add_vertices("S", spark.createDataFrame([(1, "s")], "k long, x string"), "k")
    s = Session(spark).register(g)
    assert sorted(r[0] for r in s.execute("SELECT v.x FROM MATCH (v:A|B)").collect()) == [2.5, 5.0]
    with pytest.raises(BindError, match="different types"):
        s.execute("SELECT v.x FROM MATCH (v)")


def test_mapped_graphs_are_read_only(shop):
    with pytest.raises(GraphError, match="mapped"):
        shop.execute("INSERT VERTEX x")


def test_import_and_transactions(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    g = PropertyGraph("g").add_vertices("V", spark.range(5).withColumnRenamed("id", "k"), "k")
    g.add_edges("e", spark.range(4).selectExpr("id as a", "id + 1 as b"), ("V", "a"), ("V", "b"))
    s.import_graph("copy", g)
    s.execute("USE copy")
    s.execute("BEGIN")
    s.execute("INSERT VERTEX x LABELS (V) PROPERTIES (x.k = 9)")
    assert Session(spark, str(tmp_path)).execute("SELECT COUNT(*) FROM MATCH (v) ON copy").first()[0] == 5
    s.execute("COMMIT")
    other = Session(spark, str(tmp_path))
    assert other.execute("SELECT COUNT(*) FROM MATCH (v) ON copy").first()[0] == 6
    assert other.execute("SELECT COUNT(e) AS n FROM MATCH ANY SHORTEST (a)-[e]->*(b) ON copy WHERE a.k = 0 AND b.k = 4").first()[0] == 4
    ids = [r[0] for r in other.execute("SELECT ID(v) FROM MATCH (v) ON copy").collect()]
    assert len(set(ids)) == 6


def test_dbapi(spark, tmp_path):
    connection = dbapi.connect(str(tmp_path), spark)
    c = connection.cursor()
    c.execute("CREATE GRAPH g").execute("USE g").execute("CREATE LABEL V")
    c.executemany("INSERT VERTEX x LABELS (V) PROPERTIES (x.a = ?)", [(1,), (2,), (3,)])
    c.execute("SELECT v.a AS a FROM MATCH (v:V) WHERE v.a >= ? ORDER BY a", [2])
    assert [d[0] for d in c.description] == ["a"] and c.fetchone() == (2,) and c.fetchmany(5) == [(3,)] and c.fetchall() == []
    c.execute("BEGIN").execute("DELETE v FROM MATCH (v)")
    connection.rollback()
    assert c.execute("SELECT COUNT(*) FROM MATCH (v)").fetchall() == [(3,)]
    with pytest.raises(dbapi.Error):
        c.execute("SELECT FROM")


def test_cli(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.StringIO("CREATE GRAPH g; USE g;\nINSERT VERTEX x PROPERTIES (x.a = 123);\nSELECT x.a,\n  x AS v FROM MATCH (x);\nSELECT nonsense;\nSHOW GRAPHS"))
    assert cli.main(["play", "-D", str(tmp_path)]) == 1
    out = capsys.readouterr().out
    assert "| `x`.`a` | v         |" in out and "| 123     | VERTEX(1) |" in out and "error: syntax error" in out and "| g     |" in out
