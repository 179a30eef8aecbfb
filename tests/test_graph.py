from pyspark.sql import functions as F
import pytest

from codeloom.operators import community, mro, process, search, tools, traverse
from codeloom.operators.graph import PropertyGraph
from codeloom.plans.cypher import CypherError, markdown, run

NODES = "id string, label string, name string, filePath string, isExported boolean"
EDGES = "src string, dst string, type string, confidence double"


@pytest.fixture(scope="module")
def graph(spark):
    n = [("f1", "Function", "main", "src/main.py", True), ("f2", "Function", "helper", "src/util.py", False), ("f3", "Function", "deep", "src/deep.py", False), ("c1", "Class", "Box", "src/box.py", True), ("m1", "Method", "open", "src/box.py", True), ("t1", "Function", "test_it", "src/tests/a.py", False)]
    e = [("f1", "f2", "CALLS", 1.0), ("f2", "f3", "CALLS", 0.9), ("f1", "m1", "CALLS", 0.4), ("c1", "m1", "HAS_METHOD", 1.0), ("t1", "f3", "CALLS", 1.0), ("f1", "gone", "CALLS", None)]
    return PropertyGraph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def test_patterns(spark, graph):
    one = spark.createDataFrame([("f1",)], "id string")
    assert {r.other for r in graph.expand(one).collect()} == {"f2", "m1", "gone"}
    assert {r.other for r in graph.expand(one, types=["CALLS"], min_confidence=0.5).collect()} == {"f2", "gone"}  # unknown confidence passes
    assert {r.id: r.other for r in graph.optional(graph.label("Class"), types=["CALLS"]).collect()} == {"c1": None}
    assert [r.n2 for r in graph.hops(one, 2).collect()] == ["f3"]
    assert {(r.src, r.dst) for r in graph.orphans().collect()} == {("f1", "gone")}
    left = graph.without_files(spark.createDataFrame([("src/util.py",)], "filePath string"))
    assert left.nodes.count() == 5 and left.edges.filter("src = 'f2' or dst = 'f2'").count() == 0


def test_impact_stops_at_tests(spark, graph):
    target = tools.resolve_target(graph, "deep").select("id")
    assert {(r.id, r.depth) for r in tools.impact(graph, target).collect()} == {("f2", 1), ("f1", 2)}
    assert {r.id for r in tools.impact(graph, target, tests=True).collect()} == {"f1", "f2", "t1"}


def test_levels_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")], "src string, dst string")
    n = spark.createDataFrame([(c,) for c in "abcdxyzs"], "id string")
    assert {r.id: r.level for r in traverse.levels(e, n).collect()} == dict(c=0, b=1, d=1, a=2, x=3, y=3, z=3, s=3)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in [*range(21), 50, 51, 99]], "id long")
    got = {r.id: r.component for r in traverse.components(e, n).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[51] == 50 and got[99] == 99


def test_traces(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("b", "d", 2), ("a", "x", 2)], "src string, dst string, rank int")
    got = {tuple(r.path) for r in traverse.traces(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", "b", "c"), ("a", "b", "d")}
    assert not traverse.traces(e, spark.createDataFrame([("c",)], "id string"), depth=2).count()


def test_process_selection(spark):
    t = spark.createDataFrame([("a", ["a", "b", "c", "d"]), ("b", ["b", "c", "d"]), ("a", ["a", "x", "d"]), ("q", ["q", "r", "s"])], "entry string, path array<string>")
    assert {tuple(r.path) for r in process.drop_contained(t).collect()} == {("a", "b", "c", "d"), ("a", "x", "d"), ("q", "r", "s")}
    assert {tuple(r.path) for r in process.select_traces(t, 10).collect()} == {("a", "b", "c", "d"), ("q", "r", "s")}


def test_process_rows(spark):
    t = spark.createDataFrame([("1", "3", ["1", "2", "3"])], "entry string, end string, path array<string>")
    n = spark.createDataFrame([("1", "run it"), ("2", "b"), ("3", "save")], "id string, name string")
    m = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1)], "id string, community int")
    rows, steps = process.process_rows(t, n, m)
    r = rows.first()
    assert (r.process, r.label, r.type, r.steps) == ("proc_0_run_it", "Run it → Save", "cross_community", 3)
    assert [x.step for x in steps.orderBy("step").collect()] == [1, 2, 3]


def test_c3_and_overrides(spark):
    assert mro.c3({"D": ["B", "C"], "B": ["A"], "C": ["A"]}, "D") == ["D", "B", "C", "A"]
    assert mro.c3({"X": ["A", "B"], "Y": ["B", "A"], "Z": ["X", "Y"]}, "Z") is None
    assert mro.c3({"A": ["B"], "B": ["A"]}, "A") is None
    p = spark.createDataFrame([("D", "B", "EXTENDS", 0), ("D", "C", "EXTENDS", 1), ("B", "A", "EXTENDS", 0), ("C", "A", "EXTENDS", 0)], "src string, dst string, type string, ord int")
    m = spark.createDataFrame([("A", "run", "A.run"), ("C", "run", "C.run"), ("B", "own", "B.own"), ("D", "own", "D.own"), ("A", "own", "A.own")], "owner string, name string, method string")
    d = spark.createDataFrame([("D",)], "id string")
    assert [r.id for r in mro.linearize(p, d).orderBy("place").collect()] == ["B", "C", "A"]
    for strategy, owner in (("first-wins", "C"), ("c3", "C"), ("leftmost-base", "A")):
        got = mro.overrides(p, m, d, strategy).collect()
        assert [(r.name, r.owner) for r in got] == [("run", owner)], strategy


def test_communities(spark):
    clique = lambda a, n: [(i, j) for i in range(a, a + n) for j in range(i + 1, a + n)]
    pairs = spark.createDataFrame(clique(0, 6) + clique(10, 6) + [(5, 10)], "a long, b long")
    found = community.communities(pairs)
    got = {r.id: r.community for r in found.collect()}
    assert set(got) == {*range(6), *range(10, 16)}
    single = spark.createDataFrame([(i, i) for i in got], "id long, community long")
    assert community.modularity(pairs, found) > community.modularity(pairs, single)
    assert len({got[i] for i in range(6)}) == 1 and got[0] != got[12]
    coh = {r.community: r.cohesion for r in community.cohesion(pairs, found).collect()}
    assert all(0 <= c <= 1 for c in coh.values())


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    got = search.rrf(a, b, "id").orderBy("rank").collect()
    assert [r.id for r in got] == ["y", "x", "z"] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12 and got[0].sources == "bm25,semantic"
    assert search.rrf(a.limit(0), b.limit(0), "id").count() == 0
    assert search.rrf(a, b, "id", start=0).orderBy("rank").first().score == pytest.approx(1 / 61 + 1 / 60)


def test_cypher(spark, graph):
    q = lambda t, **p: [tuple(r) for r in run(graph, t, **p).collect()]
    assert q("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) RETURN a.name, c.name") == [("main", "deep")]
    assert q("MATCH (c:Class)-[:HAS_METHOD]->(m) RETURN c.name AS c, collect(m.name) AS m") == [("Box", ["open"])]
    assert q("MATCH (n) WHERE n.label IN ['Class', 'Method'] AND NOT n.name = 'open' RETURN n.name") == [("Box",)]
    assert q("MATCH (n:Function) WHERE n.name =~ '.*e.*' RETURN count(*) AS n") == [(3,)]
    assert q("MATCH (a {name: $n})<-[:CALLS]-(b) RETURN b.name AS b ORDER BY b", n="deep") == [("helper",), ("test_it",)]
    assert q("MATCH (x)-[:CALLS]->(m), (c:Class)-[:HAS_METHOD]->(m) RETURN x.name, m.name") == [("main", "open")]
    assert q("MATCH (a:Function) OPTIONAL MATCH (a)-[r:CALLS]->(b) RETURN a.name AS a, count(b) AS n ORDER BY n DESC, a LIMIT 1") == [("main", 2)]
    assert q("MATCH (a {name: 'main'})-[:CALLS*1..2]->(b) RETURN b.name AS b ORDER BY b") == [("deep",), ("helper",), ("open",)]
    assert q("MATCH (a:Function) WITH a WHERE a.name STARTS WITH 'h' MATCH (a)-[:CALLS]->(z) RETURN a.name, z.name") == [("helper", "deep")]
    assert "| name |" in markdown(run(graph, "MATCH (n:Class) RETURN n.name AS name"))
    for bad in ("CREATE (n)", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) RETURN n.name FROM", "MATCH (n RETURN n"):
        with pytest.raises(CypherError):
            run(graph, bad)
    assert q("MATCH (n:Class) WHERE n.name = 'set' RETURN n.name") == []


def test_entry_scores(spark, graph):
    s = {r.id: r.score for r in process.entry_scores(graph.nodes, graph.typed(["CALLS"])).collect()}
    assert s["f1"] == pytest.approx(3 / 1 * 2 * 1.5 * 2.0) and s["f3"] == 0
    assert {r.id for r in process.entry_points(graph.nodes, graph.typed(["CALLS"])).collect()} == {"f1", "f2"}


def test_wiki(spark, graph):
    from codeloom.operators import wiki

    member = graph.nodes.select("id", F.when(F.col("label") == "Function", 0).otherwise(1).alias("community"))
    got = {r.community: r for r in wiki.skills(graph, member).collect()}
    assert got[0].members == 4 and got[0].links == 1 and got[1].links == 0
    assert wiki.module_calls(graph, spark.createDataFrame([("src/util.py",)], "filePath string")).count() == 2
