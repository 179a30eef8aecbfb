import pytest

from codeloom.operators import group, tools
from codeloom.plans.analyze import analyze, register_views
from codeloom.plans.cypher import run
from codeloom.sources.graph_store import GraphStore

FILES = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def save(self, x):\n        return check(x)\n\ndef check(x):\n    return clean(x)\n\ndef clean(x):\n    return x\n",
    "pkg/child.py": "from .base import Base, check as verify\n\nclass Child(Base):\n    def run(self):\n        return verify(1)\n",
    "pkg/main.py": "from pkg.child import Child\nfrom pkg import base\n\ndef main():\n    c = Child()\n    start()\n\ndef start():\n    step()\n\ndef step():\n    finish()\n\ndef finish():\n    pass\n",
    "docs/a.md": "# Top\nsee [code](../pkg/base.py)\n",
    "web/x.ts": "import { y } from './y'\nexport function callY() {\n  y()\n}\n",
    "web/y.ts": "export function y() {\n}\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    store = f"file://{tmp_path_factory.mktemp('store')}/g"
    meta = analyze(spark, f"file://{root}", store, "c1")
    assert meta["version"] == 1 and analyze(spark, f"file://{root}", store, "c1")["version"] == 1
    return GraphStore(spark, store).read()


def edges(graph, type):
    return {(r.src, r.dst) for r in graph.typed([type]).collect()}


def test_structure(graph):
    assert ("File:pkg/child.py", "File:pkg/base.py") in edges(graph, "IMPORTS")
    assert ("File:pkg/main.py", "File:pkg/child.py") in edges(graph, "IMPORTS")
    assert ("File:docs/a.md", "File:pkg/base.py") in edges(graph, "IMPORTS")
    assert ("File:web/x.ts", "File:web/y.ts") in edges(graph, "IMPORTS")
    assert ("Folder:pkg", "File:pkg/main.py") in edges(graph, "CONTAINS")
    assert ("Class:pkg/child.py:Child", "Class:pkg/base.py:Base") in edges(graph, "EXTENDS")


def test_calls(graph):
    calls = edges(graph, "CALLS")
    assert ("Function:pkg/base.py:check", "Function:pkg/base.py:clean") in calls
    assert ("Method:pkg/child.py:Child.run#0", "Function:pkg/base.py:check") in calls
    assert ("Function:pkg/main.py:main", "Class:pkg/child.py:Child") in calls
    assert ("Function:web/x.ts:callY", "Function:web/y.ts:y") in calls


def test_flows_and_communities(graph, spark):
    assert graph.label("Community").count() >= 1
    flows = run(graph, "MATCH (f)-[s:STEP_IN_PROCESS]->(p:Process) RETURN p.id AS p, f.name AS f, s.step AS step").collect()
    main = [r.f for r in sorted(flows, key=lambda r: r.step) if "main" in r.p]
    assert main[:4] == ["main", "start", "step", "finish"]
    register_views(graph, "t_")
    assert spark.sql("select count(*) from t_steps").first()[0] == len(flows)


def test_impact(graph):
    target = tools.resolve_target(graph, "clean").select("id")
    found = {r.id: r.depth for r in tools.impact(graph, target).collect()}
    assert found["Function:pkg/base.py:check"] == 1 and found["Method:pkg/child.py:Child.run#0"] == 2


def test_groups(spark):
    good = {"version": 1, "name": "g", "repos": {"a": "/a", "b": "/b"}, "links": [{"from": "a", "to": "b"}]}
    c = spark.createDataFrame([("a", "http::GET::/x", "provider", None), ("b", "http::GET::/x", "consumer", None), ("b", "lib::z", "consumer", None), ("c", "http::GET::/x", "consumer", None)], "repo string, contractId string, role string, service string")
    links, rest = group.sync(good, c)
    assert links.count() == 1 and rest.count() == 0
    for bad in ({}, {"version": 1}, {"version": 1, "name": "g", "repos": []}, {**good, "links": [{"from": "a", "to": "zz"}]}):
        with pytest.raises(ValueError):
            group.parse_config(bad)
    hits = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("b", 3, 0.1)], "repo string, id long, score double")
    assert [r.id for r in group.query(hits, 2).collect()] == [1, 3]
