"""Plans that hold at scale: filters and columns reach the scan, no products."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions import paths as P
from codeloom.operators import mro
from codeloom.sources.graph_store import merge

SF = "/root/testdata/sf0.001"
STRAIGHT = ("one_hop_out", "two_hop", "diamond", "star_membership", "module_edges", "tiered_resolution", "contract_match", "suffix_resolve", "service_assign", "inter_file_calls", "hash_diff", "method_implements", "name_only_calls", "folder_tree", "cypher_two_hop")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", STRAIGHT)
def test_no_products(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_pushdown(spark):
    text = plan(catalog.QUERIES["semi_join_ids"](spark, SF))
    assert "EqualTo(p_size,7)" in text
    scans = [line for line in text.split("\n") if "ReadSchema" in line and "lineitem" in line]
    assert scans and all("l_comment" not in s and "l_extendedprice" not in s for s in scans)


def test_rank_limits_run_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["limit_per_parent"](spark, SF))


def test_top_k_is_partial(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["hotspots"](spark, SF))


def test_bm25_reads_a_text_twice_at_most(spark):
    from codeloom.operators import search

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counted = search._term_counts(docs, "text", ["public", "license", "token"], ["doc_id"]).observe("seen", F.count("*")).filter(F.exists("tf", lambda x: x > 0))
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2


def test_suffixes_meet_two_files_at_most(spark):
    """Many files of one base name: an import's row count doesn't grow with them."""
    from codeloom.operators import resolve

    files = spark.createDataFrame([(f"pkg{i}/Sub/index.ts" if i % 2 else f"pkg{i}/sub/index.ts", i) for i in range(300)] + [("a/utils.py", 500), ("b/Utils.py", 501)], "file string, seq long")
    imports = spark.createDataFrame([(i, "index") for i in range(200)] + [(900, "sub/index"), (901, "SUB/index"), (902, "Utils"), (903, "x/utils"), (904, "pkg7/Sub/index"), (905, "nowhere")], "import_id long, path string")
    found = {r.import_id: r.file for r in resolve.resolve_suffix(imports, files).collect()}
    assert found[0] == found[199] == "pkg0/sub/index.ts" and found[900] == "pkg0/sub/index.ts" and found[901] == "pkg0/sub/index.ts"
    assert found[902] == "b/Utils.py" and found[903] == "a/utils.py" and found[904] == "pkg7/Sub/index.ts" and 905 not in found


def test_types_cross_all_import_levels(spark):
    from codeloom.operators import resolve

    known = spark.createDataFrame([("f0", "x", "T"), ("f0", "y", "B"), ("f0", "y", "A")], "scope string, var string, type string")
    none = spark.createDataFrame([], "owner string, name string, type string")
    pending = spark.createDataFrame([], "scope string, var string, kind string, base string, member string, seq long")
    levels = spark.createDataFrame([(f"f{i}", 20 * i) for i in range(4)], "file string, level int")
    imports = spark.createDataFrame([(f"f{i}", v, f"f{i - 1}", v) for i in range(1, 4) for v in "xy"], "file string, local string, source string, exported string")
    got = {(r.scope, r.var): r.type for r in resolve.propagate_across_files(known, pending, none, none, imports, levels.filter("level <= 60")).collect() if r.scope != "f0"}
    assert got == {(f"f{i}", v): t for i in range(1, 4) for v, t in (("x", "T"), ("y", "A"))}


def test_store_survives_a_job_that_died(spark, tmp_path):
    from codeloom.operators.graph import PropertyGraph
    from codeloom.sources.graph_store import GraphStore

    nodes = lambda *ids: spark.createDataFrame([(i, "File", i) for i in ids], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "CALLS", 1.0)], "src string, dst string, type string, confidence double")
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.meta() is None
    store.write(PropertyGraph(nodes("a", "b"), edges), "one")
    point, store._point = store._point, lambda meta: (_ for _ in ()).throw(RuntimeError("died before the pointer"))
    with pytest.raises(RuntimeError):
        store.write(PropertyGraph(nodes("a", "b", "c"), edges), "two")
    assert store.meta()["lastCommit"] == "one" and store.read().nodes.count() == 2
    store._point = point
    assert store.write(PropertyGraph(nodes("a", "b", "c"), edges), "two")["version"] == 2 and store.read().nodes.count() == 3
    with pytest.raises(FileExistsError):
        store._point(store.meta())


def test_merge_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string")
    assert sorted(tuple(r) for r in merge(old, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 7), st.lists(st.integers(0, 7), max_size=3, unique=True), max_size=8))
def test_c3_is_consistent(parents):
    for c in parents:
        order = mro.c3(parents, c)
        if order is None:
            continue
        assert order[0] == c and len(order) == len(set(order))
        for a, ups in parents.items():
            if a in order:
                places = [order.index(p) for p in ups if p in order]
                assert places == sorted(places) and all(order.index(a) < p for p in places)


SEGMENT = st.sampled_from(["a", "b", "..", ".", "c"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(SEGMENT, max_size=3), st.lists(SEGMENT, min_size=1, max_size=4)), min_size=1, max_size=10))
def test_relative_paths(spark, pairs):
    def want(base, rel):
        out = []
        for p in base + rel:
            if p == "..":
                out = out[:-1]
            elif p != ".":
                out.append(p)
        return "/".join(out)

    df = spark.createDataFrame([("/".join(b), "/".join(r), want(b, r)) for b, r in pairs], "b string, r string, w string")
    assert df.filter(P.join_relative(F.col("b"), F.col("r")) != F.col("w")).count() == 0
