"""Steps that must not grow faster than the tables: what they shuffle, and
their results against plain Python."""

import random

import pytest

from codeloom import catalog, session
from codeloom.operators import mro, resolve, traverse

SF = "/root/testdata/sf0.01"


def shuffled(spark, run):
    """MB written to shuffles while run() is at work."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite() / 1e6

    before = total()
    run()
    return total() - before


#: MB at sf0.01, between the figures before (0.57, 4.3, 4.0, 3.0, 44, 6.2, 9.2) and after (0.14, 0.64, 0.88, 0.64, 4.2, 2.8, 1.6).
LIMITS = {"name_only_calls": 0.3, "c3_mro": 1.5, "method_overrides": 1.5, "ancestors_bfs": 1.5, "communities_louvain": 12, "component_cohesion": 4.2, "flow_reach": 4}


@pytest.mark.parametrize("name", LIMITS)
def test_shuffle(spark, name):
    assert shuffled(spark, lambda: catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()) < LIMITS[name]


def most_rows(df):
    """The most rows that a step of the plan put out, once df was collected."""

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        m, kids = p.metrics(), p.children()
        return max([m.apply("numOutputRows").value() if m.contains("numOutputRows") else 0, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_dispatch_makes_no_pairs(spark):
    """200 methods of one interface and name, 200 of its implementor: a caller
    of all of the first reaches all of the second, not each of them 200 times."""
    n = 200
    methods = spark.createDataFrame([(i, i // n, "run") for i in range(2 * n)] + [(7000, 1, "run"), (7000, 0, "run"), (7001, 1, "stop")], "method long, owner long, name string")
    calls = spark.createDataFrame([(s, i) for s in (1000, 1001, 250) for i in range(n)] * 2, "src long, dst long")
    links = spark.createDataFrame([(0, 1), (0, 0)], "iface long, cls long")
    found = resolve.dispatch(calls, methods, links)
    got = [(r.src, r.dst) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, i) for s in (1000, 1001, 250) for i in [*range(2 * n), 7000] if s != i}
    assert most_rows(found) < 20 * n


def test_call_counts(spark):
    """A name's calls and symbols are counted, not paired; as name_calls() lists them."""
    rng = random.Random(3)
    symbols = spark.createDataFrame([(i, rng.choice("abc")) for i in range(300)] + [(300, "only"), (301, "me")], "id long, name string")
    refs = spark.createDataFrame(sorted({(rng.randrange(320), rng.choice(["a", "b", "only", "none"])) for _ in range(500)} | {(301, "me")}), "src long, name string")
    want = {}
    for r in resolve.name_calls(refs, symbols).collect():
        n, c = want.get(r.src, (0, 1.0))
        want[r.src] = (n + 1, min(c, r.confidence))
    found = resolve.name_call_counts(refs, symbols)
    assert {r.src: (r.targets, r.confidence) for r in found.collect()} == want and 301 not in want
    assert most_rows(found) <= 600


def test_callable_counts(spark):
    rng = random.Random(4)
    some = [("f|a", t, p, q, 40) for t in ("Function", "Class") for p, q in ((None, None), (3, None), (4, 2))]
    symbols = spark.createDataFrame(some, "ref string, type string, parameters int, required int, m long")
    calls = [(rng.randrange(200), rng.choice(["f|a", "f|b"]), rng.choice([None, 1, 3, 4]), "free") for _ in range(1000)]
    want = {}
    for key, ref, args, _ in set(calls):
        n = sum(m for r, t, p, q, m in some if r == ref and t == "Function" and (args is None or p is None or (p if q is None else q) <= args <= p))
        if n:
            want[key] = want.get(key, 0) + n
    found = resolve.callable_counts(spark.createDataFrame(calls, "key long, ref string, args int, form string"), symbols)
    assert {r.key: r.n for r in found.collect()} == want
    assert most_rows(found) <= 1000


def test_tiers_rank_files_not_symbols(spark):
    """2,000 symbols of a name in 3 files, 50 references: 150 rows are ranked."""
    symbols = spark.createDataFrame([(i, "x", f"f{i % 3}" if i else None) for i in range(2000)], "id long, name string, file string")
    refs = spark.createDataFrame([(i, f"f{i}", "x") for i in range(50)], "ref long, file string, name string")
    imports = spark.createDataFrame([(f"f{i}", "f1") for i in range(10, 20)], "file string, target string")
    got = resolve.resolve_names(refs, symbols, imports).groupBy("ref", "tier").count()
    tiers = {(r.ref, r.tier, r["count"]) for r in got.collect()}
    assert {(1, "same-file", 667), (12, "import", 667), (30, "global", 2000)} <= tiers and len(tiers) == 50


def climb(parents, root):
    """{id: (depth, ord)} as ancestors() has it."""
    out, front, depth = {}, {root: ""}, 0
    while front:
        depth += 1
        step = {}
        for at, path in front.items():
            for p, o in parents.get(at, []):
                if p != root and p not in out:
                    step[p] = min(step.get(p, "~"), path + f"{o:04d}")
        out |= {p: (depth, o) for p, o in step.items()}
        front = step
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_inheritance_by_batches(spark, monkeypatch, kind):
    """Random graphs with cycles, in batches of two roots and chunks of one."""
    monkeypatch.setattr(mro, "ROOTS", 2)
    rng = random.Random(5)
    name = (lambda i: i) if kind == "long" else "c{:02d}".format
    parents = {name(i): [(name(p), o) for o, p in enumerate(rng.sample(range(max(0, i - 9), min(40, i + 2)), rng.randrange(3)))] for i in range(40)}
    edges = spark.createDataFrame([(c, p, "IMPLEMENTS" if o else "EXTENDS", o) for c, ups in parents.items() for p, o in ups], f"src {kind}, dst {kind}, type string, ord int")
    roots = spark.createDataFrame([(c,) for c in parents], f"id {kind}")
    want = {c: climb(parents, c) for c in parents}
    got = {c: {} for c in parents}
    for r in mro.ancestors(edges, roots).collect():
        got[r.root][r.id] = (r.depth, r.ord)
    assert got == want

    places = {c: [] for c in parents}
    for r in mro.linearize(edges, roots).orderBy("place").collect():
        places[r.root].append(r.id)
    plain = {c: [p for p, _ in ups] for c, ups in parents.items()}
    assert places == {c: (mro.c3(plain, c) or [c])[1:] for c in parents} and any(map(len, places.values()))

    has = {(c, rng.choice("mno")) for c in parents for _ in range(2)}
    methods = spark.createDataFrame([(c, m, f"{c}.{m}") for c, m in sorted(has)], f"owner {kind}, name string, method string")
    ifaces = {p for ups in plain.values() for p in ups[1:2]}
    for strategy in ("first-wins", "leftmost-base", "c3", "implements-split"):
        best = {}
        for c in parents:
            up = {i: (n, "") for n, i in enumerate(places[c])} if strategy == "c3" else want[c]
            for m in "mno":
                who = [i for i in up if (i, m) in has]
                fits = [i for i in who if strategy != "implements-split" or i not in ifaces]
                if (c, m) not in has and len(who) > 1 and fits:
                    key = (lambda i, up=up: (up[i][1], i)) if strategy == "leftmost-base" else (lambda i, up=up: (*up[i], i))
                    best[c, m] = min(fits, key=key)
        won = mro.overrides(edges, methods, roots, strategy).collect()
        assert {(r.root, r.name): r.owner for r in won} == best and len(won) == len(best) and all(r.method == f"{r.owner}.{r.name}" for r in won), strategy


@pytest.mark.parametrize("name", ["transitive_edge_type", "toposort_levels"])
def test_edges_are_not_broadcast(spark, monkeypatch, name):
    """However small their files are: rounds of over SMALL rows sort, others
    are sent themselves. 1.1 MB is the least that a broadcast table has."""
    for at in (session, traverse):
        monkeypatch.setattr(at, "SMALL", 1000, raising=False)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1200000b")
    try:
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.1").count() > 0
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_levels_by_rounds(spark):
    """Random graphs with cycles, loops and ends that are no nodes."""
    rng = random.Random(6)
    for most in (1, 3):
        nodes = list(range(60))
        edges = {(i, j) for i in range(64) for j in rng.sample(range(64), rng.randrange(most)) if j < i or rng.random() < 0.03}
        want, left, level = {}, set(nodes), 0
        while ready := {i for i in left if all(s != i for s, _ in edges)}:
            want |= dict.fromkeys(ready, level)
            left -= ready
            edges_left = {(s, t) for s, t in edges if t not in ready}
            edges, kept, level = edges_left, edges if level == 0 else kept, level + 1
        want |= dict.fromkeys(left, level)
        got = traverse.levels(spark.createDataFrame(sorted(kept), "src long, dst long"), spark.createDataFrame([(i,) for i in nodes] * 2, "id long"))
        rows = [(r.id, r.level) for r in got.collect()]
        assert dict(rows) == want and len(rows) == len(want)


def test_reach_and_bfs_beyond_small(spark, monkeypatch):
    """The same whether rounds are broadcast or sorted."""
    rng = random.Random(7)
    edges = spark.createDataFrame([(rng.randrange(80), rng.randrange(80), rng.choice("xy")) for _ in range(120)], "src long, dst long, type string")
    roots = spark.createDataFrame([(i,) for i in range(0, 80, 9)], "id long")
    both = []
    for most in (100_000, 0):
        for at in (session, traverse):
            monkeypatch.setattr(at, "SMALL", most)
        both.append([sorted(map(tuple, df.collect())) for df in (traverse.reach(edges, roots, 3), traverse.bfs(edges, roots, 5, stop=roots.limit(2)), traverse.bfs(edges, roots, 5, "in").select("id", "depth"))])
    assert both[0] == both[1] and all(both[0])


def test_flow_edges_by_threshold(spark):
    from codeloom.sources.tables import flow_edges

    for least in (0.95, 0.99, 1.0):
        want = flow_edges(spark, SF).filter(f"confidence >= {least}")
        assert sorted(map(tuple, flow_edges(spark, SF, least).collect())) == sorted(map(tuple, want.collect()))
