"""Every registered query of the library against its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from codeloom import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return f"{v:.6g}" if isinstance(v, float) else "None" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    got = catalog.QUERIES[name](spark, str(SF))
    want = db.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0


def test_component_cohesion_takes_every_edge(spark):
    from codeloom.sources.tables import flow_edges, part_nodes

    edges = [(r.src, r.dst) for r in flow_edges(spark, str(SF)).filter("confidence >= 1.0").collect()]
    up = {r.id: r.id for r in part_nodes(spark, str(SF)).select("id").collect()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    size, inner = Counter(map(root, up)), Counter(root(a) for a, _ in edges)
    assert any(a % 3 != b % 3 for a, b in edges)
    got = {(r.component, r["size"], r.cohesion) for r in catalog.QUERIES["component_cohesion"](spark, str(SF)).collect()}
    assert got == {(c, n, round(inner[c] / len(edges), 6)) for c, n in size.items()}
