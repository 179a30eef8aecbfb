"""Inheritance: ancestors, linearisation, overrides and implementations."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import SMALL, checkpoint, partitions, ship, sized


#: Roots of a batch, and roots times nodes that a task holds at a time.
ROOTS, CELLS = 2048, 2_000_000


def _closure(parents: DataFrame, roots: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame]:
    """(batch, root) and (batch, id): neighbouring roots in batches, and every
    node that a root of the batch reaches, itself included.

    A batch shares its ancestors, so there are far fewer rows than roots times
    ancestors, and never more.
    """
    n = partitions(parents.sparkSession)
    e = checkpoint(parents.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct().repartition(n, "id").sortWithinPartitions("id"))
    r = roots.select(F.col("id").alias("root")).filter("root is not null").distinct().repartitionByRange(n, "root").sortWithinPartitions("root")
    r = checkpoint(r.select(F.floor(F.monotonically_increasing_id() / ROOTS).alias("batch"), "root"))
    front = seen = r.select("batch", F.col("root").alias("id"))
    depth = 0
    while rounds is None or depth < rounds:
        depth += 1
        rows = front.count()
        if not rows:
            break
        step = sized(front, rows).join(e.hint("merge") if rows > SMALL else e, "id").select("batch", F.col("next").alias("id")).distinct()
        if depth % 4 == 0:  # what is met again costs less than looking back each round; cycles end here
            step = step.join(seen.hint("merge"), ["batch", "id"], "left_anti")
        front = checkpoint(step)
        seen = seen.unionByName(front)
    return r, seen.distinct()


def _per_batch(parents: DataFrame, roots: DataFrame, run, schema: str, rounds: int | None = None, methods: DataFrame | None = None) -> DataFrame:
    """The rows of run(nodes, roots, edges, methods) of each batch.

    nodes: the sorted ids; roots, edges (src, dst) and the methods' owners are
    places in it; run yields Arrow batches.
    """
    ship(parents.sparkSession)
    r, reached = _closure(parents, roots, rounds)
    kind = parents.schema["src"].dataType.simpleString()
    method = "string" if methods is None else methods.schema["method"].dataType.simpleString()
    none = [F.lit(None).cast("string").alias("name"), F.lit(None).cast(method).alias("method"), F.lit(0).alias("iface")]
    edges = reached.hint("merge").join(parents.select(F.col("src").alias("id"), "dst", F.coalesce(F.col("ord").cast("long"), F.lit(0)).alias("ord")), "id")
    rows = r.select("batch", F.lit(0).alias("what"), F.col("root").cast(kind).alias("a"), F.col("root").cast(kind).alias("b"), F.lit(0).cast("long").alias("ord"), *none)
    rows = rows.unionByName(edges.select("batch", F.lit(1).alias("what"), F.col("id").alias("a"), F.col("dst").alias("b"), "ord", *none))
    if methods is not None:
        mine = reached.hint("merge").join(methods.withColumnRenamed("owner", "id"), "id")
        rows = rows.unionByName(mine.select("batch", F.lit(2).alias("what"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("ord"), F.col("name").cast("string").alias("name"), "method", "iface"))

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
        a, b, what = at[: len(t)], at[len(t) :], t["what"].to_numpy()
        up, own = what == 1, what == 2
        took = t.filter(pa.array(own)).select(["name", "method", "iface"])
        ids = pa.array(nodes, t["a"].type)
        return run(ids, np.sort(a[what == 0]), (a[up], b[up], t["ord"].to_numpy()[up]), (a[own], took))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None
        for x in batches:
            keys = x.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)] if len(keys) else []
            for i, j in itertools.pairwise(cuts):
                if held and keys[i] != at:
                    yield from one(pa.Table.from_batches(held))
                    held = []
                at = keys[i]
                held.append(x.slice(i, j - i))
        if held:
            yield from one(pa.Table.from_batches(held))

    return rows.repartition(partitions(parents.sparkSession), "batch").sortWithinPartitions("batch").mapInArrow(go, schema)


def _climb(n: int, roots: np.ndarray, edges: tuple, max_depth: int, ordered: bool, text: bool) -> Iterator[tuple]:
    """(root, id, depth, rank, ord) of some roots at a time, as arrays of
    places: breadth-first over edges. rank orders one depth as ord does."""
    src, dst, o = edges
    by = np.lexsort((o, dst, src))
    src, dst = src[by], dst[by]
    padded, o = np.unique([str(x).rjust(4, "0")[:4] for x in o[by].tolist()], return_inverse=True) if len(by) else (np.array([], "U4"), o)
    padded = padded.astype(object)
    first = np.searchsorted(src, np.arange(n + 1))
    for chunk in range(0, len(roots), k := max(1, CELLS // max(1, n))):
        mine = roots[chunk : chunk + k]
        seen = np.zeros(len(mine) * n, bool)
        fr, fn, rank, ord_ = np.arange(len(mine)), mine, np.zeros(len(mine), np.int64), np.full(len(mine), "", object)
        seen[fr * n + fn] = True
        out = []
        for depth in range(1, max_depth + 1):
            many = first[fn + 1] - first[fn]
            by = np.repeat(np.arange(len(fn)), many)
            e = np.arange(len(by)) - np.repeat(np.cumsum(many) - many, many) + first[fn][by]
            cell = fr[by] * n + dst[e]
            new = ~seen[cell]
            by, e, cell = by[new], e[new], cell[new]
            if not len(cell):
                break
            if ordered:
                key = rank[by] * len(padded) + o[e]
                s = np.lexsort((key, cell))
                s = s[np.concatenate([[True], np.diff(cell[s]) != 0])]
                cell, rank = cell[s], np.unique(key[s], return_inverse=True)[1]
                ord_ = ord_[by[s]] + padded[o[e[s]]] if text else ord_
            else:
                cell = np.unique(cell)
            seen[cell] = True
            fr, fn = np.divmod(cell, n)
            out.append((mine[fr], fn, np.full(len(fn), depth, np.int32), rank if ordered else fr, ord_ if text else fr))
        if out:
            yield tuple(np.concatenate(x) for x in zip(*out))


def ancestors(parents: DataFrame, roots: DataFrame, max_depth: int = 100, order: bool = True) -> DataFrame:
    """(root, id, depth, ord): all ancestors of each root (id) by breadth-first
    order over parents (src, dst, ord); a diamond counts once, cycles end.

    Without ``order`` there is no ord. A batch of roots climbs in one task,
    over the edges among its own ancestors.
    """
    kind = parents.schema["src"].dataType.simpleString()

    def run(ids: pa.Array, roots: np.ndarray, edges: tuple, _: tuple) -> Iterator[pa.RecordBatch]:
        for r, i, depth, _, ord_ in _climb(len(ids), roots, edges, max_depth, order, order):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), ids.take(pa.array(i)), pa.array(depth), *([pa.array(ord_, pa.string())] if order else [])], ["root", "id", "depth", *(["ord"] if order else [])])

    return _per_batch(parents, roots, run, f"root {kind}, id {kind}, depth int" + ", ord string" * order, max_depth)


def c3(parents: dict, start, done: dict | None = None) -> list | None:
    """C3 order of a class by its parents' lists; None if there is none, as
    on a cycle. done: orders found so far."""
    done = {} if done is None else done
    stack, open_ = [start], set()
    while stack:
        c = stack[-1]
        if c in done:
            stack.pop()
            continue
        ups = parents.get(c, [])
        if c not in open_:
            open_.add(c)
            todo = [p for p in ups if p not in done]
            if not any(p in open_ for p in todo):
                stack += todo
                continue
        stack.pop()
        open_.discard(c)
        done[c] = None if any(done.get(p) is None for p in ups) else _merge(c, [*(done[p] for p in ups), ups])
    return done[start]


def _merge(c, lists: list[list]) -> list | None:
    out, lists = [c], [x for x in lists if x]
    tails = Counter(z for x in lists for z in x[1:])
    at = [0] * len(lists)
    left = set(range(len(lists)))
    while left:
        head = next((h for k in sorted(left) if not tails[h := lists[k][at[k]]]), None)
        if head is None:
            return None
        out.append(head)
        for k in list(left):
            if lists[k][at[k]] == head:
                at[k] += 1
                if at[k] == len(lists[k]):
                    left.discard(k)
                else:
                    tails[lists[k][at[k]]] -= 1
    return out


def _orders(roots: np.ndarray, edges: tuple) -> Iterator[tuple]:
    """(root, id, place) of C3 orders, as arrays of places, some at a time."""
    src, dst, o = edges
    ups: dict = {}
    by = np.lexsort((dst, o, src))
    for s, t in zip(src[by].tolist(), dst[by].tolist()):
        if t not in ups.setdefault(s, []):
            ups[s].append(t)
    done: dict = {}
    held, rows = [], 0
    for r in roots.tolist():
        found = c3(ups, r, done)
        if found and len(found) > 1:
            held.append((np.full(len(found) - 1, r), np.array(found[1:]), np.arange(1, len(found), dtype=np.int32)))
            rows += len(found)
        if rows > CELLS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def linearize(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, place): C3 order of each root's ancestors, from 1; roots
    without a consistent order give no rows.

    A batch of roots shares the orders of its ancestors in one task.
    """
    kind = parents.schema["src"].dataType.simpleString()

    def run(ids: pa.Array, roots: np.ndarray, edges: tuple, _: tuple) -> Iterator[pa.RecordBatch]:
        for r, i, place in _orders(roots, edges):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), ids.take(pa.array(i)), pa.array(place)], ["root", "id", "place"])

    return _per_batch(parents, roots, run, f"root {kind}, id {kind}, place int")


CONFIDENCE = {"first-wins": 0.9, "leftmost-base": 0.9, "c3": 0.95, "implements-split": 0.85}


def overrides(parents: DataFrame, methods: DataFrame, roots: DataFrame, strategy: str = "first-wins") -> DataFrame:
    """(root, name, owner, method, confidence): for every method name that at
    least two ancestors have and the class itself hasn't, the one that wins.

    methods: owner, name, method. first-wins and leftmost-base take the first
    ancestor in breadth-first or depth-first order, c3 in C3 order;
    implements-split prefers the one class ancestor over interfaces and gives
    no winner where several interfaces alone have the name.
    """
    m = methods.select("owner", "name", "method").filter("name is not null").withColumn("iface", F.lit(0))
    if strategy == "implements-split":
        kinds = parents.filter("type = 'IMPLEMENTS'").select(F.col("dst").alias("owner")).distinct().withColumn("iface", F.lit(1))
        m = m.drop("iface").join(kinds, "owner", "left").withColumn("iface", F.coalesce("iface", F.lit(0)))
    kind, named, called = (x.schema[c].dataType.simpleString() for x, c in ((parents, "src"), (methods, "name"), (methods, "method")))

    def run(ids: pa.Array, roots: np.ndarray, edges: tuple, own: tuple) -> Iterator[pa.RecordBatch]:
        owner, rest = own
        by = np.argsort(owner, kind="stable")
        owner, rest = owner[by], rest.take(pa.array(by))
        names, name = np.unique(rest["name"].to_numpy(), return_inverse=True)
        first = np.searchsorted(owner, np.arange(len(ids) + 1))
        iface = rest["iface"].to_numpy()
        method = np.unique(rest["method"].to_numpy(), return_inverse=True)[1] if len(owner) and not rest["method"].null_count else np.arange(len(owner))
        if strategy == "c3":
            climbed = ((r, i, place, place, place) for r, i, place in _orders(roots, edges))
        else:
            climbed = _climb(len(ids), roots, edges, 100, True, strategy == "leftmost-base")
        has = np.unique(owner * len(names) + name)
        for r, i, depth, rank, ord_ in climbed:
            many = first[i + 1] - first[i]
            by = np.repeat(np.arange(len(i)), many)
            k = np.arange(len(by)) - np.repeat(np.cumsum(many) - many, many) + first[i][by]
            key = r[by] * len(names) + name[k]
            new = ~np.isin(key, has)
            by, k, key = by[new], k[new], key[new]
            if not len(key):
                continue
            pairs = np.unique(np.stack([key, i[by]]), axis=1)[0] if len(has) < len(owner) else key
            several, count = np.unique(pairs, return_counts=True)
            fits = np.isin(key, several[count > 1]) & (iface[k] == 0)
            by, k, key = by[fits], k[fits], key[fits]
            if strategy == "leftmost-base":
                order = (np.unique(ord_[by], return_inverse=True)[1],) if len(by) else (by,)
            else:
                order = (i[by], rank[by], depth[by])
            s = np.lexsort((method[k], *order, key))
            s = s[np.concatenate([[True], np.diff(key[s]) != 0])] if len(s) else s
            if len(s):
                got = rest.take(pa.array(k[s])).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[by[s]])), *(pa.concat_arrays(got[c].chunks) for c in ("name", "method")), ids.take(pa.array(i[by[s]]))], ["root", "name", "method", "owner"])

    won = _per_batch(parents, roots, run, f"root {kind}, name string, method {called}, owner {kind}", None if strategy == "c3" else 100, m)
    return won.select("root", F.col("name").cast(named).alias("name"), "owner", "method", F.lit(CONFIDENCE.get(strategy, 0.5)).alias("confidence"))


def implementations(parents: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, target, confidence): own methods against those of direct
    interfaces with the same name: equal parameter types 1.0; unknown types
    with fitting arity 0.7; several candidates give none.

    methods: owner, name, method, types (array or null), arity.
    """
    direct = parents.filter("type = 'IMPLEMENTS'").select(F.col("src").alias("owner"), F.col("dst").alias("iface")).distinct()
    theirs = methods.select(F.col("owner").alias("iface"), "name", F.col("method").alias("target"), F.col("types").alias("t2"), F.col("arity").alias("n2"))
    pairs = methods.join(direct, "owner").join(theirs, ["iface", "name"])
    exact = F.col("types").isNotNull() & F.col("t2").isNotNull() & (F.col("types") == F.col("t2"))
    loose = (F.col("types").isNull() | F.col("t2").isNull()) & (F.col("arity").isNull() | F.col("n2").isNull() | (F.col("arity") == F.col("n2")))
    scored = pairs.withColumn("confidence", F.when(exact, 1.0).when(loose, 0.7)).filter("confidence is not null")
    best = scored.withColumn("_b", F.max("confidence").over(W.partitionBy("method", "iface"))).filter("confidence = _b")
    single = best.withColumn("_n", F.count("*").over(W.partitionBy("method", "iface"))).filter("_n = 1")
    return single.select("method", "target", "confidence").distinct()
