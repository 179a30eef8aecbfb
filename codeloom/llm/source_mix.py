"""Mixing sources to target weights by Pareto order sampling (native).

Every document expects some copies: a number in proportion to its odds, so
that its source's words are expected to reach the target, but ``MOST`` at
most. Whole copies are certain; the broken part p is an inclusion chance,
decided by Pareto order sampling: documents are ranked by random odds over
inclusion odds, u / (1 - u) : p / (1 - p), and the source takes them in that
order until its words are used up. Chances are unequal within a source: the
odds are the fourth root of the size, down to a power of two, unless a column
gives other ones.

The sample is of fixed size in words, not in documents: the prefix that fits
ends within one document of the target, and the rest, smaller than that one
document, is filled from those left out, by size: of each size the document of
the lowest rank, the largest size that still fits first, and then one that is
a little too large, if that comes nearer. A source's fills are fewer than the
root of twice that rest; all others are taken by their rank.

No source is ever sorted in one task: the place where its prefix ends is found
with a histogram over 16 bits of the rank, and only the rows of one of these
cells are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, within

#: No document is taken more often.
MOST = 3
#: Cells of the histogram over ranks in [0, 1).
CELLS = 65536
WORD = r"[^\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\x0c\r"


def word_count(text: str) -> Column:
    """Words of a text; one byte a word is held, not the words."""
    return F.coalesce(F.octet_length(F.translate(F.regexp_replace(text, WORD, "a"), _BLANK, "")), F.lit(0)).cast("long")


def size_odds(size: str = "_size") -> Column:
    """1024 times the fourth root of the size rounded down to a power of two."""
    power = F.pow(F.lit(2.0), F.char_length(F.bin(size)) - 1)
    return F.round(F.sqrt(F.sqrt(power)) * 1024).cast("long")


def column_odds(column: str) -> Column:
    """1024 times the column rounded to the nearest 2^(k/8), from 2^-10 to
    2^20; null, zero and less count as 1."""
    x = F.col(column).cast("double")
    eighths = F.round(F.least(F.lit(20.0), F.greatest(F.lit(-10.0), F.log2(F.when(x > 0, x).otherwise(1.0)))) * 8)
    return F.round(F.pow(F.lit(2.0), eighths / 8) * 1024).cast("long")


def allocate(totals: DataFrame, most: float = MOST, within_key: list[str] | None = None, total: Column | None = None) -> DataFrame:
    """Adds ``target`` to totals (key, size, weight): shares of ``total`` (all
    sizes, by default) by weight, none above ``most`` times its size, the
    excess reshared by weight. With ``within_key``, each group for itself.

    The repeated resharing ends at min(cap, level * weight) for one level; it
    is found in one pass over the rows in order of cap / weight.
    """
    cap = F.lit(float(most)) * F.col("size")
    everything = W.partitionBy(*(within_key or [F.lit(0)]))
    order = everything.orderBy("ratio", "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = (
        totals.withColumn("cap", cap)
        .withColumn("ratio", F.coalesce(F.try_divide("cap", "weight"), F.lit(0.0)))
        .withColumn("left", (F.sum("size").over(everything) if total is None else total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.try_divide("left", "rest"))
        .withColumn("level", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
        .withColumn("level", F.max("level").over(everything))  # they fall after the first
    )
    return t.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select(*totals.columns, "target")


def _by_source(rows: DataFrame, small: DataFrame, on: list[str], few: bool) -> DataFrame:
    """Equi-join with a table of a few rows a source; broadcast where these
    have been counted and are few."""
    return rows.join(F.broadcast(small) if few else small, on)


def _cut(rows: DataFrame, budget: DataFrame, few: bool) -> DataFrame:
    """(key, cut) per source: the first candidate (v, id) that overruns.

    rows: key, v in [0, 1), id, size. What comes before it in order of (v, id)
    is the longest prefix whose words fit ``budget`` (key, gap). A null cut
    takes all.
    """
    run = lambda *by: W.partitionBy("key").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    over = F.col("before") + F.col("size") > F.col("gap")
    rows = rows.withColumn("cell", F.floor(F.col("v") * CELLS))
    hist = rows.groupBy("key", "cell").agg(F.sum("size").alias("size")).join(budget, "key")
    hist = hist.withColumn("before", F.coalesce(F.sum("size").over(run("cell")), F.lit(0))).filter(over)
    first = hist.groupBy("key", "gap").agg(F.min(F.struct("cell", "before")).alias("at")).select("key", "gap", "at.cell", F.col("at.before").alias("base"))
    inside = _by_source(rows, first, ["key", "cell"], few).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(run("v", "id")), F.lit(0)))
    ends = inside.filter(over).groupBy("key").agg(F.min(F.struct("v", "id")).alias("cut"))
    return budget.join(ends, "key", "left").select("key", "cut")


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def _with_ranks(rows: DataFrame) -> DataFrame:
    """Adds whole copies, the rank v in [0, 1) for one more, and whether there may be one."""
    rows = rows.withColumn("_whole", F.floor(F.col("_want") + 1e-12).cast("long")).withColumn("_p", F.greatest(F.lit(0.0), F.col("_want") - F.col("_whole")))
    low, high = F.col("_u") * (1 - F.col("_p")), F.col("_p") * (1 - F.col("_u"))
    return rows.withColumn("_v", low / (low + high)).withColumn("_open", (F.col("_p") > 0) & (F.col("_size") > 0))


def _place() -> Column:
    return F.struct(F.col("_v").alias("v"), F.col("_id").alias("id"))


def _in_prefix() -> Column:
    return F.col("_open") & (F.col("_gap") > 0) & (F.col("_cut").isNull() | (_place() < F.col("_cut")))


def _filled() -> Column:
    return F.col("_open") & F.coalesce(F.array_contains("_fills", _place()), F.lit(False))


def _fill(rest: DataFrame, left: DataFrame) -> DataFrame:
    """(_key, _fills): places of the documents that fill ``_rest``.

    left: _key, _size, doc; one document for each size. A source's array has
    its distinct sizes below twice the rest, which is under one document's
    size, so it is bounded by the words of the longest text.
    """
    sizes = left.groupBy("_key").agg(F.sort_array(F.collect_list("_size"), asc=False).alias("sizes")).join(rest.select("_key", "_rest"), "_key")
    none = F.array().cast("array<bigint>")
    take = lambda s, x: F.struct((s["rest"] - x).alias("rest"), F.concat(s["chosen"], F.array(x)).alias("chosen"))
    greedy = F.aggregate("sizes", F.struct(F.col("_rest").alias("rest"), none.alias("chosen")), lambda s, x: F.when(x <= s["rest"], take(s, x)).otherwise(s))
    done = sizes.withColumn("done", greedy)
    over = F.array_min(F.filter("sizes", lambda x: (x > F.col("done.rest")) & (x < 2 * F.col("done.rest")) & ~F.array_contains("done.chosen", x)))
    chosen = done.select("_key", F.explode(F.concat("done.chosen", F.when(over.isNull(), none).otherwise(F.array(over)))).alias("_size"))
    return chosen.join(left, ["_key", "_size"]).groupBy("_key").agg(F.collect_list("doc").alias("_fills"))


class Mix:
    """Sizes and random numbers of all documents, and the few numbers a source
    that decide how often each is taken."""

    def __init__(self, docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, odds: str | None = None, seed: str = "mix"):
        scratch = Scratch(docs.sparkSession, "source-mix")
        digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
        self.own = {"_key": _key(), "_size": word_count("text"), "_odds": column_odds(odds) if odds else F.lit(0).cast("long"), "_u": u, "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}
        self.by_size = odds is None
        self.sized = scratch.write(self._own(docs, [F.col("doc_id")]), "sized")

        classes = self.sized.groupBy(F.col("_key").alias("source"), F.col("_odds").alias("key")).agg(F.sum("_size").alias("size"))
        classes = scratch.write(classes, "classes")  # at most some 240 rows a source
        totals = classes.groupBy(F.col("source").alias("key")).agg(F.sum("size").alias("size"))
        if weights is None:
            place = F.row_number().over(W.orderBy("key")) - 1  # '=' sorts before '~'; one row a source
            totals = totals.withColumn("weight", (place % 3 + 1).cast("double"))
        else:
            totals = totals.join(weights.select(_key().alias("key"), F.col("weight").cast("double").alias("weight")), "key").filter("weight > 0")
        goal = allocate(totals, most).select(F.col("key").alias("source"), F.col("size").alias("_source_size"), F.col("target").alias("_target"))
        shares = classes.join(goal, "source").withColumn("weight", F.col("key") * F.col("size"))
        shares = allocate(shares, most, ["source"], F.col("_target"))
        want = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("size"))).otherwise(0.0)
        self.plan = scratch.write(
            shares.select(F.col("source").alias("_key"), F.col("key").alias("_odds"), F.col("size").alias("_class_size"), "_source_size", "_target", want.alias("_want")), "plan"
        )
        self.few = within(self.plan, 50_000)
        sure = F.sum(F.col("_class_size") * F.floor(F.col("_want") + 1e-12).cast("long"))
        gaps = scratch.write(self.plan.groupBy("_key").agg((F.first("_target") - sure).alias("_gap")), "gaps")
        ranked = _with_ranks(_by_source(self.sized, self.plan, ["_key", "_odds"], self.few))
        open_rows = ranked.filter("_open").select(F.col("_key").alias("key"), F.col("_v").alias("v"), F.col("_id").alias("id"), F.col("_size").alias("size"))
        cuts = _cut(open_rows, gaps.filter("_gap > 0").select(F.col("_key").alias("key"), F.col("_gap").alias("gap")), self.few)
        cuts = scratch.write(gaps.join(cuts.select(F.col("key").alias("_key"), F.col("cut").alias("_cut")), "_key", "left"), "cuts")
        used = _by_source(ranked, cuts, ["_key"], self.few).filter(_in_prefix()).groupBy("_key").agg(F.sum("_size").alias("used"))
        rest = scratch.write(cuts.join(used, "_key", "left").withColumn("_rest", F.col("_gap") - F.coalesce("used", F.lit(0))).drop("used"), "rest")
        left = _by_source(ranked, rest.filter("_rest > 0"), ["_key"], self.few).filter(F.col("_open") & ~_in_prefix() & (F.col("_size") < 2 * F.col("_rest")))
        left = scratch.write(left.groupBy("_key", "_size").agg(F.min(_place()).alias("doc")), "left")
        self.cuts = scratch.write(rest.join(_fill(rest, left), "_key", "left").drop("_rest"), "decided")

    def _own(self, docs: DataFrame, more: list[Column]) -> DataFrame:
        rows = docs.select(*more, *(c.alias(n) for n, c in self.own.items()))
        return rows.withColumn("_odds", size_odds()) if self.by_size else rows

    def decide(self, rows: DataFrame) -> DataFrame:
        """rows with their own numbers, their source's, and ``_copies``."""
        rows = _by_source(_with_ranks(_by_source(rows, self.plan, ["_key", "_odds"], self.few)), self.cuts, ["_key"], self.few)
        # the explode keeps filters on the result from being unfolded into all these terms
        return rows.withColumn("_copies", F.explode(F.array(F.col("_whole") + (_in_prefix() | _filled()).cast("long"))))


def mixed(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, odds: str | None = None, seed: str = "mix") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies.

    docs: doc_id, text, source (and ``odds``, a positive number) and any other
    columns, which stay. weights: source, weight > 0 (sources that it lacks
    are left out); without it sources in code-point order, null last, weigh 1,
    2, 3, repeating. A null source is a source of its own. Null and empty
    texts have size 0; they get whole copies only, none where all texts of
    their odds are empty. Rows that repeat an id share its random number;
    those of one size are decided alike. The random number is the md5 of
    ``seed`` and the id, so reruns agree. An empty table gives no rows.

    The decisions are a few numbers per source, so texts are never shuffled;
    they are read once for the sizes and once for the result.
    """
    m = Mix(docs, weights, most, odds, seed)
    names = docs.columns
    rows = m.decide(m._own(docs, [F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")]))
    return rows.select(
        *(F.col(f"_row.`{c}`").alias(c) for c in names),
        F.col("_size").alias("mix_size"),
        F.col("_source_size").alias("mix_source_size"),
        F.col("_target").alias("mix_target"),
        F.col("_copies").alias("mix_copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats
    counted) of every row of docs; see ``mixed``. Texts are read once."""
    m = Mix(docs, **options)
    return m.decide(m.sized).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


#: The same in SQL, by whole sorts instead of histograms.
SQL = """
with recursive sized as (
  select doc_id, case when source is null then '~' else '=' || source end as key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         (('0x' || md5('mix:' || coalesce(cast(doc_id as varchar), ''))[1:12])::bigint::double + 0.5) / 281474976710656.0 as u
  from documents),
graded as (
  select *, cast(round(sqrt(sqrt(2.0::double ** (len(bin(size)) - 1))) * 1024) as bigint) as odds from sized),
totals as (
  select key, cast(sum(size) as bigint) as size, (row_number() over (order by key) - 1) % 3 + 1.0::double as weight from graded group by key),
ordered as (
  select *, 3.0::double * size as cap, 3.0::double * size / weight as ratio from totals),
levels as (
  select *,
    (sum(size) over () - coalesce(sum(cap) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0)) as lvl
  from ordered),
plan as (
  select key, size as source_size,
    least(cap, coalesce((select max(lvl) from levels where lvl <= ratio) * weight, cap)) as target
  from levels),
classes as (
  select key, odds, cast(sum(size) as bigint) as size, cast(odds * sum(size) as bigint) as weight from graded group by key, odds),
class_ordered as (
  select c.*, p.source_size, p.target, 3.0::double * c.size as cap, case when c.weight > 0 then 3.0::double * c.size / c.weight else 0.0 end as ratio from classes c join plan p using (key)),
class_levels as (
  select *,
    (target - coalesce(sum(cap) over (partition by key order by ratio, odds rows between unbounded preceding and 1 preceding), 0))
    / nullif((sum(weight) over (partition by key) - coalesce(sum(weight) over (partition by key order by ratio, odds rows between unbounded preceding and 1 preceding), 0))::double, 0) as lvl
  from class_ordered),
wants as (
  select *, case when size > 0 then least(3.0, least(cap, coalesce(max(lvl) filter (lvl <= ratio) over (partition by key) * weight, cap)) / size) else 0.0 end as want
  from class_levels),
parts as (
  select g.doc_id, g.key, g.size, g.u, w.source_size, w.target,
    cast(floor(w.want + 1e-12) as bigint) as whole, greatest(0.0, w.want - floor(w.want + 1e-12)) as p
  from graded g join wants w on g.key = w.key and g.odds = w.odds),
ranked as (
  select *, u * (1 - p) / (u * (1 - p) + p * (1 - u)) as v, p > 0 and size > 0 as free, coalesce(cast(doc_id as varchar), '') as id from parts),
gaps as (select *, target - sum(size * whole) over (partition by key) as gap from ranked),
prefix as (
  select *, free and gap > 0 and sum(size) filter (free) over (partition by key order by v, id) <= gap as by_rank from gaps),
rests as (select *, gap - coalesce(sum(size) filter (by_rank) over (partition by key), 0) as rest from prefix),
left_out as (
  select key, size, rest, v, id from rests where free and not by_rank and rest > 0 and size < 2 * rest
  qualify row_number() over (partition by key, size order by v, id) = 1),
greedy as (
  select distinct key, rest, cast(null as bigint) as size from left_out
  union all
  select g.key, g.rest - n.size, n.size from greedy g, lateral (
    select max(l.size) as size from left_out l where l.key = g.key and l.size <= g.rest and (g.size is null or l.size < g.size)) n
  where n.size is not null),
chosen as (select key, size from greedy where size is not null),
done as (select key, min(rest) as rest from greedy group by key),
fills as (
  select key, size from chosen
  union all
  select l.key, min(l.size) from left_out l join done d using (key)
  where l.size > d.rest and l.size < 2 * d.rest and not exists (select 1 from chosen c where c.key = l.key and c.size = l.size) group by l.key),
filled as (select l.key, l.v, l.id from left_out l join fills f on l.key = f.key and l.size = f.size)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
  cast((whole + (by_rank or free and f.id is not null)::int) * size as bigint) as taken
from rests r left join filled f on r.key = f.key and r.v = f.v and r.id = f.id
"""
