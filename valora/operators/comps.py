"""Comparable-sales search for every listing at once.

Criteria per target: same zip, sqft within +-20 %, bedrooms +-1, year built
+-15, not itself.  Score = .5*|dsqft|/sqft + .3*|dbeds| + .2*|dyear|/100,
rounded to 10 digits; best ``n`` by (score, id), NULL scores last.  Targets
with no match fall back to the whole zip.

Plan: targets that agree in zip, sqft, bedrooms and year are one kind; a kind
keeps its best n + 1, so that each of its targets has n besides itself.  For
fixed (zip, bedrooms, year) the score only grows with the distance in sqft, so
the n nearest sqft values on each side hold the best.  Listings of such a group
are numbered in order of sqft; a kind finds its place in each group it may use
by one running maximum over sorted rows, and then joins the few numbers around
it.  A kind meets at most (2 n + 2) * 3 (n + 1) listings of a group, whatever
the data size.

Equal sqft values (to 1e-6, the rounding of the score) are one value; of each
only the listings that can still be among the best are kept (smallest ids,
smallest and largest sqft), cut before the shuffle where sqft is the same, so a
sqft shared by many listings costs nothing.  Once a group has over
``WIDE_ROWS`` of them, groups are cut into slabs of ``SLAB_SQFT`` square feet,
and numbers run on from one slab to the next: no window holds a whole group.

The nearest bedrooms come first: where one more bedroom always costs more than
the widest match with the same bedrooms, only kinds with too few such matches
look further.  Where groups hold many listings (``DENSE_ROWS`` on average) and
there are many years (``MANY_YEARS`` of a zip's bedrooms), the nearest years
come first as well, and a kind only goes on to years that can still beat the
last of its best.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.session import stage

GROUP = ["zip", "beds", "year"]
KIND = ["zip", "t_sqft", "t_beds", "t_year"]
PAIR = [*KIND, "c_id", "c_price", "score"]
#: group size from which groups are cut into slabs, and their width
WIDE_ROWS, SLAB_SQFT = 50_000, 64
#: mean group size and number of years from which those within NEAR_YEARS are looked at first
DENSE_ROWS, MANY_YEARS, NEAR_YEARS = 64, 12, 1


def _score(sqft: Column, beds: Column, year: Column, c_sqft: Column, c_beds: Column, c_year: Column) -> Column:
    return F.round(F.abs(c_sqft - sqft) / sqft * 0.5 + F.abs(c_beds - beds) * 0.3
                   + F.abs(c_year - year) / 100 * 0.2, 10)


def _useful(base: DataFrame, n: int) -> DataFrame:
    """Listings with all attributes that can be among the best n + 1."""
    c = base.select(*GROUP, F.col("id").alias("c_id"), F.col("sqft").alias("c_sqft"), F.col("price").alias("c_price")) \
        .dropna(subset=["beds", "year", "c_sqft"]).withColumn("cell", F.round("c_sqft", 6))
    same = Window.partitionBy(*GROUP, "cell", "c_sqft").orderBy("c_id")
    c = c.withColumn("w", F.row_number().over(same)).where(F.col("w") <= n + 1).drop("w")
    ways = [F.row_number().over(Window.partitionBy(*GROUP, "cell").orderBy(*o))
            for o in (["c_id"], ["c_sqft", "c_id"], [F.desc("c_sqft"), "c_id"])]
    useful = reduce(lambda x, y: x | y, [F.col(f"w{i}") <= n + 1 for i in range(3)])
    return c.withColumns({f"w{i}": w for i, w in enumerate(ways)}).where(useful).drop("w0", "w1", "w2")


def _slab(sqft: Column, wide: bool) -> Column:
    if not wide:
        return F.lit(0).cast("long")
    return F.floor(F.least(F.greatest(sqft / SLAB_SQFT, F.lit(-1e15)), F.lit(1e15)))


def _slab_ends(rows: DataFrame) -> DataFrame:
    """``rows`` (GROUP, slab, end) with ``before``, the largest end of the
    slabs below, and ``last``, that of the group."""
    group = Window.partitionBy(*GROUP)
    below = group.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"before": F.coalesce(F.max("end").over(below), F.lit(0)), "last": F.max("end").over(group)})


def _numbered(useful: DataFrame, wide: bool) -> DataFrame:
    """Useful listings numbered within their group by sqft value (``place``)."""
    rows = useful.withColumn("slab", _slab(F.col("cell"), wide))
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*GROUP, "slab").orderBy("cell")))
    if not wide:
        return rows
    sizes = rows.groupBy(*GROUP, "slab").agg(F.max("place").alias("end"))
    below = Window.partitionBy(*GROUP).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("end").over(below), F.lit(0)).cast("int")).drop("end")
    return rows.join(offsets, [*GROUP, "slab"]).withColumn("place", F.col("place") + F.col("offset")).drop("offset")


def _near(probes: DataFrame, members: DataFrame, n: int, wide: bool) -> DataFrame:
    """``probes`` (GROUP, KIND) with the members of their group at the n + 1
    sqft values below and above."""
    places = members.select(*GROUP, "slab", F.col("cell").alias("at"), "place").distinct()
    events = (probes.withColumns({"at": F.col("t_sqft"), "slab": _slab(F.col("t_sqft"), wide), "place": F.lit(None).cast("int")})
              .unionByName(places, allowMissingColumns=True))
    slab = Window.partitionBy(*GROUP, "slab")
    upto = slab.orderBy("at", F.col("place").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    here = events.withColumn("here", F.max("place").over(upto))
    if wide:
        ends = _slab_ends(events.groupBy(*GROUP, "slab").agg(F.max("place").alias("end")))
        here = here.join(ends.drop("end"), [*GROUP, "slab"])
    else:
        here = here.withColumns({"last": F.max("place").over(slab), "before": F.lit(0)})
    here = (here.where(F.col("t_sqft").isNotNull() & F.col("last").isNotNull())
            .withColumn("here", F.coalesce("here", "before")))
    lo, hi = F.greatest(F.lit(1), F.col("here") - n), F.least(F.col("last"), F.col("here") + n + 1)
    spots = here.where(lo <= hi).drop("at", "slab").withColumn("place", F.explode(F.sequence(lo, hi)))
    return spots.join(members.drop("slab"), [*GROUP, "place"]) \
        .withColumn("score", _score(F.col("t_sqft"), F.col("t_beds"), F.col("t_year"), F.col("c_sqft"), F.col("beds"), F.col("year")))


def _best(pairs: DataFrame, n: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").asc_nulls_last(), "c_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _of_targets(pairs: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The best n of every target besides itself: the n + 1 best of its kind
    as one short list, joined to the targets (a hot kind can be split)."""
    lists = (_best(pairs, n + 1, KIND).groupBy(*KIND)
             .agg(F.array_sort(F.collect_list(F.struct("rank", "c_id", "c_price", "score"))).alias("list")))  # n + 1 entries
    others = F.slice(F.filter("list", lambda c: c["c_id"] != F.col("t_id")), 1, n)
    return (targets.join(lists, KIND).select("t_id", "t_price", F.posexplode(others).alias("pos", "c"))
            .select("t_id", "t_price", "c.c_id", "c.c_price", "c.score", (F.col("pos") + 1).alias("rank")))


def _apart() -> Column:
    return F.abs(F.col("year") - F.col("t_year"))


class _Search:
    """Matches of kinds among the numbered listings."""

    def __init__(self, members: DataFrame, n: int, sqft_tol: float, year_tol: int, wide: bool):
        self.members, self.n, self.sqft_tol, self.year_tol, self.wide = members, n, sqft_tol, year_tol, wide
        self.groups = members.select(*GROUP).distinct()

    def matches(self, kinds: DataFrame, beds: list[int], years: Column) -> DataFrame:
        """Pairs within the criteria, for the given differences in bedrooms and
        a condition on the years."""
        probes = (kinds.withColumn("beds", F.explode(F.array(*[(F.col("t_beds") + d).cast("int") for d in beds])))
                  .join(self.groups, ["zip", "beds"]).where(years).select(*KIND, "beds", "year"))
        near = _near(probes, self.members, self.n, self.wide)
        return near.where((F.col("c_sqft") >= F.col("t_sqft") * (1 - self.sqft_tol))
                          & (F.col("c_sqft") <= F.col("t_sqft") * (1 + self.sqft_tol))).select(*PAIR)

    def all_years(self, kinds: DataFrame, beds: list[int]) -> DataFrame:
        return self.matches(kinds, beds, _apart() <= self.year_tol)

    def years_by_distance(self, kinds: DataFrame, beds: list[int]) -> DataFrame:
        """As ``all_years``, but years beyond NEAR_YEARS only as far as one of
        them can still come before the last of the n + 1 nearest."""
        first = stage(_best(self.matches(kinds, beds, _apart() <= NEAR_YEARS), self.n + 1, KIND), "comps_near_years").drop("rank")
        bound = first.groupBy(*KIND).agg(F.when(F.count(F.lit(1)) == self.n + 1, F.max("score")).alias("bound"))
        # a score of 0.2 years / 100 or less, ties and a hair of rounding included
        reach = F.least(F.lit(self.year_tol), F.floor(F.coalesce("bound", F.lit(1e6)) * 500 + 1e-6).cast("int"))
        more = kinds.join(bound, KIND, "left").withColumn("reach", reach).where(F.col("reach") > NEAR_YEARS)
        return first.unionByName(self.matches(more, beds, (_apart() > NEAR_YEARS) & (_apart() <= F.col("reach"))))


def _whole_zip(lonely: DataFrame, base: DataFrame, search: _Search, n: int) -> DataFrame:
    """Pairs for targets without a match: the nearest of every group of the
    zip, and the smallest ids among the listings without a score."""
    complete = F.col("t_sqft").isNotNull() & F.col("t_beds").isNotNull() & F.col("t_year").isNotNull()
    kinds = lonely.where(complete).select(*KIND).distinct()
    scored = _best(_near(kinds.join(search.groups, "zip"), search.members, n, search.wide).select(*PAIR), n + 1, KIND).drop("rank")
    first = Window.partitionBy("zip").orderBy("c_id")
    plain = base.select("zip", F.col("id").alias("c_id"), F.col("price").alias("c_price"),
                        (F.col("sqft").isNull() | F.col("beds").isNull() | F.col("year").isNull()).alias("open"))
    head = lambda df: df.withColumn("w", F.row_number().over(first)).where(F.col("w") <= n + 1)
    without = (lonely.where(complete).join(head(plain.where("open")), "zip")
               .unionByName(lonely.where(~complete).join(head(plain), "zip"))
               .withColumn("score", F.lit(None).cast("double")))
    own = ["t_id", "t_price", "c_id", "c_price", "score"]
    return lonely.join(scored, KIND).select(*own).unionByName(without.select(*own)).where(F.col("c_id") != F.col("t_id"))


def find_comps(df: DataFrame, n: int = 5, sqft_tol: float = 0.20, year_tol: int = 15,
               with_fallback: bool = True) -> DataFrame:
    """(target_id, comp_id, rank, similarity_score, comp_price, target_price, fallback)."""
    base = stage(df.where(F.col("zip_code").isNotNull())
                 .select("id", F.col("zip_code").alias("zip"), F.col("sqft").cast("double").alias("sqft"),
                         F.col("bedrooms").cast("int").alias("beds"), F.col("year_built").cast("int").alias("year"), "price"),
                 "comps_base")
    useful = stage(_useful(base, n), "comps_useful")
    sizes = (useful.groupBy(*GROUP).count().groupBy("zip", "beds").agg(F.max("count").alias("m"), F.sum("count").alias("s"), F.count("*").alias("y"))
             .agg(F.max("m").alias("most"), (F.sum("s") / F.sum("y")).alias("rows"), F.avg("y").alias("years")).first())
    wide = (sizes["most"] or 0) > WIDE_ROWS
    dense = (sizes["rows"] or 0) >= DENSE_ROWS and (sizes["years"] or 0) >= MANY_YEARS
    search = _Search(stage(_numbered(useful, wide), "comps_numbered"), n, sqft_tol, year_tol, wide)
    targets = base.select("zip", F.col("id").alias("t_id"), F.col("sqft").alias("t_sqft"), F.col("beds").alias("t_beds"),
                          F.col("year").alias("t_year"), F.col("price").alias("t_price"))
    kinds = stage(targets.select(*KIND).dropna().distinct(), "comps_kinds")
    look = search.years_by_distance if dense and year_tol > NEAR_YEARS else search.all_years
    widest_same = 0.5 * sqft_tol + 0.2 * year_tol / 100
    if widest_same < 0.3:
        same = stage(_best(look(kinds, [0]), n + 1, KIND), "comps_same")
        full = same.where(F.col("rank") == n + 1).select(*KIND)
        found = same.drop("rank").unionByName(search.all_years(kinds.join(full, KIND, "left_anti"), [-1, 1]))
    else:
        found = search.all_years(kinds, [-1, 0, 1])
    best = stage(_of_targets(found, targets, n), "comps_best").withColumn("fallback", F.lit(False))
    if not with_fallback:
        return _finish(best)
    lonely = stage(targets.join(best.select("t_id"), "t_id", "left_anti"), "comps_lonely")
    fb = _best(_whole_zip(lonely, base, search, n), n, ["t_id"]).withColumn("fallback", F.lit(True))
    return _finish(best.unionByName(fb, allowMissingColumns=True))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(F.col("t_id").alias("target_id"), F.col("c_id").alias("comp_id"),
                     F.col("rank").cast("bigint").alias("rank"),
                     F.col("score").alias("similarity_score"),
                     F.col("c_price").alias("comp_price"), F.col("t_price").alias("target_price"),
                     "fallback")


def comp_summary(comps: DataFrame, predictions: DataFrame | None = None,
                 pred_col: str = "model_price") -> DataFrame:
    """Per target: comp count, average comp price, and the gap to the
    target's model price (or list price when no predictions are given)."""
    agg = comps.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_comps"),
        (F.round(F.sum("comp_price"), 2) / F.count("comp_price")).alias("avg_comp_price"),
        F.first("target_price").alias("target_price"))
    if predictions is not None:
        agg = agg.join(predictions.select(F.col("id").alias("target_id"), pred_col), "target_id", "left") \
            .withColumn("reference_price", F.col(pred_col)).drop(pred_col)
    else:
        agg = agg.withColumn("reference_price", F.col("target_price"))
    return agg.withColumn("comp_difference", F.col("reference_price") - F.col("avg_comp_price"))
