"""Hex-cell spatial lag features, cell feature store and cell geometry.

Plan shape (flagship ``spatial_lags``): rows -> cell id (row-local) ->
one partial-aggregated cell table -> neighbour table built from the *cell*
table only (cells x 6 offsets, equi-join on (q, r)) -> both joined back to
rows on the cell key.  Row-level work is two joins against tables whose size
is the number of occupied cells; the per-cell price rank uses the skew-safe
sub-bucket rank from ``windows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.functions import stats as ST
from valora.functions import geo
from valora.operators import windows
from valora.operators.features import price_per_sqft
from valora.session import stage

LAG_COLS = ["h3_median_ppsf", "h3_neighbor_median_ppsf", "h3_listing_density",
            "h3_price_percentile"]


def add_cell_index(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return geo.with_cell(df, lat, lon, "h3_index")


def add_cell_numeric(df: DataFrame) -> DataFrame:
    if "h3_index" not in df.columns:
        df = add_cell_index(df)
    return df.withColumn("h3_numeric", geo.cell_numeric("h3_index"))


def add_all_spatial_features(df: DataFrame) -> DataFrame:
    """cell index + numeric cell + distance to centre (both column names)."""
    d = geo.distance_to_center()
    return add_cell_numeric(add_cell_index(df)).withColumns(
        {"distance_to_center_km": d, "distance_to_downtown_km": d})


def _ensure_ppsf(df: DataFrame) -> DataFrame:
    if "h3_index" not in df.columns:
        df = add_cell_index(df)
    if "price_per_sqft" not in df.columns:
        df = price_per_sqft(df)
    return df


def _cell_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Rows that have a cell.  Where the cell is not a column yet, it is written
    once: a filter on it would carry the whole formula of the cell, each of its
    steps many times over, into every consumer's scan."""
    if not {"h3_index", "price_per_sqft"} <= set(df.columns):
        df = stage(_ensure_ppsf(df).select("h3_index", "price_per_sqft", *cols), "cell_rows")
    return df.where(F.col("h3_index").isNotNull())


def cell_stats(df: DataFrame) -> DataFrame:
    """Per cell: ppsf median/mean/std/count(non-null), price median/min/max."""
    rows = _cell_rows(df, "price")
    sums = rows.groupBy("h3_index").agg(
        F.avg("price_per_sqft").alias("h3_mean_ppsf"),
        F.stddev_samp("price_per_sqft").alias("h3_std_ppsf"),
        F.count("price_per_sqft").alias("h3_listing_density"),
        F.min("price").alias("h3_min_price"),
        F.max("price").alias("h3_max_price"),
    )
    med = ST.quantiles(rows, ["h3_index"], {"h3_median_ppsf": ("price_per_sqft", 0.5), "h3_median_price": ("price", 0.5)})
    return sums.join(med, "h3_index", "left")


def cell_feature_store(df: DataFrame) -> DataFrame:
    """Per cell aggregate store used to score new listings quickly."""
    rows = _cell_rows(df, "price", "sqft", "bedrooms")
    sums = rows.groupBy("h3_index").agg(
        F.avg("price_per_sqft").alias("mean_ppsf"),
        F.stddev_samp("price_per_sqft").alias("std_ppsf"),
        F.count("price_per_sqft").alias("listing_count"),
        F.avg("price").alias("mean_price"),
    )
    med = ST.quantiles(rows, ["h3_index"], {
        "median_ppsf": ("price_per_sqft", 0.5), "median_price": ("price", 0.5),
        "median_sqft": ("sqft", 0.5), "median_bedrooms": ("bedrooms", 0.5)})
    return sums.join(med, "h3_index", "left")


def neighbor_ppsf(cells: DataFrame) -> DataFrame:
    """Density-weighted mean of neighbour medians over the 6 adjacent cells.

    Works on the cell table only: explode 6 offsets per cell, equi-join the
    cell table on (q, r), group by the centre cell.  Sum of densities 0 ->
    median of the neighbour medians; no occupied neighbour -> no row (NULL).
    """
    # the cell table feeds both sides of the self-join: staged once (it has
    # one row per occupied cell)
    ax = stage(cells.select("h3_index", "h3_median_ppsf", "h3_listing_density",
                            geo.cell_unpack("h3_index").alias("_ax")), "nbr_cells")
    centres = ax.select(F.col("h3_index").alias("center"),
                        F.explode(geo.disk_offsets(1, include_center=False)).alias("_o"),
                        "_ax") \
        .select("center", (F.col("_ax.q") + F.col("_o.dq")).alias("q"),
                (F.col("_ax.r") + F.col("_o.dr")).alias("r"))
    nbr = ax.select(F.col("_ax.q").alias("q"), F.col("_ax.r").alias("r"),
                    "h3_median_ppsf", "h3_listing_density")
    j = centres.join(nbr, ["q", "r"])
    tot = F.sum("h3_listing_density")
    return (j.groupBy("center").agg(
        F.when(tot > 0, _ordered_sum(F.col("h3_median_ppsf") * F.col("h3_listing_density")) / tot)
        .otherwise(F.median("h3_median_ppsf")).alias("h3_neighbor_median_ppsf"))  # at most 6 values
        .withColumnRenamed("center", "h3_index"))


def _ordered_sum(col):
    """Sum of the few values of a disk of cells in ascending order: the sum of
    doubles depends on the order, and the order of arrival on the partitions."""
    return F.aggregate(F.array_sort(F.collect_list(col)), F.lit(0.0), lambda t, x: t + x)


def neighborhood_stats(df: DataFrame, target_col: str = "price", k: int = 1) -> DataFrame:
    """Per row: unweighted mean of cell means and summed counts over the
    k-ring disk (centre included), computed at cell level then joined.

    The result doesn't depend on the order of rows: cell sums are exact
    decimals of the target at four places, divided once, and the at most
    3k(k + 1) + 1 means of a disk are added in ascending order."""
    df = _ensure_ppsf(df)
    exact = F.sum(F.col(target_col).cast("decimal(28, 4)")).cast("double")
    cells = (df.where(F.col("h3_index").isNotNull()).groupBy("h3_index")
             .agg(F.try_divide(exact, F.count(target_col)).alias("_mean"), F.count(target_col).alias("_count")))
    ax = stage(cells.select("h3_index", "_mean", "_count", geo.cell_unpack("h3_index").alias("_ax")),
               "disk_cells")  # both sides of the self-join
    centres = ax.select(F.col("h3_index").alias("center"), "_ax",
                        F.explode(geo.disk_offsets(k, include_center=True)).alias("_o")) \
        .select("center", (F.col("_ax.q") + F.col("_o.dq")).alias("q"),
                (F.col("_ax.r") + F.col("_o.dr")).alias("r"))
    nbr = ax.select(F.col("_ax.q").alias("q"), F.col("_ax.r").alias("r"), "_mean", "_count")
    agg = (centres.join(nbr, ["q", "r"]).groupBy("center")
           .agg(F.try_divide(_ordered_sum("_mean"), F.count("_mean")).alias("neighborhood_avg_price"),
                F.sum("_count").alias("neighborhood_count"))
           .withColumnRenamed("center", "h3_index"))
    return df.join(agg, "h3_index", "left")


def cell_price_percentile(df: DataFrame, staged: bool = False) -> DataFrame:
    """100 * (#rows in the cell with a strictly lower price) / (#rows in the
    cell); NULL cell or single-row cell -> 50; NULL price -> 0.  ``staged``:
    ``df`` reads a written table, which is not written again."""
    ranked = windows.count_lower_in_group(df, ["h3_index"], "price", "_lower", "_n", staged=staged)
    pct = (F.when(F.col("h3_index").isNull() | (F.col("_n") <= 1), F.lit(50.0))
           .when(F.col("price").isNull(), F.lit(0.0))
           .otherwise(F.col("_lower") * 100.0 / F.col("_n")))
    return ranked.withColumn("h3_price_percentile", pct).drop("_lower", "_n")


def fill_with_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL -> column median (one 1-row aggregate, broadcast)."""
    meds = ST.quantiles(df, [], {f"_med_{c}": (c, 0.5) for c in cols})
    out = df.crossJoin(F.broadcast(meds))
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
    return out.drop(*[f"_med_{c}" for c in cols])


def leave_one_out_median(df: DataFrame) -> DataFrame:
    """Rows with ``h3_median_ppsf`` of their cell without the row itself (NULL
    where it is alone), from at most four ranked values of a cell.

    Of n sorted values, taking out the one at rank i leaves n - 1; the values
    at rank k of what is left are those at rank k, or k + 1 from i on.  So the
    values around the middle decide, and whether the row is below them."""
    rows = df.where(F.col("h3_index").isNotNull() & F.col("price_per_sqft").isNotNull())
    around = ST.ranked_values(rows, "h3_index", "price_per_sqft", lambda n: [
        F.floor((n - 2) / 2), F.floor((n - 2) / 2) + 1, F.ceil((n - 2) / 2), F.ceil((n - 2) / 2) + 1])
    v = F.col("price_per_sqft")
    at = lambda a, b: F.when(v <= F.col(a), F.col(b)).otherwise(F.col(a))
    out = df.join(around, "h3_index", "left")
    med = F.when(F.col("n") < 2, None).when(v.isNull(), None).otherwise((at("r0", "r1") + at("r2", "r3")) / 2)
    return out.withColumn("h3_median_ppsf", med).drop("n", "r0", "r1", "r2", "r3")


def spatial_lags(df: DataFrame, leave_one_out: bool = False) -> DataFrame:
    """Cell median ppsf, neighbour ppsf, density, within-cell price percentile.

    As in the original, a row's own price is inside its cell statistics;
    ``leave_one_out`` takes it out of the cell median (the neighbour cells
    never hold it).
    """
    # the row table feeds four consumers (cell stats, rank buckets, bucket
    # counts, the join back) and the joined table two (medians, output):
    # both are staged once instead of re-deriving the rows per consumer
    df = stage(_ensure_ppsf(df), "lag_rows")
    cells = stage(cell_stats(df), "lag_cells")
    ranked = cell_price_percentile(df, staged=True)
    joined = ranked.join(cells.select("h3_index", "h3_median_ppsf", "h3_listing_density",
                                      "h3_median_price"), "h3_index", "left")
    if leave_one_out:
        joined = leave_one_out_median(joined.drop("h3_median_ppsf"))
    joined = stage(joined.join(neighbor_ppsf(cells), "h3_index", "left"), "lag_joined")
    return fill_with_median(joined, LAG_COLS)


def cell_geojson(df: DataFrame, value_col: str = "price") -> DataFrame:
    """One GeoJSON Feature per cell (mean, count, closed [lon, lat] ring).

    Coordinates carry 7 decimals (~1 cm) and the mean is taken from the
    cent-rounded sum, so the JSON text is the same on every engine."""
    if "h3_index" not in df.columns:
        df = add_cell_index(df)
    cells = (df.where(F.col("h3_index").isNotNull()).groupBy("h3_index")
             .agg((F.round(F.sum(value_col), 2) / F.count(value_col)).alias("value"),
                  F.count(value_col).alias("count")))
    ax = geo.cell_unpack("h3_index")
    ring = geo.cell_boundary(ax["q"], ax["r"])
    coords = F.transform(ring, lambda p: F.array(F.round(p["lon"], 7), F.round(p["lat"], 7)))
    closed = F.concat(coords, F.slice(coords, 1, 1))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"),
        F.struct("h3_index", "value", "count").alias("properties"))
    return cells.select("h3_index", "value", "count", F.to_json(feature).alias("feature"))


#: finest level of the quad grid of ``nearest_property`` (360 / 2^20 degrees)
FINEST, STEP = 20, 2


def _quad(lat, lon) -> tuple:
    """Column and row of the finest quad cell."""
    size = F.lit(360.0 / (1 << FINEST))
    return F.floor((F.col(lat) + 90) / size), F.floor((F.col(lon) + 180) / size)


def nearest_property(df: DataFrame, points: DataFrame) -> DataFrame:
    """For each click point (point_id, plat, plon): the listing with the
    smallest squared degree distance (ties -> lower id), however far it is.

    Descent of a quad grid whose cells carry the bounding box of their
    listings.  A point starts with the one cell of level 0; each step joins the
    cells below (equi-join on the parent) and keeps those whose box begins
    nearer than the nearest box ends, so a point holds a few cells at any
    level.  Only the finest cells that are left are joined with listings.  The
    listings are scanned once and written with their cell; points or listings
    without coordinates take no part.
    """
    x, y = _quad("lat", "lon")
    rows = stage(df.where("lat is not null and lon is not null").select("id", "lat", "lon", x.alias("x"), y.alias("y")),
                 "nearest_rows")
    levels = list(range(STEP, FINEST + 1, STEP))
    finest = rows.groupBy("x", "y").agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    cells = finest.withColumn("level", F.explode(F.array(*map(F.lit, levels)))) \
        .withColumns({c: F.expr(f"shiftright({c}, {FINEST} - level)") for c in ("x", "y")}) \
        .groupBy("level", "x", "y").agg(*[f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    cells = stage(cells, "nearest_cells")

    def gap(c, p):
        return F.greatest(F.lit(0.0), F.col(f"{c}_lo") - F.col(p), F.col(p) - F.col(f"{c}_hi"))

    def reach(c, p):
        return F.greatest(F.abs(F.col(f"{c}_lo") - F.col(p)), F.abs(F.col(f"{c}_hi") - F.col(p)))
    begins = F.pow(gap("lat", "plat"), 2) + F.pow(gap("lon", "plon"), 2)
    ends = F.pow(reach("lat", "plat"), 2) + F.pow(reach("lon", "plon"), 2)
    open_ = (points.where("plat is not null and plon is not null").select("point_id", "plat", "plon")
             .withColumns({"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long")}))
    for level in levels:
        below = cells.where(F.col("level") == level).drop("level").withColumns(
            {"px": F.shiftright("x", STEP), "py": F.shiftright("y", STEP)})
        near = open_.join(below, ["px", "py"]).withColumns({"begins": begins, "ends": ends})
        least = F.min("ends").over(Window.partitionBy("point_id"))
        # a hair of slack, so that rounding never drops the right cell
        open_ = (near.withColumn("least", least).where(F.col("begins") <= F.col("least") * (1 + 1e-9))
                 .select("point_id", "plat", "plon", F.col("x").alias("px"), F.col("y").alias("py")))
    d = geo.sq_degree_distance("lat", "lon", "plat", "plon")
    best = F.min(F.struct(d.alias("dist"), F.col("id")))
    hits = open_.join(rows, (open_["px"] == rows["x"]) & (open_["py"] == rows["y"]))
    return (hits.groupBy("point_id").agg(best.alias("b"))
            .select("point_id", F.col("b.id").alias("id"), F.col("b.dist").alias("sq_dist")))
