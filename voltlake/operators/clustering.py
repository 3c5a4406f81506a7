"""Clustering of scaled features within each data set, all data sets in one plan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType

from voltlake.operators.graph import components
from voltlake.operators.quantiles import exact_percentiles, finite
from voltlake.runtime import materialize, row_count_up_to, small_side


def _square_distance(a: str, b: str, columns: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        gap = F.col(f"{a}{c}") - F.col(f"{b}{c}")
        total = total + gap * gap
    return total


#: Rows of a group that a k-means kernel sees at once.
CHUNK_ROWS = 2048


def _lloyd_sums(width: int, group_type: DataType):
    """Arrow batches of (g, xs, starts, cs) to (g, s, c, n, t0.., o0.., cost): of each start
    and centre the rows it is nearest to, their sums, its old place, and their cost."""
    doubles = [f"{e}{i}" for e in "to" for i in range(width)]
    schema = StructType([StructField("g", group_type), StructField("s", LongType()), StructField("c", LongType()), StructField("n", LongType())])
    for name in (*doubles, "cost"):
        schema = schema.add(name, DoubleType())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, parts = [], []
            for r in range(batch.num_rows):
                x, cs = (batch.column(n)[r].values.to_numpy(zero_copy_only=False).reshape(-1, width) for n in ("xs", "cs"))
                starts = batch.column("starts")[r].values.to_numpy(zero_copy_only=False)
                k = len(cs) // len(starts)
                # |x - c|^2 = |x|^2 + 2 (|c|^2 / 2 - x c); the rows' own part is the same for all centres
                half = ((cs * cs).sum(1) / 2)[:, None] - cs @ x.T
                half = half.reshape(len(starts), k, -1)
                best, near = half[:, 0].copy(), np.zeros((len(starts), len(x)), dtype=np.int64)
                for c in range(1, k):
                    near[half[:, c] < best] = c
                    np.minimum(best, half[:, c], out=best)
                place = (near + np.arange(len(starts))[:, None] * k).ravel()
                cost = (x * x).sum(1) + 2 * best
                weights = [np.tile(x[:, i], len(starts)) for i in range(width)]
                sums = [np.bincount(place, w, len(cs)) for w in (*weights, cost.ravel())]
                part = [np.repeat(starts, k), np.tile(np.arange(k), len(starts)), np.bincount(place, minlength=len(cs))]
                parts.append([*part, *sums[:-1], *cs.T, sums[-1]])
                groups += [r] * len(cs)
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(groups)), *columns], names=schema.names)

    return kernel, schema


def kmeans(rows: DataFrame, group: str, key: str, columns: Sequence[str], k: int = 5, rounds: int = 300, starts: int = 10, seed: int = 42) -> DataFrame:
    """(group, key, cluster, distance): Lloyd's rounds for every group and start at once,
    until no centre moves. Of a group's starts the one of least cost is kept (to nine
    digits, the first of equals). A start's first centres are k rows in the order of their
    hash, each start going on where the last ended; a centre that loses its rows keeps its
    place. Each round joins chunks of rows with the centres of their group and adds up;
    starts that have come to rest leave the join."""
    width = len(columns)
    base = materialize(rows.select(F.col(group).alias("g"), F.col(key).alias("id"), *columns), "rows")
    sizes = materialize(base.groupBy("g").agg(F.count("*").alias("size")).withColumnRenamed("g", "sg"), "sizes")
    sized = base.join(small_side(sizes), F.col("g").eqNullSafe(F.col("sg"))).drop("sg")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CHUNK_ROWS)).alias("chunk")
    point = F.array(*[F.col(c).cast("double") for c in columns])
    packed = sized.groupBy("g", chunk).agg(F.array_sort(F.collect_list(F.struct("id", point.alias("x")))).alias("xs"))
    chunks = materialize(packed.select("g", F.flatten("xs.x").alias("xs")), "chunks")

    rank = F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))
    low = sized.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("r", rank).where(F.col("r") <= k * starts)
    low = low.select("g", "size", "r", point.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(starts - 1)).cast("array<long>")).alias("s"))
    turn = F.pmod(F.col("r") - 1 - F.col("s") * k, F.least(F.col("size"), F.lit(k * starts))).alias("c")
    low = low.select("g", "s", turn, "x").where(F.col("c") < k)

    def by_start(centres: DataFrame, shift: Column, cost: Column) -> DataFrame:
        place = F.array_sort(F.collect_list(F.struct("c", "x")))
        return centres.groupBy("g", "s").agg(place.alias("cs"), F.max(shift).alias("shift"), F.sum(cost).alias("cost")).withColumn("cs", F.flatten("cs.x"))

    now = materialize(by_start(low, F.lit(float("inf")), F.lit(0.0)), "starts")
    kernel, schema = _lloyd_sums(width, base.schema["g"].dataType)
    moving = F.col("shift") >= 1e-18
    for _ in range(rounds):
        if not row_count_up_to(now.where(moving), 0):
            break
        side = now.where(moving).groupBy(F.col("g").alias("cg")).agg(F.array_sort(F.collect_list(F.struct("s", "cs"))).alias("o"))
        side = small_side(side.select("cg", F.col("o.s").alias("starts"), F.flatten("o.cs").alias("cs")))
        met = chunks.join(side, chunks["g"].eqNullSafe(side["cg"])).select("g", "xs", "starts", "cs")
        summed = met.mapInArrow(kernel, schema).groupBy("g", "s", "c").agg(
            F.sum("n").alias("n"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(width)], *[F.max(f"o{i}").alias(f"o{i}") for i in range(width)], F.sum("cost").alias("cost")
        )
        new = summed.select("g", "s", "c", "cost", *[f"o{i}" for i in range(width)], *[F.when(F.col("n") > 0, F.col(f"t{i}") / F.col("n")).otherwise(F.col(f"o{i}")).alias(f"n{i}") for i in range(width)])
        shift = _square_distance("o", "n", [str(i) for i in range(width)])
        fresh = by_start(new.withColumn("x", F.array(*[f"n{i}" for i in range(width)])), shift, F.col("cost"))
        now = materialize(fresh.unionByName(now.where(~moving)), "starts")

    best = now.groupBy(F.col("g").alias("cg")).agg(F.min(F.struct(F.format_string("%.8e", "cost").cast("double").alias("cost"), "s", "cs")).alias("b"))
    side = small_side(materialize(best.select("cg", F.col("b.cs").alias("cs")), "centres"))
    met = base.join(side, base["g"].eqNullSafe(side["cg"]))
    total = lambda c: sum((F.pow(F.col(x) - F.element_at("cs", (c * width + i + 1).cast("int")), F.lit(2.0)) for i, x in enumerate(columns)), F.lit(0.0))
    places = F.sequence(F.lit(0), (F.size("cs") / width).cast("int") - 1)
    near = met.withColumn("_n", F.array_min(F.transform(places, lambda c: F.struct(total(c).alias("d"), c.alias("c")))))
    return near.select(F.col("g").alias(group), F.col("id").alias(key), F.col("_n.c").cast("int").alias("cluster"), F.sqrt("_n.d").alias("distance"))


#: Halvings of a group's span that the neighbour search tells apart.
DEPTH = 16


def _distinct_points(rows: DataFrame, group: str, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows (g, id, columns), points (g, p, m, columns)): equal rows of a group are one
    point of weight m, named by their least key."""
    for c in columns:
        rows = rows.where(finite(F.col(c)))
    base = materialize(rows.select(F.col(group).alias("g"), F.col(key).alias("id"), *columns), "rows")
    return base, base.groupBy("g", *columns).agg(F.count("*").alias("m"), F.min("id").alias("p"))


def _of_points(base: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with what was found for their points (g, columns, ...)."""
    right = found.select(F.col("g").alias("_g"), *[F.col(c).alias(f"_{c}") for c in columns], *[c for c in found.columns if c not in ("g", *columns)])
    on = base["g"].eqNullSafe(right["_g"])
    for c in columns:
        on = on & (base[c] == right[f"_{c}"])
    return base.join(right, on, "left").drop("_g", *[f"_{c}" for c in columns])


def _kth(pairs: DataFrame, k: int) -> DataFrame:
    """(a, d2): of pairs (a, b, m, d2) the square distance within which a has k rows."""
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d2", "b"))).where(F.col("r") <= k)
    lists = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d2", "b", "m"))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d2"))
    walk = lambda s, e: F.struct((s["n"] + e["m"]).alias("n"), F.when(s["n"] < k, e["d2"]).otherwise(s["d2"]).alias("d2"))
    return lists.select("a", F.aggregate("l", start, walk)["d2"].alias("d2"))


def neighbour_distances(rows: DataFrame, group: str, key: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """(group, key, distance) to the k-th nearest row of the group, itself counted; groups
    of fewer rows have none, nor have rows with a null, NaN or infinite column.

    The span of a group is halved again and again. A point's home is the smallest of its
    cells with k rows; the k-th distance inside bounds the true one, and a second join
    looks into the cells that a ball of that radius meets, whose width follows the radius.
    A home's sparse part holds fewer than k rows, so few points look into a dense cell and
    the pairs grow with the rows, not with their square. Equal rows are one point.
    """
    base, points = _distinct_points(rows, group, key, columns)
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    sizes = base.groupBy(F.col("g").alias("wg")).agg(F.count("*").alias("n"), F.min("id").alias("h"), *bounds).where(F.col("n") >= k)
    # a hair wider than the rows, so that all lie in [0, 1)
    span = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in columns], F.lit(1e-300)) * (1 + 1e-9)
    side = small_side(materialize(sizes.select("wg", "h", span.alias("w"), *[f"lo_{c}" for c in columns]), "spans"))
    units = [((F.col(c) - F.col(f"lo_{c}")) / F.col("w")).alias(f"u_{c}") for c in columns]
    placed = materialize(points.join(side, F.col("g").eqNullSafe(F.col("wg"))).select("g", "h", "p", "m", "w", *columns, *units), "placed")

    cell = [f"q_{c}" for c in columns]
    leveled = placed.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
    spots = [F.floor(F.col(f"u_{c}") * F.pow(F.lit(2.0), F.col("l"))).alias(q) for c, q in zip(columns, cell, strict=True)]
    cells = materialize(leveled.select("h", "l", *spots, "p", "m", *columns), "cells")
    where = ["h", "l", *cell]
    full = cells.groupBy(*where).agg(F.sum("m").alias("t")).where(F.col("t") >= k).drop("t")
    home = cells.join(full, where).groupBy("p").agg(F.max(F.struct("l", "h", *cell)).alias("o")).select("p", "o.*")
    a_points = home.join(placed.drop("h"), "p").select(*where, F.col("p").alias("a"), "w", *[F.col(f"u_{c}") for c in columns], *[F.col(c).alias(f"a_{c}") for c in columns])
    a_points = materialize(a_points, "homes")
    b_points = cells.select(*where, F.col("p").alias("b"), "m", *[F.col(c).alias(f"b_{c}") for c in columns])
    met = a_points.join(b_points, where).select("a", "b", "m", _square_distance("a_", "b_", columns).alias("d2"))
    bound = materialize(_kth(met, k).withColumnRenamed("d2", "most"), "bounds")

    ball = a_points.drop(*where[1:]).join(bound, "a").withColumn("r", F.sqrt("most") / F.col("w") * (1 + 1e-9) + 1e-15)
    ball = ball.withColumn("l", F.least(F.greatest(F.floor(-F.log2("r")), F.lit(0)), F.lit(DEPTH)).cast("int"))
    scale = F.pow(F.lit(2.0), F.col("l"))
    for c, q in zip(columns, cell, strict=True):
        reach = [F.least(F.greatest(F.floor((F.col(f"u_{c}") + way * F.col("r")) * scale), F.lit(0)), scale.cast("long") - 1) for way in (-1, 1)]
        ball = ball.withColumn(q, F.explode(F.sequence(*reach)))
    met = ball.drop("w", "r", *[f"u_{c}" for c in columns]).join(b_points, where).withColumn("d2", _square_distance("a_", "b_", columns))
    found = _kth(met.where(F.col("d2") <= F.col("most")).select("a", "b", "m", "d2"), k)
    named = placed.join(found, placed["p"] == found["a"]).select("g", *columns, F.sqrt("d2").alias("distance"))
    return _of_points(base, named, columns).where(F.col("distance").isNotNull()).select(F.col("g").alias(group), F.col("id").alias(key), "distance")


def estimate_eps(distances: DataFrame, group: str, percentile: float = 0.6) -> DataFrame:
    """(group, eps): the percentile of the k-th neighbour distances."""
    return exact_percentiles(distances, [group], ["distance"], [percentile]).select(group, F.col("value").alias("eps"))


#: Cells to the side of a block in which cells look for each other, and the pairs of points
#: of two boxes up to which the points themselves are compared.
BLOCK, FEW_PAIRS = 4, 64


def _box(columns: Sequence[str]) -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]


def _box_distances(columns: Sequence[str]) -> tuple[Column, Column]:
    """Least and greatest square distance of points in boxes a and b. Differences and
    squares round in order, so the bounds hold for the computed distances too."""
    least, most = F.lit(0.0), F.lit(0.0)
    for c in columns:
        right, left = F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}")
        gap, reach = F.greatest(right, left, F.lit(0.0)), F.greatest(F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"), F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"))
        least, most = least + gap * gap, most + reach * reach
    return least, most


def _prefixed(df: DataFrame, prefix: str, names: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(n).alias(f"{prefix}{n}") for n in names])


def _near_cells(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, w): cells with boxes at most w apart, each with itself too. A cell looks for
    the others in its block, to which all cells within reach have come."""
    reach = math.isqrt(len(columns) - 1) + 1
    cell, blocks = [f"q_{c}" for c in columns], [f"k_{c}" for c in columns]
    names = ["c", *cell, *[f"{n}_{c}" for c in columns for n in ("lo", "hi")]]
    home = _prefixed(cells, "a_", names, ["h", "w", *[F.floor(F.col(q) / BLOCK).alias(k) for q, k in zip(cell, blocks, strict=True)]])
    guest = cells
    for q, k in zip(cell, blocks, strict=True):
        guest = guest.withColumn(k, F.explode(F.sequence(F.floor((F.col(q) - reach) / BLOCK), F.floor((F.col(q) + reach) / BLOCK))))
    met = home.join(_prefixed(guest, "b_", names, ["h", *blocks]), ["h", *blocks])
    for q in cell:
        met = met.where(F.abs(F.col(f"a_{q}") - F.col(f"b_{q}")) <= reach)
    return met.where(_box_distances(columns)[0] <= F.col("w") * F.col("w")).select(F.col("a_c").alias("a"), F.col("b_c").alias("b"), "w")


def _linked_cells(near: DataFrame, core: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(u, v): cells of the pairs ``near`` (a, b, w) with core points at most w apart.
    Boxes settle most pairs; doubtful boxes of few points are compared point by point,
    others are halved along each column and looked at again."""
    cell = [f"q_{c}" for c in columns]
    names = ["c", *cell, "n", *[f"{n}_{c}" for c in columns for n in ("lo", "hi")]]
    ab = [f"{s}_{q}" for s in "ab" for q in cell]
    tops = core.select("c", *[F.floor(f"u_{c}").alias(q) for c, q in zip(columns, cell, strict=True)]).distinct()
    open_ = near.join(_prefixed(tops, "a_", ["c", *cell]), F.col("a") == F.col("a_c")).join(_prefixed(tops, "b_", ["c", *cell]), F.col("b") == F.col("b_c"))
    open_ = materialize(open_.select("a", "b", "w", *ab), "open")
    links = None
    for depth in count():  # ends when each box is settled or one point
        here = [F.floor(F.col(f"u_{c}") * F.lit(2.0**depth)).alias(q) for c, q in zip(columns, cell, strict=True)]
        parts = materialize(core.select("c", "p", *columns, *here), "parts")
        boxes = parts.groupBy("c", *cell).agg(F.count("*").alias("n"), *_box(columns))
        above = [(F.floor(F.col(q) / 2) if depth else F.col(q)).alias(f"up_{q}") for q in cell]
        met = open_.select("a", "b", "w", *[F.col(x).alias(f"up_{x}") for x in ab])
        for side in "ab":
            kids = boxes.select(*[F.col(n).alias(f"{side}_{n}") for n in names], *[u.alias(f"up_{side}_{q}") for u, q in zip(above, cell, strict=True)])
            met = met.withColumn(f"{side}_c", F.col(side)).join(kids, [f"{side}_c", *[f"up_{side}_{q}" for q in cell]])
        least, most = _box_distances(columns)
        met = met.where(least <= F.col("w") * F.col("w"))
        met = materialize(met.select("a", "b", "w", *ab, (F.col("a_n") * F.col("b_n")).alias("pairs"), (most <= F.col("w") * F.col("w")).alias("sure")), "boxes")
        sure = met.where("sure").select("a", "b").distinct()
        rest = met.join(sure, ["a", "b"], "left_anti")
        few = rest.where(F.col("pairs") <= FEW_PAIRS)
        for side in "ab":
            few = few.join(_prefixed(parts, f"{side}_", [*cell, *columns], [F.col("c").alias(side)]), [side, *[f"{side}_{q}" for q in cell]])
        close = few.where(_square_distance("a_", "b_", columns) <= F.col("w") * F.col("w")).select("a", "b").distinct()
        found = materialize(sure.unionByName(close), "links")
        links = found if links is None else links.unionByName(found)
        open_ = materialize(rest.where(F.col("pairs") > FEW_PAIRS).join(found, ["a", "b"], "left_anti").select("a", "b", "w", *ab), "open")
        if not row_count_up_to(open_, 0):
            return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def dbscan(rows: DataFrame, group: str, key: str, columns: Sequence[str], eps: DataFrame, min_samples: int = 5) -> DataFrame:
    """(group, key, cluster): density clusters named by their least core key; noise is
    null, and so are rows with a null, NaN or infinite column and those of groups without
    a radius. Core rows have ``min_samples`` rows within eps, themselves counted; a border
    row joins the nearest core row (least key of equals), so the result is the same in
    any order. A radius below a billionth of the group's span counts as that.

    Rows of a cell of diagonal eps are all alike: with ``min_samples`` rows all are core.
    Only rows of thinner cells count their neighbours, and only cells are linked, so
    dense places do not cost the square of their rows. Equal rows are one point.
    """
    base, points = _distinct_points(rows, group, key, columns)
    span = F.greatest(*[F.max(c) - F.min(c) for c in columns], F.lit(0.0))
    lows = base.groupBy(F.col("g").alias("lg")).agg(F.min("id").alias("h"), span.alias("span"), *[F.min(c).alias(f"lo_{c}") for c in columns])
    radius = eps.select(F.col(group).alias("eg"), F.col("eps").alias("e")).where(finite(F.col("e")))
    side = lows.join(radius, F.col("lg").eqNullSafe(F.col("eg"))).withColumn("w", F.greatest("e", F.lit(1e-12), F.col("span") * 1e-9))
    side = small_side(materialize(side.select("lg", "h", "w", *[f"lo_{c}" for c in columns]), "radii"))
    cell = [f"q_{c}" for c in columns]
    edge = F.col("w") * ((1 - 1e-6) / math.sqrt(len(columns)))
    placed = points.join(side, F.col("g").eqNullSafe(F.col("lg"))).select("g", "h", "p", "m", "w", *columns, *[((F.col(c) - F.col(f"lo_{c}")) / edge).alias(f"u_{c}") for c in columns])
    placed = materialize(placed.select("*", *[F.floor(f"u_{c}").alias(q) for c, q in zip(columns, cell, strict=True)]), "placed")
    cells = materialize(placed.groupBy("h", *cell).agg(F.min("p").alias("c"), F.sum("m").alias("t"), F.max("w").alias("w"), *_box(columns)), "cells")
    near = materialize(_near_cells(cells, columns), "near")
    inside = placed.join(cells.select("h", *cell, "c", "t"), ["h", *cell]).select("g", "p", "m", "c", "t", *columns, *[f"u_{c}" for c in columns])
    inside = materialize(inside, "inside")

    thin = _prefixed(inside.where(F.col("t") < min_samples), "a_", columns, [F.col("c").alias("a"), F.col("p").alias("ap")])
    others = _prefixed(inside, "b_", columns, [F.col("c").alias("b"), F.col("p").alias("bp"), "m"])
    met = thin.join(near, "a").join(others, "b").withColumn("d2", _square_distance("a_", "b_", columns))
    met = materialize(met.where(F.col("d2") <= F.col("w") * F.col("w")).select("a", "b", "ap", "bp", "m", "d2"), "met")
    dense = met.groupBy(F.col("ap").alias("p")).agg(F.sum("m").alias("n")).where(F.col("n") >= min_samples).select("p")
    core = materialize(inside.where(F.col("t") >= min_samples).unionByName(inside.join(dense, "p", "left_semi")).select("p", "c", *columns, *[f"u_{c}" for c in columns]), "core")

    # links with a thin cell are among the counted neighbours; two full cells are settled by boxes
    names = core.select("p")
    thin_links = met.where(F.col("a") != F.col("b")).join(names.withColumnRenamed("p", "ap"), "ap", "left_semi").join(names.withColumnRenamed("p", "bp"), "bp", "left_semi")
    thin_links = thin_links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    full = cells.where(F.col("t") >= min_samples).select("c")
    ends = near.where(F.col("a") < F.col("b")).join(full.withColumnRenamed("c", "a"), "a", "left_semi").join(full.withColumnRenamed("c", "b"), "b", "left_semi")
    labels = components(thin_links.unionByName(_linked_cells(ends, core.join(full, "c", "left_semi"), columns)))
    named = core.join(labels, core["c"] == labels["node"], "left").select("p", F.coalesce("label", "c").alias("label"))
    named = materialize(named, "named")
    names = named.groupBy("label").agg(F.min("p").alias("cluster"))
    of_core = materialize(named.join(names, "label").select("p", "cluster"), "of_core")
    nearest = met.join(of_core.withColumnRenamed("p", "bp"), "bp").groupBy(F.col("ap").alias("p")).agg(F.min(F.struct("d2", "bp", "cluster"))["cluster"].alias("cluster"))
    border = nearest.join(of_core, "p", "left_anti")
    found = inside.select("g", "p", *columns).join(of_core.unionByName(border), "p").drop("p")
    labelled = _of_points(base, found, columns).select(F.col("g").alias("_g"), F.col("id").alias("_id"), "cluster")
    out = rows.join(labelled, rows[group].eqNullSafe(labelled["_g"]) & (rows[key] == labelled["_id"]), "left")
    return out.select(rows[group], rows[key], "cluster")


def silhouette(rows: DataFrame, group: str, cluster: str, columns: Sequence[str]) -> DataFrame:
    """(group, n, silhouette): mean silhouette with squared distances. Mean distances to
    a cluster follow from its sums, so a row meets its group's list of clusters, not other
    rows. Rows without a cluster do not count; groups of one cluster have none; clusters
    of one row score 0."""
    x2 = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    base = rows.where(F.col(cluster).isNotNull()).select(F.col(group).alias("g"), F.col(cluster).alias("k"), *columns, x2.alias("x2"))
    facts = base.groupBy("g", "k").agg(F.count("*").alias("n"), F.avg("x2").alias("y2"), F.array(*[F.avg(c) for c in columns]).alias("m"))
    lists = facts.groupBy(F.col("g").alias("fg")).agg(F.collect_list(F.struct("k", "n", "y2", "m")).alias("clusters"))
    lists = small_side(materialize(lists, "clusters"))
    met = base.join(lists, base["g"].eqNullSafe(lists["fg"]))
    dot = lambda f: sum((F.col(c) * F.get(f["m"], F.lit(i)) for i, c in enumerate(columns)), F.lit(0.0))
    mean = lambda f: F.greatest(F.col("x2") - 2 * dot(f) + f["y2"], F.lit(0.0))
    own = F.get(F.filter("clusters", lambda f: f["k"] == F.col("k")), F.lit(0))
    other = F.array_min(F.transform(F.filter("clusters", lambda f: f["k"] != F.col("k")), mean))
    scored = met.withColumn("f", own).select("g", F.col("f.n").alias("n"), F.when(F.col("f.n") > 1, mean(F.col("f")) * F.col("f.n") / (F.col("f.n") - 1)).alias("a"), other.alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("n") == 1, 0.0).when(top > 0, (F.col("b") - F.col("a")) / F.when(top > 0, top)).otherwise(0.0)
    return scored.where(F.col("b").isNotNull()).groupBy("g").agg(F.count("*").alias("n"), F.avg(s).alias("silhouette")).withColumnRenamed("g", group)
