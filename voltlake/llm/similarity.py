"""Similarity clusters of records: parallel pivot correlation clustering and its links.

Records lie on a grid whose cells are no wider than the likeness limits, so all records
of a cell are alike: cells are the nodes. Boxes settle which cells are linked for sure,
which never, and which are in doubt. Pivots are the nodes whose hash is the least among
their open neighbours; they absorb those neighbours, round by round. Members then move to
the closest pivot that they are linked to, and medoids are taken anew.

For the connected groups the pivots absorb along the sure links alone; what they leave
apart is joined, and only doubtful pairs between groups still apart are looked into.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.graph import components
from voltlake.runtime import materialize, row_count_up_to, small_side


@dataclass(frozen=True)
class Likeness:
    """Records of one group are alike if each of ``ratios`` differs by a factor of at
    most ``factor`` and ``circular`` by at most ``degrees`` around the circle."""

    group: str
    key: str
    circular: str
    ratios: tuple[str, ...]
    factor: float = 1.4
    degrees: float = 25.0

    def inner(self) -> Likeness:
        """The same limits with names that no input column has."""
        ratios = tuple(f"_x{i}" for i in range(1, len(self.ratios) + 1))
        return Likeness("_group", "_key", "_x0", ratios, self.factor, self.degrees)

    @property
    def sectors(self) -> int:
        return math.ceil(360 / self.degrees)

    @property
    def reach(self) -> int:
        """How many sectors apart alike records can lie."""
        return math.ceil(self.degrees / (360 / self.sectors))


def usable(like: Likeness) -> Column:
    """All fields are finite numbers and the ratio fields positive; other records are
    alike to none."""
    ok = F.lit(True)
    for c in (like.circular, *like.ratios):
        v = F.col(c)
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    for c in like.ratios:
        ok = ok & (F.col(c) > 0)
    return ok


def gridded(records: DataFrame, like: Likeness) -> DataFrame:
    """Adds ``c0`` (sector) and ``c1``.. (steps of the factor)."""
    angle = F.pmod(F.col(like.circular), F.lit(360.0))
    out = records.withColumn("c0", F.floor(angle / (360.0 / like.sectors)).cast("int"))
    for i, c in enumerate(like.ratios, 1):
        out = out.withColumn(f"c{i}", F.floor(F.ln(c) / math.log(like.factor)).cast("int"))
    return out


def _axes(like: Likeness) -> list[str]:
    return [f"c{i}" for i in range(len(like.ratios) + 1)]


def _boxes(like: Likeness) -> list[Column]:
    angle = F.pmod(F.col(like.circular), F.lit(360.0))
    ends = [F.min(angle).alias("lo0"), F.max(angle).alias("hi0")]
    for i, c in enumerate(like.ratios, 1):
        ends += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    return ends


def _turn(x: Column, y: Column) -> Column:
    """Distance around the circle."""
    d = F.pmod(x - y, F.lit(360.0))
    return F.least(d, 360.0 - d)


def _box_test(like: Likeness, a: str, b: str) -> tuple[Column, Column]:
    """(all records of the two boxes are alike, none can be). Sectors are narrow, so a
    box spans the arc between its ends."""
    lo0a, hi0a, lo0b, hi0b = (F.col(f"{s}.{e}0") for s in (a, b) for e in ("lo", "hi"))
    far = F.greatest(_turn(hi0a, lo0b), _turn(hi0b, lo0a), _turn(lo0a, lo0b), _turn(hi0a, hi0b))
    overlap = ((lo0a <= hi0b) & (lo0b <= hi0a)).cast("boolean")
    near = F.when(overlap, 0.0).otherwise(F.least(_turn(hi0a, lo0b), _turn(hi0b, lo0a)))
    sure, never = far <= like.degrees, near > like.degrees
    for i in range(1, len(like.ratios) + 1):
        la, ha, lb, hb = (F.col(f"{s}.{e}{i}") for s in (a, b) for e in ("lo", "hi"))
        sure = sure & (ha / lb <= like.factor) & (hb / la <= like.factor)
        never = never | (lb / ha > like.factor) | (la / hb > like.factor)
    return sure, never


def cells_of(points: DataFrame, like: Likeness) -> DataFrame:
    """One row per occupied cell: ``cell``, ``n``, ``first`` (least key), its box, its
    least record ``hash`` and that record's place ``p0``.. (its pivot record)."""
    axes = _axes(like)
    mark = F.min(F.struct(F.xxhash64(like.key).alias("h"), *[F.col(c).alias(f"p{i}") for i, c in enumerate((like.circular, *like.ratios))]))
    cells = points.groupBy("cell", like.group, *axes).agg(F.count("*").alias("n"), F.min(like.key).alias("first"), mark.alias("_m"), *_boxes(like))
    return cells.select("*", F.col("_m.h").alias("hash"), *[F.col(f"_m.p{i}").alias(f"p{i}") for i in range(len(axes))]).drop("_m")


def neighbour_cells(cells: DataFrame, like: Likeness) -> DataFrame:
    """(u, v): ids of occupied cells that could hold alike records, each pair once. A
    cell's id is the hash of its place, so only ids are moved."""
    offsets = [()]
    for reach in (like.reach, *(1 for _ in like.ratios)):
        offsets = [(*o, d) for o in offsets for d in range(-reach, reach + 1)]
    half = [o for o in offsets if o > tuple(0 for _ in o)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in half]))
    axes = _axes(like)
    there = [F.pmod(F.col("c0") + F.col("o.d0"), F.lit(like.sectors)).cast("int")]
    there += [(F.col(c) + F.col(f"o.d{i}")).cast("int") for i, c in enumerate(axes[1:], 1)]
    moved = cells.select("cell", like.group, *axes, steps.alias("o")).select(F.col("cell").alias("u"), F.xxhash64(like.group, *there).alias("v"))
    # the offsets multiply the rows, which Spark's size estimates do not know
    met = moved.join(cells.select(F.col("cell").alias("v")).hint("merge"), "v", "left_semi").where(F.col("u") != F.col("v"))
    if 2 * like.reach + 1 > like.sectors:  # so few sectors that both ways round meet
        met = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return met.select("u", "v")


def judged_pairs(cells: DataFrame, like: Likeness) -> DataFrame:
    """(u, v, sure, a, b): neighbouring cells with their boxes; pairs that cannot hold
    alike records are left out."""
    ends = [f"{e}{i}" for i in range(len(like.ratios) + 1) for e in ("lo", "hi")]
    boxes = lambda me, name: cells.select(F.col("cell").alias(me), F.struct(*ends).alias(name)).hint("merge")
    pairs = neighbour_cells(cells, like).join(boxes("u", "a"), "u").join(boxes("v", "b"), "v")
    sure, never = _box_test(like, "a", "b")
    return pairs.where(~never).select("u", "v", sure.alias("sure"), "a", "b")


def settle(points: DataFrame, doubt: DataFrame, like: Likeness, parts: int = 3) -> DataFrame:
    """(u, v) of the doubtful pairs (u, v, a, b) that hold at least one alike pair of records.

    The records of each side that lie near the other's box are put in boxes, which settle
    most pairs. Boxes in doubt are cut in ``parts`` along every axis, round by round, and
    only cuts of boxes that are still in doubt meet again. A box of equal records is a
    point, which its test judges exactly, so every pair is settled in the end.
    """
    values = [like.circular, *like.ratios]
    ends = [f"{e}{i}" for i in range(len(values)) for e in ("lo", "hi")]
    sides = []
    for me, other in (("u", "b"), ("v", "a")):
        want = doubt.select(F.col(me).alias("cell"), "u", "v", *[F.col(f"{other}.{e}").alias(e) for e in ends])
        near = points.select("cell", *values).join(small_side(want), "cell")
        close = F.lit(True)
        for i, c in enumerate(like.ratios, 1):
            close = close & (F.col(c) / F.col(f"hi{i}") <= like.factor) & (F.col(f"lo{i}") / F.col(c) <= like.factor)
        angle = F.pmod(F.col(like.circular), F.lit(360.0))
        inside = (angle >= F.col("lo0")) & (angle <= F.col("hi0"))
        close = close & (inside | (F.least(_turn(angle, F.col("lo0")), _turn(angle, F.col("hi0"))) <= like.degrees))
        places = [angle.alias(like.circular), *like.ratios]
        sides.append(materialize(near.where(close).select("u", "v", F.lit(0).cast("long").alias("part"), *places), "near"))
    open_ = doubt.select("u", "v", F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"))
    found = None
    up = [F.lit(0).cast("long")] * 2
    while True:
        boxes = []
        for side, parent, name in zip(sides, up, "ab", strict=True):
            box = side.groupBy("u", "v", parent.alias(f"p{name}"), "part").agg(*_boxes(like))
            boxes.append(box.select("u", "v", f"p{name}", F.struct("part", *ends).alias(name)).hint("merge"))
        sure, never = _box_test(like, "a", "b")
        judged = open_.join(boxes[0], ["u", "v", "pa"]).join(boxes[1], ["u", "v", "pb"]).where(~never)
        judged = materialize(judged.select("u", "v", "a", "b", sure.alias("sure")), "judged")
        alike = judged.where("sure").select("u", "v").distinct()
        found = materialize(alike if found is None else found.unionByName(alike), "alike")
        rest = materialize(judged.where(~F.col("sure")).join(small_side(alike), ["u", "v"], "left_anti"), "open")
        if not row_count_up_to(rest, 0):
            return found
        open_ = rest.select("u", "v", F.col("a.part").alias("pa"), F.col("b.part").alias("pb"))
        cut = []
        for side, name in zip(sides, "ab", strict=True):
            box = rest.select("u", "v", F.col(f"{name}.part").alias("part"), *[F.col(f"{name}.{e}").alias(e) for e in ends]).distinct()
            steps = []
            for i, c in enumerate(values):
                width = F.col(f"hi{i}") - F.col(f"lo{i}")
                steps.append(F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"lo{i}")) / width * parts), F.lit(parts - 1))).otherwise(0).cast("int"))
            inner = side.join(small_side(box), ["u", "v", "part"])
            cut.append(materialize(inner.select("u", "v", F.col("part").alias("parent"), F.xxhash64("part", *steps).alias("part"), *values), "cut"))
        sides, up = cut, [F.col("parent")] * 2


def pivot_clusters(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, pivot): each cell's pivot, itself for pivots and cells without links.

    In every round the open cells whose hash is the least among their open neighbours
    become pivots and absorb these neighbours; of several pivots the least hash wins.
    """
    nodes = cells.select("cell", "hash")
    edges = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y"))).distinct()
    order = nodes.select(F.col("cell").alias("y"), F.struct("hash", "cell").alias("p"))
    edges = materialize(edges.join(order, "y").join(nodes.select(F.col("cell").alias("x"), F.struct("hash", "cell").alias("q")), "x"), "ordered")
    done = nodes.join(edges.select(F.col("x").alias("cell")).distinct(), "cell", "left_anti").select("cell", F.col("cell").alias("pivot"))
    parts = [materialize(done, "alone")]
    while row_count_up_to(edges, 0):
        pivots = edges.groupBy("x").agg(F.min("p").alias("least"), F.min("q").alias("own")).where(F.col("own") < F.col("least")).select(F.col("x").alias("pivot"), F.col("own"))
        pivots = materialize(pivots, "pivots")
        side = small_side(pivots.select(F.col("pivot").alias("y"), "own"))
        taken = edges.join(side, "y").groupBy("x").agg(F.min("own").alias("w")).select(F.col("x").alias("cell"), F.col("w.cell").alias("pivot"))
        fresh = materialize(taken.unionByName(pivots.select(F.col("pivot").alias("cell"), "pivot")), "fresh")
        gone = small_side(fresh.select(F.col("cell").alias("x")))
        still = materialize(edges.join(gone, "x", "left_anti").join(gone.withColumnRenamed("x", "y"), "y", "left_anti"), "ordered")
        # open cells whose neighbours are all taken stand alone
        lone = edges.select("x").distinct().join(gone, "x", "left_anti").join(still.select("x").distinct(), "x", "left_anti")
        parts += [fresh, lone.select(F.col("x").alias("cell"), F.col("x").alias("pivot"))]
        edges = still
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return materialize(whole, "clusters")


@dataclass(frozen=True)
class Grid:
    """points: the usable records with ``cell``; cells: one row per cell; sure: links
    (u, v) that boxes settle; doubt: pairs (u, v, a, b) that they leave open. Their
    columns bear the inner names of ``like``."""

    like: Likeness
    points: DataFrame
    cells: DataFrame
    sure: DataFrame
    doubt: DataFrame


def on_grid(records: DataFrame, like: Likeness) -> Grid:
    """Puts the records on the grid, within each ``like.group``. Unusable records (nulls,
    NaN, infinite or non-positive) are left out, as are further columns, whatever their
    names. Keys must be unique."""
    outer, like = like, like.inner()
    names = [(like.group, outer.group), (like.key, outer.key), (like.circular, outer.circular), *zip(like.ratios, outer.ratios, strict=True)]
    kept = records.where(usable(outer)).select(*[F.col(c).alias(n) for n, c in names])
    points = materialize(gridded(kept, like).withColumn("cell", F.xxhash64(like.group, *_axes(like))), "points")
    cells = materialize(cells_of(points, like), "cells")
    judged = materialize(judged_pairs(cells, like), "cellpairs")
    return Grid(outer, points, cells, judged.where("sure").select("u", "v"), judged.where(~F.col("sure")).drop("sure"))


def all_links(grid: Grid) -> DataFrame:
    """(u, v): all pairs of cells with at least one alike pair of records, each once."""
    return materialize(grid.sure.unionByName(settle(grid.points, grid.doubt, grid.like.inner())), "links")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (cell, part) with the parts that ``links`` (u, v) connect made one."""
    ends = links.join(label.select(F.col("cell").alias("u"), F.col("part").alias("x")), "u").join(label.select(F.col("cell").alias("v"), F.col("part").alias("y")), "v")
    across = ends.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    joined = components(across)
    return materialize(label.join(small_side(joined), label["part"] == joined["node"], "left").select("cell", F.coalesce("label", "part").alias("part")), "parts")


def connected_groups(grid: Grid, least: int = 10) -> DataFrame:
    """(cluster_first, key): records of groups of ``least`` or more that hang together
    through alike records, with the group's smallest key.

    Pivots absorb along sure links; the clusters that further sure links join are one
    part. Doubtful pairs are settled only where they lie between two parts: within one
    they could add nothing. No link between parts is lost.
    """
    label = pivot_clusters(grid.cells, grid.sure).withColumnRenamed("pivot", "part")
    label = _joined(label, grid.sure)
    u, v = (label.select(F.col("cell").alias(c), F.col("part").alias(f"p{c}")) for c in "uv")
    open_ = materialize(grid.doubt.join(small_side(u), "u").join(small_side(v), "v").where(F.col("pu") != F.col("pv")).select("u", "v", "a", "b"), "between")
    if row_count_up_to(open_, 0):
        label = _joined(label, settle(grid.points, open_, grid.like.inner()))
    sizes = grid.cells.join(label, "cell").groupBy("part").agg(F.sum("n").alias("n"), F.min("first").alias("cluster_first")).where(F.col("n") >= least)
    kept = materialize(label.join(sizes, "part").select("cell", "cluster_first"), "kept")
    return grid.points.join(small_side(kept), "cell").select("cluster_first", F.col("_key").alias(grid.like.key))


def _distance(like: Likeness, other: list[Column]) -> Column:
    """Distance of a record to a place, in units of the likeness limits."""
    total = F.pow(_turn(F.pmod(F.col(like.circular), F.lit(360.0)), other[0]) / like.degrees, F.lit(2.0))
    for c, x in zip(like.ratios, other[1:], strict=True):
        total = total + F.pow((F.ln(c) - F.ln(x)) / math.log(like.factor), F.lit(2.0))
    return F.sqrt(total)


def pivot_members(grid: Grid, links: DataFrame) -> DataFrame:
    """The records with ``pivot``: the pivots absorb their linked cells, then each record
    moves to the closest pivot record among the pivots that its cell is linked to."""
    like = grid.like.inner()
    pivots = materialize(pivot_clusters(grid.cells, links).select("pivot").distinct(), "pivots")
    places = [f"p{i}" for i in range(len(like.ratios) + 1)]
    marks = materialize(grid.cells.select(F.col("cell").alias("pivot"), *places).join(small_side(pivots), "pivot", "left_semi"), "marks")
    both = links.select(F.col("u").alias("cell"), F.col("v").alias("pivot")).unionByName(links.select(F.col("v").alias("cell"), F.col("u").alias("pivot")))
    near = both.unionByName(pivots.select(F.col("pivot").alias("cell"), "pivot")).join(small_side(marks), "pivot")
    options = near.groupBy("cell").agg(F.collect_list(F.struct("pivot", *places)).alias("options"))  # at most the neighbouring cells
    met = grid.points.join(small_side(materialize(options, "options")), "cell")
    scored = F.array_min(F.transform("options", lambda o: F.struct(F.round(_distance(like, [F.pmod(o["p0"], F.lit(360.0)), *[o[p] for p in places[1:]]]), 9).alias("d"), o["pivot"].alias("pivot"))))
    return met.select(like.group, like.key, like.circular, *like.ratios, "cell", scored["pivot"].alias("pivot"))


def described(grid: Grid, members: DataFrame, typical: int = 3) -> DataFrame:
    """One row per cluster: group, pivot, size, the centroid, and the ``typical`` records
    closest to it (the first is the medoid)."""
    outer, like = grid.like, grid.like.inner()
    turn = F.radians(like.circular)
    middle = [F.pmod(F.degrees(F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn)))), F.lit(360.0)).alias("m0")]
    middle += [F.exp(F.avg(F.ln(c))).alias(f"m{i}") for i, c in enumerate(like.ratios, 1)]
    facts = materialize(members.groupBy("pivot").agg(F.min(like.group).alias(like.group), F.count("*").alias("size"), *middle), "facts")
    places = [f"m{i}" for i in range(len(like.ratios) + 1)]
    placed = members.join(small_side(facts.select("pivot", *places)), "pivot")
    near = placed.select("pivot", like.key, F.round(_distance(like, [F.col(m) for m in places]), 9).alias("d"))
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy("d", like.key))
    top = near.withColumn("r", rank).where(F.col("r") <= typical).groupBy("pivot").agg(F.array_sort(F.collect_list(F.struct("r", like.key))).alias("t"))
    return facts.join(top, "pivot").select(
        F.col(like.group).alias(outer.group), "pivot", "size", F.col("m0").alias(outer.circular), *[F.col(f"m{i}").alias(c) for i, c in enumerate(outer.ratios, 1)],
        F.transform("t", lambda s: s[like.key]).alias("typical"),
    )
