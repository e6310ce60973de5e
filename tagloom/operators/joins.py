"""Joins by nearness: bands, nearest rows, boxes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.geometry import box, iou


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sends neither side through the driver: the size of a written table tells nothing of the rows that it is read or exploded into."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, tolerance: int, strict: bool, also: tuple[tuple[str, int, bool], ...] = (), prefix: str = "r_") -> DataFrame:
    """Pairs with equal keys whose ``on`` differs by less than ``tolerance`` (or no more, if not strict); the right side's columns get a prefix.

    Both sides are cut into bands as wide as the tolerance, and the left row goes to its own band and
    the two beside it, so that the join is an equi-join with the exact test as residual and each pair
    comes once. also: further columns with their tolerances.
    """
    other = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    bands = left.withColumn("__band", F.explode(F.sequence(F.floor(F.col(on) / tolerance) - 1, F.floor(F.col(on) / tolerance) + 1)))
    other = other.withColumn("__other", F.floor(F.col(prefix + on) / tolerance))
    condition = F.col("__band") == F.col("__other")
    for k in keys:
        condition = condition & (bands[k] == other[prefix + k])
    for name, width, sharp in ((on, tolerance, strict), *also):
        gap = F.abs(bands[name] - other[prefix + name])
        condition = condition & ((gap < width) if sharp else (gap <= width))
    return meet(bands, other, condition).drop("__band", "__other")


def first_match(pairs: DataFrame, left_key: str, *order: Column) -> DataFrame:
    """One pair of each left row: the least by ``order``."""
    return pairs.withColumn("__n", F.row_number().over(Window.partitionBy(left_key).orderBy(*order))).where("__n = 1").drop("__n")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], on: str, tolerance: int, distance: Column, prefix: str = "r_") -> DataFrame:
    """For each left row the nearest right row within the tolerance, of equally near ones the first."""
    return first_match(band_join(left, right, keys, on, tolerance, strict=False, prefix=prefix), "pos", distance, F.col(prefix + "pos"))


NEAR = (50, 200, 800)  # the widths by which the nearest point is looked for


def nearest_point(left: DataFrame, right: DataFrame, keys: list[str], on: str, tolerance: int, other: list[str]) -> DataFrame:
    """pos, r_pos, distance: for each left row the right row of the least sum of gaps in ``on`` and ``other``, of equals the first, with a gap in ``on`` within the tolerance.

    Distinct points meet, in cells of a width that grows: what is found within the width is the nearest, as all that is
    nearer lies in the same cell or beside it, and only points with nothing so near are met by wider cells.
    Those that are left meet by bands of ``on``.
    """
    at = [on, *other]
    theirs = saved(right.groupBy(*keys, *at).agg(F.min("pos").alias("pos")))
    rest = saved(left.select(*keys, *at).distinct())
    first = lambda near: near.groupBy(*keys, *at).agg(F.min(F.struct("distance", "r_pos")).alias("m"))
    gap = sum((F.abs(F.col(c) - F.col("r_" + c)) for c in at), F.lit(0))
    found = None
    rows = theirs.count()
    for width in [w for w in NEAR if w <= tolerance]:
        place = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        beside = lambda c: F.explode(F.sequence(place(c) - 1, place(c) + 1))  # noqa: B023, E731
        few = rest.count() <= rows  # the smaller side goes to the cells beside its own
        cells = lambda df, wide: df.withColumns({"__a": (beside if wide else place)(on)}).withColumns({"__b": (beside if wide else place)(other[0])})  # noqa: B023, E731
        mine = cells(rest, few)
        held = cells(theirs, not few).select(*keys, *[F.col(c).alias("r_" + c) for c in at], F.col("pos").alias("r_pos"), "__a", "__b")
        near = meet(mine, held, [*keys, "__a", "__b"]).withColumn("distance", gap).where(F.col("distance") <= width)
        best = saved(first(near))
        found = best if found is None else found.unionByName(best)
        fewer = saved(meet(rest, best.select(*keys, *at), [*keys, *at], "left_anti").select(*rest.columns))
        dropped(rest)
        rest = fewer
    last = first(band_join(rest, theirs, keys, on, tolerance, strict=False).withColumn("distance", gap))
    found = last if found is None else found.unionByName(last)
    told = meet(left, found, [*keys, *at]).groupBy("pos").agg(F.min("m").alias("m"))  # a pos may stand in several rows
    return told.select("pos", "m.r_pos", "m.distance")


def nearest_group(asked: DataFrame, rows: DataFrame, keys: list[str], on: str, tolerance: int) -> DataFrame:
    """pos, anchor, n: how many rows lie within the tolerance of each asked value; where none do, of the value nearest to it, the lesser of two.

    The values nearest on either side are found among the distinct ones: in their own band, else at the end of the
    nearest band that has any, so that only the table of bands is ordered by whole keys.
    """
    values = saved(rows.groupBy(*keys, on).agg(F.count("*").alias("__rows")))
    within = lambda left: band_join(left, values, keys, on, tolerance, strict=False).groupBy("pos", F.col(on).alias("anchor")).agg(F.sum("r___rows").alias("n"))
    own = saved(within(asked.select("pos", *keys, on)))
    band = F.floor(F.col(on) / tolerance).alias("__band")
    lacking = asked.select("pos", *keys, on, band).join(own.select("pos"), "pos", "left_anti")
    bands = values.groupBy(*keys, band).agg(F.min(on).alias("__low"), F.max(on).alias("__high"))
    # a value of the same band would be within the tolerance, so that the nearest are at the ends of other bands
    every = lacking.select(*keys, "__band", F.lit(None).alias("__low"), F.lit(None).alias("__high")).distinct().unionByName(bands)
    ends = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    told = every.withColumns({"__below": ends("__high", F.asc("__band")), "__above": ends("__low", F.desc("__band"))}).where("__low is null").select(*keys, "__band", "__below", "__above")
    met = lacking.join(told, [*keys, "__band"])
    gap = lambda c: F.abs(F.col(c) - F.col(on))
    anchor = F.when(F.col("__above").isNull() | (gap("__below") <= gap("__above")), F.col("__below")).otherwise(F.col("__above"))
    found = met.select("pos", *keys, anchor.alias(on)).where(F.col(on).isNotNull())
    return own.unionByName(within(found))


def _ranked(rows: DataFrame, keys: list[str], on: str, band: Column) -> DataFrame:
    """``rows`` with their band and their number by ``on`` and pos within the keys, counted by bands."""
    cut = rows.withColumn("__band", band)
    sizes = cut.groupBy(*keys, "__band").agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "__band", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__band").orderBy(on, "pos"))
    return cut.withColumn("__place", place).join(before, [*keys, "__band"]).withColumn("__rank", F.col("__before") + F.col("__place"))


def context(rows: DataFrame, keys: list[str], on: str, tolerance: int, label: str, first: int) -> DataFrame:
    """pos, near, names: how many other rows with a label lie within the tolerance of each row, and the labels of the ``first`` of them by ``on`` and pos.

    Labelled rows are numbered within their keys; a row's neighbours are the numbers from the first to the last within its
    tolerance, which are counted by bands as wide as that, so that their number follows by subtraction and only
    those that are shown are joined. Rows with none are left out.
    """
    width = F.lit(tolerance)
    band = lambda value: F.floor(value / width)
    named = _ranked(rows.where(F.col(label) != "").select(*keys, "pos", on, label), keys, on, band(F.col(on)))
    named = saved(named.select(*keys, "__band", "__rank", "pos", on, label))
    # how many labelled rows lie before a value, or up to it: those of the bands before, and those of its own band
    ends = rows.select(*keys, F.explode(F.array(F.struct((F.col(on) - tolerance).alias("v"), F.lit(0).alias("side")), F.struct((F.col(on) + tolerance).alias("v"), F.lit(2).alias("side")))).alias("e"))
    ends = ends.select(*keys, "e.v", "e.side").distinct().withColumn("__band", band(F.col("v")))
    both = ends.select(*keys, "__band", "v", "side", F.lit(0).alias("one")).unionByName(named.select(*keys, "__band", F.col(on).alias("v"), F.lit(1).alias("side"), F.lit(1).alias("one")))
    upto = F.sum("one").over(Window.partitionBy(*keys, "__band").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0))
    own = both.withColumn("__upto", upto).where("side <> 1").select(*keys, "__band", "v", "side", "__upto")
    # bands without labelled rows have some before them as well
    sizes = named.groupBy(*keys, "__band").agg(F.count("*").alias("__size"))
    table = own.select(*keys, "__band").unionByName(sizes.select(*keys, "__band")).distinct().join(sizes, [*keys, "__band"], "left")
    earlier = Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(*keys, "__band", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    counts = own.join(table, [*keys, "__band"]).select(*keys, "v", "side", (F.col("__before") + F.col("__upto")).alias("__n"))
    low = counts.where("side = 0").select(*keys, (F.col("v") + tolerance).alias(on), F.col("__n").alias("__low"))
    high = counts.where("side = 2").select(*keys, (F.col("v") - tolerance).alias(on), F.col("__n").alias("__high"))
    self_counts = F.when(F.col(label) != "", 1).otherwise(0)
    met = rows.select(*keys, "pos", on, label).join(low.join(high, [*keys, on]), [*keys, on]).withColumn("near", (F.col("__high") - F.col("__low") - self_counts).cast("long")).where("near > 0")
    shown = met.select(*keys, "pos", "near", F.explode(F.sequence(F.col("__low") + 1, F.least(F.col("__high"), F.col("__low") + first + 1))).alias("__rank"))
    other = named.select(*keys, "__rank", F.col("pos").alias("__pos"), F.col(label).alias("__label"))
    beside = shown.join(other, [*keys, "__rank"]).where("pos <> __pos")
    told = beside.groupBy("pos").agg(F.max("near").alias("near"), F.array_sort(F.collect_list(F.struct("__rank", "__label"))).alias("l"))
    return told.select("pos", "near", F.array_join(F.transform(F.slice("l", 1, first), lambda x: x["__label"]), "|").alias("names"))


def by_keys_in_turn(left: DataFrame, right: DataFrame, keys: list[list[str]], value: str) -> DataFrame:
    """``left`` with ``value`` of the right rows that agree in the first list of keys; where none do, in the second, and so on. Of several, the least."""
    out = left
    for k, on in enumerate(keys):
        out = out.join(right.groupBy(*on).agg(F.min(value).alias(f"__v{k}")), on, "left")
    tries = [f"__v{k}" for k in range(len(keys))]
    return out.withColumn(value, F.coalesce(*tries)).drop(*tries)


CELL = 256  # pixels


def on_grid(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """Every box in each of the cells (__cx, __cy) that it touches."""
    places = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.greatest(F.col(high), F.col(low) + 1) - 1) / cell)))
    return boxes.withColumn("__cx", places("x_min", "x_max")).withColumn("__cy", places("y_min", "y_max"))


def sharing_cells(left: DataFrame, right: DataFrame, keys: list[str], near: Column, prefix: str = "r_") -> DataFrame:
    """The left rows, once for each cell, that share one with a right row for which ``near`` holds; the first of these is enough."""
    two = on_grid(right).select(*[F.col(c).alias(prefix + c) for c in right.columns], F.col("__cx").alias("__rx"), F.col("__cy").alias("__ry"))
    met = (F.col("__cx") == F.col("__rx")) & (F.col("__cy") == F.col("__ry")) & near
    for k in keys:
        met = met & (F.col(k) == F.col(prefix + k))
    return meet(on_grid(left), two, met, "left_semi").drop("__cx", "__cy")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "r_", cell: int = CELL) -> DataFrame:
    """Pairs with equal keys whose boxes share some area; the right side's columns get a prefix.

    Every box goes to the cells of a grid that it touches, and the boxes meet by cell. A pair is told in the cell
    that holds the upper left corner of what both share, and so once.
    """
    one = on_grid(left, cell)
    two = on_grid(right, cell).select(*[F.col(c).alias(prefix + c) for c in right.columns], F.col("__cx").alias("__rx"), F.col("__cy").alias("__ry"))
    met = (one["__cx"] == two["__rx"]) & (one["__cy"] == two["__ry"])
    for k in keys:
        met = met & (one[k] == two[prefix + k])
    corner = [F.greatest(one[c], two[prefix + c]) for c in ("x_min", "y_min")]
    share = (corner[0] < F.least(one["x_max"], two[prefix + "x_max"])) & (corner[1] < F.least(one["y_max"], two[prefix + "y_max"]))
    here = (F.floor(corner[0] / cell) == one["__cx"]) & (F.floor(corner[1] / cell) == one["__cy"])
    return meet(one, two, met & share & here).drop("__cx", "__cy", "__rx", "__ry")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """pos, r_pos, iou: for each left row the right row whose box it overlaps most, by ``least`` or more, of equals the first. Equal boxes are compared once."""
    sides = ["x_min", "y_min", "x_max", "y_max"]
    mine = left.select(*keys, *sides).distinct()
    theirs = right.groupBy(*keys, *sides).agg(F.min("pos").alias("pos"))
    met = overlapping(mine, theirs, keys).withColumn("iou", iou(box(), box("r_"))).where(F.col("iou") >= least)
    best = met.groupBy(*keys, *sides).agg(F.min(F.struct((-F.col("iou")).alias("apart"), "r_pos")).alias("m"))
    told = meet(left.select("pos", *keys, *sides), best, [*keys, *sides]).groupBy("pos").agg(F.min("m").alias("m"))  # a pos may stand in several rows
    return told.select("pos", "m.r_pos", (-F.col("m.apart")).alias("iou"))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share. Only a local session that names none gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="tagloom-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to the shared folder: a loop's plan stays short, and lost executors lose nothing.

    :func:`dropped` deletes it when its last reader is done; :func:`clear` deletes what a session has left.
    """
    spark = df.sparkSession
    path = work_path(spark, "rows")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


_left: dict[str, set[str]] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`delete` or :func:`clear` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.get(spark.sparkContext.applicationId, set()).discard(path)


def dropped(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read any more."""
    for t in tables:
        delete(t.sparkSession, t.saved_path)


def clear(spark: SparkSession) -> int:
    """Delete every saved table that this session has left, and tell how many; results that still read them are void."""
    paths = list(_left.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        delete(spark, path)
    return len(paths)


def one_to_one(edges: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """keys, left, right: the matching that takes edges in rising ``order`` (then left, then right), each if both its ends are free.

    Rounds of locally first edges: an edge that comes first at both of its ends is taken whatever the others do, and
    all edges at taken ends go. What a round takes is what the choice one by one would take, so no task needs
    the edges of a key together; firsts at an end are found by aggregates.
    """
    rest = saved(edges.select(*keys, left, right, F.struct(*dict.fromkeys([*order, left, right])).alias("o")))
    taken = []
    while not rest.isEmpty():
        first = lambda side: rest.groupBy(*keys, side).agg(F.min("o").alias("o")).select(*keys, f"o.{left}", f"o.{right}")  # noqa: E731, B023
        won = saved(first(left).join(first(right), [*keys, left, right]))
        taken.append(won)
        fewer = rest.join(won.select(*keys, left), [*keys, left], "left_anti").join(won.select(*keys, right), [*keys, right], "left_anti")
        fewer = saved(fewer.select(*rest.columns))
        dropped(rest)
        rest = fewer
    out = rest.select(*keys, left, right)
    for won in taken:
        out = out.unionByName(won)
    return out


def in_turn(edges: DataFrame, groups: DataFrame, keys: list[str], left: str, turn: list[str], wish: str, right: str) -> DataFrame:
    """keys, left, ``right``: the left ends choose in ``turn``, each of the group of least ``wish`` that has members free the least free member, of groups with equal wishes that of the lesser member.

    edges: keys, left, g, the columns of turn and wish, once for each left end and group. groups: keys, g and ``held``, their members in
    order; no member in two. A group's members go in order, so that edges to groups are enough, however many members alike
    these have. Each round settles, of those that ask a group, the first in turn up to one that might yet go elsewhere or
    come from there (of equal wishes, the first alone): what comes before them is sure, so it is the choice one by one.
    """
    rest, state = saved(edges.select(*dict.fromkeys([*keys, left, "g", *turn, wish]))), saved(groups.select(*keys, "g", "held", F.lit(0).alias("used")))
    taken = []
    while not rest.isEmpty():
        free = state.select(*keys, "g", (F.size("held") - F.col("used")).alias("free"), F.col("held")[F.col("used")].alias("head"))
        queue, own = Window.partitionBy(*keys, "g").orderBy(*dict.fromkeys([*turn, left])), Window.partitionBy(*keys, left)
        asked = meet(rest, free, [*keys, "g"]).withColumn("k", F.row_number().over(queue) - 1)
        behind = F.lead(wish).over(own.orderBy(wish, "head"))
        asked = asked.withColumns({"first": F.row_number().over(own.orderBy(wish, "head")) == 1, "alone": behind.isNull() | (behind != F.col(wish))})
        # who is served by another group even if all that come before ask that one is in nobody's way here
        asked = asked.withColumn("served", F.max((F.col("first") & F.col("alone") & (F.col("k") < F.col("free"))).cast("int")).over(own) == 1)
        placed = asked.withColumn("seat", F.coalesce(F.sum(F.col("first").cast("int")).over(queue.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
        clear = F.when(F.col("first"), F.col("alone") | (F.col("seat") == 0)).otherwise(F.col("served"))
        placed = placed.withColumn("sure", F.min(clear.cast("int")).over(queue.rowsBetween(Window.unboundedPreceding, 0)))
        served = placed.where(F.col("first") & (F.col("sure") == 1) & (F.col("seat") < F.col("free"))).select(*keys, left, "g", F.col("seat").alias("k"))
        won = saved(meet(served, state, [*keys, "g"]).select(*keys, left, "g", F.col("held")[F.col("used") + F.col("k")].alias(right)))
        taken.append(won)
        after = meet(state, won.groupBy(*keys, "g").agg(F.count("*").cast("int").alias("more")), [*keys, "g"], "left")
        after = saved(after.select(*keys, "g", "held", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used")).where(F.col("used") < F.size("held")))
        fewer = meet(meet(rest, won.select(*keys, left), [*keys, left], "left_anti"), after.select(*keys, "g"), [*keys, "g"], "left_semi")
        fewer = saved(fewer.select(*rest.columns))
        dropped(rest, state)
        rest, state = fewer, after
    out = rest.join(state.select(*keys, "g", F.col("held")[0].alias(right)), [*keys, "g"]).select(*keys, left, right)
    for won in taken:
        out = out.unionByName(won.select(*keys, left, right))
    return out


def reached(links: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the nodes on the chains that begin at ``starts`` (keys, n; one for each key) and follow ``links`` (keys, n, to).

    By pointer doubling: after k rounds the first 2**k nodes of every chain are known, and links lead 2**k nodes on.
    """
    seen, jump = saved(starts.select(*keys, "n")), saved(links.select(*keys, "n", "to").where("to is not null"))
    while True:
        more = saved(seen.join(jump, [*keys, "n"]).select(*keys, F.col("to").alias("n")))
        if more.isEmpty():
            dropped(more, jump)
            return seen
        onward = jump.select(*keys, F.col("n").alias("to"), F.col("to").alias("then"))
        further = saved(jump.join(onward, [*keys, "to"]).select(*keys, "n", F.col("then").alias("to")))
        both = saved(seen.unionByName(more))
        dropped(seen, more, jump)
        seen, jump = both, further


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, name: str, width: int) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row: within stretches of ``width`` of the order, and over the stretches before."""
    cut = rows.withColumn("__part", F.floor(F.col(order) / width))
    parts = cut.groupBy(*keys, "__part").agg(F.sum(value).alias("__all"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__all").over(before), F.lit(0))).drop("__all")
    inside = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("__sum", F.sum(value).over(inside)).join(parts, [*keys, "__part"]).withColumn(name, F.col("__sum") + F.col("__before")).drop("__part", "__sum", "__before")


def first_at_least(points: DataFrame, keys: list[str], n: str, value: str, step: float, name: str, width: int) -> DataFrame:
    """keys, n, name: for each point the least n whose value is that of the point plus ``step`` or more, null if there is none.

    Values must not fall with n. Points lie in stretches of ``width`` of n. The greatest value of each stretch tells in
    which stretch a point's answer lies, and within it the answer is a running minimum over falling values,
    so that only tables of stretches are ordered by whole keys.
    """
    cut = points.select(*keys, n, F.col(value).alias("__v"), F.floor(F.col(n) / width).alias("__part"))
    top = cut.groupBy(*keys, "__part").agg(F.max("__v").alias("__top"), F.min("__v").alias("__low"))
    last = F.lag("__top").over(Window.partitionBy(*keys).orderBy("__part"))
    goals = top.withColumn("__last", last).select(*keys, F.col("__part").alias("__goal"), "__last", "__top")
    # the stretches that answers for a stretch can lie in
    asks = top.select(*keys, "__part", (F.col("__low") + step).alias("__from"), (F.col("__top") + step).alias("__to"))
    ways = asks.join(goals, keys).where((F.col("__top") >= F.col("__from")) & (F.col("__last").isNull() | (F.col("__last") < F.col("__to")))).select(*keys, "__part", "__goal", "__last", "__top")
    probes = cut.select(*keys, n, (F.col("__v") + step).alias("__v"), "__part").join(ways, [*keys, "__part"])
    probes = probes.where((F.col("__v") <= F.col("__top")) & (F.col("__last").isNull() | (F.col("__v") > F.col("__last"))))
    asked = probes.select(*keys, F.col("__goal").alias("__part"), "__v").distinct().withColumn("__n", F.lit(None).cast(points.schema[n].dataType))
    both = asked.unionByName(cut.select(*keys, "__part", "__v", F.col(n).alias("__n")))
    falling = Window.partitionBy(*keys, "__part").orderBy(F.desc("__v"), F.col("__n").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn(name, F.min("__n").over(falling)).where("__n is null").select(*keys, F.col("__part").alias("__goal"), "__v", name)
    found = probes.join(told, [*keys, "__goal", "__v"]).select(*keys, n, name)
    return cut.select(*keys, n).join(found, [*keys, n], "left")


def fill_by_keys(rows: DataFrame, other: DataFrame, keys: list[str], fields: list[str], pos: str = "pos") -> DataFrame:
    """``rows`` whose empty fields take, of the ``other`` rows with the same keys, the first value that is not empty."""
    told = other.groupBy(*keys).agg(*[F.min_by(c, F.when(F.trim(c) != "", F.col(pos))).alias(f"__{c}") for c in fields])
    filled = {c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.coalesce(f"__{c}", F.lit(""))).otherwise(F.col(c)) for c in fields}
    return rows.join(told, keys, "left").withColumns(filled).drop(*[f"__{c}" for c in fields])
