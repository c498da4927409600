"""Joins of peaks that lie within a tolerance of each other, between rows: all pairs, the best covers, and one-to-one pairing.

Positions are cut into cells a little wider than the tolerance, so whatever is near a row lies in its own cell or in one beside it, and every
join is an equal one. Pairing never makes all pairs: equal positions are one row with a count, a round looks at the two neighbours of each, and the
pairs of a round are those that are nearest to each other both ways. A cell is one group of a shuffle; it holds the distinct positions of a
tolerance's width, however many rows stand at each.

Covers never make a row for each query and fragment: a fragment near few of the peaks that are asked for stands in the list of every set of these, a list keeps
its k best, and a query looks up the lists of the sets that it holds.

Rows whose position is null, not a number or infinite, and rows with a null in the columns of ``by``, are near nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators import pools
from peakloom.session import cut_lineage, stored

#: Cells are wider than the tolerance by this, so that rounding in the division can't set two near positions two cells apart.
WIDER = 1.001
#: Fragments that may be near more distinct peaks than this meet the queries themselves; of others all sets of near peaks are listed.
LISTED = 6
#: Rows that a task sorts in a round of pairing, about; and pairs of two lists in a row up to which they are paired in place.
SORTED, IN_PLACE = 500_000, 4096


def _finite(rows: DataFrame, at: str, by: tuple[str, ...]) -> DataFrame:
    ok = F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double")) & (F.abs(F.col(at).cast("double")) < float("inf"))
    for c in by:
        ok &= F.col(c).isNotNull()
    return rows.where(ok)


def _cell(at: str, tolerance: float) -> Column:
    return F.floor(F.col(at).cast("double") / (tolerance * WIDER))


def within(left: DataFrame, right: DataFrame, left_at: str, right_at: str, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of rows no farther apart than the tolerance, with its distance; but for ``by``, the sides have no column in common."""
    cells = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _cell(right_at, tolerance) + d)
    spread = _finite(right, right_at, by).withColumn("_cell", F.explode(cells))
    near = _finite(left, left_at, by).withColumn("_cell", _cell(left_at, tolerance)).join(spread, [*by, "_cell"])
    return near.withColumn("distance", F.abs(F.col(left_at).cast("double") - F.col(right_at).cast("double"))).where(F.col("distance") <= tolerance).drop("_cell")


def covers(peaks: DataFrame, fragments: DataFrame, tolerance: float, k: int, query: str = "query_id", peak: str = "peak", fragment: str = "fragment_id", shift: str = "shift") -> DataFrame:
    """For each query the k fragments that come within the tolerance of most of its peaks: (query, fragment, covered, distance, rank).

    Equal peaks of a query are one; distance is the sum over covered peaks of that to the fragment's nearest shift; ties go by it, then by the fragment.
    """
    asked = cut_lineage(peaks.select(query, peak).distinct())
    return covering(asked, cover_lists(asked, fragments, tolerance, k, peak, fragment, shift), tolerance, k, query, peak, fragment)


def cover_lists(peaks: DataFrame, fragments: DataFrame, tolerance: float, k: int, peak: str = "peak", fragment: str = "fragment_id", shift: str = "shift") -> tuple[DataFrame, DataFrame | None]:
    """What queries with these peaks, or with some of them, are answered from: lists of fragments, and the shifts of fragments that stand in none, if there are such."""
    shifts = _finite(fragments.select(F.col(fragment), F.col(shift).cast("double").alias("_s")), "_s", ())
    # The distinct peaks around each cell, of all queries together.
    own = _finite(peaks.select(F.col(peak).cast("double").alias("_p")).distinct(), "_p", ())
    around = own.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _cell("_p", tolerance) + d)))
    around = around.groupBy("_cell").agg(F.count("*").alias("_n"), F.slice(F.collect_list("_p"), 1, LISTED).alias("_near"))
    met = shifts.withColumn("_cell", _cell("_s", tolerance)).join(around, "_cell")
    near = F.filter(F.transform("_near", lambda p: F.struct(p.alias("p"), F.abs(F.col("_s") - p).alias("d"))), lambda x: x["d"] <= tolerance)
    held = met.groupBy(fragment).agg(F.sum("_n").alias("_n"), F.array_sort(F.flatten(F.collect_list(F.when(F.col("_n") <= LISTED, near)))).alias("_near"))
    held = stored(held.where((F.col("_n") > LISTED) | (F.size("_near") > 0)))
    once = F.filter("_near", lambda x, i: (i == 0) | (F.get("_near", i - 1)["p"] < x["p"]))  # the nearest shift to each peak stands first
    sets = F.aggregate(
        once,
        F.expr("array(named_struct('ps', cast(array() AS array<double>), 'd', 0D))"),
        lambda s, x: F.concat(s, F.transform(s, lambda y: F.struct(F.concat(y["ps"], F.array(x["p"])).alias("ps"), (y["d"] + x["d"]).alias("d")))),
    )
    lists = held.where(F.col("_n") <= LISTED).select(F.col(fragment), F.explode(sets).alias("_x")).select(F.col(fragment), F.col("_x.ps").alias("_ps"), F.round("_x.d", 6).alias("distance")).where(F.size("_ps") > 0)
    lists = pools.ranked(lists, [F.col("distance"), F.col(fragment)], ["_ps"], "_r").where(F.col("_r") <= k)
    lists = lists.groupBy("_ps").agg(F.collect_list(F.struct(fragment, "distance")).alias("_best")).withColumns({"_a": F.get("_ps", F.lit(0)), "_b": F.coalesce(F.get("_ps", F.lit(1)), F.get("_ps", F.lit(0)))})
    many = held.where(F.col("_n") > LISTED).select(fragment)
    return stored(lists), None if many.isEmpty() else shifts.join(many, fragment, "left_semi")


def covering(peaks: DataFrame, lists: tuple[DataFrame, DataFrame | None], tolerance: float, k: int, query: str = "query_id", peak: str = "peak", fragment: str = "fragment_id") -> DataFrame:
    """As ``covers``, from lists that were made for all of these peaks, or more, with the same tolerance and k."""
    lists, many = lists
    asked = _finite(peaks.select(F.col(query), F.col(peak).cast("double").alias(peak)).distinct(), peak, ())
    # A query's sets begin with one of its peaks, or with two of them; what stands behind these is looked at after.
    own = asked.groupBy(query).agg(F.array_sort(F.collect_list(peak)).alias("_own"))
    begins = own.withColumn("_a", F.explode("_own")).withColumn("_b", F.explode(F.filter("_own", lambda x: x >= F.col("_a"))))
    found = begins.join(lists, ["_a", "_b"]).where(F.forall("_ps", lambda x: F.array_contains("_own", x)))
    found = found.select(query, F.size("_ps").cast("long").alias("covered"), F.explode("_best").alias("_x")).select(query, F.col(f"_x.{fragment}").alias(fragment), "covered", F.col("_x.distance").alias("distance"))
    # Of the lists that a fragment is found in, that of all the peaks that it covers counts.
    best = found.groupBy(query, fragment).agg(F.min(F.struct((-F.col("covered")).alias("c"), F.col("distance").alias("d"))).alias("_m"))
    scored = best.select(query, fragment, (-F.col("_m.c")).alias("covered"), F.col("_m.d").alias("distance"))
    if many is not None:
        pairs = within(asked, many, peak, "_s", tolerance)
        each = pairs.groupBy(query, fragment, peak).agg(F.min("distance").alias("distance"))
        scored = scored.unionByName(each.groupBy(query, fragment).agg(F.count("*").alias("covered"), F.round(F.sum("distance"), 6).alias("distance")))
    return pools.ranked(scored, [F.desc("covered"), F.col("distance"), F.col(fragment)], [query]).where(F.col("rank") <= k)


def _nearest(places: DataFrame, tolerance: float, by: tuple[str, ...], parts: int) -> DataFrame:
    """Each place (by, side, at, n) with the nearest place of the other side within the tolerance, the smaller one at ties, and a bound of how many rows of that side are in its reach."""
    own = places.withColumn("_cell", _cell("at", tolerance))
    ends = own.groupBy(*by, "_cell", "side").agg(F.min("at").alias("_low"), F.max("at").alias("_high"), F.sum("n").alias("n"))
    beside = [ends.select(*by, (F.col("_cell") + step).alias("_cell"), "side", F.col(end).alias("at"), "n") for step, end in ((1, "_high"), (-1, "_low"))]
    seen = own.withColumn("_own", F.lit(True)).unionByName(beside[0].unionByName(beside[1]), allowMissingColumns=True)
    seen = seen.repartition(parts, *by, "_cell")  # a task sorts it in several orders at once
    cell = Window.partitionBy(*by, "_cell")
    up = cell.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = cell.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side, w: F.last(F.when(F.col("side") == side, F.col("at")), ignorenulls=True).over(w)
    total = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))).over(cell), F.lit(0))
    seen = seen.select("*", total(0).alias("_sum0"), total(1).alias("_sum1"), *[last(side, w).alias(f"_{name}{side}") for side in (0, 1) for name, w in (("below", up), ("above", down))]).where("_own")
    other = lambda name: F.when(F.col("side") == 0, F.col(f"_{name}1")).otherwise(F.col(f"_{name}0"))
    far = lambda name: F.abs(F.col("at") - other(name))
    near = F.when(other("above").isNull() | (far("below") <= far("above")), other("below")).otherwise(other("above"))
    return seen.withColumns({"near": near, "reach": other("sum")}).where(F.abs(F.col("at") - F.col("near")) <= tolerance).select(*places.columns, "near", "reach")


def paired(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_at: str, right_at: str, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one pairs (by, left key, right key, distance) within the tolerance, nearest first.

    The pairs are those that taking the best pair again and again gives, in the order of distance, left position, right position and keys. Two
    places that are nearest to each other both ways are the best pair of both, and a place with rows enough for all in its reach serves
    everyone whose nearest it is: all these are paired in one round, as many rows of each as both have, and the next round is among the rest. A
    place without another side in reach is out for good. Every round is checkpointed, and pairs at least the nearest places of all.
    """
    sides = [_finite(rows, at, by).select(*by, F.col(at).cast("double").alias("at"), F.col(key)) for rows, key, at in ((left, left_key, left_at), (right, right_key, right_at))]
    ranked = [cut_lineage(pools.numbered(rows, [*by, "at"], [key], "_n")) for rows, key in zip(sides, (left_key, right_key), strict=True)]
    counted = [rows.groupBy(*by, "at").agg(F.count("*").alias("n")).withColumn("side", F.lit(side)) for side, rows in enumerate(ranked)]
    places = counted[0].unionByName(counted[1])
    own = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(own, sum(rows.count() for rows in ranked) // SORTED + 1)
    found = None
    while True:
        state = cut_lineage(_nearest(places, tolerance, by, parts))
        if state.isEmpty():
            break
        l = state.where("side = 0").select(*by, F.col("at").alias("l_at"), F.col("near").alias("r_at"), F.col("n").alias("l_n"))
        r = state.where("side = 1").select(*by, F.col("near").alias("l_at"), F.col("at").alias("r_at"), F.col("n").alias("r_n"))
        # Where one side alone asks, the other serves it if it serves all.
        rich = [state.where((F.col("side") == side) & (F.col("n") >= F.col("reach"))).select(*by, F.col("at").alias(name), F.lit(True).alias(f"{name}_rich")) for side, name in enumerate(("l_at", "r_at"))]
        met = l.join(r, [*by, "l_at", "r_at"], "full").join(rich[0], [*by, "l_at"], "left").join(rich[1], [*by, "r_at"], "left")
        met = met.where("l_n IS NOT NULL AND r_n IS NOT NULL OR l_n IS NULL AND l_at_rich OR r_n IS NULL AND r_at_rich")
        pairs = cut_lineage(met.select(*by, "l_at", "r_at", F.least("l_n", "r_n").alias("m")))
        found = pairs if found is None else found.unionByName(pairs)
        gone = pairs.select(*by, F.lit(0).alias("side"), F.col("l_at").alias("at"), "m").unionByName(pairs.select(*by, F.lit(1).alias("side"), F.col("r_at").alias("at"), "m"))
        used = gone.groupBy(*by, "side", "at").agg(F.sum("m").alias("m"))
        places = state.join(used, [*by, "side", "at"], "left").select(*by, "at", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), "side").where("n > 0")
    if found is None:
        found = places.select(*by, F.col("at").alias("l_at"), F.col("at").alias("r_at"), F.col("n").alias("m")).limit(0)
    # The rows of a place go to its pairs in their order.
    far = F.abs(F.col("l_at") - F.col("r_at"))
    before = lambda own, other: F.coalesce(F.sum("m").over(Window.partitionBy(*by, own).orderBy(far, other).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = cut_lineage(found.select("*", before("l_at", "r_at").alias("l_taken"), before("r_at", "l_at").alias("r_taken")))
    l, r = (
        rows.withColumnRenamed("at", f"{s}_at").join(found, [*by, f"{s}_at"]).withColumn("_i", F.col("_n") - F.col(f"{s}_taken")).where("_i >= 1 AND _i <= m").select(*by, "l_at", "r_at", "_i", key)
        for s, rows, key in (("l", ranked[0], left_key), ("r", ranked[1], right_key))
    )
    return l.join(r, [*by, "l_at", "r_at", "_i"]).select(*by, left_key, right_key, F.abs(F.col("l_at") - F.col("r_at")).alias("distance"))


def paired_lists(rows: DataFrame, left: str, right: str, tolerance: float) -> DataFrame:
    """One-to-one pairs as ``paired`` gives them, between two lists of positions in each row: the row's other columns, the places (from 0) in both lists, and distance.

    Lists of few pairs are paired in their row, by taking the best pair again and again, so that nothing is shuffled; longer ones row by row in the rounds of ``paired``.
    """
    others = [c for c in rows.columns if c not in (left, right)]
    held = stored(rows)
    many = F.coalesce(F.size(left) * F.size(right).cast("long") > IN_PLACE, F.lit(False))
    each = lambda x, i, y, j: F.struct(F.abs(x - y).alias("d"), x.alias("x"), y.alias("y"), i.alias("i"), j.alias("j"))
    pairs = F.flatten(F.transform(F.col(left).cast("array<double>"), lambda x, i: F.transform(F.col(right).cast("array<double>"), lambda y, j: each(x, i, y, j))))
    near = F.array_sort(F.filter(pairs, lambda p: p["d"] <= tolerance))
    none = F.filter(near, lambda p: F.lit(False))
    best = F.aggregate(near, none, lambda taken, p: F.when(F.exists(taken, lambda t: (t["i"] == p["i"]) | (t["j"] == p["j"])), taken).otherwise(F.concat(taken, F.array(p))))
    found = held.where(~many).select(*others, F.explode(best).alias("_p")).select(*others, F.col("_p.i").alias(left), F.col("_p.j").alias(right), F.col("_p.d").alias("distance"))
    if not held.where(many).isEmpty():
        long = stored(held.where(many).withColumn("_row", F.monotonically_increasing_id()))
        l, r = (long.select("_row", F.posexplode(c).alias(c, f"{c}_at")) for c in (left, right))
        rest = paired(l, r, left, right, f"{left}_at", f"{right}_at", tolerance, ("_row",))
        found = found.unionByName(long.select("_row", *others).join(rest, "_row").select(*others, left, right, "distance"))
    return found
