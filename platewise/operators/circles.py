"""Circles from edge rows by gradient votes: votes, peaks, radii and suppression as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.tables import dropped, written

#: Votes that a centre, and the edge at its radius, must have.
VOTES = 20


def _cells(at: Column, reach: Column | int, side: Column | int) -> Column:
    return F.sequence(F.floor((at - reach) / side), F.floor((at + reach) / side))


def ballots(edges: DataFrame, frames: DataFrame, low: int, high: int) -> DataFrame:
    """``image_id, cy, cx, n``: votes for centres, cast by each edge (``image_id, r, c, gx, gy``) along its gradient on both sides at all radii.

    Votes are summed before they are shuffled; those beyond the frame do not count.
    """
    sloped = edges.where("gx <> 0 or gy <> 0").withColumn("_g", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    reach = F.explode(F.concat(F.sequence(F.lit(low), F.lit(high)), F.sequence(F.lit(-low), F.lit(-high))))
    cast = sloped.withColumn("_r", reach).select("image_id", F.rint(F.col("r") + F.col("_r") * (F.col("gy") / F.col("_g"))).cast("long").alias("cy"), F.rint(F.col("c") + F.col("_r") * (F.col("gx") / F.col("_g"))).cast("long").alias("cx"))
    counted = cast.groupBy("image_id", "cy", "cx").agg(F.count("*").alias("n"))
    return counted.join(frames.hint("merge"), "image_id").where("cy between r0 and r1 and cx between c0 and c1").select("image_id", "cy", "cx", "n")


def peaks(counted: DataFrame, least: int = VOTES) -> DataFrame:
    """``image_id, cy, cx, n`` of centres: votes summed over three by three places, at least ``least`` and no fewer than at the neighbours (more than at those before)."""
    spots = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = counted.withColumn("o", F.explode(spots)).groupBy("image_id", (F.col("cy") + F.col("o.dr")).alias("cy"), (F.col("cx") + F.col("o.dc")).alias("cx"))
    sums = spread.agg(F.sum("n").alias("n"), F.bool_or((F.col("o.dr") == 0) & (F.col("o.dc") == 0)).alias("held"))
    full = sums.where((F.col("n") >= least) & F.col("held")).select("image_id", "cy", "cx", "n")
    seen = full.withColumn("o", F.explode(spots)).groupBy("image_id", (F.col("cy") + F.col("o.dr")).alias("cy"), (F.col("cx") + F.col("o.dc")).alias("cx"))
    own, other = (F.col("o.dr") == 0) & (F.col("o.dc") == 0), (F.col("o.dr") != 0) | (F.col("o.dc") != 0)
    # a neighbour sends its votes from the place (dr, dc) away; those before in a scan have dr, dc > (0, 0)
    rank = F.struct("n", (F.col("o.dr") * 3 + F.col("o.dc")).alias("s"))
    best = seen.agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(other, rank)).alias("b"))
    top = F.col("b").isNull() | (F.col("n") > F.col("b.n")) | (F.col("n") == F.col("b.n")) & (F.col("b.s") < 0)
    return best.where(F.col("n").isNotNull() & top).select("image_id", "cy", "cx", "n")


def radii(centres: DataFrame, edges: DataFrame, low: int, high: int, least: int = VOTES) -> DataFrame:
    """Centres with the ``radius`` at which most edges lie (ties to the smaller) and their number ``support``, at least ``least``.

    Centres are dealt to the cells that a circle may touch and edges to theirs.
    """
    side = max(1, high)
    dealt = centres.withColumn("_y", F.explode(_cells(F.col("cy"), high + 1, side))).withColumn("_x", F.explode(_cells(F.col("cx"), high + 1, side)))
    placed = edges.select("image_id", "r", "c", F.floor(F.col("r") / side).alias("_y"), F.floor(F.col("c") / side).alias("_x"))
    dy, dx = F.col("r") - F.col("cy"), F.col("c") - F.col("cx")
    far = F.rint(F.sqrt((dy * dy + dx * dx).cast("double"))).cast("int")
    rings = dealt.join(placed.hint("merge"), ["image_id", "_y", "_x"]).withColumn("radius", far).where(F.col("radius").between(low, high))
    counted = rings.groupBy("image_id", "cy", "cx", "n", "radius").agg(F.count("*").alias("support"))
    best = counted.groupBy("image_id", "cy", "cx", "n").agg(F.max(F.struct("support", (-F.col("radius")).alias("_r"))).alias("_b"))
    return best.select("image_id", "cy", "cx", "n", (-F.col("_b._r")).alias("radius"), F.col("_b.support").alias("support")).where(F.col("support") >= least)


def apart(centres: DataFrame, distance: Column) -> DataFrame:
    """Centres that stay when, from the most votes on (ties in a scan by rows), each drops those nearer to it than ``distance`` (one for each image).

    In rounds: a centre stays once no better one is left within reach, and then
    those within its reach go.  Centres meet through cells, and only pairs within reach go on.
    """
    own = F.struct((-F.col("n")).alias("n"), "cy", "cx")
    ranked = written(centres.withColumns({"id": own, "_far": distance.cast("double")}).withColumn("_side", F.greatest(F.ceil("_far"), F.lit(1))), "centres")
    left = ranked.select("image_id", F.col("id").alias("a"), F.floor(F.col("cy") / F.col("_side")).alias("_y"), F.floor(F.col("cx") / F.col("_side")).alias("_x"))
    right = ranked.withColumn("_y", F.explode(_cells(F.col("cy"), F.col("_side"), F.col("_side")))).withColumn("_x", F.explode(_cells(F.col("cx"), F.col("_side"), F.col("_side")))).select("image_id", F.col("id").alias("b"), "_far", "_y", "_x")
    dy, dx = F.col("a.cy") - F.col("b.cy"), F.col("a.cx") - F.col("b.cx")
    near = (F.col("a") < F.col("b")) & (F.sqrt((dy * dy + dx * dx).cast("double")) < F.col("_far"))
    pairs = written(left.join(right.hint("merge"), ["image_id", "_y", "_x"]).where(near).select("image_id", "a", "b"), "pairs")
    gone = None
    open_pairs = first = pairs
    while not open_pairs.isEmpty():
        # better ones that no better one is left for drop all within their reach
        beaten = open_pairs.select("image_id", F.col("b").alias("a"))
        winners = open_pairs.join(beaten.hint("merge"), ["image_id", "a"], "left_anti").select("image_id", "a").distinct()
        losers = open_pairs.join(winners.hint("merge"), ["image_id", "a"], "left_semi").select("image_id", "b").distinct()
        earlier, gone = gone, written(losers if gone is None else gone.union(losers).distinct(), "gone")
        after = first.join(gone.hint("merge"), ["image_id", "b"], "left_anti").join(gone.withColumnRenamed("b", "a").hint("merge"), ["image_id", "a"], "left_anti")
        before, open_pairs = open_pairs, written(after.select("image_id", "a", "b"), "pairs")
        for table in (earlier, before):
            if table is not None and table is not first:
                dropped(table)
    kept = ranked if gone is None else ranked.join(gone.withColumnRenamed("b", "id").hint("merge"), ["image_id", "id"], "left_anti")
    return kept.select(*centres.columns)


def hough_circles(edges: DataFrame, frames: DataFrame, low: int, high: int, distance: Column, votes: int = VOTES) -> DataFrame:
    """``image_id, x, y, radius, votes, support``: circles of radius ``low`` to ``high``, their centres at least ``distance`` apart.

    ``distance`` may use the columns of ``frames`` (``image_id, r0, r1, c0, c1``).
    """
    centres = radii(peaks(ballots(edges, frames, low, high), votes), edges, low, high, votes).join(frames.hint("merge"), "image_id")
    return apart(centres, distance).select("image_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "radius", F.col("n").alias("votes"), "support")


def strongest(circles: DataFrame, most: int = 2) -> DataFrame:
    """At most so many circles of each image, those with most votes (ties in a scan by rows)."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("votes"), "y", "x"))
    return circles.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")
