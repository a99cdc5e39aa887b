"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a target number of words. Of all rates between 0 and ``most`` that meet it, the ones closest to 1 in
(two-sided) entropy are rate(d) = most / (1 + (most - 1) exp(-tilt * x(d))), with x the document's size over the source's mean
size and one tilt per source: exponentially tilted rates, bounded above. The tilts solve a convex dual problem; Newton
steps, kept inside a bracket, solve it for all sources at once. Gradient and curvature are sums over a table of (source,
size) cells with counts, so the corpus is read once. Rates become whole copies per cell such that running copies follow
running rates from large to small sizes, a few passes then move single copies until the words taken meet the target, and the
copies of a cell go to its documents by a distributed rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wxspark.llm.common import salted_ranks, sheltered, word_count
from wxspark.session import compact, stored

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
TOLERANCE = 1e-7


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source, null last in the order.

    Targets share ``share`` of all words by weight; none is above ``most`` times its source's words, the excess is shared
    again by weight. Each round of that is an aggregate of two numbers; a round without a newly full source ends it.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int"))
    # One row per source, read by one task; the count is that of sources, not of documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_nth", F.row_number().over(order) - 1)
    table = stored(ranked.select("source", "source_size", cycle.alias("weight"), (F.col("source_size") * most).alias("cap")), "caps")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full_before = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        n, fixed, open_weight = table.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n is None or n == full_before or not open_weight:
            break
        level, full_before = max(level, (total - fixed) / open_weight), n
    return table.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def rates(cells: DataFrame, goals: DataFrame, most: float = 2.0) -> DataFrame:
    """(source, size, n, target, rate) of each cell; ``cells`` has (source, size, n) with sizes above 0."""
    n = cells.count()  # no table below has more rows
    means = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    means = means.join(goals.withColumnRenamed("source", "_s"), _same("source", "_s")).select("source", "target", (F.col("words") / F.col("docs")).alias("mean"), (F.col("words") * most).alias("cap"))
    known = means.select(F.col("source").alias("_s"), "target", "mean", "cap")
    base = compact(cells.join(known, _same("source", "_s")).select("source", "size", "n", "target", "mean", "cap", (F.col("size") / F.col("mean")).alias("x")), n, "base")
    # A source with no target or with all it can give needs no tilt.
    inner = (F.col("target") > 0) & (F.col("target") < F.col("cap") * (1 - 1e-12))
    at = compact(means.where(inner).select("source", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high")), n, "tilts")
    while True:
        here = at.select(F.col("source").alias("_s"), "tilt", "low", "high")
        rate = most / (1 + (most - 1) * F.exp(-F.greatest(F.least(F.col("tilt") * F.col("x"), F.lit(600.0)), F.lit(-600.0))))
        sums = base.join(here, _same("source", "_s")).withColumn("r", rate).groupBy("source").agg(
            F.first("tilt").alias("tilt"), F.first("low").alias("low"), F.first("high").alias("high"),
            (F.sum(F.col("n") * F.col("x") * F.col("r")) - F.first(F.col("target") / F.col("mean"))).alias("g"),
            F.sum(F.col("n") * F.col("x") * F.col("x") * F.col("r") * (1 - F.col("r") / most)).alias("h"),
            F.first(F.col("target") / F.col("mean")).alias("goal"),
        )
        off = F.abs("g") / F.col("goal")
        low = F.when(F.col("g") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("g") > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.col("g") / F.greatest("h", F.lit(1e-300))
        # Outside the bracket, or far beyond the current size of the tilt, halve the way or double the tilt.
        reach = 2 * F.abs("tilt") + 4
        held = F.greatest(F.least(step, F.col("tilt") + reach), F.col("tilt") - reach)
        inside = (held > low) & (held < high)
        moved = F.when(off < TOLERANCE, F.col("tilt")).when(inside, held).otherwise((low + high) / 2)
        # A source is settled when it meets its target, or when no number is left between the ends of its bracket.
        still = (off >= TOLERANCE) & (moved != F.col("tilt"))
        at = compact(sums.select("source", moved.alias("tilt"), low.alias("low"), high.alias("high"), still.alias("open")), n, "tilts")
        unsettled = not at.where("open").isEmpty()
        at = at.drop("open")
        if not unsettled:
            break
    # Nine digits of the tilt, so that the order in which sums were added does not show in the rates.
    kept = at.select(F.col("source").alias("_s"), F.expr("cast(format_string('%.9e', tilt) as double)").alias("tilt"))
    power = F.exp(-F.greatest(F.least(F.col("tilt") * F.col("x"), F.lit(600.0)), F.lit(-600.0)))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), most).otherwise(most / (1 + (most - 1) * power))
    return base.join(kept, _same("source", "_s"), "left").select("source", "size", "n", "target", rate.alias("rate"))


def cell_copies(rated: DataFrame, most: int = 2) -> DataFrame:
    """(source, size, n, copies): whole copies of each cell, between 0 and ``most`` per document.

    Running copies follow running rates from large to small sizes; what is then missing or too much of a source's words is
    moved by whole copies of the largest size that still fits. Each round brings a source nearer to its target or does not touch it;
    the rounds end when no copy helps any source.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))  # a row per size, not per document
    running = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    copies = F.greatest(F.least(F.round(running) - F.round(earlier), F.col("n") * most), F.lit(0)).cast("long")
    current = stored(rated.select("source", "size", "n", "target", copies.alias("copies")), "copies")
    cells = current.count()
    while True:
        lack = current.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack")).select(F.col("source").alias("_s"), "lack")
        open_ = F.when(F.col("lack") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = current.join(lack, _same("source", "_s")).withColumn("open", open_).where("open > 0 and size <= 2 * abs(lack)")
        # Half of the largest size that still helps: a copy brings the words nearer if its size is below twice what lacks.
        best = fits.groupBy("source").agg(
            F.max_by(F.struct("size", "lack", "open"), F.when(F.col("size") <= F.abs("lack"), F.col("size")).otherwise(-F.col("size"))).alias("b")
        ).where("b.size <= abs(b.lack) or 2 * abs(b.lack) > b.size")
        times = F.greatest(F.least(F.floor(F.abs("b.lack") / F.col("b.size")), F.col("b.open")), F.lit(1))
        move = compact(best.select(F.col("source").alias("_s"), F.col("b.size").alias("_z"), (F.signum("b.lack") * times).cast("long").alias("_m")), cells, "moves")
        if move.isEmpty():
            break
        moved = current.join(move, _same("source", "_s") & (F.col("size") == F.col("_z")), "left")
        current = compact(moved.select("source", "size", "n", "target", (F.col("copies") + F.coalesce("_m", F.lit(0))).alias("copies")), cells, "copies")
    return current.select("source", "size", "n", "copies")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(units, goals): copies of each document, and the target of each source.

    ``docs`` has doc_id, source and size (words, at least 0). Units: doc_id, source, size, rows, copies; rows that agree in all
    three columns are one unit, and each of its rows is taken ``copies`` times. A document without words is taken once
    for nothing. Null ids and a null source are ordinary values. An empty table gives empty tables.
    """
    units = stored(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "units")
    sized = units.groupBy("source", "size").agg(F.sum("rows").alias("n"))
    cells = compact(sized.where("size > 0"), units.count(), "cells")
    goals = stored(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights), "goals")
    chosen = cell_copies(rates(cells, goals.select("source", "target"), most), most)
    chosen = chosen.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", F.col("copies").alias("all"))
    ranked = salted_ranks(units.where("size > 0"), ["source", "size"], ["doc_id"], weight="rows")
    joined = ranked.join(chosen, _same("source", "_s") & (F.col("size") == F.col("_z")))
    # The first ``all mod n`` rows of a cell get one copy more; a unit that lies across that line goes with its larger part.
    extra = F.col("all") % F.col("n") - F.col("rank")
    copies = F.floor(F.col("all") / F.col("n")) + (2 * extra >= F.col("rows")).cast("int")
    none = units.where("size = 0").select("doc_id", "source", "size", "rows", F.lit(1).alias("copies"))
    return joined.select("doc_id", "source", "size", "rows", copies.cast("int").alias("copies")).union(none), goals


def copied(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, documents that are not taken left out; all columns as they were."""
    return sheltered(docs, ("doc_id", "source", "text"), lambda rows: _copied(rows, share, most, weights))


def _copied(docs: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    sized = docs.withColumn("_mix_size", word_count(F.col("text").cast("string")))
    units, _ = mix(sized.select("doc_id", "source", F.col("_mix_size").alias("size")), share, most, weights)
    taken = units.where("copies > 0").select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_words"), "copies")
    taken = taken.withColumnRenamed("copies", "_mix_copies")
    same = _same("doc_id", "_mix_id") & _same("source", "_mix_source") & (F.col("_mix_size") == F.col("_mix_words"))
    rows = sized.join(taken, same).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return rows.select(*[rows[f"`{c}`"] for c in docs.columns])


def report(documents: DataFrame) -> DataFrame:
    """One row per document: size, its source's size and target, and the words taken."""
    docs = documents.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"))
    units, goals = mix(docs)
    known = goals.select(F.col("source").alias("_s"), "source_size", "target")
    each = units.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    joined = each.join(F.broadcast(known) if goals.count() <= 100_000 else known, _same("source", "_s"), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
