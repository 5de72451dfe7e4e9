"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a document's draw that name its bin: 4,096 bins a source.
BIN_DIGITS = 3
#: Sources up to which their table is broadcast; beyond it, the join is a shuffle join.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds `target` to sources (weight, source_size): level * weight, clamped at max_epochs * source_size.

    In each round the sources above their cap are clamped and the rest of the budget is spread over the others
    in proportion to their weights; only three sums reach the driver a round. The level never falls, so a
    source once clamped stays clamped. A source without weight gets nothing.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.col("weight").cast("double")
    level = 0.0
    while True:
        clamped = (weight > 0) & (cap <= weight * F.lit(level))
        row = sources.agg(
            F.sum(F.when(clamped, cap)).alias("fixed"), F.sum(F.when(~clamped & (weight > 0), weight)).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (budget - (row["fixed"] or 0.0)) / row["open"]
        if new <= level:
            break
        level = new
    return sources.withColumn(
        "target", F.when(weight > 0, F.least(cap, weight * F.lit(level))).otherwise(F.lit(0.0)))


def source_table(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) of rows (source, size); weights repeat over the sources in code-point order, NULL last."""
    sums = staged(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Ranked in two steps, so that no task sees more than the sources of one leading part.
    part = F.coalesce(F.substring(F.col("source"), 1, 2), F.lit(""))
    sums = sums.withColumns({"last": F.col("source").isNull(), "part": part})
    before = sums.groupBy("last", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("last", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("last", "part").orderBy("source")) - 1 + F.col("before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.join(before.drop("n"), ["last", "part"]).withColumn(
        "weight", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    ranked = staged(ranked.select("source", "source_size", "weight"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    return staged(water_fill(ranked, share * total, max_epochs).drop("weight"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0,
        seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        extra: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, repeats, taken, and the `extra` columns.

    Every document of a source is repeated floor(target / source_size) times; the fraction left is met by a
    seeded sample without replacement: documents are drawn in the order of md5(seed:id) until the words drawn
    come as near as possible to the fraction, so a source misses its target by less than one document. The
    order is cut by bins (leading hex digits of the draw): sizes are summed per source and bin, and only the
    documents of the one bin in which the fraction ends are put in order.

    NULL texts have size 0, a NULL source is a source of its own, documents of size 0 are never repeated for
    their words (repeats follow the draw all the same); rows with the same identifier and size share one draw
    and are told apart by nothing else. An extra column named like one of the above makes that one mix_<name>.
    An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias("__more") if extra else F.lit(None).cast("int").alias("__more"),
    )
    rows = rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("bin", F.substring("draw", 1, BIN_DIGITS))
    bins = staged(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")))
    sources = source_table(bins.select("source", "size"), weights, share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn(
        "left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    # The bin in which each source's fraction ends, and the words before it.
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = bins.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    cut = cut.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).where(
        (F.col("c.before") <= F.col("s.left"))).groupBy("s.source", "s.source_size", "s.target", "s.whole", "s.left").agg(
        F.max(F.struct("c.bin", "c.before")).alias("cut"))
    cut = staged(cut.select("source", "source_size", "target", "whole", "left", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("cut_before")))
    few = cut.count() <= BROADCAST_SOURCES
    table = cut.withColumnRenamed("source", "src")
    joined = rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    sure = joined.where(F.col("bin") != F.col("cut_bin")).withColumn("more", (F.col("bin") < F.col("cut_bin")).cast("long"))
    order = Window.partitionBy("source", "bin").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where(F.col("bin") == F.col("cut_bin")).withColumn(
        "before", F.col("cut_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # A document is drawn if more than half of its words lie before the cut.
    edge = edge.withColumn("more", (F.col("before") + F.col("size") / 2 < F.col("left")).cast("long")).drop("before")
    out = sure.unionByName(edge).withColumn("repeats", (F.col("whole") + F.col("more")).cast("long"))
    own = {
        "doc_id": F.col("doc_id"), "size": F.col("size"), "source_size": F.col("source_size").cast("long"),
        "target": F.col("target").cast("double"), "repeats": F.col("repeats"), "taken": F.col("repeats") * F.col("size"),
    }
    more = [F.col("__more").getField(c).alias(c) for c in extra]
    return out.select(*[v.alias(f"mix_{k}" if k in extra else k) for k, v in own.items()], *more)
