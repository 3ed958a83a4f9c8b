"""Mixing sources to target weights by entropy balancing.

Operator 10.  Rates r of documents minimise the sum of r (log r - 1) over 0 <= r <= cap under one
token constraint per source; the dual has one multiplier per source, and a document's rate is
min(cap, exp(multiplier * size / mean size)).  Rates depend on a document only through its source
and size, so Newton runs on the histogram of sizes, which grows with the length of texts and not
with their number.  Copies are rounded within the histogram and dealt to documents by hash.
Only DataFrame operations run; no user functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

#: Weights repeat over the sources in code point order.
WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
CAP = 2
STEPS = 60
#: A bucket of documents that are dealt copies together.
DEAL = 1_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the number of words of each whole text, and a hash of the row."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    return docs.select("doc_id", "source", words.cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("h"))


def targets(histogram: DataFrame, weights=WEIGHTS, percent: int = TOTAL_PERCENT, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) by water filling: capped sources' excess goes to the rest by weight.

    A source is capped exactly when its size per weight lies below the level at which the
    shares add up; sorted by that ratio, the level is found with two running sums over one
    row per source.
    """
    per = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = per.select("source", "source_size", weight.cast("double").alias("w"))
    everything = Window.partitionBy()
    ratio = F.col("source_size") / F.col("w")
    listed = listed.select("*", ratio.alias("ratio"), (F.sum("source_size").over(everything) * percent / 100.0).alias("total"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(onwards)
    listed = listed.select("*", level.alias("level"))
    # the first source whose share at its level is no more than its cap sets the level for all
    fits = F.when(F.col("level") <= cap * F.col("ratio"), F.struct("ratio", "level"))
    best = F.min(fits).over(everything)["level"]
    capped = F.least(F.col("w") * best, (cap * F.col("source_size")).cast("double"))
    return listed.select("source", "source_size", F.coalesce(capped, (cap * F.col("source_size")).cast("double")).alias("target"))


def multipliers(histogram: DataFrame, wanted: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """(source, mean, tilt, full): safeguarded Newton on the concave dual of every source at once.

    Gradient and curvature are sums over the histogram that Spark adds up anew in each step; what
    goes from step to step is one row per source.  ``full`` marks sources at their cap.
    """
    base = (
        histogram.where("size > 0")
        .groupBy("source")
        .agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.max("size").alias("longest"), F.min("size").alias("least"))
    )
    state = base.join(wanted, base["source"].eqNullSafe(wanted["source"])).select(
        base["source"], "mean", "target",
        (F.col("target") >= cap * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("tilt"), F.lit(-1e3).alias("low"),
        (F.log(F.lit(float(cap))) * F.col("mean") / F.col("least")).alias("high"),
        F.lit(False).alias("met"),
    )
    bins = checkpointed(histogram.where("size > 0"))
    state = checkpointed(state)
    for _ in range(steps):
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * z))
        moving = F.col("tilt") * z < F.log(F.lit(float(cap)))
        mass = F.col("n") * F.col("size")
        sums = (
            bins.alias("b")
            .join(state.where("NOT full AND NOT met").alias("s"), F.expr("b.source <=> s.source"))
            .groupBy("s.source")
            .agg(F.sum(mass * rate).alias("got"), F.sum(F.when(moving, mass * rate * z).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        met = F.abs(gap) <= 1e-9 * F.col("target")
        new = (
            state.alias("o")
            .join(sums.alias("g"), F.expr("o.source <=> g.source"), "left")
            .select(
                F.col("o.source").alias("source"), "mean", "target", "full",
                F.when(F.col("got").isNull() | met, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
                F.when(F.col("got").isNull(), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("got").isNull(), F.col("high")).otherwise(high).alias("high"),
                (F.col("met") | F.coalesce(met, F.lit(False))).alias("met"),
            )
        )
        state = checkpointed(new)
        if state.where("NOT full AND NOT met").isEmpty():
            break
    return state.select("source", "mean", "tilt", "full")


def allotted(histogram: DataFrame, wanted: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, source_size, target, copies): whole copies for each size of each source.

    Fractions are rounded along falling sizes so that running totals differ by less than one
    copy; what is missing then, about the longest document at most, goes to the smallest sizes
    that can take it, so the words left over are fewer than one of those has.
    """
    cap_ = F.lit(float(cap))
    rated = (
        histogram.alias("h")
        .join(wanted.alias("w"), F.expr("h.source <=> w.source"))
        .join(tilts.alias("m"), F.expr("h.source <=> m.source"), "left")
        .select(
            "h.source", "h.size", "h.n", "w.source_size", "w.target",
            F.when(F.col("h.size") == 0, F.lit(0.0))
            .when(F.col("m.full"), cap_)
            # rounded, so that the order of additions in the last step doesn't show
            .otherwise(F.least(cap_, F.exp(F.round("m.tilt", 7) * F.col("h.size") / F.col("m.mean")))).alias("rate"),
        )
    )
    by_source = Window.partitionBy("source")
    falling = by_source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rising = by_source.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.floor(F.col("n") * F.col("rate"))
    part = F.col("n") * F.col("rate") - whole
    run = F.sum("part").over(falling)
    rounded = (
        rated.select("*", whole.alias("whole"), part.alias("part"))
        .select("*", run.alias("run"))
        .select("*", (F.col("whole") + F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("part") + 0.5)).alias("k"))
        .select("*", F.least(F.greatest(F.col("k"), F.lit(0)), cap * F.col("n")).cast("long").alias("k0"))
        .select("*", (F.col("target") - F.sum(F.col("k0") * F.col("size")).over(by_source)).alias("gap"))
        .select("*", F.when(F.col("gap") > 0, cap * F.col("n") - F.col("k0")).otherwise(F.col("k0")).alias("room"))
        .select("*", (F.sum(F.col("room") * F.col("size")).over(rising) - F.col("room") * F.col("size")).alias("before"))
    )
    fit = F.greatest(F.lit(0), F.floor((F.abs("gap") - F.col("before")) / F.col("size")))
    moved = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.col("room"), fit))
    return rounded.select(
        "source", "size", "n", "source_size", "target",
        (F.col("k0") + F.when(F.col("gap") > 0, moved).otherwise(-moved)).cast("long").alias("copies"),
    )


def dealt(sized: DataFrame, groups: DataFrame, deal: int = DEAL) -> DataFrame:
    """Each document's copies: equal shares within its size, what remains in order of a hash.

    A large group is ranked in hashed buckets of about ``deal`` documents, whose counts are
    added up first, so that no group of equal sizes meets in one task.
    """
    keyed = (
        sized.alias("d")
        .join(groups.alias("g"), F.expr("d.source <=> g.source AND d.size = g.size"))
        .select(
            "d.doc_id", "d.source", "d.size", "d.h", "g.source_size", "g.target",
            F.floor(F.col("copies") / F.col("n")).alias("each"), F.expr("copies % n").alias("rest"), F.ceil(F.col("n") / deal).alias("buckets"),
        )
        .select("*", F.expr("pmod(h, buckets)").alias("bucket"))
    )
    order = Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")
    # rows that tie here are equal in all that is returned
    ranked = keyed.select("*", F.row_number().over(order).alias("rank"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.where("buckets > 1")
        .groupBy("source", "size", "bucket")
        .agg(F.count("*").alias("c"))
        .select("source", "size", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    )
    return (
        ranked.alias("r")
        .join(offsets.alias("o"), F.expr("r.source <=> o.source AND r.size = o.size AND r.bucket = o.bucket"), "left")
        .select(
            "doc_id", "r.source", "r.size", "h", "source_size", "target",
            (F.col("each") + F.when(F.col("rank") + F.coalesce("offset", F.lit(0)) <= F.col("rest"), 1).otherwise(0)).cast("long").alias("copies"),
        )
    )


def mixed(docs: DataFrame, weights=WEIGHTS, percent: int = TOTAL_PERCENT, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, h, source_size, target, copies) for each row of ``docs`` (doc_id, source, text).

    A null source is a source, the last; a null or empty text has size 0 and gets no copy; each
    row counts, so of repeated rows (null ids or not) some may be taken once more than others; h is a hash of
    the row; other columns are ignored; an empty table gives an empty table.
    """
    sized = checkpointed(sizes(docs))
    histogram = checkpointed(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = checkpointed(targets(histogram, weights, percent, cap))
    tilts = multipliers(histogram, wanted, cap)
    groups = checkpointed(allotted(histogram, wanted, tilts, cap))
    return dealt(sized, groups)


def mix_sources(docs: DataFrame, weights=WEIGHTS, percent: int = TOTAL_PERCENT, cap: int = CAP) -> DataFrame:
    """Contract columns of op10: what the mix takes of each document."""
    return mixed(docs, weights, percent, cap).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def repeated(docs: DataFrame, weights=WEIGHTS, percent: int = TOTAL_PERCENT, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows that share doc_id, source and text share their copies as evenly as whole copies can.  Nulls, empty texts and
    empty tables are as in ``mixed``; other columns go along, whatever their names.
    """
    copies = mixed(docs, weights, percent, cap).groupBy("h", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", "source", "text").alias("h"), words.alias("size"))
    both = row.join(copies, ["h", "size"])
    place = F.row_number().over(Window.partitionBy("h", "size").orderBy(F.xxhash64("_row")))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(place <= F.expr("copies % rows"), 1).otherwise(0)
    taken = both.select("_row", own.cast("int").alias("own")).where("own > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("own")))).select("_row.*")
