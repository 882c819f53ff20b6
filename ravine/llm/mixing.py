"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral is the source's
weight; the weights share the corpus' words, no source above ``cap`` times its size. A source's
documents, in a hash order, are laid end to end (again and again while the target asks for
repeats), and the cumulative demand is inverted: the document that begins at word c of a source
with target T is due at the t where the normalised integral of the schedule reaches c / T.
Sorting by that position by ranges gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.llm.common import WORD, materialize

#: Hash buckets within a source; fixed, so that a hot source is spread over all tasks.
BUCKETS = 4096
#: Piecewise linear weights over training time, dealt to the sources in turn; integrals 1, 2, 3.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (0.5, 3.0), (1.0, 4.5)))


def integral(schedule) -> float:
    """The area under a schedule's knots (t, weight)."""
    return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def _inverse(schedule, share: Column) -> Column:
    """The t at which the normalised integral of the schedule reaches ``share`` (0 to 1)."""
    total, done, out = integral(schedule), 0.0, None
    pieces = list(zip(schedule, schedule[1:]))
    for i, ((t0, w0), (t1, w1)) in enumerate(pieces):
        area, left = (w0 + w1) / 2 * (t1 - t0), share * total - done
        slope = (w1 - w0) / (t1 - t0)
        if slope:
            t = t0 + (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * left)) - w0) / slope
        else:
            t = t0 + (left / w0 if w0 else F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(t0)), F.lit(t1))
        last = i == len(pieces) - 1
        out = t if out is None and last else (F.when(share * total < done + area, t) if out is None else (out.otherwise(t) if last else out.when(share * total < done + area, t)))
        done += area
    return out


def _placer(schedule):
    return lambda share: _inverse(schedule, F.least(share, F.lit(1.0)))


def targets(sizes: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """Per source: rank (by code point, null last) and target words.

    All words are shared by weight; a target stops at ``cap`` times its source's size and the
    excess is shared again, until none is above. That ends at target = min(cap * size, level *
    weight) for one level, found over the sources in the order in which they reach their caps.
    ``sizes`` has source and source_size, one row per source.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    t = sizes.withColumn("rank", F.row_number().over(by_code) - 1).withColumn("weight", weight)
    t = t.withColumn("limit", F.lit(cap) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, here = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(here))
    # the first source, in that order, whose cap is not reached sets the level
    open_ = F.col("level") * F.col("weight") <= F.col("limit")
    t = t.withColumn("level", F.min(F.when(open_, F.struct((F.col("limit") / F.col("weight")).alias("at"), F.col("rank").alias("r"), F.col("level").alias("level")))).over(everyone)["level"])
    return t.select("source", "source_size", "rank", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def mix(df: DataFrame, schedules=SCHEDULES, cap: float = 3.0, key: str = "doc_id") -> DataFrame:
    """Add size, source_size, target, taken, copies and positions to each document.

    size: words of ``text`` (null: 0). taken: the words that the mix takes from the document,
    repeats counted; a source's taken words sum to its target, rounded. The document at which a
    target ends is taken in part. copies: how often the whole document is laid out (it is rounded
    to whole documents); positions: the training time of each copy. Null sources are one source,
    null keys are ordered like any value, repeated rows count each on its own; columns that have
    one of the added names are replaced. An empty table gives an empty one; texts are only counted,
    so their length doesn't matter.
    """
    df = df.drop("size", "source_size", "target", "taken", "copies", "positions")
    order = [F.xxhash64(F.lit(7), F.col(key)), F.col(key), F.col("size"), F.xxhash64(F.col("text"))]
    df = df.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    df = df.withColumn("__order", F.struct(*order)).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(BUCKETS)))
    # a null source has a key of its own, so that one shuffle by key and bucket serves window and join
    df = df.withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    buckets = df.groupBy(F.col("source").alias("__source"), F.col("__s").alias("__k"), F.col("__bucket").alias("__b")).agg(F.sum("size").alias("__words"))
    buckets = materialize(buckets, "buckets")  # BUCKETS rows a source; texts are counted once for them
    ahead = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("__before", F.coalesce(F.sum("__words").over(ahead), F.lit(0)))
    sizes = buckets.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size"))
    plan = targets(sizes, [integral(s) for s in schedules], cap).withColumnRenamed("source", "__source")
    offsets = buckets.join(plan, buckets["__source"].eqNullSafe(plan["__source"])).drop(plan["__source"])
    inside = Window.partitionBy("__s", "__bucket").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(offsets.drop("__words", "__source"), (F.col("__s") == F.col("__k")) & (F.col("__bucket") == F.col("__b")))
    begins, asked = F.col("__before") + F.col("__inside"), F.floor(F.col("target") + 0.5).cast("long")
    df = df.withColumn("__begins", begins).withColumn("__asked", asked)
    rounds = F.when(F.col("source_size") > 0, F.expr("__asked div source_size")).otherwise(F.lit(1)).cast("long")
    df = df.withColumn("__rounds", rounds).withColumn("__rest", F.when(F.col("source_size") > 0, F.col("__asked") % F.col("source_size")).otherwise(F.lit(0)))
    part = F.least(F.greatest(F.col("__rest") - F.col("__begins"), F.lit(0)), F.col("size"))
    df = df.withColumn("taken", F.col("size") * F.col("__rounds") + part)
    whole = (F.col("__begins") + F.expr("size div 2") < F.col("__rest")).cast("long")
    df = df.withColumn("copies", (F.col("__rounds") + whole).cast("int"))
    asked_ = F.greatest(F.col("__asked"), F.lit(1)).cast("double")
    cases = None
    for i, s in enumerate(schedules):
        due = F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1), lambda e: (e * F.col("source_size") + F.col("__begins")) / asked_)
        at = F.transform(due, _placer(s))
        cases = F.when(F.col("rank") % len(schedules) == i, at) if cases is None else cases.when(F.col("rank") % len(schedules) == i, at)
    df = df.withColumn("positions", F.slice(cases, F.lit(1), F.col("copies")))
    return df.drop("__order", "__bucket", "__b", "__s", "__k", "__before", "__inside", "__begins", "__asked", "__rounds", "__rest", "rank")


def in_order(df: DataFrame, position: str = "position", key: str = "doc_id") -> DataFrame:
    """Rows range-sorted by their training position; of equal ones the smaller key, then the text's
    or row's hash, comes first. Rows without a position come last."""
    rest = F.xxhash64(*(c for c in df.columns if c != "positions"))
    order = [F.col(position).asc_nulls_last(), F.col(key).asc_nulls_last(), rest]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def curriculum(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The training sequence: a row for each copy, range-sorted by its ``position`` (see ``in_order``)."""
    return in_order(mixed.withColumn("position", F.explode("positions")).drop("positions"), key=key)


def mix_documents(documents: DataFrame) -> DataFrame:
    """Every document with its share of the mix, range-sorted by the position of its first copy."""
    out = mix(documents.select("doc_id", "source", "text"))
    return in_order(out.select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("position")))
