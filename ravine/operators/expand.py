"""Context around found chunks: siblings, hierarchy under a token budget, assets, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions.ranges import span
from ravine.sources.shared import materialize


def token_estimate(content: Column) -> Column:
    return F.ceil(F.length(content) / 4).cast("long")


def neighbours(rows: DataFrame, value: Column, n: int = 2, doc: str = "doc_id", id_: str = "id", buckets: int | None = None) -> DataFrame:
    """``before`` and ``after`` of every row: the values of the n rows around it in its document.

    Rows are cut into buckets by document and id, so a document may span many; the last and first n
    of a bucket also go to the n buckets after and before it, and the rest is a window of a bucket.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.col(doc).alias("__doc"), F.col(id_).alias("__id"), value.alias("__v"))
    cut = materialize(keyed.repartitionByRange(buckets, "__doc", "__id").withColumn("__b", F.spark_partition_id()), "neighbours")
    number = Window.orderBy("__b")
    used = cut.groupBy("__b").count().select("__b", F.row_number().over(number).alias("__bucket"))  # a row a bucket: empty ones don't part neighbours
    own = cut.join(F.broadcast(used), "__b").drop("__b").withColumn("__own", F.lit(True))
    inside = Window.partitionBy("__bucket")
    ends = own.withColumns({"f": F.row_number().over(inside.orderBy("__doc", "__id")), "l": F.row_number().over(inside.orderBy(F.desc("__doc"), F.desc("__id")))})
    steps = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    halo = [ends.filter(F.col(side) <= n).select("__doc", "__id", "__v", F.explode(F.transform(steps(*to), lambda k: F.col("__bucket") + k)).alias("__bucket"), F.lit(False).alias("__own")) for side, to in (("l", (1, n)), ("f", (-n, -1)))]
    both = own.unionByName(halo[0]).unionByName(halo[1])
    w = inside.orderBy("__doc", "__id")
    near = lambda a, b: F.collect_list(F.struct(F.col("__doc").alias("d"), F.col("__v").alias("v"))).over(w.rowsBetween(a, b))
    of = lambda c: F.transform(F.filter(c, lambda x: x["d"].eqNullSafe(F.col("__doc")) & x["v"].isNotNull()), lambda x: x["v"])
    found = both.withColumns({"before": near(-n, -1), "after": near(1, n)}).filter("__own")
    return found.select(F.col("__doc").alias(doc), F.col("__id").alias(id_), of("before").alias("before"), of("after").alias("after"))


def siblings(chunks: DataFrame, seeds: DataFrame, n: int = 2, doc: str = "doc_id", id_: str = "id") -> DataFrame:
    """For each seed, the ids of the n chunks before and after in its document."""
    return neighbours(chunks, F.col(id_), n, doc, id_).join(seeds.select(id_), id_, "left_semi")


def numbered(rows: DataFrame, order: list, out: str = "place", parts: int | None = None) -> DataFrame:
    """Rows with their place (from 1) in an order over the whole table: range-sorted parts, each counted
    from where the ones before it end. Only the parts' sizes are added up in one place."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = cut.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a part
    return cut.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + row + 1).drop("__p", "__m", "__before")


def within_budget(df: DataFrame, tokens: str, budget: int | Column, order: list, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows before the first that overflows the running budget."""
    used = F.sum(tokens).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).filter(F.col("used") <= budget)


def expand(chunks: DataFrame, seeds: DataFrame, sections: DataFrame | None = None, budget: int = 8000, parents: bool = True, children: bool = False) -> DataFrame:
    """Per query its seeds, then chunks of their sections and of the parents (and children) of these,
    by page, until the shared token budget first overflows.

    ``chunks``: id, section_id, page_number, content; ``seeds``: query_id, id; ``sections``:
    section_id, parent_section_id. Returns query_id, id, kind, page_number, tokens; kind is the
    nearest relation of a chunk's section.
    """
    sized = chunks.select("id", "section_id", "page_number", token_estimate(F.col("content")).alias("tokens"))
    order = ["page_number", "id"]
    seed = sized.join(seeds.select("query_id", "id"), "id")
    kept = within_budget(seed, "tokens", budget, order, ("query_id",))
    spent = kept.groupBy("query_id").agg(F.sum("tokens").alias("spent"))
    own = seed.select("query_id", "section_id").distinct()
    wanted = own.withColumn("near", F.lit(0))
    if sections is not None and parents:
        up = sections.filter("parent_section_id is not null").select("section_id", "parent_section_id")
        wanted = wanted.unionByName(own.join(up, "section_id").select("query_id", F.col("parent_section_id").alias("section_id"), F.lit(1).alias("near")))
    if sections is not None and children:
        down = sections.select(F.col("parent_section_id").alias("__p"), F.col("section_id").alias("__c"))
        wanted = wanted.unionByName(own.join(down, F.col("section_id") == F.col("__p")).select("query_id", F.col("__c").alias("section_id"), F.lit(2).alias("near")))
    wanted = wanted.groupBy("query_id", "section_id").agg(F.min("near").alias("near"))
    # what lies behind two budgets in its own section can't fit, whatever of it the seeds have taken
    fits = within_budget(sized, "tokens", 2 * budget, order, ("section_id",)).drop("used")
    more = fits.join(wanted, "section_id").join(kept.select("query_id", "id"), ["query_id", "id"], "left_anti").join(spent, "query_id", "left")
    more = within_budget(more, "tokens", F.lit(budget) - F.coalesce("spent", F.lit(0)), order, ("query_id",))
    kind = F.element_at(F.array(F.lit("sibling"), F.lit("parent"), F.lit("child")), F.col("near") + 1)
    cols = ["query_id", "id", "kind", "page_number", "tokens"]
    return kept.withColumn("kind", F.lit("seed")).select(*cols).unionByName(more.withColumn("kind", kind).select(*cols))


def attach_assets(chunks: DataFrame, assets: DataFrame, names: tuple[str, str] = ("section_id", "page_number"), doc: str = "doc_id") -> DataFrame:
    """A chunk's assets in its document: those of its section, and only where the section has none those
    of its page."""
    section, page = names
    by_section = assets.filter(F.col(section).isNotNull()).groupBy(doc, section).agg(F.sort_array(F.collect_list("asset_id")).alias("of_section"))
    by_page = assets.groupBy(doc, page).agg(F.sort_array(F.collect_list("asset_id")).alias("of_page"))
    joined = chunks.join(by_section, [doc, section], "left").join(by_page, [doc, page], "left")
    return joined.withColumn("assets", F.coalesce("of_section", "of_page", F.array().cast("array<bigint>"))).drop("of_section", "of_page")


def first_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, order: str, width: int, by: str | None = None, closed: bool = False) -> DataFrame:
    """For each point the first interval [start, end) that holds it; ``closed``: [start, end].

    An interval is dealt to every bucket of ``width`` that it touches, so the join is an equi-join
    on the bucket with the range as a residual filter; points without an interval stay.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - (0 if closed else 1)) / width)
    dealt = intervals.withColumn("__b", F.explode(F.sequence(first, F.greatest(first, last))))
    # points repeated are one until the end
    p = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__b", F.floor(F.col(at) / width))
    on = (p["__b"] == dealt["__b"]) & (p[at] >= dealt[start]) & ((p[at] <= dealt[end]) if closed else (p[at] < dealt[end]))
    if by:
        on = on & (p[by] == dealt[by])
        dealt_cols = [dealt[c] for c in intervals.columns if c != by]
    else:
        dealt_cols = [dealt[c] for c in intervals.columns]
    joined = p.join(dealt, on, "left").select(*(p[c] for c in points.columns), p["__copies"], *dealt_cols)
    w = Window.partitionBy(*points.columns).orderBy(F.col(order).asc_nulls_last())
    first_of = joined.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first_of.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).drop("__k", "__copies")


def deepest_section(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Of the sections that cover a page, the one of the deepest level; of equals the later."""
    dealt = sections.withColumn("page_no", F.explode(span("start_page", "end_page")))
    w = Window.partitionBy("doc_id", "page_no").orderBy(F.col("level").desc(), F.col("idx").desc())
    best = dealt.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("doc_id", "page_no", "section_id", "level")
    return pages.join(best, ["doc_id", "page_no"], "left")
