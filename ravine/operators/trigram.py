"""Titles found by trigrams, for many queries at once: a prefix-filtered set-similarity join.

Two sets with a Jaccard similarity of t share one of the first n - ceil(t * n) + 1 trigrams of
either, when both put rare trigrams first. So only these prefixes are joined; a pair comes up once,
at the first trigram that both prefixes have. Equal titles are one until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions import text
from ravine.sources.shared import materialize

THRESHOLD = 0.3


def _sorted(rows: DataFrame, key: str, frequency: DataFrame) -> DataFrame:
    """(key, grams): each text's trigrams, the rarest first."""
    each = rows.select(key, F.explode(text.trigrams(key)).alias("gram")).join(frequency, "gram", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))  # no more than the text is long
    return each.groupBy(key).agg(order.alias("o")).select(key, F.transform("o", lambda x: x["gram"]).alias("grams"))


def _prefix(grams: Column, threshold: float) -> Column:
    n = F.size(grams)
    return F.slice(grams, F.lit(1), n - F.ceil(n * threshold).cast("int") + 1)


def similar(titles: DataFrame, queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(title, query) of all pairs of different texts with a trigram similarity of ``threshold`` or more."""
    frequency = materialize(titles.select(F.explode(text.trigrams("title")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "trigrams")
    sides = []
    for rows, key in ((titles, "title"), (queries, "query")):
        grams = _sorted(rows.select(key), key, frequency).withColumn("prefix", _prefix(F.col("grams"), threshold))
        sides.append(grams.select(key, F.col("grams").alias(f"{key}_grams"), F.col("prefix").alias(f"{key}_prefix"), F.explode("prefix").alias("gram")))
    a, b = F.size("title_grams"), F.size("query_grams")
    pairs = sides[0].join(sides[1], "gram").filter((a >= F.ceil(threshold * b)) & (b >= F.ceil(threshold * a)))
    pairs = pairs.filter(F.array_intersect("title_prefix", "query_prefix")[0] == F.col("gram"))
    both = F.size(F.array_intersect("title_grams", "query_grams"))
    return pairs.filter(both >= threshold * (a + b - both) - 1e-9).select("title", "query")


def containing(titles: DataFrame, queries: DataFrame) -> DataFrame:
    """(title, query) of all titles that hold a query, without regard to case: by the query's rarest
    three letters, or the whole of a shorter one, then by looking."""
    low = lambda c: F.lower(F.col(c))
    every = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))
    asked = queries.select("query", low("query").alias("q")).filter("q <> ''").withColumn("size", F.least(F.lit(3), F.length("q")))
    sizes = [r[0] for r in asked.select("size").distinct().collect()]  # of 1, 2 and 3
    grams = titles.select("title", low("title").alias("t"))
    held = None
    for n in sizes:
        some = grams.select("title", "t", F.explode(every(F.col("t"), F.lit(n))).alias("gram"))
        held = some if held is None else held.unionByName(some)
    if held is None:
        return titles.select("title").limit(0).withColumn("query", F.lit(""))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    each = asked.select("query", "q", F.explode(every(F.col("q"), F.col("size"))).alias("gram")).join(often, "gram", "left")
    rarest = each.groupBy("query", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("m")).select("query", "q", F.col("m.gram").alias("gram"))
    return held.join(rarest, "gram").filter(F.contains("t", F.col("q"))).select("title", "query")


def search_documents(documents: DataFrame, queries: DataFrame, k: int = 20, threshold: float = THRESHOLD) -> DataFrame:
    """The k best completed documents (id, title, status, tags: a JSON array) of every query (query_id,
    query): titles more similar than ``threshold``, titles that hold the query, and documents tagged
    with it, by similarity and id."""
    done = documents.filter("status = 'completed' AND title IS NOT NULL").select("id", "title", "tags")
    asked = queries.filter("query IS NOT NULL").select("query_id", "query")
    titles, words = done.select("title").distinct(), asked.select("query").distinct()
    found = similar(titles, words, threshold).unionByName(containing(titles, words)).distinct()
    score = F.round(text.trigram_similarity("title", "query"), 6)
    found = found.withColumn("similarity", score).filter((F.col("similarity") > threshold) | F.contains(F.lower("title"), F.lower("query")))
    first = Window.partitionBy("title").orderBy("id")
    members = done.select("id", "title").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).drop("n")  # of equal titles the k first suffice
    by_title = found.join(members, "title").select("query", "id", "title", "similarity")
    tag = done.select("id", "title", F.explode(F.from_json("tags", "array<string>")).alias("query"))
    tagged = tag.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.round(text.trigram_similarity("title", "query"), 6).desc(), "id"))).filter(F.col("n") <= k)
    by_tag = tagged.join(words, "query", "left_semi").select("query", "id", "title", score.alias("similarity"))
    both = by_title.unionByName(by_tag).distinct().join(asked, "query")
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "title", "similarity", "rank")
