"""Retrieval: vector, keyword, hybrid, topic-boosted, fused, routed and cached search.

All rank by the score rounded to six digits, then by id, so ties never depend on the plan. Search
ranks narrow rows (id and score) and joins the text back for the rows it returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions import grammar, rank, text, vector
from ravine.operators import text_index, vector_index
from ravine.sources.shared import materialize

#: Queries of a batch whose vectors a pass over the chunks takes.
BLOCK = 2048


def where(**equal) -> Column:
    """A conjunction of the parameters that are given; None means no condition."""
    return reduce(lambda a, b: a & b, [F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in equal.items() if v is not None], F.lit(True))


def top(df: DataFrame, score: str, k: int, id_: str = "id", above: float | None = None) -> DataFrame:
    """The k best rows; ``above``: of these, those with a higher score (null: none).

    The condition comes after the limit, where the same rows meet it: before, the score's whole
    expression would be worked out once for the filter and again for the rows.
    """
    out = df.orderBy(F.col(score).desc_nulls_last(), F.col(id_)).limit(k)
    return out if above is None else out.filter(F.col(score) > above)


def ranked(df: DataFrame, score: str, out: str = "rank", by: tuple[str, ...] = (), id_: str = "id") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), id_)))


def vector_search(chunks: DataFrame, query: list[float], threshold: float = 0.3, k: int = 10, **equal) -> DataFrame:
    """Cosine top-k above a strict threshold; rows without an embedding never match."""
    scored = chunks.filter(where(**equal) & F.col("embedding").isNotNull()).withColumn("similarity", F.round(vector.cosine_to(F.col("embedding"), query), 6))
    return top(scored, "similarity", k, above=threshold)


def match_documents(chunks: DataFrame, query: list[float], doc_id: object = None, match_threshold: float = 0.3, match_count: int = 10) -> DataFrame:
    """``vector_search`` under its other name and parameters."""
    return vector_search(chunks, query, match_threshold, match_count, doc_id=doc_id)


def batch_vector_search(chunks: DataFrame, queries: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """The k nearest chunks (id, embedding) of every query (query_id, embedding), with their rank.

    Exact: all blocks of rows meet all blocks of queries, on the executors (see ``vector_index.nearest``).
    """
    whole = lambda df, id_: df.filter("embedding is not null").select(F.col(id_).cast("long").alias(id_), "embedding", F.lit(0).alias("list"))
    return vector_index.nearest(whole(chunks, "id"), whole(queries, "query_id"), k, block)


def best_of(df: DataFrame, scores: list[str], k: int, id_: str = "id") -> DataFrame:
    """The k best rows by each of some scores (null: not in its list), in one pass: ``list`` is the
    score's number and ``rank`` the place. Each task keeps its best; these few are merged."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * len(scores)
        for b in batches:
            for i, s in enumerate(scores):
                some = pa.Table.from_batches([b]).filter(b.column(s).is_valid())
                both = some if held[i] is None else pa.concat_tables([held[i], some])
                held[i] = both.sort_by([(s, "descending"), (id_, "ascending")]).slice(0, k)
        for i, t in enumerate(held):
            for b in t.combine_chunks().to_batches() if t is not None else []:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i] * b.num_rows, pa.int32())], names=[*b.schema.names, "list"])

    small = df.mapInArrow(keep, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", list int")
    score = F.element_at(F.array(*(F.col(s).cast("double") for s in scores)), F.col("list") + 1)
    place = F.row_number().over(Window.partitionBy("list").orderBy(score.desc(), id_))
    return small.withColumn("rank", place).filter(F.col("rank") <= k)


def hybrid(chunks: DataFrame, query: list[float], terms: list[str], semantic: float = 0.7, keyword: float = 0.3, threshold: float = 0.0, k: int = 10, **equal) -> DataFrame:
    """Weighted search driven by the vectors: keyword-only chunks never appear."""
    rows = chunks.filter(where(**equal) & F.col("embedding").isNotNull()).withColumn("__w", text.spaced("content"))
    keyed = F.when(rank.all_terms(F.col("__w"), terms), rank.tf_norm(F.col("__w"), terms))
    scored = rows.withColumns({"semantic_score": F.round(vector.cosine_to(F.col("embedding"), query), 6), "keyword_score": F.round(F.coalesce(keyed, F.lit(0.0)), 6)}).drop("__w")
    scored = scored.withColumn("combined_score", F.round(semantic * F.col("semantic_score") + keyword * F.col("keyword_score"), 6))
    return top(scored, "combined_score", k, above=threshold)


def hybrid_topics(chunks: DataFrame, query: list[float], terms: list[str], include: list[str] | None = None, exclude: list[str] | None = None, semantic: float = 0.5, keyword: float = 0.5, k: int = 10) -> DataFrame:
    """Two branches of 2k, merged by the larger of each score, then boosted by topic.

    A chunk found by one branch only scores 0 in the other. With ``exclude``, rows without topics
    go, as the three-valued condition has it. The boost comes after the branches' limits. Rows
    without a similarity fill the vector branch only where others don't.
    """
    df = chunks
    if exclude:
        no = F.array(*map(F.lit, exclude))
        df = df.filter(~F.arrays_overlap("topics", no) & (F.col("topic").isNull() | ~F.col("topic").isin(*exclude)))
    boost = rank.topic_boost(F.col("topic"), F.col("topics"), include)
    df = df.select("id", boost.alias("boost"), F.round(vector.cosine_to(F.col("embedding"), query), 6).alias("v"), text.spaced("content").alias("__w"))
    words = F.when(rank.all_terms(F.col("__w"), terms), F.round(rank.tf_norm(F.col("__w"), terms), 6))
    found = best_of(df.select("id", "boost", F.coalesce("v", F.lit(-2.0)).alias("v"), words.alias("w")), ["v", "w"], 2 * k)  # a cosine is above -2
    by_vector = F.col("list") == 0
    merged = found.groupBy("id").agg(F.max(F.when(by_vector & (F.col("v") >= -1), F.col("v")).otherwise(0.0)).alias("semantic_score"), F.max(F.when(by_vector, 0.0).otherwise(F.col("w"))).alias("keyword_score"), F.max("boost").alias("topic_boost"))
    final = (semantic * F.col("semantic_score") + keyword * F.col("keyword_score")) * F.col("topic_boost")
    return top(merged.withColumn("final_score", F.round(final, 6)), "final_score", k)


def multi_source(chunks: DataFrame, query: list[float], terms: list[str], sources: list[str], semantic: float = 0.5, keyword: float = 0.5, per_source: int = 5, k: int = 15) -> DataFrame:
    """The best of each source, merged; chunks without an embedding are left out."""
    rows = chunks.filter(F.col("doc_id").isin(*sources) & F.col("embedding").isNotNull()).select("id", F.col("doc_id").alias("source"), "embedding", text.spaced("content").alias("__w"))
    score = semantic * vector.cosine_to(F.col("embedding"), query) + keyword * rank.tf_norm(F.col("__w"), terms)
    scored = rows.select("id", "source", F.round(score, 6).alias("score"))
    return top(ranked(scored, "score", by=("source",)).filter(F.col("rank") <= per_source), "score", k)


def rrf(chunks: DataFrame, query: list[float], terms: list[str], fts: float = 0.4, vec: float = 0.6, k: int = 10, candidates: int | None = None) -> DataFrame:
    """Two ranked lists of 2k fused by weighted reciprocal ranks.

    ``candidates``: only the first so many chunks by id are compared by vector (default: all).
    """
    rows = chunks.select("id", "embedding", text.spaced("content").alias("__w"))
    near, words = F.round(vector.cosine_to(F.col("embedding"), query), 6), F.round(rank.tf_norm(F.col("__w"), terms), 6)
    scored = rows.select("id", near.alias("v"), words.alias("w"))
    if candidates is not None:
        some = scored.filter("v is not null").orderBy("id").limit(candidates).select("id", F.lit(True).alias("__in"))
        scored = scored.join(some, "id", "left").withColumn("v", F.when(F.col("__in"), F.col("v"))).drop("__in")
    found = best_of(scored.select("id", F.when(F.col("w") > 0, F.col("w")).alias("w"), F.when(F.col("v") > 0.1, F.col("v")).alias("v")), ["w", "v"], 2 * k)
    both = found.groupBy("id").agg(F.max(F.when(F.col("list") == 0, F.col("rank"))).alias("fts_rank"), F.max(F.when(F.col("list") == 1, F.col("rank"))).alias("vector_rank"))
    kind = F.when(F.col("fts_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "fts").otherwise("both")
    score = rank.reciprocal(F.col("fts_rank"), fts) + rank.reciprocal(F.col("vector_rank"), vec)
    return top(both.withColumns({"score": F.round(score, 6), "match_type": kind}), "score", k)


def rrf_queries(lists: DataFrame, by: str = "group_id", k: int = 15) -> DataFrame:
    """Ranked lists of several variants of a query (group_id, variant, id, rank) fused by unweighted
    reciprocal ranks, with appearances, mean rank (from 0) and the variants that found a row."""
    fused = lists.groupBy(by, "id").agg(F.round(F.sum(rank.reciprocal(F.col("rank"))), 6).alias("score"), F.count(F.lit(1)).alias("appearances"), F.round(F.avg(F.col("rank") - 1), 6).alias("avg_rank"), F.array_sort(F.collect_set("variant")).alias("variants"))
    return ranked(fused, "score", by=(by,)).filter(F.col("rank") <= k)


def hybrid_index(chunks: DataFrame, index: text_index.TextIndex, query: list[float], words: str, semantic: float = 0.7, keyword: float = 0.3, threshold: float = 0.0, k: int = 10, **equal) -> DataFrame:
    """Weighted search driven by the vectors, with the index' grammar and normalised cover rank."""
    rows = chunks.filter(where(**equal) & F.col("embedding").isNotNull()).select("id", F.round(vector.cosine_to(F.col("embedding"), query), 6).alias("semantic_score"))
    found = index.matches(words).select("id", F.round(F.col("rank") / (F.col("rank") + 1), 6).alias("keyword_score"))
    scored = rows.join(found, "id", "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    return top(scored.withColumn("combined_score", F.round(semantic * F.col("semantic_score") + keyword * F.col("keyword_score"), 6)), "combined_score", k, above=threshold)


def multi_source_index(chunks: DataFrame, documents: DataFrame, index: text_index.TextIndex, query: list[float], words: str, kinds: list[str], semantic: float = 0.5, keyword: float = 0.5, k: int = 15, **equal) -> DataFrame:
    """Chunks of completed documents (doc_id, status, source_type) of some kinds, scored by vector and
    cover rank; no word has to match, but rows without an embedding are left out."""
    some = documents.filter((F.col("status") == "completed") & F.col("source_type").isin(kinds)).select("doc_id", "source_type")
    rows = chunks.filter(where(**equal) & F.col("embedding").isNotNull()).join(some, "doc_id").select("id", "source_type", "embedding")
    score = semantic * vector.cosine_to(F.col("embedding"), query) + keyword * F.coalesce("rank", F.lit(0.0))
    return top(rows.join(index.matches(words), "id", "left").select("id", "source_type", F.round(score, 6).alias("score")), "score", k)


def rrf_index(chunks: DataFrame, index: text_index.TextIndex, query: list[float], words: str, fts: float = 0.4, vec: float = 0.6, k: int = 10, **equal) -> DataFrame:
    """Two ranked lists of 2k, of the index and of the vectors above 0.1, fused by weighted reciprocal
    ranks; conditions on the chunk hold for both lists."""
    rows = chunks.filter(where(**equal))
    near = rows.filter("embedding is not null").select("id", F.round(vector.cosine_to(F.col("embedding"), query), 6).alias("v"))
    numbered = lambda df, score, out: ranked(df, score, out).select("id", out)  # noqa: E731  of 2k rows
    a = numbered(index.search(words, 2 * k, among=rows if equal else None), "score", "fts_rank")
    b = numbered(top(near, "v", 2 * k, above=0.1), "v", "vector_rank")
    kind = F.when(F.col("fts_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "fts").otherwise("both")
    score = rank.reciprocal(F.col("fts_rank"), fts) + rank.reciprocal(F.col("vector_rank"), vec)
    return top(a.join(b, "id", "full").withColumns({"score": F.round(score, 6), "match_type": kind}), "score", k)


def golden(ranked_: DataFrame) -> DataFrame:
    """Ten golden and five backup rows by rank."""
    return ranked_.filter("rank <= 15").withColumn("tier", F.when(F.col("rank") <= 10, "golden").otherwise("backup"))


def merged_golden(lists: DataFrame, by: str = "query_id", k: int = 5) -> DataFrame:
    """Rows of several documents' result lists, the best five of each query."""
    return ranked(lists, "score", by=(by,)).filter(F.col("rank") <= k)


def keyword_search(df: DataFrame, column: str, terms: list[str], k: int = 20, any_: bool = False) -> DataFrame:
    """Rows with all (or any) terms, by normalised term frequency."""
    rows = df.withColumn("__w", text.spaced(column))
    found = rank.any_term(F.col("__w"), terms) if any_ else rank.all_terms(F.col("__w"), terms)
    return top(rows.withColumn("score", F.when(found, F.round(rank.tf_norm(F.col("__w"), terms), 6))).drop("__w"), "score", k, above=-1)


def bm25_search(df: DataFrame, column: str, terms: list[str], k: int = 10) -> DataFrame:
    """BM25 over (id, text): one pass counts each row's terms and size, the corpus' counts come from
    these, and the best rows from both."""
    rows = df.select("id", text.spaced(column).alias("__w"))
    counted = materialize(rows.select("id", text.token_count(F.col("__w")).alias("size"), *(text.token_hits(F.col("__w"), t).alias(f"tf{i}") for i, t in enumerate(terms))), "term-counts")
    all_ = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score = rank.bm25({t: F.col(f"tf{i}") for i, t in enumerate(terms)}, F.col("size"), all_.n, {t: all_[f"df{i}"] for i, t in enumerate(terms)}, all_.avg or 1.0)
    return top(counted.select("id", F.round(score, 6).alias("score")).filter("score > 0"), "score", k)


def list_documents(index: DataFrame, page: int = 1, size: int = 20, search: str | None = None, **equal) -> DataFrame:
    """A page of the catalog, with the number of rows that match in all."""
    cond = where(**equal)
    if search:
        cond = cond & (F.col("title").ilike(f"%{search}%") | F.col("summary").ilike(f"%{search}%"))
    found, size = index.filter(cond), min(size, 100)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.col("id").desc()).offset((page - 1) * size).limit(size).join(F.broadcast(total), F.lit(True))  # a page and a single row


def fuzzy_search(index: DataFrame, query: str, column: str = "title", threshold: float = 0.3, k: int = 20) -> DataFrame:
    """Trigram similarity above the threshold, or the query as a substring."""
    sim = F.round(text.trigram_similarity(F.col(column), F.lit(query)), 6)
    return top(index.withColumn("similarity", sim).filter((F.col("similarity") > threshold) | F.col(column).ilike(f"%{query}%")), "similarity", k)


def route(index: DataFrame, query: str, n: int = 3) -> DataFrame:
    """Documents for a query: summaries that have any term; without any, titles; without any, all.

    One pass gives every row its stage, and the least stage that has rows is kept.
    """
    terms = [t for t in query.lower().split() if t]
    low = index.select("id", F.lower("title").alias("t"), F.lower("summary").alias("s"), text.spaced("summary").alias("w"))
    in_title = {t: F.contains("t", F.lit(t)) for t in terms}
    stage = F.when(rank.any_term(F.col("w"), terms), 1).when(reduce(lambda a, b: a | b, in_title.values(), F.lit(False)), 2).otherwise(3)
    points = sum((in_title[t].cast("int") * 3 + F.contains("s", F.lit(t)).cast("int") for t in terms), F.lit(0))
    whole = F.contains(F.concat_ws(" ", "t", "s"), F.lit(query.lower())).cast("int") * 5
    scored = low.select("id", stage.alias("stage"), (points + whole).alias("points"))
    best = top(scored.orderBy("stage", F.col("points").desc(), "id").limit(2 * n), "points", 2 * n)
    least = best.agg(F.min("stage").alias("least"))
    return best.join(F.broadcast(least), F.col("stage") == F.col("least")).orderBy(F.col("points").desc(), "id").limit(n).drop("least")


def cached_answer(cache: DataFrame, question: str, doc: str, query: list[float] | None, as_of, ttl_days: int = 7, similar: float = 0.95) -> DataFrame:
    """The cached answer of the same question, else the nearest of the document above ``similar``."""
    live = cache.filter((F.col("doc") == doc) & (F.col("created_at") > F.lit(as_of) - F.expr(f"interval {ttl_days} days")))
    key = text.cache_key(F.lit(question), F.lit(doc))
    match = F.when(F.col("cache_key") == key, F.lit(2.0))
    if query is not None:
        sim = F.round(vector.cosine_to(F.col("embedding"), query), 6)
        match = match.otherwise(F.when(sim >= similar, sim))
    return top(live.withColumn("match", match).filter("match is not null"), "match", 1)


def web_search(df: DataFrame, column: str, query: str, k: int = 20) -> DataFrame:
    """Rows that meet a query of the search grammar, by normalised frequency of its stems."""
    parsed = grammar.parse(query)
    rows, words = df.withColumn("__words", grammar.words(column)), F.col("__words")
    return top(rows.withColumn("score", F.when(grammar.matches(words, parsed), F.round(grammar.rank(words, parsed), 6))).drop("__words"), "score", k, above=-1)


def tagged(column: str, tag: str) -> Column:
    """Whether a JSON array of tags has one."""
    return F.coalesce(F.array_contains(F.from_json(F.col(column), "array<string>"), tag), F.lit(False))
