"""Reads by key, page, section and time: chunks, sections, assets, screenshots, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions.ranges import span
from ravine.operators.search import where


def details(index: DataFrame, id_: object, key: str = "id") -> DataFrame:
    """A document's row."""
    return index.filter(F.col(key) == id_)


def chunks_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of a list of ids, by page and id."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi").orderBy("page_number", "id")


def with_document(chunks: DataFrame, index: DataFrame, *columns: str, status: str | None = "completed", key: str = "doc_id") -> DataFrame:
    """Chunks with columns of their document; only of documents with a status, if one is asked for."""
    docs = index.filter(F.col("status") == status) if status else index
    return chunks.join(docs.select(F.col("id").alias(key), *columns), key)


def sections_of_chunks(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each chunk the sections of its document that list its id."""
    listed = sections.select("doc_id", "section_id", F.explode("chunk_ids").alias("id"))
    return listed.join(chunks.select("doc_id", "id"), ["doc_id", "id"])


def covering_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """All sections that cover a page: a section is dealt to each of its pages."""
    dealt = sections.withColumn("page_no", F.explode(span("start_page", "end_page")))
    return pages.join(dealt, ["doc_id", "page_no"])


def assets_of_chunks(chunks: DataFrame, assets: DataFrame, k: int = 5) -> DataFrame:
    """For each chunk the first k assets of its document and page."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("asset_id")
    first = assets.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")
    return chunks.join(first, ["doc_id", "page_number"])


def assets_by_pages(assets: DataFrame, doc: object, pages: list[int] | None = None, k: int | None = 10) -> DataFrame:
    """A document's assets, on the given pages, the first k by page and id."""
    out = assets.filter(where(doc_id=doc, page_number=pages)).orderBy("page_number", "asset_id")
    return out.limit(k) if k else out


def on_pages_or_sections(assets: DataFrame, doc: object, sections: list[str], pages: list[int]) -> DataFrame:
    """A document's assets in one of the sections or on one of the pages."""
    return assets.filter(where(doc_id=doc) & (F.col("section_id").isin(*sections) | F.col("page_number").isin(*pages)))


def in_sections_or_none(assets: DataFrame, docs: list, sections: list[str], **include: bool) -> DataFrame:
    """Assets of the documents in one of the sections or in none; ``include`` says which optional
    columns the result has."""
    out = assets.filter(where(doc_id=docs) & (F.col("section_id").isin(*sections) | F.col("section_id").isNull()))
    return out.drop(*(c for c, yes in include.items() if not yes))


def section_of_asset(assets: DataFrame, index: DataFrame) -> DataFrame:
    """Assets with the section that the index has for their id (null: none)."""
    return assets.join(index.select("asset_id", F.col("section_id").alias("indexed")), "asset_id", "left").withColumn("section_id", F.coalesce("section_id", "indexed")).drop("indexed")


def between(at: str, start: float | None = None, end: float | None = None) -> Column:
    """A closed range with optional bounds."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(at) >= start)
    if end is not None:
        out = out & (F.col(at) <= end)
    return out


def around(shots: DataFrame, doc: object, start: float, end: float, slack: float = 2, k: int = 3) -> DataFrame:
    """The first k screenshots from ``slack`` seconds before a span to as long after it."""
    return shots.filter(where(doc_id=doc) & between("at", start - slack, end + slack)).orderBy("at", "asset_id").limit(k)


def first_around(spans: DataFrame, shots: DataFrame, slack: int = 2, k: int = 3, width: int = 60) -> DataFrame:
    """``around`` for a table of spans (span_id, doc_id, start_s, end_s): an equi-join on time buckets."""
    dealt = spans.withColumn("__b", F.explode(span(F.floor((F.col("start_s") - slack) / width), F.floor((F.col("end_s") + slack) / width))))
    p = shots.withColumn("__b", F.floor(F.col("at") / width))
    near = dealt.join(p, ["doc_id", "__b"]).filter(F.col("at").between(F.col("start_s") - slack, F.col("end_s") + slack))
    w = Window.partitionBy("span_id").orderBy("at", "asset_id")
    return near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("span_id", "n", "asset_id", "at")


def visible_jobs(jobs: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Active jobs, and ended ones for some minutes after their last update."""
    recent = F.col("updated_at") > F.lit(as_of) - F.expr(f"interval {minutes} minutes")
    return jobs.filter(F.col("status").isin("queued", "processing") | (F.col("status").isin("completed", "failed", "cancelled") & recent))


def lacking(df: DataFrame, column: str, *, given: str | None = None) -> DataFrame:
    """Rows without a value in a column (and with a text in ``given``)."""
    cond = F.col(column).isNull()
    return df.filter(cond & (F.length(F.trim(F.coalesce(given, F.lit("")))) > 0) if given else cond)


def missing_names(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """Which of the expected names no row's JSON object has. Null and what is no object has none."""
    have = rows.select(F.explode(F.json_object_keys(column)).alias("name")).distinct()
    return rows.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(names)], "name string").join(have, "name", "left_anti")


def literals(spark, **values: str) -> DataFrame:
    """A union of literal rows (name, value)."""
    out = None
    for k, v in values.items():
        one = spark.range(1).select(F.lit(k).alias("name"), F.lit(v).alias("value"))
        out = one if out is None else out.union(one).distinct()
    return out
