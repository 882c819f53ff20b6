"""A parsed document's hierarchy: sections, chunks, assets and page index in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ravine.operators import expand, ingest, structure


def html_items(pages: DataFrame) -> DataFrame:
    """The headings, paragraphs and list items of HTML pages as parsed items (doc_id, page_no, idx,
    label, text): the offline stand-in for a document parser."""
    tags = r"(?s)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</\1>"
    found = F.posexplode(F.regexp_extract_all("html", F.lit(tags), F.lit(0)))
    e = pages.select(F.col("page_id").alias("doc_id"), found.alias("idx", "e"))
    tag = F.regexp_extract("e", r"^<(h[1-6]|p|li)", 1)
    text = F.btrim(F.regexp_replace(F.regexp_replace("e", "<[^>]*>", " "), r"\s+", " "))
    label = F.when(tag.startswith("h"), F.concat(F.lit("section-"), F.substring(tag, 2, 1), F.lit("-header"))).when(tag == "li", "list_item").otherwise("text")
    return e.select("doc_id", F.lit(1).alias("page_no"), "idx", label.alias("label"), text.alias("text"))


def sections(elements: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
    """Sections of elements (doc_id, page_no, idx, type, text): headers outside the contents pages that
    pass the noise filters; with bookmarks, these, on the pages of the headers that they match.

    doc_id, section_id, idx, title, level, start_page, end_page, number, parent_section_id, path.
    """
    contents = ingest.toc_pages(elements).filter("is_toc").select("doc_id", "page_no")
    heads = elements.filter("type = 'section_header'").join(contents, ["doc_id", "page_no"], "left_anti")
    found = ingest.headings(heads.select("doc_id", "page_no", "idx", F.trim("text").alias("text")))
    if bookmarks is not None:
        named = structure.outline_sections(bookmarks, found.select("doc_id", "idx", F.col("text").alias("title"), F.col("page_no").alias("page")))
        found = named.select("doc_id", F.substring("section_id", 5, 10).cast("int").alias("idx"), F.col("title").alias("text"), F.col("start_page").alias("page_no"), "section_id", "level")
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+){0,3})\.?\s+\S", 1)
    s = found.select("doc_id", "section_id", "idx", F.col("text").alias("title"), F.least("level", F.lit(4)).alias("level"), F.col("page_no").alias("start_page"), F.col("page_no").alias("end_page"), F.lit("").alias("number"), number.alias("shown"))
    tree = ingest.section_parents(s.select("doc_id", "idx", "level")).select("doc_id", "idx", "parent_idx")
    paths = ingest.section_paths(s.select("doc_id", "idx", "level", "title"))
    ids = s.select("doc_id", F.col("idx").alias("parent_idx"), F.col("section_id").alias("parent_section_id"))
    return s.drop("shown").join(tree, ["doc_id", "idx"]).join(ids, ["doc_id", "parent_idx"], "left").drop("parent_idx").join(paths, ["doc_id", "idx"])


def hierarchy(elements: DataFrame, bookmarks: DataFrame | None = None, assets: DataFrame | None = None) -> dict[str, DataFrame]:
    """All phases over typed elements (doc_id, page_no, idx, type, text): sections with tree, paths and
    chunk ranges; chunks with topics; assets (asset_id, doc_id, page_no, kind) with the deepest
    section of their page; the page index."""
    of = sections(elements, bookmarks)
    chunks = structure.chunk_elements(elements, of).join(of.select("doc_id", "section_id", "title", "path", F.col("level").alias("section_level"), "parent_section_id"), ["doc_id", "section_id"], "left")
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("Unknown")), "text"))
    chunks = chunks.withColumn("__low", low).withColumn("topics", ingest.topics(F.col("__low"))).drop("__low", "title")
    chunks = chunks.withColumns({"topic": F.get("topics", F.lit(0)), "id": F.format_string("%d_chunk_%06d", "doc_id", "chunk_no")})
    ranges = chunks.filter("section_id is not null").groupBy("doc_id", "section_id").agg(F.min("chunk_no").alias("first_chunk"), F.max("chunk_no").alias("last_chunk"), F.count(F.lit(1)).alias("chunk_count"))
    if assets is None:
        assets = elements.sparkSession.createDataFrame([], "asset_id long, doc_id long, page_no int, kind string")
    placed = expand.deepest_section(assets, of)
    return {"sections": of.join(ranges, ["doc_id", "section_id"], "left"), "chunks": chunks, "assets": placed, "page_index": structure.page_index(elements, chunks, assets, of)}
