"""Parsed documents and videos: items, outlines, assets, sections, samples, pages of time."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.functions.ranges import span
from ravine.functions import text as T
from ravine.operators import folds
from ravine.operators.ingest import element_type, heading_level

#: Image sizes, ratio and repeats of the image rules, and words of captions.
LEAST_SIDE, LARGE_SIDE, MOST_RATIO, MOST_REPEATS, LEAST_COMPLEXITY = 80, 150, 5.0, 3, 0.1
TECHNICAL_KEYWORDS = ["block", "diagram", "module", "slot", "controller", "board", "card", "terminal", "connector", "port", "panel", "enclosure", "cabinet", "sensor", "actuator", "valve", "relay", "switch", "wiring", "schematic", "circuit", "connection", "cable", "wire", "pinout", "terminal", "junction", "harness", "screen", "interface", "display", "menu", "dialog", "window", "button", "field", "form", "view", "editor", "workspace", "flowchart", "flow", "topology", "architecture", "layout", "structure", "hierarchy", "tree", "network", "map", "chart", "graph", "plot", "table", "matrix", "grid", "timeline", "gantt", "histogram", "trend", "drawing", "blueprint", "specification", "dimension", "elevation", "section", "detail", "assembly", "exploded", "cutaway", "system", "configuration", "setup", "installation", "mounting", "placement", "location", "positioning"]
DECORATIVE_KEYWORDS = ["logo", "trademark", "copyright", "watermark", "banner", "header", "footer", "icon", "bullet", "decoration", "divider", "separator", "border", "frame"]
#: Seconds of an audio part, of a page of time; segments that a chapter search takes.
PART_SECONDS, PAGE_SECONDS, SAMPLE_SEGMENTS = 1200, 60, 100
#: Words that are no key topics.
COMMON_WORDS = ["about", "there", "their", "where", "which", "these", "those"]


def typed_elements(items: DataFrame) -> DataFrame:
    """Parsed items with a page and a text, as elements with type and heading level."""
    ok = items.filter(F.col("page_no").isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    return ok.withColumns({"type": element_type(F.col("label")), "level": heading_level(F.col("label"))})


def pictures(docs: DataFrame, column: str = "pictures") -> DataFrame:
    """A row for each picture of a document's JSON: place, joined captions, size of the decoded image."""
    items = F.from_json(column, "array<struct<image:string,captions:array<string>,page_no:int>>")
    rows = docs.select("doc_id", F.posexplode(items).alias("idx", "p"))
    return rows.select("doc_id", "idx", F.col("p.page_no").alias("page_no"), F.array_join("p.captions", " ").alias("caption"), F.length(F.unbase64("p.image")).alias("bytes"))


def tables(docs: DataFrame, column: str = "tables") -> DataFrame:
    """A row for each table of a document's JSON: rows, columns and markdown."""
    items = F.from_json(column, "array<struct<cells:array<array<string>>,page_no:int>>")
    rows = docs.select("doc_id", F.posexplode(items).alias("idx", "t"))
    cells = F.col("t.cells")
    return rows.select("doc_id", "idx", F.col("t.page_no").alias("page_no"), F.size(cells).alias("n_rows"), F.coalesce(F.size(F.get(cells, F.lit(0))), F.lit(0)).alias("n_columns"), markdown(cells).alias("markdown"))


def markdown(rows: Column) -> Column:
    """A table of cells as markdown, each line ended; empty below two rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")), "|"), F.lit("|\n"))
    body = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), line), "")
    return F.when(F.size(rows) >= 2, F.concat(line(F.get(rows, F.lit(0))), rule, body)).otherwise(F.lit(""))


def _plain(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", "")


def containing(patterns: Iterable[str], texts: dict[str, list]) -> dict[str, list]:
    """For each pattern what stands under the texts that contain it. Every start in a text is looked up by the
    lengths of the patterns that begin with its four characters, so no pattern meets every text."""
    known, sizes, out = set(patterns), {}, {}
    for p in known:
        sizes.setdefault(p[:4] if len(p) >= 4 else None, set()).add(len(p))
    short = sizes.pop(None, set())
    for text, rows in texts.items():
        seen = set()
        for i in range(len(text) + 1):
            seen.update(text[i : i + n] for n in sizes.get(text[i : i + 4], ()) if i + n <= len(text))
            seen.update(text[i : i + n] for n in short if i + n <= len(text))
        for p in seen & known:
            out.setdefault(p, []).extend(rows)
    return out


def greedy_titles(bookmarks: list[tuple[int, str]], headings: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(b, h, score): each bookmark's heading by the rule of ``outline_sections``; work and memory grow with the
    titles and their matches, not with all pairs."""
    of: dict[str, list[int]] = {}
    for h, title in headings:
        of.setdefault(title, []).append(h)
    marks: dict[int, set[str]] = {}
    for b, title in bookmarks:
        marks.setdefault(b, set()).add(title)
    titles = {t for _, t in bookmarks}
    words = {t: [w for w in dict.fromkeys(re.split(r"[ \t\n\x0b\f\r]+", t)) if len(w) > 3] for t in titles}
    inside = containing(titles, of)
    for ht, some in containing(of, {t: [t] for t in titles}).items():
        for t in some:
            inside.setdefault(t, []).extend(of[ht])
    holding = containing({w for some in words.values() for w in some}, of)
    lists = {(100, t): sorted(of[t]) for t in titles if t in of} | {(80, t): sorted(v) for t, v in inside.items()} | {(50, w): sorted(v) for w, v in holding.items()}
    at, used, out = dict.fromkeys(lists, 0), set(), []

    def first(key):
        rows = lists.get(key, ())
        i = at.get(key, 0)
        while i < len(rows) and rows[i] in used:  # each place is passed once
            i += 1
        at[key] = i
        return rows[i] if i < len(rows) else None

    for b in sorted(marks):
        for score in (100, 80, 50):
            keys = [k for t in marks[b] for k in (words[t] if score == 50 else [t])]
            found = [h for h in (first((score, k)) for k in keys) if h is not None]
            if found:
                used.add(min(found))
                out.append((b, min(found), score))
                break
    return out


def _taken(bookmarks: pa.Table, headings: pa.Table) -> pa.Table:
    """The chosen headings of one document's outline."""
    rows = lambda t, *names: list(zip(*(t.column(c).to_pylist() for c in names)))
    chosen = greedy_titles(rows(bookmarks, "b", "bt"), rows(headings, "h", "ht"))
    page, doc = dict(rows(headings, "h", "found_page")), bookmarks.column("doc_id")[0].as_py() if bookmarks.num_rows else None
    columns = [[doc] * len(chosen), *([c[k] for c in chosen] for k in range(3)), [page[h] for _, h, _ in chosen]]
    schema = pa.schema([("doc_id", pa.int64()), ("b", pa.int32()), ("h", pa.int32()), ("score", pa.int32()), ("found_page", pa.int32())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def outline_sections(bookmarks: DataFrame, headings: DataFrame) -> DataFrame:
    """Sections from bookmarks (doc_id, idx, title, level, page) and found headings (doc_id, idx, title, page).

    Each bookmark in order takes the heading with the best score that none before it took: equal
    titles (100), one in the other (80), a longer word of it in the heading (50); of equal scores
    the first. The page is that of the heading, else the bookmark's own. The choice is sequential, so
    a document's titles are one group.
    """
    b = bookmarks.select("doc_id", F.col("idx").alias("b"), _plain(F.col("title")).alias("bt")).dropna()
    h = headings.select("doc_id", F.col("idx").alias("h"), _plain(F.col("title")).alias("ht"), F.col("page").alias("found_page")).dropna(subset=["doc_id", "ht"])
    chosen = b.groupBy("doc_id").cogroup(h.groupBy("doc_id")).applyInArrow(_taken, "doc_id bigint, b int, h int, score int, found_page int")
    out = bookmarks.join(chosen.select(F.col("doc_id").alias("__d"), F.col("b").alias("__b"), "score", "found_page"), (F.col("doc_id") == F.col("__d")) & (F.col("idx") == F.col("__b")), "left")
    out = out.withColumn("start_page", F.coalesce("found_page", "page")).withColumn("source", F.when(F.col("score").isNotNull(), "bookmark").otherwise("bookmark_only"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_page", "level", "idx")) - 1
    return out.select("doc_id", F.format_string("sec_%04d", number).alias("section_id"), "title", "level", "start_page", "source", "score")


def chunk_elements(elements: DataFrame, sections: DataFrame | None = None, target: int = 1200, least: int = 150, least_element: int = 30) -> DataFrame:
    """Elements (doc_id, page_no, idx, type, text) to chunks; see ``folds.greedy_chunks``.

    Noise goes first: short elements, file names, page numbers and lines under 60 characters that
    a document has more than three times. ``sections`` (doc_id, section_id, start_page, end_page,
    level, idx, title, number): a header on a section's first page with its title begins it; other
    text starts in its page's deepest section.
    """
    t = F.trim("text")
    e = elements.select("doc_id", "page_no", "idx", (F.col("type") == "section_header").alias("header"), t.alias("text"), F.col("type"))
    often = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text"))
    short = F.length("text") < 60
    noise = (F.length("text") < least_element) | F.col("text").rlike(r"(?i)^.+\.(docx?|pdf)$") | F.col("text").rlike(r"^\s*\d+\s*$") | F.col("text").rlike(r"(?i)^(page|p\.?)\s*\d+\s*$")
    kind = F.col("type").isin("text", "paragraph", "list_item")
    e = e.withColumn("often", F.when(short, often)).filter(F.col("header") | (kind & ~noise & ~(short & (F.col("often") > 3))))
    if sections is None:
        e = e.withColumn("section_id", F.lit(None).cast("string")).withColumn("shown", F.col("text"))
    else:
        titles = sections.select("doc_id", F.col("start_page").alias("page_no"), F.trim("title").alias("text"), F.col("section_id").alias("begins"), F.concat_ws(" ", F.nullif("number", F.lit("")), "title").alias("full"))
        first = titles.groupBy("doc_id", "page_no", "text").agg(F.min("begins").alias("begins"), F.min_by("full", "begins").alias("full"))
        pages = sections.withColumn("page_no", F.explode(span("start_page", "end_page"))).groupBy("doc_id", "page_no").agg(F.max_by("section_id", F.struct("level", "idx")).alias("deepest"))
        e = e.join(first, ["doc_id", "page_no", "text"], "left").join(pages, ["doc_id", "page_no"], "left")
        e = e.withColumn("section_id", F.when(F.col("header"), F.col("begins")).otherwise(F.col("deepest"))).withColumn("shown", F.when(F.col("header"), F.col("full")).otherwise(F.col("text")))
    rows = e.select("doc_id", "page_no", "idx", "section_id", "header", F.col("shown").alias("text"))
    return folds.fold(rows, "doc_id", ["page_no", "idx"], folds.greedy_chunks(target, least), "doc_id bigint, chunk_no int, page_no int, section_id string, n_elements int, length int, text string")


def page_index(elements: DataFrame, chunks: DataFrame, assets: DataFrame, sections: DataFrame, k: int = 5) -> DataFrame:
    """Pages with chunks: their number, key topics, images and tables, and the sections that cover them.

    Key topics are the first k, in order, of the page's longer alphabetic words.
    """
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$") & ~w.isin(*COMMON_WORDS))
    topics = elements.groupBy("doc_id", "page_no").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(words))))), 1, k).alias("key_topics"))
    counts = chunks.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("chunk_count"))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    held = assets.groupBy("doc_id", "page_no").agg(of("image").alias("image_count"), of("table").alias("table_count"))
    covered = sections.withColumn("page_no", F.explode(span("start_page", "end_page"))).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("section_id")).alias("section_ids"))
    on = ["doc_id", "page_no"]
    out = counts.join(topics, on, "left").join(held, on, "left").join(covered, on, "left").fillna(0, ["image_count", "table_count"])
    none = F.array().cast("array<string>")
    return out.select(*on, "chunk_count", F.coalesce("key_topics", none).alias("key_topics"), "image_count", (F.col("image_count") > 0).alias("has_images"), "table_count", (F.col("table_count") > 0).alias("has_tables"), F.coalesce("section_ids", none).alias("section_ids"))


def image_rules(images: DataFrame) -> DataFrame:
    """Images (doc_id, idx, width, height, hash, caption, complexity) with ``keep`` and ``reason``.

    An image that passes the size rules counts towards the repeats of its hash in its document.
    """
    w, h = F.col("width"), F.col("height")
    small = (w < LEAST_SIDE) | (h < LEAST_SIDE)
    thin = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1)) > MOST_RATIO
    seen = F.sum((~small & ~thin).cast("int")).over(Window.partitionBy("doc_id", "hash").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    caption = F.lower(F.coalesce("caption", F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(caption, F.lit(x)) for x in dict.fromkeys(words)])
    large, bare = (w >= LARGE_SIDE) & (h >= LARGE_SIDE), F.length(F.trim(caption)) < 5
    reason = (
        F.when(small, "too_small").when(thin, "extreme_ratio").when(seen > MOST_REPEATS, "repeated").when(has(DECORATIVE_KEYWORDS), "decorative")
        .when(bare & large & (F.col("complexity") > LEAST_COMPLEXITY), "complex").when(bare & large, "simple").when(bare, "no_caption")
        .when(has(TECHNICAL_KEYWORDS), "technical").when(large, "captioned").otherwise("unclear")
    )
    return images.withColumn("reason", reason).withColumn("keep", F.col("reason").isin("complex", "technical", "captioned"))


def image_stats(judged: DataFrame) -> DataFrame:
    """Images processed, kept and skipped, the share kept and how many different ones passed the size rules."""
    new = F.count_distinct(F.when(~F.col("reason").isin("too_small", "extreme_ratio"), F.struct("doc_id", "hash")))
    out = judged.agg(F.count(F.lit(1)).alias("processed"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("skipped"), new.alias("unique_images"))
    return out.withColumn("keep_rate", F.round(F.col("kept") / F.greatest("processed", F.lit(1)), 6))


def content_sample(elements: DataFrame) -> DataFrame:
    """What a summary is made from: rows (doc_id, part, n, text).

    The first page's first ten longer texts, the first twenty headers of the first ten pages, and
    longer ones of the middle page's first five elements, of a document with more than three pages.
    """
    pages = Window.partitionBy("doc_id").orderBy("page_no")
    e = elements.withColumn("p", F.dense_rank().over(pages) - 1)
    e = e.withColumn("pages", F.max("p").over(Window.partitionBy("doc_id")) + 1).withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("idx")))
    t = F.trim("text")
    middle = (F.col("pages") > 3) & (F.col("p") == F.floor(F.col("pages") / 2)) & (F.col("i") <= 5) & (F.length(t) > 30)
    head = (F.col("p") < 10) & (F.col("type") == "section_header") & (t != "")
    parts = F.array(F.when((F.col("p") == 0) & (F.length(t) > 20), "first_page"), F.when(head, "headers"), F.when(middle, "middle"))
    rows = e.select("doc_id", "page_no", "idx", t.alias("text"), F.explode(F.array_compact(parts)).alias("part"))
    n = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("page_no", "idx"))
    most = F.when(F.col("part") == "first_page", 10).when(F.col("part") == "headers", 20).otherwise(5)
    return rows.withColumn("n", n).filter(F.col("n") <= most).select("doc_id", "part", "n", "text")


def dominance(chunks: DataFrame) -> DataFrame:
    """Per document: its most frequent top-level section's share, spread of pages, sections, and whether
    it is a whole system's (share below 0.7, more than 50 pages and 8 sections). chunks: doc_id, top, section_id, page_number."""
    of = chunks.groupBy("doc_id", "top").agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("a"), F.max("page_number").alias("b"))
    kinds = chunks.groupBy("doc_id").agg(F.count_distinct("section_id").alias("sections"))
    out = of.groupBy("doc_id").agg(F.max_by("top", F.struct("n", "top")).alias("dominant"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), (F.max("b") - F.min("a")).alias("page_spread"))
    return out.join(kinds, "doc_id").withColumn("whole_system", (F.col("share") < 0.7) & (F.col("page_spread") > 50) & (F.col("sections") > 8))


def every_nth(segments: DataFrame, key: str = "key", order: str = "seq", most: int = SAMPLE_SEGMENTS) -> DataFrame:
    """Every (n div most)-th segment of a key with more than ``most``, else all."""
    w = Window.partitionBy(key)
    out = segments.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    return out.filter((F.col("__n") <= most) | (F.col("__i") % F.greatest(F.expr(f"__n div {most}"), F.lit(1)) == 0)).drop("__i", "__n")


def joined_parts(segments: DataFrame, seconds: int = PART_SECONDS) -> DataFrame:
    """Segments of audio parts (part, start_s, end_s) on the whole recording's clock."""
    return segments.withColumns({c: F.col(c) + F.col("part") * seconds for c in ("start_s", "end_s")})


def one_chapter(segments: DataFrame, title: str = "title") -> DataFrame:
    """The fallback: a single chapter from 0 to the last segment's end."""
    return segments.groupBy("key").agg(F.min(title).alias("title"), F.lit(0).cast("long").alias("start_s"), F.max("end_s").alias("end_s"))


def video_pages(segments: DataFrame, seconds: int = PAGE_SECONDS) -> DataFrame:
    """Pages of time: the segments that begin in [page * seconds, (page + 1) * seconds), their texts
    in order; a page without any is left out. segments: key, at, seq, end_s, text."""
    page = F.floor(F.col("at") / seconds).cast("int")
    found = segments.withColumn("page_no", page).groupBy("key", "page_no").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "text"))).alias("e"))
    last = segments.groupBy("key").agg(F.max("end_s").alias("duration"))
    out = found.join(last, "key")
    return out.select("key", "page_no", (F.col("page_no") * seconds).cast("long").alias("start_s"), F.least((F.col("page_no") + 1) * seconds, F.col("duration")).cast("long").alias("end_s"), F.size("e").alias("n"), F.array_join(F.transform("e", lambda x: x["text"]), " ").alias("text"))


def merged_shots(scenes: DataFrame, intervals: DataFrame, gap: float = 5) -> DataFrame:
    """Screenshots (key, at) of both methods, without those within ``gap`` seconds of the last one kept."""
    both = scenes.select("key", "at").unionByName(intervals.select("key", "at"))
    return folds.fold(both, "key", ["at"], folds.spaced(gap), "key bigint, at bigint")
