"""Trees of any depth by recursive SQL: nested outlines, section paths, ancestors."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ravine.sources.shared import materialize

#: Levels at most; a tree that has more, or a circle, is an error.
LEVELS = 1000


@contextmanager
def _unbounded(spark: SparkSession):
    """Recursion stops by itself at the leaves, not after a number of rows."""
    want = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(LEVELS)}
    before = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def recursive(spark: SparkSession, query: str, name: str, **frames: DataFrame) -> DataFrame:
    """A recursive query over some DataFrames, written once."""
    with _unbounded(spark):
        return materialize(spark.sql(query, **frames), name)


def outline(docs: DataFrame, column: str = "outline") -> DataFrame:
    """A nested outline in JSON as rows (doc_id, place, title, level, page), the page 1 by default;
    ``place`` sorts them as they stand. Null and what is no JSON gives none."""
    query = f"""
    WITH RECURSIVE items(doc_id, place, level, item) AS (
      SELECT doc_id, format_string('%04d.', pos), 1, value FROM {{docs}}, LATERAL variant_explode(try_parse_json(`{column}`))
      UNION ALL
      SELECT i.doc_id, concat(i.place, format_string('%04d.', pos)), i.level + 1, value
      FROM items i, LATERAL variant_explode(try_variant_get(i.item, '$.children', 'variant')))
    SELECT doc_id, place, try_variant_get(item, '$.title', 'string') AS title, level, coalesce(try_variant_get(item, '$.page', 'int'), 1) AS page FROM items"""
    return recursive(docs.sparkSession, query, "outline", docs=docs)


def ancestors(sections: DataFrame) -> DataFrame:
    """(doc_id, idx, ancestor, distance) of every section (doc_id, idx, parent_idx) and all above it."""
    query = """
    WITH RECURSIVE up(doc_id, idx, ancestor, distance) AS (
      SELECT doc_id, idx, parent_idx, 1 FROM {sections} WHERE parent_idx IS NOT NULL
      UNION ALL
      SELECT up.doc_id, up.idx, s.parent_idx, up.distance + 1 FROM up JOIN {sections} s ON s.doc_id = up.doc_id AND s.idx = up.ancestor WHERE s.parent_idx IS NOT NULL)
    SELECT * FROM up"""
    return recursive(sections.sparkSession, query, "ancestors", sections=sections.select("doc_id", "idx", "parent_idx"))


def paths(sections: DataFrame, separator: str = " > ") -> DataFrame:
    """(doc_id, idx, level, path) of every section (doc_id, idx, parent_idx, title) that hangs on a root: the
    titles from the root to it."""
    query = f"""
    WITH RECURSIVE down(doc_id, idx, level, path) AS (
      SELECT doc_id, idx, 1, title FROM {{sections}} WHERE parent_idx IS NULL
      UNION ALL
      SELECT s.doc_id, s.idx, down.level + 1, concat(down.path, '{separator}', s.title) FROM down JOIN {{sections}} s ON s.doc_id = down.doc_id AND s.parent_idx = down.idx)
    SELECT * FROM down"""
    return recursive(sections.sparkSession, query, "paths", sections=sections.select("doc_id", "idx", "parent_idx", "title"))
