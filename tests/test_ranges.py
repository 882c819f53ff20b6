"""Assets of a document, points that repeat, ranges that end before they start."""

from __future__ import annotations

from ravine.operators import expand


def test_assets_stay_in_their_document(spark):
    chunks = spark.createDataFrame([(1, "a", "s1", 1), (2, "b", "s1", 1), (3, "b", None, 2), (4, None, "s1", 1)], "id bigint, doc_id string, section_id string, page_number int")
    assets = spark.createDataFrame([(10, "a", "s1", 5), (11, "b", None, 1), (12, "b", None, 2), (13, "c", "s1", 1)], "asset_id bigint, doc_id string, section_id string, page_number int")
    got = {r["id"]: r["assets"] for r in expand.attach_assets(chunks, assets).collect()}
    assert got == {1: [10], 2: [11], 3: [12], 4: []}


def test_points_that_repeat_stay(spark):
    points = spark.createDataFrame([(5,), (5,), (70,)], "at bigint")
    intervals = spark.createDataFrame([(0, 10, 1), (4, 6, 2)], "a bigint, z bigint, n int")
    got = sorted((r["at"], r["n"]) for r in expand.first_interval(points, intervals, "at", "a", "z", "n", 10).collect())
    assert got[:2] == [(5, 1), (5, 1)] and got[2] == (70, None)


def test_a_section_that_ends_before_it_starts_covers_nothing(spark):
    pages = spark.createDataFrame([("d", p) for p in range(1, 5)], "doc_id string, page_no int")
    sections = spark.createDataFrame([("d", "x", 3, 2, 1, 0), ("d", "y", 1, 2, 1, 1)], "doc_id string, section_id string, start_page int, end_page int, level int, idx int")
    got = {r["page_no"]: r["section_id"] for r in expand.deepest_section(pages, sections).collect()}
    assert got == {1: "y", 2: "y", 3: None, 4: None}
