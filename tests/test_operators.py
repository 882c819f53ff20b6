"""Literal cases and invariants."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ravine.functions import formats, grammar, rank, text, vector
from ravine.operators import analytics, answers, expand, ingest, pipeline, providers, search, state, structure, understanding as U
from ravine.sources import tables


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_cosine_edges(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    r = one(spark, vector.cosine(v(1.0, 0.0), v(0.0, 2.0)).alias("a"), vector.cosine(v(1.0, 2.0), v(2.0, 4.0)).alias("b"), vector.cosine(v(1.0), v(1.0, 1.0)).alias("c"), vector.cosine(v(0.0, 0.0), v(1.0, 1.0)).alias("d"))
    assert r.a == 0 and math.isclose(r.b, 1) and r.c == 0 and r.d is None


def test_cache_keys(spark):
    key = lambda q: text.cache_key(F.lit(q), F.lit("doc"))
    r = one(spark, key("What is X?").alias("a"), key("  what is x  ").alias("b"), key("what is x ?").alias("c"))
    assert r.a == r.b != r.c


@pytest.mark.parametrize(
    "question,type_,want",
    [("What is a system?", "definition", ("simple", 2, 1)), ("Compare BACnet and Modbus with LON for a JACE", "comparison", ("complex", 9, 3)), ("how to set up the thing with a lot of words and more", "example", ("moderate", 5, 2))],
)
def test_adaptive(spark, question, type_, want):
    q, t = F.lit(question), F.lit(type_)
    level = U.complexity(q, t, U.entity_count(q))
    r = one(spark, level.alias("l"), U.top_k(level, t).alias("k"), U.window(level, t).alias("w"))
    assert (r.l, r.k, r.w) == want


def test_classifier_and_rewriter(spark):
    q = F.lit("how do multi-tier supervisrs share grahics")
    c = U.categories(q)
    r = one(spark, c.alias("c"), U.rewrite(q, c).alias("r"), U.topics_of(c).alias("t"), U.categories(F.lit("zzz")).alias("d"))
    assert r.c[:2] == ["architecture", "graphics"] and r.d == ["configuration"]
    assert r.r == "how do multi-tier supervisors share graphics Niagara BAS/HVAC multi-tier System Database enterprise supervisor"
    assert r.t == ["system_database", "multi_tier_architecture", "graphics"]


def test_metrics_fixture(spark):
    data = [("a", 0.85, "system_database", ["system_database", "architecture"]), ("b", 0.78, "graphics", ["graphics"]), ("c", 0.72, "provisioning", ["provisioning"]), ("d", 0.68, "multi_tier_architecture", ["multi_tier_architecture"]), ("e", 0.65, "graphics", ["graphics"])]
    df = spark.createDataFrame([(0, i + 1, *r[1:]) for i, r in enumerate(data)], "query_id int, rank int, score double, topic string, topics array<string>")
    m = analytics.retrieval_metrics(df, ["system_database", "multi_tier_architecture", "graphics"]).first()
    assert (m.n, m.avg_score, m.max_score, m.min_score, m.coverage, m.diversity) == (5, 0.736, 0.85, 0.65, 0.8, 5)
    assert m.variance == 0.005144


def test_topic_rules(spark):
    r = one(spark, ingest.topics(F.lit("backup and restore the station"), F.lit("provisioning")).alias("a"), ingest.topics(F.lit("zzz")).alias("b"), ingest.backfill(F.lit("the system database is multi-tier")).alias("c"))
    # substrings, not words: "io" occurs in "station"
    assert r.a == ["provisioning", "hardware"] and r.b == ["other"] and r.c == ["system_database", "multi_tier_architecture"]


def test_greedy_chunks_keep_elements_whole(spark):
    sizes = [(1, i, n, "text") for i, n in enumerate([700, 600, 40, 100, 90])] + [(2, 0, 100, "text")]
    e = spark.createDataFrame([(d, 0, i, t, "x" * (n - 2) + f"{i:02d}") for d, i, n, t in sizes], "doc_id long, page_no int, idx int, type string, text string")
    got = structure.chunk_elements(e).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, r.n_elements, r.length) for r in got] == [(1, 0, 2, 1301), (1, 1, 3, 232)]


def test_chunks_end_at_headers_and_sections(spark):
    t = "words " * 40
    rows = [(1, 0, 0, "section_header", "Intro"), (1, 0, 1, "text", t), (1, 0, 2, "section_header", "Unknown"), (1, 0, 3, "text", t + "a"), (1, 1, 4, "text", t + "b"), (1, 1, 5, "section_header", "Setup"), (1, 1, 6, "text", t + "c"), (1, 1, 7, "text", "Page 5"), (1, 1, 8, "text", "a name that ends in a file name.pdf")]
    e = spark.createDataFrame(rows, "doc_id long, page_no int, idx int, type string, text string")
    sections = spark.createDataFrame([(1, "s1", 0, 0, 1, 0, "Intro", "1"), (1, "s2", 1, 1, 1, 5, "Setup", "")], "doc_id long, section_id string, start_page int, end_page int, level int, idx int, title string, number string")
    got = structure.chunk_elements(e, sections).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.page_no, r.section_id, r.n_elements, r.text[:9]) for r in got] == [(0, 0, "s1", 2, "## 1 Intr"), (1, 0, "s1", 2, "words wor"), (2, 1, "s2", 2, "## Setup ")]


def test_outline_sections_against_a_loop(spark):
    import re

    from ravine.plans.registry import QUERIES
    from ravine.plans.structure_queries import _toc

    marks, headings = (sorted(map(tuple, d.collect())) for d in _toc(spark, "/root/testdata/sf0.001"))
    plain = lambda t: re.sub(r"[^a-z0-9\s]", "", t.lower())
    want = []
    for doc in {m[0] for m in marks}:
        used, rows = set(), []
        for _, idx, title, level, page in (m for m in marks if m[0] == doc):
            best = (0, None)
            for _, h, other, at in (h for h in headings if h[0] == doc and h[1] not in used):
                a, b = plain(title), plain(other)
                score = 100 if a == b else 80 if a in b or b in a else 50 if any(len(w) > 3 and w in b for w in a.split()) else 0
                if score > best[0]:
                    best = (score, (h, at))
            if best[1]:
                used.add(best[1][0])
            rows.append((best[1][1] if best[1] else page, level, idx, title, "bookmark" if best[1] else "bookmark_only", best[0] or None))
        want += [(doc, f"sec_{i:04d}", t, lv, at, src, sc) for i, (at, lv, _, t, src, sc) in enumerate(sorted(rows))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in QUERIES["bookmark_sections"](spark, "/root/testdata/sf0.001").collect())


def test_search_grammar(spark):
    parsed = grammar.parse('alarms "system database" OR -the restoring')
    assert parsed == [[(False, ["alarm"]), (False, ["system", "database"])], [(False, ["restor"])]]
    rows = [(1, "Alarm of the System Database"), (2, "alarm database system"), (3, "it restores"), (4, "Restored, at last"), (5, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    assert [r.id for r in search.web_search(df, "t", 'alarms "system database" OR restored').orderBy("id").collect()] == [1, 4]
    assert [r.id for r in search.web_search(df, "t", "alarm -system").collect()] == []
    assert search.web_search(df, "t", " the ").count() == 0


def test_spaced_tokens_are_the_tokens(spark):
    for t, tokens in (("The the, the-end", ["the", "the", "the", "end"]), ("", []), (" . ", []), ("a1 b", ["a1", "b"])):
        w = text.spaced(F.lit(t))
        r = one(spark, text.tokens(F.lit(t)).alias("a"), text.token_count(w).alias("n"), text.token_hits(w, "the").alias("h"), text.has_token(w, "end").alias("e"))
        assert (r.a, r.n, r.h, r.e) == (tokens, len(tokens), tokens.count("the"), "end" in tokens)


def test_batch_search_in_blocks(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(90, [0.0, 0.0, 0.0]), (91, None)]
    e = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = e.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    one_pass, blocks = (sorted(map(tuple, search.batch_vector_search(e, asked, 4, n).collect())) for n in (2048, 2))
    assert one_pass == blocks and {q for q, *_ in one_pass} == {0, 10, 20, 30, 40, 50}
    for q in (0, 10):
        near = [(i, s) for k, i, s, _ in one_pass if k == q]
        assert [i for i, s in near if s == 1.0][:1] == [min(i for i, v in rows[:60] if v == rows[q][1])]


def test_best_of_keeps_each_lists_best(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 2 else float(i)) for i in range(40)], "id long, a double, b double").repartition(5)
    got = search.best_of(df, ["a", "b"], 3).collect()
    assert sorted((r.list, r.rank, r.id) for r in got) == [(0, 1, 6), (0, 2, 13), (0, 3, 20), (1, 1, 38), (1, 2, 36), (1, 3, 34)]


def test_provider_rules(spark):
    q = lambda c: one(spark, c.alias("x")).x
    assert q(providers.sub_questions(F.lit("What is A and how is B? And C"))) == ["What is A", "how is B", "And C"]
    assert q(providers.sub_questions(F.lit("?"))) == ["?"]
    assert q(providers.valid_topics(F.lit(None), ["a"], F.array(F.lit("r")))) == ["r"]
    assert q(formats.without_fence(F.lit("```md\nx\n```"))) == "x" and q(formats.without_quotes(F.lit('"\'a\'"'))) == "a"
    assert q(formats.batch_summaries(F.lit("Type: Photo\nnote\nSummary: A dog\nType: x"), 2)) == [("photo", "A dog"), ("unknown", "")]


def test_job_states(spark):
    actions = ["complete", "start", "fail", "retry", "start", "fail", "retry", "start", "fail", "retry", "start", "fail", "retry", "resume", "cancel", "cancel"]
    e = spark.createDataFrame([(1, i, i, a) for i, a in enumerate(actions)], "job_id long, at long, event_id long, action string")
    got = sorted(state.transitions(e).collect(), key=lambda r: r.at)
    assert [r.accepted for r in got] == [False] + [True] * 11 + [False, True, True, False]
    assert (got[-1].status, got[-1].retries) == ("cancelled", 3)


def test_empty_folds(spark):
    assert structure.merged_shots(spark.createDataFrame([], "key long, at long"), spark.createDataFrame([], "key long, at long")).count() == 0


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "id int, tokens int")
    assert [r.id for r in expand.within_budget(df, "tokens", 10, ["id"]).collect()] == [1]


def test_rrf_is_symmetric():
    assert 0.5 / (rank.RRF_K + 1) + 0.5 / (rank.RRF_K + 2) == 0.5 / (rank.RRF_K + 2) + 0.5 / (rank.RRF_K + 1)


def test_topk_prefix(spark):
    c = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "id int, embedding array<float>")
    ten = [r.id for r in search.vector_search(c, [1.0, 0.2], -1, 10).collect()]
    assert ten[:5] == [r.id for r in search.vector_search(c, [1.0, 0.2], -1, 5).collect()]


def test_topic_exclusion_drops_rows_without_topics(spark):
    c = spark.createDataFrame([(1, "a b", [1.0], "graphics", ["graphics"]), (2, "a b", [1.0], None, None), (3, "a b", [1.0], "hardware", ["hardware"])], "id int, content string, embedding array<float>, topic string, topics array<string>")
    assert [r.id for r in search.hybrid_topics(c, [1.0], ["a"], exclude=["graphics"]).collect()] == [3]


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, v string, hits int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 0)], "id int, v string, hits int")
    assert sorted(map(tuple, tables.upsert(old, new, "id", ("hits",)).collect())) == [(1, "a", 5), (2, "c", 6), (3, "d", 0)]
    parents, kept, counts = tables.cascade_delete(old, {"new": (new, "id")}, old.filter("id = 2"), "id")
    assert (parents.count(), kept["new"].count(), {r.name: r.deleted for r in counts.collect()}) == (1, 1, {"parents": 1, "new": 1})


def test_links_and_report(spark, tmp_path):
    (tmp_path / "links.csv").write_text("doc_id,url\na,http://x\n,\nb,\n")
    df = tables.read_links(spark, str(tmp_path / "links.csv"))
    assert [r.doc_id for r in df.collect()] == ["a"]
    tables.write_report(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_spacing_is_from_the_last_kept(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 3, 6, 9, 12)], "key int, at long")
    assert sorted(r.at for r in structure.merged_shots(df, df, 5).collect()) == [0, 6, 12]


def test_headings(spark):
    r = one(spark, text.is_identifier(F.lit("Overview")).alias("a"), text.is_navigation(F.lit("User preferences next")).alias("b"), text.is_valid_title(F.lit("SHOUTING TITLE")).alias("c"), text.section_level(F.lit("1.2 Setup")).alias("d"), text.is_header_noise(F.lit("Page 5")).alias("e"), ingest.heading_level(F.lit("section-2-x")).alias("f"), ingest.heading_level(F.lit("Title")).alias("g"), ingest.heading_level(F.lit("para")).alias("h"))
    assert tuple(r) == (True, True, False, 2, True, 2, 0, 99)


def test_markdown(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, structure.markdown(rows).alias("m")).m == "| a | b |\n|---|---|\n| 1 | 2 |\n"
    assert one(spark, structure.markdown(F.slice(rows, 1, 1)).alias("m")).m == ""


def test_entities(spark):
    m = spark.createDataFrame([(1, 0, "user", "The System Database and JACE. The JACE works")], "session_id int, message_index int, role string, content string")
    got = {r.entity: r.n for r in answers.frequent_entities(m).collect()}
    assert got["jace"] == 2 and got["the system database"] == 1 and got["the jace"] == 1 and got["system database"] == 1


def test_hierarchy_of_a_document(spark):
    t = "useful words " * 15
    rows = [(1, 0, 0, "section_header", "Contents of this book"), (1, 0, 1, "text", "..... 4"), (1, 1, 2, "section_header", "1 First steps here"), (1, 1, 3, "text", t), (1, 2, 4, "section_header", "1.1 Backup of stations"), (1, 2, 5, "text", t + "restore"), (1, 3, 6, "text", t)]
    e = spark.createDataFrame(rows, "doc_id long, page_no int, idx int, type string, text string")
    assets = spark.createDataFrame([(7, 1, 2, "image"), (8, 1, 3, "table")], "asset_id long, doc_id long, page_no int, kind string")
    made = pipeline.hierarchy(e, assets=assets)
    s = {r.section_id: r for r in made["sections"].collect()}
    assert [(s[k].title, s[k].level, s[k].parent_section_id, s[k].path) for k in sorted(s)] == [("1 First steps here", 1, None, "1 First steps here"), ("1.1 Backup of stations", 2, "sec_0000", "1 First steps here > 1.1 Backup of stations")]
    c = sorted(made["chunks"].collect(), key=lambda r: r.chunk_no)
    assert [(r.section_id, r.page_no, r.n_elements) for r in c] == [("sec_0000", 1, 2), ("sec_0001", 2, 3)] and "provisioning" in c[1].topics
    assert {(r.asset_id, r.section_id) for r in made["assets"].collect()} == {(7, "sec_0001"), (8, None)}
    assert {(r.page_no, r.chunk_count, r.has_images, r.has_tables) for r in made["page_index"].collect()} == {(1, 1, False, False), (2, 1, True, False)}
    marks = spark.createDataFrame([(1, 0, "FIRST steps", 1, 9), (1, 1, "Appendix", 1, 3)], "doc_id long, idx int, title string, level int, page int")
    named = pipeline.sections(e, marks).orderBy("section_id").collect()
    assert [(r.title, r.start_page) for r in named] == [("FIRST steps", 1), ("Appendix", 3)]


def test_requests(spark):
    import json

    from ravine.api import Engine

    engine = Engine(spark, "/root/testdata/sf0.001")
    found = json.loads(engine.handle({"route": "documents", "page_size": 3, "language": "en"}))["rows"]
    assert len(found) == 3 and all(r["language"] == "en" for r in found)
    assert "error" in json.loads(engine.handle('{"route": "nowhere"}')) and "error" in json.loads(engine.handle("no json"))
    assert json.loads(engine.handle({"route": "jobs/stats"}))["rows"][0]["total"] == 1500
