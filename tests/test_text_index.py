"""The positional index against plain loops; the stemmer on its published sample words."""

from __future__ import annotations

import random
import re

import pytest

from ravine.functions import grammar, stemmer
from ravine.operators import text_index

#: Sample words and stems as published with the algorithm.
SAMPLES = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir
conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave
knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die news news generate generat generously generous communication communic arsenal arsenal hopping hop hoping hope relational relat conditional condit happy happi say say by by cries cri ties tie gas gas this this gaps gap
exceed exceed electricity electr formalize formal hopefulness hope adoption adopt controlling control""".split()


def test_stemmer():
    assert [(w, stemmer.stem(w)) for w in SAMPLES[::2]] == list(zip(SAMPLES[::2], SAMPLES[1::2]))


def plain(docs, query, stem):
    """Every minimal cover found by looking at all stretches of each document."""
    out = {}
    for id_, text in docs:
        words = [stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
        total, met = 0.0, False
        for every in grammar.parse(query, stem):
            if all(a for a, _ in every):
                continue
            at = [(absent, [i for i in range(len(words)) if words[i : i + len(run)] == run]) for absent, run in every]
            if any(bool(p) == absent for absent, p in at):
                continue
            met, items = True, [list(p) for p in dict.fromkeys(tuple(p) for absent, p in at if not absent)]
            entries = sorted((p, i) for i, ps in enumerate(items) for p in ps)
            full = lambda b, e, entries=entries, n=len(items): len({i for _, i in entries[b : e + 1]}) == n
            begun = -1
            for e in range(len(entries)):
                for b in range(e + 1):
                    if full(b, e) and not full(b + 1, e) and not full(b, e - 1) and entries[b][0] > begun:
                        begun = entries[b][0]
                        total += text_index.WEIGHT / (1 + max(0, (entries[e][0] - entries[b][0]) - (e - b)))
        if met:
            out[id_] = total
    return out


QUERIES = ["alpha beta", '"alpha beta" gamma', "alpha OR gamma -beta", '"beta gamma" OR "gamma alpha" delta', "-alpha", "the", "the alpha", '"the alpha"', "", "alpha alpha", 'alpha "alpha beta"', 'gamma -"alpha beta"', "nowhere OR delta", "running"]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "delta", "the", "runs", "running", "of,", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "ALPHA-beta!"), (503, "alpha beta " * 3000)]


@pytest.mark.parametrize("english", [False, True])
def test_search(spark, tmp_path, docs, english):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "id bigint, text string, term string").repartition(4)
    index = text_index.build(df, str(tmp_path / f"ix{english}"), english=english, buckets=5)
    for q in QUERIES:
        want = plain([d for d in docs if d[0] != 503], q, index.stem)
        got = {r["id"]: r["rank"] for r in index.matches(q).collect() if r["id"] != 503}
        assert got.keys() == want.keys(), q
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want), q
    best = index.search("alpha beta", 3).collect()
    assert best[0]["id"] == 503 and best == sorted(best, key=lambda r: (-r["score"], r["id"])) and 0 < best[0]["score"] < 1
    among = index.search("alpha", 50, among=spark.createDataFrame([(3,), (3,), (502,)], "id bigint")).collect()
    assert {r["id"] for r in among} <= {3, 502} and len(among) == len({r["id"] for r in among})
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term,alpha)" in plan


def test_bm25_needs_no_text(spark, tmp_path, docs):
    from ravine.operators import search

    df = spark.createDataFrame(docs, "id bigint, text string").filter("text <> ''")
    index = text_index.build(df, str(tmp_path / "bm"), english=False)
    want = [tuple(r) for r in search.bm25_search(df, "text", ["alpha", "delta"], 7).collect()]
    assert [tuple(r) for r in index.bm25(["alpha", "delta"], 7).collect()] == want


def test_words_are_stemmed_once():
    """stems and rows of many texts; null and empty ones have none."""
    import re

    import pyarrow as pa

    from ravine.operators import text_index

    texts = [f"The cats, the CATS and number{i % 7} of the cat" for i in range(3000)] + [None, "", "...", "one " * 400_000]
    calls = []

    def stem(word):
        calls.append(word)
        return word.rstrip("s")

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    got = {(t, i): (n, p) for b in text_index._postings(iter([batch]), stem) for t, i, n, p in zip(*(c.to_pylist() for c in b.columns))}
    want = {}
    for i, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        for at, w in enumerate(words):
            want.setdefault((w.rstrip("s"), i), (len(words), []))[1].append(at)
    assert got == want and len(calls) < 100
