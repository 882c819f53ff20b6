"""The training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from ravine.llm import fmindex, mixing, nbsvm, quality, sharding, simhash, spans, suffixes, templates, tokens, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def awkward(seed=3):
    """Null and empty texts, ties, repeated rows, a null key, null groups, one long text."""
    r = random.Random(seed)
    vocab = ["alpha", "beta", "gé", "delta", "x", "The", "42", "km", "日本"]
    words = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [words(r.randint(5, 60)) for _ in range(5)]
    texts = [None, "", " \n\t", "one", "a " * 300, "q" * 900, "ab cd " * 700, "x" + "ab cd " * 90] + ["\n".join(r.choice([words(r.randint(0, 20)), r.choice(shared)]) for _ in range(r.randint(1, 9))) for _ in range(80)]
    texts.append(" ".join(texts[10:60]) * 3)
    texts += texts[6:18]
    rows = [(None if i == 7 else i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(docs, empty):
    rows = awkward()
    got = sharding.shard_documents(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard_documents(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_documents(empty).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 17, 1000):
        out = sharding.permute(spark.range(n), n, "id", "p", 5)
        assert sorted(r.p for r in out.collect()) == list(range(n))


#: Names that the operators use themselves, in one way or another.
CLASHING = ["shard", "slot", "row_number", "kept", "size", "taken", "position", "positions", "did", "rk", "gram", "fp", "at", "n", "low", "high", "spans", "root", "node", "component", "least", "label", "score", "feature", "window", "words", "item_id", "start", "path", "content", "chunk", "digest", "key", "hash", "row", "share", "times", "copy", "__rk", "__key", "n_words", "base_failed", "first_id"]


def test_clashing_columns(spark, docs):
    """Columns with the operators' own names change nothing, and stay where rows are returned whole."""
    from pyspark.sql import functions as F

    odd = docs.withColumns({c: F.lit("x") for c in CLASHING} | {"extra": F.lit(3)})
    assert sharding.shard(odd, 4).filter("shard >= 0 and extra = 3").count() == len(awkward())
    assert mixing.mix(odd).filter("extra = 3").count() == len(awkward())
    assert quality.judge(odd).filter("extra = 3").count() == len(awkward())
    kept = simhash.keep_one(odd.drop("__rk"))
    assert kept.columns == odd.drop("__rk").columns and kept.count() == simhash.keep_one(docs).count()
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", "x", "y")], "item_id long, text string, window string, words string")
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(60)], "doc_id long, quality int, toxic int, text string")
    pages, more = (d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *(F.lit("x").alias(c) for c in cs)) for d, cs in ((docs, []), (docs, CLASHING)))
    rows = lambda d: Counter(map(str, (tuple(r) for r in d.collect())))
    for run in (tokens.tokenize_documents, suffixes.dedup_documents, fmindex.dedup_documents, simhash.near_duplicate_documents, mixing.mix_documents, quality.judge_documents, sharding.shard_documents, lambda d: templates.leaked_documents(d, bench), lambda d: nbsvm.score_documents(d, labels)):
        assert rows(run(odd)) == rows(run(docs))
    assert rows(warc.archive_pages(more)) == rows(warc.archive_pages(pages))


def test_warc(spark):
    pages = [(1, "http://a b\r\nX: 1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "n", "<p>x</p>"), (5, "v", "é" * 40_000), (6, "w", "solo"), (6, "w", "solo")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archive_pages(df).collect()
    sha = lambda h: warc.base32_sha1((h or "").encode())
    want = []
    for p, _, h in pages:
        ids = [q for q, _, g in pages if (g or "") == (h or "") and q is not None]
        first = max(ids)
        want.append((p, len((h or "").encode()), sha(h), "response" if p == first else "revisit", None if p == first else first))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_reader_rejects_damage():
    whole = warc.record(1, "u", b"payload", None, False)
    import zstandard

    packed = warc.skippable(b"dictionary" * 9) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"dictionary" * 9)).compress(whole)
    (headers, payload), = warc.records(packed)
    assert payload == b"payload" and headers["x-page-id"] == "1"
    for bad in (packed[:-3], packed + b"junkjunk"):
        with pytest.raises(warc.WarcError):
            list(warc.records(bad))
    with pytest.raises(warc.WarcError):
        warc.parse(whole.replace(b"payload", b"pay"))
    with pytest.raises(warc.WarcError):
        warc.parse(whole.replace(b"\r\n\r\npayload", b"\r\n\r\nPayload"))


def test_simple8b():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 1023, 1024, 1025, 9000):
        for high in (2, 50257, 1 << 40, 1 << 63):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            if n > 10:
                ids[3], ids[4], ids[5] = 2**64 - 1, 15 << 60, 0
            words, offsets = tokens.pack(ids)
            assert (tokens.unpack(words, offsets, n) == ids).all()


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    odd = [(200, "a  b \n\n c\t d <|endoftext|>   x  y \x1c z  ", None, None, None), (201, "it's\u0085 don't   ", None, None, None)]
    got = tokens.tokenize_documents(docs.union(spark.createDataFrame(odd, DOCS))).collect()
    want = Counter()
    for d, x, *_ in awkward() + odd:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want[(d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert tokens.tokenize_documents(empty).count() == 0


def test_long_documents_go_on_in_the_next_chunk(monkeypatch):
    """Documents longer than a chunk, through writer and reader."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CHUNK_IDS", 100)
    texts = ["a b c " * 200, None, "short", "x", "word " * 99, "tail " * 301]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4, 5, 6]), pa.array(texts)], names=["doc_id", "text"])
    data = b"".join(x.as_py() + tokens.END.encode() for b in tokens._writer(tokens.tokenizer_path(), True)(iter([rows])) for x in b.column(0))
    assert max(len(ids) for _, ids in tokens.chunks(data)) == 100
    out, = tokens._reader(iter([pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data])], names=["path", "content"])]))
    encode, at = tokens.Encoder(tokens.tokenizer_path(), True), 0
    for doc, begins, n, crc, text in zip(*(out.column(k).to_pylist() for k in range(1, 5)), texts, strict=True):
        ids = np.append(encode([np.frombuffer((text or "").encode(), np.uint8)])[0], 0).astype("<u4")
        assert (begins, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n


def test_encoder_against_the_library(monkeypatch):
    """Boundaries of all kinds, long texts, a table that starts anew, pieces of one hash."""
    from tokenizers import Tokenizer

    r, t = random.Random(2), Tokenizer.from_file(tokens.tokenizer_path())
    alphabet = ["a", "B", "é", "ß", "日", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\u0085", "'s", "1", "23", ".", ",", "!", "|", "*", "#", "$", "%", "&", "-", "<|endoftext|>", "<|endo", "😀", "Ã"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", "x " * 5000, "word" * 3000]
    raw = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in tokens.Encoder(tokens.tokenizer_path(), True)(raw)] == want
    monkeypatch.setattr(tokens, "PIECES", 50)
    monkeypatch.setattr(tokens, "TOGETHER", 300)
    assert [x.tolist() for x in tokens.Encoder(tokens.tokenizer_path(), True)(raw)] == want
    monkeypatch.setattr(spans.Sums, "__call__", lambda self, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    assert [x.tolist() for x in tokens.Encoder(tokens.tokenizer_path(), True)(raw)] == want


def test_query_has_the_added_tokens_of_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from ravine.llm import queries

    e = "<|endoftext|>"
    texts = [f"one {e} two", f"a{e}b.{e}{e}\n c", e, f"x  {e}  y", f"it'{e}s <|endoftext|", "plain text, no token", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.QUERIES["op3_token_ids"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    t, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    assert t.encode(texts[0], add_special_tokens=False).ids == [505, 220, 50256, 734]
    for r, x in zip(got, texts, strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def suffix_oracle(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in data for i in range(len(t) - n + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((len(t), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t))), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("n,gram,cell,report,piece,bucket", [(40, 10, 4, 256, 1 << 20, 6 << 20), (60, 12, 16, 30, 1 << 20, 6 << 20), (60, 12, 16, 30, 300, 2000), (24, 6, 10, 18, 100, 500)])
def test_suffixes(docs, monkeypatch, n, gram, cell, report, piece, bucket):
    monkeypatch.setattr(spans, "PIECE", piece)
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rows = awkward()
    want = Counter((d, *w, s) for (d, *_), w, s in zip(rows, suffix_oracle([r[1] for r in rows], n), shared_oracle(rows, min(n, report))))
    got = suffixes.dedup_bytes(docs, length=n, report=report, gram=gram, cell=cell).collect()
    assert Counter(tuple(r)[:6] for r in got) == want


def shared_oracle(rows, n):
    """Bytes in strings of n bytes that start under another key too (null is one key)."""
    data, of = [(t or "").encode() for _, t, *_ in rows], {}
    for (d, *_), t in zip(rows, data):
        for i in range(len(t) - n + 1):
            of.setdefault(t[i : i + n], set()).add(d)
    out = []
    for t in data:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if len(of[t[i : i + n]]) > 1:
                hit[i : i + n] = b"\1" * n
        out.append(sum(hit))
    return out


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for alphabet, depth in ((2, 40), (3, 13), (1, 30), (250, 8)):
        data = rng.integers(0, alphabet, 3000).astype(np.uint8)
        data[1000:1400] = data[:400]
        at, group = rng.permutation(2900)[:1500], rng.integers(0, 3, 1500)
        order, same = suffixes.multikey_quicksort(suffixes.tokens(data), at, group, 0, depth)
        keys = [(group[i], data[at[i] : at[i] + depth].tobytes()) for i in order]
        assert sorted(order.tolist()) == list(range(1500)) and keys == sorted(keys)
        assert same.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


@pytest.mark.parametrize("piece,length,gram,reach", [(64, 30, 6, 30), (100, 30, 6, 47), (1 << 20, 30, 6, 47), (7, 13, 5, 13)])
def test_long_texts_in_pieces(monkeypatch, piece, length, gram, reach):
    """Every window of every text is in one segment, whatever the pieces; rows in a row count."""
    import pyarrow as pa

    monkeypatch.setattr(spans, "PIECE", piece)
    r = random.Random(1)
    texts = ["", "short", None, "abc" * 200, "".join(r.choice("ab") for _ in range(900)), "".join(r.choice("abcdefgh") for _ in range(2500)), "z" * 9000]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["did", "rk", "text"])
    seen, by_print = Counter(), {}
    for out in spans.finder(spans.byte_codes, length, gram, reach, spans.Common(np.empty(0, np.uint64)))(iter([b])):
        for did, g, fp, at in zip(*(out.column(k).to_pylist() for k in (0, 2, 3, 4))):
            first, n, offset = spans.place(at)
            for k in range(at >> 52):
                begin = first + k * n
                seen.update((did, x) for x in range(begin, begin + n))
                part = texts[did][begin : begin + n - 1 + reach]
                assert by_print.setdefault((g, fp), (n, offset, part)) == (n, offset, part)
    assert seen == Counter((i, x) for i, t in enumerate(texts) for x in range(len(t or "") - length + 1))


def test_common_grams_come_last():
    """Segments differ with the common grams, windows with their anchors don't go astray."""
    rng = np.random.default_rng(1)
    codes = spans.BYTE_CODES[rng.integers(0, 3, 2000)]
    grams = np.unique(spans.Sums(codes).each(6))
    for common in (grams[:0], grams[::2], grams):
        which, first, n, anchor, _, _ = spans.segments(codes, np.array([0, 900]), np.array([900, 2000]), np.array([871, 1071]), 30, 6, 30, spans.Common(common))
        assert sorted(x for a, k in zip(first.tolist(), n.tolist()) for x in range(a, a + k)) == [*range(871), *range(900, 1971)]
        assert (anchor >= first + n - 1).all() and (anchor <= first + 24).all()


def word_oracle(rows, n):
    split = [(2**63 - 1 if d is None else d, WORD.findall(t or "")) for d, t, *_ in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n,gram,wide,piece", [(6, 2, 20_000, 1 << 20), (13, 3, 20_000, 50), (6, 2, 1, 1 << 20), (13, 5, 2, 1 << 20)])
def test_fm_index(docs, monkeypatch, n, gram, wide, piece):
    monkeypatch.setattr(fmindex, "WIDE", wide)
    monkeypatch.setattr(spans, "PIECE", piece)
    rows = awkward()
    want = Counter((d, *w) for (d, *_), w in zip(rows, word_oracle(rows, n)))
    assert Counter(tuple(r)[:4] for r in fmindex.dedup_words(docs, length=n, gram=gram).collect()) == want


def test_least_keys():
    """Every window's least key, with few and many different words, repeated texts and short ones."""
    rng = np.random.default_rng(1)
    for t in range(60):
        n, v = int(rng.integers(1, 14)), int(rng.integers(1, 6)) if t % 2 else 3000
        words = [rng.integers(0, v, int(rng.integers(0, 40))).astype(np.uint64) for _ in range(int(rng.integers(1, 12)))]
        words += [w.copy() for w in words[: t % 3]]
        keys, least = rng.integers(0, 50, len(words)), {}
        windows = [[tuple(w[i : i + n].tolist()) for i in range(len(w) - n + 1)] for w in words]
        for own, k in zip(windows, keys.tolist()):
            for w in own:
                least[w] = min(least.get(w, 99), k)
        assert [x.tolist() for x in fmindex.least_keys(words, keys, n)] == [[least[w] for w in own] for own in windows]


def test_backward_search():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(20)])
    index = fmindex.FMIndex(text, 5)
    ends = np.arange(1, len(text) + 1)
    length, low, high = index.search(text, ends, 5)
    raw = text.tolist()
    for e, n, a, b in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist()):
        p = raw[e - n : e]
        assert 0 not in p
        if n:
            assert b - a == sum(raw[i : i + n] == p for i in range(len(raw)))


def test_empty_tables(empty):
    assert suffixes.dedup_documents(empty).count() == 0
    assert fmindex.dedup_documents(empty).count() == 0
    assert simhash.near_duplicate_documents(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert quality.judge_documents(empty).count() == 0


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, docs):
    rows = [r[:2] for r in awkward()] + [(r.doc_id + 1000, r.text) for r in table(spark, "documents").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicate_documents(df).collect()
    prints = [simhash.fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    least = {}
    for (d, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots))


def five_words(text):
    words = WORD.findall((text or "").translate(simhash._LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_sets(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(r, words, n):
    """``words`` with n of them replaced, dropped or doubled."""
    out = list(words)
    for i in sorted(r.sample(range(len(out)), n), reverse=True):
        out[i : i + 1] = r.choice([["other"], [], [out[i], "more"]])
    return " ".join(out)


def test_similar_texts(spark):
    """Links against exact Jaccard similarity: near copies are one class, others are apart."""
    r, rows = random.Random(5), []
    for k in range(60):
        words = [f"w{r.randrange(900)}" for _ in range(r.randint(120, 700))]
        rows.append(" ".join(words))
        if k % 2:
            rows += [edited(r, words, max(1, len(words) // n)) for n in (150, 90)]
        elif k % 4:
            rows += [edited(r, words, len(words) // 12)]
    rows += [None, "", "one", "One", "two", "three small words", rows[0], rows[1].upper()]
    df = spark.createDataFrame([(None if i == 3 else i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, root string")
    kept = simhash.keep_one(df).collect()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [five_words(t) for t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if similar_sets(sets[i], sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(i)
    want = {min((i for i in c if i != 3), default=None) for c in classes.values()}
    assert {x.doc_id for x in kept} == want and len(kept) == len(want)
    assert df.columns == kept[0].__fields__
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_similar_links_in_large_cells(monkeypatch):
    """A cell beyond PAIRS gives a forest of what its pairs would connect."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, 4)).astype(np.uint64)
    points = base[rng.integers(0, 4, 90)] ^ (np.uint64(1) << rng.integers(0, 60, (90, 4)).astype(np.uint64))
    a, b = simhash.spanning(points, 12)
    roots = list(range(90))
    for x, y in zip(a.tolist(), b.tolist()):
        roots = [roots[x] if v == roots[y] else v for v in roots]
    near = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2) <= 12
    assert all(near[x, y] for x, y in zip(a.tolist(), b.tolist()))
    assert all(roots[i] == roots[j] for i in range(90) for j in range(90) if near[i, j])
    assert len(set(roots)) == 4


def test_similar_prints_by_hand():
    text = "A b c d e f g h i j a b c d e f"
    words = text.lower().split()
    hashes = {int(spans.Sums(spans.word_codes(np.frombuffer(" ".join(words[i : i + 5]).encode(), np.uint8))).each(5)[0]) for i in range(len(words) - 4)}
    salts = spans.mix(np.arange(1, 5, dtype=np.uint64))
    want = []
    for salt in salts:
        mixed = [int(spans.mix(np.array([h], np.uint64) + salt)[0]) for h in hashes]
        want.append(sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed)))
    got, _ = simhash.similar_prints(np.frombuffer(text.encode(), np.uint8))
    assert got.tolist() == want
    assert not simhash.similar_prints(np.empty(0, np.uint8))[0].any()


def test_fingerprint_by_hand():
    import xxhash

    words = "a b c d e f".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    assert simhash.fingerprint("A b  C\nd e F") == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, (2, 2000), dtype=np.uint64)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) <= np.bitwise_count(a ^ b)).all()


def test_cells_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 8, (60, 2))})
    monkeypatch.setattr(simhash, "BLOCK", 7)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    roots = brute_components(prints)
    assert len({r.root for r in found}) == len({x for x, n in Counter(roots).items() if n > 1})


def test_mixing(docs):
    got = mixing.mix_documents(docs).collect()
    rows = awkward()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    of = {}
    for r in got:
        of.setdefault(r.source_size, []).append(r)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, *_ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    for s in order:
        mine = [r for r in of[sizes[s]] if abs(r.target - target[s]) < 1e-6]
        assert mine and abs(sum(r.taken for r in mine) - target[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))


def test_schedule_inverse(spark):
    from pyspark.sql import functions as F

    for s in mixing.SCHEDULES:
        got = spark.range(0, 11).select(mixing._inverse(s, F.col("id") / 10).alias("t")).collect()
        for i, r in enumerate(got):
            knots = [(t, w) for t, w in s if t < r.t]
            w_at = next(w0 + (w1 - w0) * (r.t - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(s, s[1:]) if t0 <= r.t <= t1)
            assert abs(mixing.integral((*knots, (r.t, w_at))) / mixing.integral(s) - i / 10) < 1e-6


def measures(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs):
    got = quality.judge_documents(docs).collect()
    want = Counter()
    for d, t, *_ in awkward():
        m = measures(t)
        want[(d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_sketch_buckets(spark):
    from pyspark.sql import functions as F

    got = [(r.id, r.b) for r in spark.range(0, 5000, 7).select("id", quality.bucket(F.col("id")).alias("b")).collect()]
    assert all(b <= v and v - b <= v / 64 for v, b in got) and [b for v, b in got] == sorted(b for v, b in got)


def test_classifier(spark):
    # sf0.001 has 19 held-out rows and 68 to learn from, too few to judge accuracy by
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in nbsvm.score_documents(d, labels).collect()}
    known = [(r.quality, got[r.doc_id]) for r in labels.collect() if r.doc_id in got]
    held = [(q, r) for q, r in known if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert sum(q == r.predicted for q, r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in nbsvm.score_documents(d.repartition(3), labels).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in got.items())


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert nbsvm.score_documents(docs, none).filter("score between 0 and 1").count() == len(awkward())
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert nbsvm.score_documents(empty, some).count() == 0
    assert nbsvm.score_documents(docs, some).filter("score between 0 and 1 and predicted = cast(score >= 0.3 as int)").count() == len(awkward())


def test_log_ratios_by_hand(spark, monkeypatch):
    """Counts over all training rows against a plain count, ratios against their formula."""
    import math

    texts = ["good fine words", "good words", "bad stuff 12", "bad bad STUFF", None, "good"]
    rows = [(i, t) for i, t in enumerate(texts * 8)]
    marks = [(i, int("good" in (t or ""))) for i, t in rows]
    model = nbsvm.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    feats, n = nbsvm.Features(), {}
    for (i, t), (_, y) in zip(rows, marks):
        if zlib.crc32(str(i).encode()) % 5:
            for f in feats(t).tolist():
                n.setdefault(f, [0, 0])[y] += 1
    total = [sum(1 + c[y] for c in n.values()) + (1 << nbsvm.BITS) - len(n) for y in (0, 1)]
    for f, (bad, good) in n.items():
        assert math.isclose(model.ratio[f], math.log((1 + good) / total[1]) - math.log((1 + bad) / total[0]))
    assert np.count_nonzero(model.ratio) <= len(n)


def test_dual_descent_against_projected_gradient():
    """The same minimum of the hinge loss as a slow solver of the dual."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, rng.integers(1, 6), replace=False)) for _ in range(40)]
    ratio, y = rng.normal(size=12), np.where(rng.random(40) < 0.5, -1.0, 1.0)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, 12] = 1  # the bias is a weight like any other
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    gram, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(40)
    for _ in range(20_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, 1)
    w, bias = nbsvm.dual_descent(rows, ratio, y, epochs=3000)
    assert abs(loss(np.append(w, bias)) - loss((alpha * y) @ x)) < 1e-2


def test_fit_is_bounded(spark, monkeypatch):
    """Rows and features of the fit stay below their bounds; counts still cover all rows."""
    seen = []
    real = nbsvm.dual_descent
    monkeypatch.setattr(nbsvm, "dual_descent", lambda rows, *a: seen.append(rows) or real(rows, *a))
    monkeypatch.setattr(nbsvm, "FIT_ROWS", 20)
    monkeypatch.setattr(nbsvm, "FIT_FEATURES", 60)
    rows = [(i, f"w{i} x{i % 3} y{i % 5} z") for i in range(100)]
    nbsvm.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    assert 2 <= len(seen[0]) <= 20 and sum(map(len, seen[0])) <= 60


def test_templates(spark):
    item = "A train leaves the station at 60 km per hour and Alice waits 25 minutes before she follows it on the same road to Paris. How far does it go?"
    other = item.replace("60", "75").replace("25", "40").replace("Alice", "Bob").replace("Paris", "Rome")
    mixed = item.replace("60", "75", 1) + " unrelated words follow here and then some more of these"
    rows = [(1, "Intro text. " + item + " Outro."), (2, "junk " + other), (3, "a train is a nice thing at the station"), (4, None), (5, ""), (None, item), (6, mixed)]
    bench = spark.createDataFrame([(9, item), (8, "short one"), (7, None)], "item_id long, text string")
    got = {r.doc_id: r for r in templates.leaked_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, None, 6} and all(r.item_id == 9 for r in got.values())
    assert got[2].reparameterised and not got[1].reparameterised


def found_in(spark, items, rows):
    """(doc_id, item_id) to (run, coverage, reparameterised) of the leaks in literal texts."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = templates.leaked_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), bench).collect()
    return {(r.doc_id, r.item_id): (r.run, r.coverage, r.reparameterised) for r in got}


def test_verbatim_items_with_few_literal_words(spark):
    items = ["What is 17 + 25 * 3?", "Solve 3x + 4y = 12", "Find the sum of 12 45 78 23 56 91 34 and 67 and 89."]
    rows = [f"Some text here. {x} And some more." for x in items] + ["What is 17 + 26 * 3? Solve 3x + 4y = 13"]
    got = found_in(spark, items, rows)
    assert set(got) == {(0, 0), (1, 1), (2, 2)}
    assert all(coverage == 1 and not changed for _, coverage, changed in got.values())


def test_each_occurrence_keeps_its_own_mapping(spark):
    item = "Add {} to {} and {} to {} then {} to {} and {} to {} then {} to {} now please."
    first, second = (item.format(*((20 if i % 2 == k else 80) + i for i in range(10))) for k in (0, 1))
    rows = [f"Text begins. {first}", f"Text begins. {second}", f"Text begins. {first} More follows. {second}", f"{first} {second} {first} {second}", f"{first} x {second.replace('then', 'then so', 1)} y"]
    got = found_in(spark, [item.format(*range(2, 12))], rows)
    assert set(got) == {(i, 0) for i in range(5)}
    assert all(coverage >= 0.95 and changed for _, coverage, changed in got.values())


def test_occurrences_in_repetitive_text(spark):
    item = "one two three four " * 6
    got = found_in(spark, [item], [item * 400, "one two three five " * 2000])
    assert got == {(0, 0): (24, 1.0, False)}


def test_names_whatever_their_case(spark):
    item = "A train leaves the station at 60 km per hour and Alice waits 25 minutes before she follows it on the same road to Paris. How far does it go?"
    other = item.replace("60", "75").replace("25", "40")
    short = "What is the capital of France?"
    rows = [f"some notes here\n{short}", f"some notes here\n{short.replace('France', 'Spain')}", short.upper(), item.lower(), item.upper(), other.lower(), other.upper(), other.replace(" and Alice", "\nand\nBob")]
    got = found_in(spark, [item, short], rows)
    assert set(got) == {(0, 1), (1, 1), (2, 1), *((i, 0) for i in range(3, 8))}
    assert all(got[i, 0][1] == 1 for i in range(3, 7)) and not got[3, 0][2] and got[5, 0][2]


def brute_leaks(items, docs):
    """Every document against every item: windows compared code by code, occurrences judged as they are."""
    canon = templates.shared_canon()

    def readings(text, n):
        """(kind of reading, the window's codes) to (start, slot values) of every window."""
        codes, typed, names, found = canon(text)
        out = {}
        for s in range(len(codes) - n + 1):
            part, slot, name = (x[s : s + n].tolist() for x in (codes, typed, names))
            words, raw = found[s : s + n].tolist(), canon.plain[found[s : s + n]].tolist()
            held = [a or b for a, b in zip(slot, name)]
            template = [int(templates.NAME) if b else c for c, b in zip(part, name)]
            literal, least = n - sum(held), min(templates.LITERAL, n)
            value = lambda which: "\x1f".join(canon.raw[w] for w, yes in zip(words, which) if yes)
            kinds = []
            if literal >= least:
                kinds.append((tuple(template), value(held)))
            if name[0] and literal + 1 >= least:
                kinds.append(((part[0], *template[1:]), value([False, *held[1:]])))
            if any(name) and literal + sum(name) >= least:
                kinds.append((tuple(part), value(slot)))
            if literal < n:
                kinds.append((tuple(raw), ""))
            for k, v in kinds:
                out.setdefault(k, set()).add((s, v))
        return out

    leaked = {}
    for i, item in enumerate(items):
        total = len(canon(item)[0])
        if not total:
            continue
        n = min(templates.WINDOW, total)
        own = readings(item, n)
        for d, text in enumerate(docs):
            of = readings(text, n)
            found = {}
            for k in own.keys() & of.keys():
                for s, a in own[k]:
                    for at, b in of[k]:
                        found.setdefault((s, n, a, b), set()).add(at)
            best = templates.occurrence([(*k, sorted(v)) for k, v in found.items()], total)
            if best:
                leaked[d, i] = (best[1], best[0] / total, best[2])
    return leaked


@pytest.mark.parametrize("many", [50, 1])
def test_leaks_against_brute_force(spark, monkeypatch, many):
    """All documents against all items, with frames that many items share."""
    monkeypatch.setattr(templates, "MANY", many)
    r = random.Random(11)
    vocab = ["the", "train", "leaves", "at", "Paris", "Bob", "and", "12", "7", "km", "so", "it", "runs", "Anna", "fast.", "how", "3.5kg", "far"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    frame = "read the text below and answer the question in one word please"
    items = [say(r.randint(1, 30)) for _ in range(12)] + [f"{frame} {say(12)}" for _ in range(6)] + [frame, frame, "", "..."]
    change = {"12": "40", "Bob": "Eve", "7": "9", "Paris": "Rome"}
    docs = []
    for k in range(40):
        item = r.choice(items)
        if k % 3 == 0:
            item = " ".join(change.get(w, w) for w in item.split())
        docs.append(f"{say(r.randint(0, 12))} {item} {say(r.randint(0, 12))}")
    docs += [frame, None, "", say(200)]
    got = found_in(spark, items, docs)
    assert got == {k: (run, pytest.approx(share), changed) for k, (run, share, changed) in brute_leaks(items, docs).items()}
    assert len(got) > 20


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert templates.leaked_documents(docs, bench).count() == 0
    assert templates.leaked_documents(empty, spark.createDataFrame([(1, "one two three")], "item_id long, text string")).count() == 0


def test_slots_must_keep_one_mapping():
    ok, changed = templates.consistent([(0, 8, "60\x1f25", "75\x1f40"), (1, 8, "60\x1f25", "75\x1f40"), (9, 8, "60", "99")])
    assert ok == [(0, 8), (1, 8)] and changed


def test_leaks_in_tables(spark):
    d, b = table(spark, "documents"), table(spark, "benchmark")
    items = [r.text for r in b.collect()]
    want = {r.doc_id for r in d.collect() if any(t in (r.text or "") for t in items)}
    assert want <= {r.doc_id for r in templates.leaked_documents(d, b).collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    d = table(spark, "documents")
    kept = {r.doc_id for r in quality.judge_documents(d).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in d.collect() if r.doc_id in kept]
    parent, sets = list(range(len(rows))), [five_words(t) for _, t in rows]  # brute force over all pairs

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar_sets(sets[i], sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc), doc)
    docs = d
    for k, (name, stage) in enumerate(p.STAGES[:3]):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), d.schema)
        assert docs.columns == d.columns
        if k == 0:
            assert {r.doc_id for r in docs.collect()} == kept
        if k == 1:
            assert sorted(r.doc_id for r in docs.collect()) == sorted(first.values())
    leaks = {r.doc_id for r in templates.leaked_documents(d, table(spark, "benchmark")).collect()}
    stay = sorted(set(first.values()) - leaks)
    assert sorted(r.doc_id for r in docs.collect()) == stay
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(docs).collect()}
    out = p.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter({k: n for k, n in copies.items() if n})
    assert {(r.shard, r.slot) for r in out} == {(i % 16, i // 16) for i in range(len(out))}


def test_pipeline_awkward(spark, docs):
    import corpus_pipeline as p

    rows = docs
    for _, stage in p.STAGES:
        rows = stage(spark, rows, SF)
    assert rows.count() >= 0
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
