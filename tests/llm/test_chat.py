"""Conversations folded from logs, rendered and read back, against plain loops."""

from __future__ import annotations

import hashlib
import random

import pytest

from ravine.llm import chat

LOG = "conv bigint, seq bigint, event string, msg string, role string, text string, place string, piece string"


def plain(log):
    """Messages of each conversation, folded one event after another."""
    rank = {k: i for i, k in enumerate(chat.KINDS)}
    out = {}
    for c, seq, event, msg, role, text, *_ in sorted((r for r in {r[:4] + (r[5],): r for r in reversed(log)}.values() if r[2] in rank), key=lambda r: (r[0], r[1] is None, r[1] or 0, rank[r[2]], r[3], hashlib.md5((r[5] or "").encode()).hexdigest() if r[5] is not None else "")):
        messages = out.setdefault(c, [])
        at = next((i for i, m in enumerate(messages) if m[0] == msg), None)
        if event == "open" and at is None:
            messages.append([msg, role or "", text or ""])
        elif event == "delta" and at is not None:
            messages[at][2] += text or ""
        elif event in ("edit", "regenerate") and at is not None:
            del messages[at + 1 :]
            messages[at][2] = (text or "") if event == "edit" else ""
    return {c: [(r, t) for _, r, t in m] for c, m in out.items() if m}


def formatted(turns):
    def esc(t):
        return "".join({"\\": "\\\\", "<": "\\l", "[": "\\o", "]": "\\c"}.get(c, c) for c in t)

    return "".join(f"<s>[{esc(r)}] {esc(t)}</s>" for r, t in turns)


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted(turns))


def random_log(n):
    rng, rows = random.Random(3), []
    texts = ["", None, "</s>", "[INST] ok [/INST]", "\\", "<s>[user] ", "]\\l[", "ü\U0001f600\n", "plain words"]
    for seq in range(n):
        rows.append((rng.choice([1, 1, 1, 2, 3, 4]), rng.choice([seq, seq, seq, seq // 3]), rng.choices([*chat.KINDS, "other", None], [5, 1, 1, 9, 1, 1])[0], f"m{rng.randrange(12)}", rng.choice(["user", "assistant", "assistant", "sys]tem", None]), rng.choice(texts), "clash", "clash"))
    return rows


def test_fold_render_read_back(spark):
    log = random_log(400)
    want = plain(log)
    df = spark.createDataFrame(log, LOG).repartition(5)
    pieces = chat.render(chat.fold(df, "conv", ["seq"]), "conv").cache()
    got = {r["conv"]: r for r in chat.assembled(pieces, "conv").collect()}
    assert {c: r["formatted"] for c, r in got.items()} == {c: formatted(t) for c, t in want.items()}
    for c, r in got.items():
        text = "".join(r["formatted"][s["start"] : s["end"]] for s in r["loss"])
        assert chat.unescape(text) == "".join(t for role, t in want[c] if role == "assistant")
    assert {r[0]: tuple(r)[1:] for r in chat.read_back(pieces, "conv").collect()} == {c: digests(t) for c, t in want.items()}


def test_reader_refuses_other_text(spark):
    for text in ("<s>[user] hello", "hello", "<s>[user] a</s>b", "<s>[user] <s>[user] a</s>"):
        with pytest.raises(Exception, match="isn't of this template|has no end"):
            chat.read_back(spark.createDataFrame([(1, 0, text, False)], "conv bigint, piece bigint, formatted string, loss boolean"), "conv").collect()


def test_query_on_awkward_rows(spark):
    long = "word <tag> [x] \\ " * 90_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", long), (2, None, "assistant", "late"), (2, 3, None, "x"), (2, 3, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a" * chat.DELTA), (3, 0, "assistant", "ü" * (chat.DELTA + 1)), (3, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "e", "m") for r in rows], "conv_id bigint, turn bigint, role string, text string, event string, msg string")
    want = {
        -1: digests([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]),
        1: digests([("user", ""), ("assistant", long)]),
        2: digests([("", "x"), ("", "x"), ("assistant", "late")]),
        3: digests([("assistant", "ü" * (chat.DELTA + 1)), ("assistant", "")]),
        None: digests([("user", "q"), ("assistant", "a" * chat.DELTA)]),
    }
    assert {r[0]: tuple(r)[1:] for r in chat.format_conversations(df).collect()} == want
    assert [r["conv_id"] for r in chat.format_conversations(df.limit(0)).collect()] == [-1]
