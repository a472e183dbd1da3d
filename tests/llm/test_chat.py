"""Chat formatting: exact round trip of every turn."""

import hashlib

import pytest

from telemetry_ops.llm import chat as C

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "\\", "<\\/s>", "\\\\<|", "<<SYS>>", "[\\INST]", "<|image:1|>", "", "é😀\n\n", "<" * 5 + "|", "\\n"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible_and_leaves_no_control(text):
    safe = C.escape(text)
    assert C.unescape(safe) == text
    assert not any(c in safe for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))
    assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)


def digest(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha(whole), len(said), sha(said))


def test_read_back(spark):
    talks = {7: [("user", NASTY[0]), ("assistant", NASTY[1])], 8: [("assistant", t) for t in NASTY], 9: [(None, None), ("odd\nrole", "x"), ("assistant", None)]}
    talks[None] = [("user", "no id"), ("assistant", "yes")]
    rows = [(c, i, r, t, "clash") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string").repartition(4)
    got = {r["conv_id"]: r for r in C.chat_digests(C.format_chats(df)).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == digest(turns)


def test_parts_are_flattened_in_order(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 10), ("text", " and", None, None), ("document", None, "c.pdf", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("image", None, "d.png", 1)])], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    rows = sorted(C.format_chats(df).collect(), key=lambda r: r["position"])
    assert rows[0]["piece"] == "<|im_start|>user\nsee <|image:1|><|audio:2|> and<|document:3|><|im_end|>\n"
    assert [(a["number"], a["ref"], a["tokens"]) for r in rows for a in r["attachments"]] == [(1, "a.png", 512), (2, "b.wav", 250), (3, "c.pdf", 640), (4, "d.png", 256)]
    (d,) = C.chat_digests(C.format_chats(df)).collect()
    assert (d["n_attachments"], d["attachment_tokens"], d["loss_chars"]) == (4, 1658, 0)
    assert d["formatted_chars"] == sum(len(r["piece"]) for r in rows)


def test_ties_repeated_rows_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "z")]
    (d,) = C.chat_digests(C.format_chats(spark.createDataFrame(rows, schema))).collect()
    assert tuple(d)[1:5] == digest([("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "z")])
    assert C.chat_digests(C.format_chats(spark.createDataFrame([], schema))).collect() == []
