"""Spans against plain regular expressions; terms against counting by hand."""

import hashlib
import random
import re

from telemetry_ops.llm import sanitise as S

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["a@b.c", "x.y@z-1.org.", "_@q.r", "@", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111111", "12-", "+1 (555) 010-9999",
            "+", "é", "😀", " ", "\n", "5", "55 ", "a.b", ".", "-", "%", "4444-3333 2222 1111", "+12345678", "(", "word"]
    return ["".join(rng.choices(bits, k=rng.randrange(0, 14))) for _ in range(n)]


def report(spark, rows):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, base string, key int")
    return {r["doc_id"]: r for r in S.span_report(df).collect()}


def test_base_spans(spark):
    rows = list(enumerate(texts(1, 600)))
    rows += [(900, "a" * 60_000 + " 1" * 20_000 + "9" * 30_000 + "x@y.z"), (901, ""), (902, None), (903, ". " * 5000 + "+1" * 4000)]
    got = report(spark, rows)
    for i, t in rows:
        want = brute(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:200]
        assert got[i]["spans"].startswith(want)


def test_terms_that_disclose(spark):
    rng = random.Random(2)
    common = lambda: " ".join(rng.choices(["alpha", "bravo", "delta", "gamma", "omega"], k=20))
    rows = [(i, f"{common()} Zanzibar wrote from j.doe@mail.org today number{i} {common()}") for i in range(4)]
    rows += [(10 + i, common()) for i in range(60)] + [(80, "today is fine")]
    rows += [(90 + i, f"solo{i} near other{i}@mail.org {common()}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in S.sanitise(df).collect()}
    values = {s["value"]: s["kind"] for s in found[0]["found"]}
    assert values["Zanzibar"] == "term" and values["wrote"] == "term" and "alpha" not in values
    assert "Zanzibar" not in found[0]["text"] and "<EMAIL>" in found[0]["text"] and "j.doe" not in found[0]["text"]
    assert values["today"] == "shape" and "<WORD>" in found[0]["text"]  # others say it, too seldom to hide the link
    # A disclosing term is acted on in every text, also in one without the entity.
    assert found[10]["text"] == rows[4][1] and found[80]["text"] == "<WORD> is fine"
    assert all(s["kind"] == "email" for i in range(5) for s in found[90 + i]["found"])  # one text is no evidence


def test_terms_far_away_and_in_texts_without_the_entity(spark):
    rng = random.Random(3)
    common = lambda n=20: " ".join(rng.choices(["alpha", "bravo", "delta", "gamma", "omega"], k=n))
    rows = [(i, f"Kim {common(60)} j.doe@mail.org {common(60)} \u674e\u96f7 İzmir{'.' * i}") for i in range(4)]
    rows += [(10 + i, common()) for i in range(70)] + [(90, "Kim met us in İzmir"), (91, None), (92, "doe, a mail")]
    found = {r["doc_id"]: r for r in S.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):  # further than 80 code points from the entity, and of less than four letters
        assert {s["value"]: s["kind"] for s in found[i]["found"] if s["kind"] != "email"} == {"Kim": "shape", "İzmir": "shape", "李雷": "term"}
    assert found[90]["text"] == "<NAME> met us in <NAME>" and not found[90]["base"]
    assert found[91]["text"] is None and found[92]["text"] == "doe, a mail"  # the entity's own words are no terms
    assert all(found[10 + i]["text"] == rows[4 + i][1] for i in range(70))


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "en"), (1, "mail a@b.c", None)], "doc_id long, text string, lang string")
    got = S.sanitise(df)
    assert got.columns == ["doc_id", "text", "lang", "base", "found"]
    assert sorted(str(r["text"]) for r in got.collect()) == ["None", "mail <EMAIL>"]
    assert S.span_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_of_the_user_are_kept(spark):
    own = ("base", "found", "__key", "__gone", "__shaped", "__clear", "row", "base_", "term")
    df = spark.createDataFrame([(1, "mail a@b.c", *own), (2, None, *own)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in own))
    got = S.sanitise(df)
    assert got.columns == [*df.columns, "base__", "found_"]
    for r in got.collect():
        assert [r[c] for c in own] == list(own) and r["text"] in ("mail <EMAIL>", None)
        assert [s["value"] for s in r["found_"]] == (["a@b.c"] if r["text"] else [])
