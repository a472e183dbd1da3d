"""The pipeline's stages on the smallest table, against what they are made of."""

import corpus_pipeline as C
from telemetry_ops.llm import ngram_join, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "12 !!"), (9004, "mail me at a.b@c.org now please the and")], "doc_id long, text string")
    docs = docs.unionByName(odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")).cache()
    names = [n for n, _ in C.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixture", "encoding"]
    seen = []
    for name, step in C.STAGES[:-1]:
        before, docs = docs, step(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name == "language":
            assert {9001, 9002, 9003} & seen[-1] == set() and 9004 in seen[-1] and len(seen[-1]) >= 199
        if name == "near_duplicates":
            found = ngram_join.ngram_jaccard_join(before).collect()
            assert seen[-1] == {r["component_id"] for r in found}
        if name == "personal_data":
            assert docs.where("text like '%@%.org%'").count() == 0 and seen[-1] == seen[-2]
            assert docs.where("n_chars <> length(text)").count() == 0
    ids = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in ids} == seen[-1] and all(r["n_tokens"] == len(r["ids"]) > 0 for r in ids)


def test_columns_of_the_user_and_empty_tables(spark):
    """Names that stages use themselves survive with their values, and an empty table passes through all stages."""
    own = ("base", "found", "__key", "row", "term", "n", "count", "rate", "lang_pred", "score", "component_id", "kept")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    more = docs.selectExpr("*", *[f"'{c}' AS `{c}`" for c in own]).cache()
    for first in (more, more.where("false")):
        got = first
        for _, step in C.STAGES[:-1]:
            got = step(spark, got, SF).cache()
            assert got.columns == first.columns
        assert got.where(" OR ".join(f"`{c}` <> '{c}'" for c in own)).count() == 0
        assert C.STAGES[-1][1](spark, got, SF).count() == got.count()
        assert (got.count() > 0) == (first is more)


def test_most_frequent_with_ties(spark):
    from telemetry_ops.llm.text import most_frequent

    equal = spark.createDataFrame([(f"w{k:04}", 7) for k in range(500)], "w string, n long")
    assert most_frequent(equal, "w", "n", 400)["w"].tolist() == [f"w{k:04}" for k in range(400)]
    mixed = equal.unionByName(spark.createDataFrame([("top", 90), ("low", 1)], "w string, n long"))
    assert most_frequent(mixed, "w", "n", 3)["w"].tolist() == ["top", "w0000", "w0001"]
    assert len(most_frequent(mixed, "w", "n", 502)) == 502 == len(most_frequent(mixed, "w", "n", 9000))
    assert most_frequent(equal.where("false"), "w", "n", 5).empty


def test_copies_with_one_id_are_one_document(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]) for r in C.one_of_each_group(spark, docs, SF).collect()))
    assert got == ["1", "3", "4", "None"]


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
