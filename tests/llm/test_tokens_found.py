"""Further tokens whose digits and letters aren't neighbours."""

from inkwell.llm import secrets


def test_token_in_groups(spark):
    token = "1234-ABCD-5678-EFGH-9012"
    docs = spark.createDataFrame([(1, f"key {token} end", "s"), (2, "a-long-compound-word-of-letters 1234", "s")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["s"] for r in secrets.find(docs).select("doc_id", secrets.written("spans").alias("s")).collect()}
    assert got == {1: f"token:4:{4 + len(token)}", 2: ""}
