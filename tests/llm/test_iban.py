from gridloom.llm import pii

TEXTS = [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
    ("pay to GB82WEST12345698765432 The invoice", ["GB82WEST12345698765432"]),
    ("DE89370400440532013000 2024", ["DE89370400440532013000"]),
    ("NO93 8601 1117 947 A GB82 WEST 1234 5698 7654 32 DE89370400440532013000 X", ["NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]),
    ("MT84 MALT 0110 0001 2345 MTLC AST0 01S 12", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
    ("DE89370400440532013001 2024, DE8937040044053201300 2024, xDE89370400440532013000", []),
]


def test_ibans_before_other_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: [TEXTS[r["doc_id"]][0][x["start"] : x["stop"]] for x in r["found"] if x["kind"] == "iban"] for r in pii.personal_data(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}
    assert [r["text"] for r in pii.masked(df.where("doc_id = 1")).collect()] == ["pay to [IBAN] The invoice"]
