"""What the cleaner says it removed and corrected."""

from parlance.plans import pipeline


def test_removed_and_corrections_in_the_order_of_the_stages(spark):
    rows = [
        (1, "um i'm gonna pay twenty five dollars", "en"), (2, "All fine.", "en"), (3, None, "en"), (4, "", "en"), (5, "go to the store no wait the shop", "en"), (6, "it is kinda late. then we go. you know", "en"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    out = {r.id: r for r in pipeline.standard().apply(df, removed="gone", corrected="changes").collect()}
    plain = {r.id: r.clean_text for r in pipeline.standard().apply(df).collect()}
    assert {i: r.clean_text for i, r in out.items()} == plain
    changes = {i: [(c.kind, c.original, c.replacement) for c in r.changes] for i, r in out.items()}
    assert out[1].gone == ["um"]
    assert changes[1] == [
        ("SpokenFormNormalized", "gonna", "going to"), ("NumeralNormalized", "i'm going to pay twenty five dollars", "i'm going to pay $25"), ("Capitalized", "i", "I"), ("PunctuationInserted", "", "."),
    ]
    assert out[1].clean_text == "I'm going to pay $25."
    assert changes[2] == changes[3] == changes[4] == []
    assert out[2].gone == out[3].gone == []
    assert changes[5][0][0] == "SelfCorrectionRemoved"
    assert changes[5][0][2] == ""
    assert out[6].gone == ["you know"]
    assert [c for c in changes[6] if c[0] == "Capitalized"] == [("Capitalized", "i", "I"), ("Capitalized", "t", "T")]


def test_columns_only_on_request(spark):
    df = spark.createDataFrame([(1, "a", "en")], "id int, text string, lang string")
    assert pipeline.standard().apply(df).columns == ["id", "text", "lang", "clean_text"]
