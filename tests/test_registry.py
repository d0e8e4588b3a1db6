from nadir.operators import registry


def test_choices_of_all_domains(spark):
    rows = [("dti", "m", "The answer is (B)", "B", None), ("dti", "m", "E", "A", None), ("ct", "m", "E", None, "E"), ("ct", "m", "A.", None, "B"), ("none", "m", "A", "A", "A"), ("vp", "m", None, None, "C")]
    df = spark.createDataFrame(rows, "domain string, model string, response string, correct_answer string, gold_answer string")
    got = {r["domain"]: r for r in registry.evaluate_choices(df, "response").collect()}
    assert set(got) == {"dti", "ct", "vp"}
    assert (got["dti"]["parse_rate"], got["dti"]["accuracy"]) == (0.5, 1.0)  # a question of four choices has no E
    assert (got["ct"]["parse_rate"], got["ct"]["accuracy"]) == (1.0, 0.5)
    assert got["vp"]["parse_rate"] == 0.0 and got["vp"]["accuracy"] is None


def test_frame_and_missing_fields(spark):
    table = registry.frame(spark)
    assert table.count() == 5 and table.where("not training").first()["domain"] == "vp"
    df = spark.createDataFrame([("ge", "tested\nDepMap")], "domain string, response string")
    row = registry.described(df).first()
    assert row["gold"] is None and row["choices"] == 4
