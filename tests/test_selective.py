from rankloom.operators import metrics


def test_all_cases_with_gold(spark):
    positives = spark.createDataFrame([(1, True), (2, False)], "case_id long, success boolean")
    none = spark.createDataFrame([], "case_id long, abstained boolean, natural boolean")
    (row,) = metrics.selective(positives, none, "balanced|").collect()
    assert (row.mixture, row.n, row.positive_n, row.no_gold_n, row.positive_success) == ("natural", 2, 2, 0, 0.5)
    assert row.selective_success is None and row.abstention_rate is None and row.natural_rate is None


def test_both_classes(spark):
    positives = spark.createDataFrame([(1, True), (2, False)], "case_id long, success boolean")
    none = spark.createDataFrame([(3, True, False)], "case_id long, abstained boolean, natural boolean")
    found = {r.mixture: r for r in metrics.selective(positives, none, "balanced|").collect()}
    assert (found["natural"].selective_success, found["balanced"].n, found["natural"].abstention_rate, found["natural"].natural_rate) == (0.666667, 2, 1.0, None)
