import random

from rankloom.operators import audit


def test_ranges_against_all_pairs(spark):
    draw = random.Random(1)
    span = lambda: (a := draw.randint(-300, 900), a + draw.choice([0, 0, 3, 70, 400, -5]))
    edits = [(draw.choice(["hot", "hot", "a", None]), *span()) for _ in range(300)] + [("hot", None, 5), ("hot", 1, 1), ("hot", 1, 1)]
    shown = [(draw.choice(["hot", "a", "b", None]), *span()) for _ in range(60)] + [("hot", 2, None)]
    found = audit.range_overlap(spark.createDataFrame(edits, "path string, s int, e int"), spark.createDataFrame(shown, "path string, lo int, hi int"))

    def covered(p, s, e):
        return None not in (p, s, e) and s <= e and any(q == p and hi is not None and lo <= hi and s <= hi and e >= lo for q, lo, hi in shown)

    assert sorted((tuple(r) for r in found.collect()), key=lambda r: (str(r[0]), str(r[1]), str(r[2]))) == sorted(((*r, covered(*r)) for r in edits), key=lambda r: (str(r[0]), str(r[1]), str(r[2])))


def test_a_hot_path_and_empty_tables(spark):
    edits = spark.range(20_000).selectExpr("'one' AS path", "CAST(id * 3 AS INT) AS s", "CAST(id * 3 + 1 AS INT) AS e")
    shown = spark.range(20_000).selectExpr("'one' AS path", "CAST(id * 6 AS INT) AS lo", "CAST(id * 6 + 1 AS INT) AS hi")
    assert audit.range_overlap(edits, shown).where("covered").count() == 10_000
    assert audit.range_overlap(edits.limit(0), shown).count() == 0 and audit.range_overlap(edits, shown.limit(0)).where("covered").count() == 0
