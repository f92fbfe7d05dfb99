from lodgewise.operators import impute

SCHEMA = "id int, branch string, total_guests int, room string, price double"


def rooms(df):
    return {r["id"]: r["room"] for r in df.collect()}


def prices(df):
    return {r["id"]: r["price"] for r in df.collect()}


def test_mode_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([(1, "x", 1, "b", 1.0), (2, "x", 1, "a", 1.0), (3, "x", 1, None, 1.0)], SCHEMA)
    assert impute.group_mode(df, ["branch"], "room").first()["mode"] == "a"


def test_room_fallbacks(spark):
    rows = [
        (1, "x", 2, "King", 1.0),
        (2, "x", 2, "King", 1.0),
        (3, "x", 2, None, 1.0),  # group mode King
        (4, "x", 3, "Queen", 1.0),
        (5, "x", 9, None, 1.0),  # branch mode King
        (6, "y", 1, None, 1.0),  # overall mode: King after the fills above
        (7, None, 2, None, 1.0),  # no group: overall mode
        (8, "z", 4, "Queen", 1.0),
        (9, "z", 4, "Queen", 1.0),
    ]
    got = rooms(impute.impute_rooms(spark.createDataFrame(rows, SCHEMA)))
    assert (got[3], got[5], got[6], got[7]) == ("King", "King", "King", "King")
    assert got[4] == "Queen"


def test_price_fallbacks(spark):
    rows = [
        (1, "x", 1, "A", 10.0),
        (2, "x", 1, "A", 30.0),
        (3, "x", 1, "A", None),  # group median 20
        (4, "y", 1, "B", None),  # group without prices: overall median
        (5, "x", 1, "C", 100.0),
        (6, None, 1, "A", None),  # NULL keys match no group
    ]
    got = prices(impute.impute(spark.createDataFrame(rows, SCHEMA)))
    assert got[3] == 20.0
    # overall median of 10, 20 (filled), 30, 100
    assert got[4] == got[6] == 25.0


def test_tables_learnt_on_one_frame_fill_another(spark, tmp_path):
    train = spark.createDataFrame([(1, "x", 1, "A", 10.0), (2, "x", 1, "A", 20.0), (3, "y", 1, "B", 90.0)], SCHEMA)
    new = spark.createDataFrame([(4, "x", 1, None, None), (5, "new", 7, None, None)], SCHEMA)
    tables = impute.fit(train)
    tables.save(str(tmp_path / "tables"))
    loaded = impute.ImputationTables.load(spark, str(tmp_path / "tables"))
    for t in (tables, loaded):
        got = t.fill(new)
        assert rooms(got) == {4: "A", 5: "A"}
        assert prices(got) == {4: 15.0, 5: 20.0}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "x", 1, None, None)], SCHEMA)
    assert impute.impute(df).select("room", "price").first() == (None, None)


def test_indicators_constant_and_summary(spark):
    df = spark.createDataFrame([(1, "x", 1, None, 1.0), (2, "x", 1, "A", None)], SCHEMA)
    flags = impute.missing_indicators(df, ["room", "price"]).orderBy("id").select("room_missing", "price_missing")
    assert flags.collect() == [(1, 0), (0, 1)]
    assert rooms(impute.fill_constant(df, ["room"])) == {1: "missing", 2: "A"}
    summary = impute.imputation_summary(df, impute.impute(df), ["room", "price"]).orderBy("column").collect()
    assert summary == [("price", 1, 0, 1), ("room", 1, 0, 1)]
