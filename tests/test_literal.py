from rankboard.sources.literal import literal_frame


def test_literal_frame_round_trips_awkward_values(spark):
    rows = [(1, "it's", ["a", "b'c"], True, 1.5e-05),
            (2, "back\\slash \\n", None, False, -0.0),
            (3, "⚠️ Demo Data", ["🥇"], None, None),
            (4, None, [], True, 123456789.125)]
    df = literal_frame(spark, rows, "id int, s string, a array<string>, b boolean, d double")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "it's", ["a", "b'c"], True, 1.5e-05),
        (2, "back\\slash \\n", None, False, -0.0),
        (3, "⚠️ Demo Data", ["🥇"], None, None),
        (4, None, [], True, 123456789.125)]
    assert df.dtypes == [("id", "int"), ("s", "string"), ("a", "array<string>"), ("b", "boolean"), ("d", "double")]


def test_literal_frame_empty(spark):
    df = literal_frame(spark, [], "id int, s string")
    assert df.count() == 0 and df.dtypes == [("id", "int"), ("s", "string")]


def test_literal_frame_dates_timestamps_decimals(spark):
    import datetime as dt
    from decimal import Decimal
    rows = [(dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 678000), Decimal("1.50"), 7)]
    df = literal_frame(spark, rows, "d date, t timestamp_ntz, x decimal(5,2), n bigint")
    assert [tuple(r) for r in df.collect()] == rows
