"""Rows that come after their day was closed are kept apart and counted."""

import datetime as dt

from lakeloom.streaming.late import daily_with_late


def test_late_rows_have_a_table_and_correct_the_counts(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 3, d, h)
    batches = [
        [(1, "a", day(1, 5)), (2, "a", day(1, 9)), (3, "b", day(1, 7))],
        [(4, "a", day(3, 2)), (5, "a", day(1, 23))],  # 5 is out of order, but its day is still open; then days 1 and 2 close
        [(6, "a", day(1, 1)), (7, "b", day(1, 2)), (8, "b", day(2, 2)), (9, "a", day(3, 1))],  # 6, 7 and 8 are late
        [(10, "a", day(5, 1))],
        [(11, "a", day(1, 3)), (12, "a", day(3, 3))],  # both late
    ]
    schema = "event_id long, event_type string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts, late = daily_with_late(stream)
    want = {}
    for rows in batches:
        for _, kind, at in rows:
            want[at.date(), kind] = want.get((at.date(), kind), 0) + 1
    assert {(r.day, r.event_type): r.n for r in counts.collect()} == want
    assert sorted(r.event_id for r in late.collect()) == [6, 7, 8, 11, 12]
