"""Queries against their SQL over rows that the small tables lack."""

from datetime import datetime

import duckdb

from marram import catalogue
from marram.operators import documents as D


def same(spark, folder, name, **tables):
    """The query's rows and its SQL's over tables of (rows, Spark schema)."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, str(folder))
    want = c.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(want.fetchall(), key=key)
    return got


TALK = [(1, 0, "user", "doñ index ó"), (1, 1, "user", "Èch éê"), (1, 2, "user", "éindex"), (1, 3, "user", "Ñ_é"), (1, 4, "user", None), (1, 5, "user", ""), (1, 6, "user", "ñfind it"), (1, 7, "user", "_find $A")], "conv_id long, turn long, role string, text string"


def test_routes_know_ascii_words_only(spark, tmp_path):
    assert [r[2] for r in same(spark, tmp_path, "intent_route", conversations=TALK)].count("manage") == 2


def test_symbol_hints_know_ascii_words_only(spark, tmp_path):
    got = same(spark, tmp_path, "query_metrics", conversations=(TALK[0] + [(2, 0, "user", "Tion éé B")], TALK[1]))
    assert any(r[5] for r in got)


def test_profiles_have_a_row_for_each_document(spark, tmp_path):
    rows = [(1, None), (2, None), (3, None), (3, ""), (4, "a\nb"), (4, "a\nb"), (5, "a\nb\nc"), (5, "d\ne"), (6, "a\r\nb\nc"), (8, "one")]
    assert len(same(spark, tmp_path, "format_profile", documents=([(*r, "s") for r in rows], "doc_id long, text string, source string"))) == 10


def test_profiles_of_mixed_lines(spark):
    rows = [(1, "a\r\n  b\n  c\n    d\n    \n    \n    "), (2, "a\n    b\n  c"), (3, "\tx\r\ny"), (3, None)]
    got = [tuple(r) for r in D.format_profile(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, "mixed", False, 2), (2, "lf", False, 2), (3, "crlf", True, None), (3, None, None, None)]


def test_ranges_without_a_start_or_an_end(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(1, at(0), 1), (2, None, 1), (3, None, 1), (5, at(50), 1), (None, at(5), 1), (None, at(30), 1), (4, None, 2), (6, None, None), (None, at(0), 3), (7, at(0), 3)]
    same(spark, tmp_path, "interval_merge", events=(rows, "event_id long, ts timestamp_ntz, user_id long"))


def test_equal_ranges_are_merged(spark):
    rows = [(i % 7, a, a + i % 3) for i in range(4000) for a in [(i * 37 % 601) * 5]]
    want = {(k, v) for k in range(7) for v in range(3100) if any(r[0] == k and r[1] <= v <= r[2] for r in rows if abs(r[1] - v) < 4)}
    got = spark.createDataFrame(rows + rows, "u long, a long, b long")
    got = [tuple(r) for r in D.merged_ranges(got, ["u"], "a", "b").collect()]
    assert {(u, v) for u, a, b in got for v in range(a, b + 1)} == want and len({(u, v) for u, a, _ in got for v in [a]}) == len(got)
    assert not any(u == w and c <= a <= d + 1 and (a, b) != (c, d) for u, a, b in got for w, c, d in got)
