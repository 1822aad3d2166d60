"""What showed on larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.functions import dates
from ledgerloom.llm import line_dedup
from ledgerloom.operators import geometry, listing
from ledgerloom.plans import extract

from .compare import both


def test_account_tails_of_long_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (*range(1, 17), *range(9_992, 10_016), 123_456)], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    names, mine, sql_names, sql = both(spark, __spark_entry__.queries()["account_tails"], __spark_entry__.oracle_sql()["account_tails"], str(tmp_path))
    assert names == sql_names and mine == sql


def test_line_dedup_deals_texts_without_a_sort_and_keys_are_short(spark):
    docs = spark.createDataFrame([(1, "a line that is repeated here\nand one that is not, at all"), (2, "a line that is repeated here")], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs, broadcast_bytes=0)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 1}
    keys = line_dedup.keyed(line_dedup.lines_of(docs, 20), 2).selectExpr("min(key) as lo", "max(key) as hi").first()
    assert 0 <= keys.lo and keys.hi < 1 << 48


def test_a_month_with_a_digit_behind_it_is_no_date_and_long_text_is_not_tried(spark):
    said = spark.createDataFrame([("january1 30",), ("5 jan1",), ("January 30",), ("2024-1-5",), ("1/5.",)], "t string")
    found = {r.t: str(r.d) for r in said.select("t", dates.parse_date(F.col("t")).alias("d")).collect()}
    assert found == {"january1 30": "None", "5 jan1": "None", "January 30": "1904-01-30", "2024-1-5": "2024-01-05", "1/5.": "1904-01-05"}


def test_headers_are_told_by_one_pattern_a_word(spark):
    words = spark.createDataFrame([([("#DATE", 0.0, 1.0), (".Amount", 2.0, 3.0), ("Dates", 4.0, 5.0), ("amount", 6.0, 7.0)],)], "w array<struct<text:string,x0:double,x1:double>>")
    found = words.select(listing.header_of(F.col("w")).alias("h"))
    assert len(found.first().h.slots) == 2
    assert "lower(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_sort_by_top_alone_and_fold_only_what_may_part(spark):
    words = spark.createDataFrame([(1, 10.0, 5.0, "b"), (1, 12.0, 1.0, "a"), (1, 15.5, 0.0, "c"), (1, 17.0, 0.0, "d"), (1, 19.9, 9.0, "e")], "page int, top double, x0 double, text string").selectExpr("page", "top", "x0", "x0 + 1 as x1", "text", "10.0d as height")
    found = geometry.lines(words, ["page"])
    assert [r.text for r in found.orderBy("line_idx").collect()] == ["a b", "c d", "e"]
    assert "text#" not in next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lag(top" in x).split("windowspecdefinition")[1].split("specifiedwindowframe")[0]


def test_sharpness_is_counted_in_dealt_tasks(spark, monkeypatch):
    words = spark.range(3000).selectExpr("id % 2 as page", "cast(id % 97 as double) as top", "cast(id % 13 as double) as x0", "1500L as n_words")
    slopes = F.array(*map(F.lit, (-0.5, 0.0, 0.25)))
    plain = sorted(map(tuple, geometry.sharpness(words, ["page"], slopes).collect()))
    for most in (10, 10_000):
        monkeypatch.setattr(geometry, "WORDS_A_TASK", most)
        dealt = geometry.sharpness(words, ["page"], slopes, 5)
        assert sorted(map(tuple, dealt.collect())) == plain
        assert dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1


def test_words_with_a_source_are_made_once(spark):
    words = spark.createDataFrame([("1", 1, "a", 0.0, 1.0, 2.0, 10.0, "text")], "doc_id string, page int, text string, x0 double, x1 double, top double, height double, source string")
    assert extract.held(words).inputFiles()
    assert extract.held(words.drop("source")).columns == words.columns[:-1]


def test_line_dedup_sends_no_text_with_the_keys_past_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a line that has a near one here"), (2, "a line that has a near two here"), (3, "a line that has a near twoo here\nand another line of its own")], "doc_id long, text string")
    plans, write = {}, line_dedup.materialize

    def noted(df, name):
        plans[name] = df.columns, df._jdf.queryExecution().sparkPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialize", noted)
    near = line_dedup.near_lines(docs, broadcast_bytes=0)
    assert near.count() == 1
    lines = {r.h: r.line for r in line_dedup.lines_of(docs, 20).collect()}
    assert {frozenset((lines[r.a], lines[r.b])) for r in near.collect()} == {frozenset(("a line that has a near two here", "a line that has a near twoo here"))}
    columns, plan = plans["line_members"]
    assert sorted(columns) == ["h", "key", "own"] and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_listing_line_is_read_for_dates_and_amounts_once(spark):
    boxes = [("1/5", 0.0, 18.0), ("C17", 22.0, 40.0), ("12.34", 44.0, 74.0), ("Jan", 100.0, 118.0), ("6", 122.0, 128.0), ("C18", 132.0, 150.0), ("7", 154.0, 160.0), (".50", 160.0, 178.0)]
    words = spark.createDataFrame([(boxes,)], "w array<struct<text:string,x0:double,x1:double>>")
    bands = F.expr("array(named_struct('x0', -1d, 'x1', 90d), named_struct('x0', 90d, 'x1', 999d))")
    found = words.select(listing.records_of(bands, F.col("w")).alias("r"))
    assert [(str(r.date), r.cents, r.description) for r in found.first().r] == [("1904-01-05", 1234, "C17"), ("1904-01-06", 750, "C18")]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 2
