"""Physical plans of the queries that decide the cost."""

import re

from pyspark.sql import functions as F

from scorespark.operators import reshape, stats, tables as ops
from scorespark.plans import tables as given
from scorespark.session import scratch_path
from scorespark.sources import tables as logs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_pivot_is_one_shuffle_with_partial_means(spark, sf):
    wide = reshape.pivot_scores(given.marks(spark, sf), ("student_id", "year"), given.SUBJECTS)
    assert exchanges(wide) == 1 and "partial_avg" in plan(wide)
    assert "o_orderkey" not in plan(wide)


def test_student_filter_reaches_both_scans(spark, sf):
    one = ops.get_student_marks(given.marks(spark, sf), given.students(spark, sf), 7, given.SUBJECTS)
    assert "EqualTo(o_custkey,7)" in plan(one) and "EqualTo(c_custkey,7)" in plan(one)


def test_split_filter_prunes_folders(spark, sf):
    path = scratch_path(spark, "by-split")
    given.engagement(spark, sf).write.partitionBy("split").parquet(path)
    assert re.search(r"PartitionFilters: \[[^\]]*split[^\]]*= test", plan(logs.get_vle_data(spark.read.parquet(path), "test")))


def test_one_key_reads_one_folder_of_a_log(spark):
    path = scratch_path(spark, "log")
    rows = spark.range(200).selectExpr(
        "id AS vle_student_id", "1 AS predicted_label", "0.5D AS predicted_proba", "'m' AS model_used")
    logs.save_vle_predictions(rows, path)
    logs.save_vle_predictions(rows.where("vle_student_id = 7"), path)
    one = logs.get_vle_predictions(spark, path, 7)
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan(one)) and one.count() == 2
    assert logs.get_vle_predictions(spark, path).count() == 201 and "_bucket" not in one.columns


def test_top_n_needs_no_sort_of_all_rows(spark, sf):
    top = plan(stats.top_performers(given.wide(spark, sf), 3, given.SUBJECTS))
    assert "TakeOrderedAndProject" in top and "rangepartitioning" not in top


def test_first_row_per_key_combines_before_the_shuffle(spark, sf):
    li = given.table(spark, sf, "lineitem")
    text = plan(ops.keep_first(li.select("l_orderkey", "l_partkey"), ["l_orderkey"], ["l_partkey"]))
    assert "partial_min" in text and "Window" not in text


def test_text_stays_on_its_side_of_the_join(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(given.text_features(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for line in text.splitlines():
        if "Exchange" in line:
            assert "text" not in line


def test_skewed_student_joins_by_shuffle(spark, sf):
    """Without broadcasts the joins still give the same rows."""
    marks, students = given.marks(spark, sf), given.students(spark, sf)
    hot = marks.withColumn("student_id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("student_id")))
    expected = sorted(map(repr, ops.get_all_marks_wide(hot, students, given.SUBJECTS).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(repr, ops.get_all_marks_wide(hot, students, given.SUBJECTS).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(expected)
    assert [g.split("urgent")[0] for g in got] == [e.split("urgent")[0] for e in expected]


def test_what_pairs_do_not_need_is_left_early(spark, sf, monkeypatch):
    """Rows without a score do not enter the mean of a key, and pairs are staged without names."""
    wide = plan(reshape.pivot_scores(given.marks(spark, sf), ("student_id", "year"), given.SUBJECTS))
    below = wide[wide.rindex("HashAggregate"):]
    assert "Filter" in below and "isnotnull" in below.lower()
    staged, plain = [], given.stage
    monkeypatch.setattr(given, "stage", lambda df, name: staged.append(df.columns) or plain(df, name))
    given.staged_pairs(spark, sf)
    assert staged and not any("name" in columns for columns in staged)
