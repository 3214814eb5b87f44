from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.plans import inputs as I

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["page_lines", "page_blocks", "page_stats", "table_blocks", "grid_lines", "grid_rows", "output_widths"])
def test_only_the_rows_that_are_read_are_exchanged(spark, name):
    assert exchanges(__spark_entry__.queries()[name](spark, SF)) == 1


def test_words_and_cells_stay_where_their_rows_were_dealt(spark):
    assert exchanges(I.text_items(spark, SF).groupBy("doc_id", "page_no").count()) == 1
    assert exchanges(I.cells(spark, SF).groupBy("file_id", "sheet_no", "row", "col").count()) == 1


def test_wanted_items_are_told_before_a_document_is_taken_apart(spark):
    every = I.text_items(spark, SF)
    wanted = every.filter((F.col("doc_id") % 7 == 0) & (F.col("item_no") % 5 == 0)).select("doc_id", "page_no", "item_no")
    got = I.text_items(spark, SF, wanted)
    assert sorted(got.collect(), key=str) == sorted(every.join(wanted, ["doc_id", "page_no", "item_no"], "left_semi").select(*got.columns).collect(), key=str)


def test_tasks_grow_with_the_rows(spark):
    assert I.tasks_for(spark.range(10), 4) == spark.sparkContext.defaultParallelism
    assert I.tasks_for(spark.range(4001), 400) == 11


@pytest.mark.parametrize("name", ["word_elements", "word_bodies"])
def test_no_paths_are_exchanged(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning(file_id") :]
    assert below.splitlines()[1].strip(" :+-*(0123456789)").startswith("Project")


@pytest.mark.parametrize("name", ["word_blocks", "word_characters"])
def test_elements_are_read_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
