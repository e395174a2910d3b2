"""Cuts of cuts stay small expressions, each computed once a row."""

from pyspark.sql import functions as F

from heronry.functions import lines


def test_second_cell_is_a_small_expression(spark):
    rows = [("<tr>\n<th>\nTitle\n</th>\n<td>\nt1\n</td>",), ("<td>\nTitle\n</td>",), ("",), (None,)]
    d = spark.createDataFrame(rows, "text string").select(lines.join_lines(lines.second_cell(F.split("text", "\n"), "Title")).alias("out"))
    assert d._jdf.queryExecution().analyzed().toString().count("<t[dh]") < 20
    assert [r.out for r in d.collect()] == ["t1", "", "", None]
