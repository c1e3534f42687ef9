"""The table functions from SQL."""

import pytest

from lodestone.functions import tables
from lodestone.functions import text as T


def test_table_functions(spark):
    tables.register(spark)
    rows = [(1, "a\nbb\nccc\n" * 4, [1, 2, 3, 4, 5]), (2, None, None), (3, "", []), (4, "x" * 30, [7]), (5, "p\fq r" * 5, [1, 2, 3])]
    df = spark.createDataFrame(rows, "id int, text string, ids array<int>")
    df.createOrReplaceTempView("given")
    got = sorted(map(tuple, spark.sql("SELECT id, c.* FROM given, LATERAL chunk_code(text, 10) c").collect()))
    assert got == sorted((r["id"], r["chunk_index"], r["text"]) for r in T.chunked(df.select("id", "text"), 10).collect()) and len(got) > 10
    for length, overlap in ((2, 1), (3, 0), (4, 2), (9, 8)):
        got = sorted((r["id"], r["window_index"], list(r["ids"])) for r in spark.sql(f"SELECT id, w.window_index, w.ids FROM given, LATERAL token_windows(given.ids, {length}, {overlap}) w").collect())
        w = df.select("id", T.token_windows("ids", length, overlap).alias("w")).where("w IS NOT NULL")
        assert got == sorted((r["id"], i, list(x)) for r in w.collect() for i, x in enumerate(r["w"]))
    assert spark.sql("SELECT * FROM token_windows(array('a', 'b', 'c'), 2, 1)").dtypes == [("window_index", "int"), ("ids", "array<string>")]


@pytest.mark.parametrize("call", ["chunk_code('x', 0)", "chunk_code(1, 5)", "token_windows(array(1), 2, 2)", "token_windows('x', 2, 1)", "chunk_code('x', NULL)"])
def test_wrong_arguments_are_errors_of_analysis(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="must be|need"):
        spark.sql(f"SELECT * FROM {call}")
