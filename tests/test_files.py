"""CSV in the dialect that is written: header, doubled quotes, line breaks in fields."""

import pytest
from pyspark.sql import functions as F

from samplewright.sources import files

ROWS = [(1, 'a "b", c', 1.5), (2, "two\nlines", None), (3, "NA", 2.0), (4, "", 3.0), (5, None, 4.0), (6, "1.000,5;x", 1000.5), (7, "  \t pad\r\n ", None)]
SCHEMA = "k int, t string, v double"


def test_stage_as_csv_is_the_identity(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    back = files.stage(df, str(tmp_path / "t"), format="csv")
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == ROWS


def test_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('v,more,t,k\n1.5,x,"say ""hi"", you",1\nbad,,NA,2\n,,"a\nb",3\n')
    got = [tuple(r) for r in files.read_csv(spark, str(path), SCHEMA).orderBy("k").collect()]
    assert got == [(1, 'say "hi", you', 1.5), (2, None, None), (3, "a\nb", None)]
    with pytest.raises(ValueError, match="no column z"):
        files.read_csv(spark, str(path), "z int")


def test_decimal_commas_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('t;v;k\n"x;y";1.234,5;1\nz;?;2\n')
    got = [tuple(r) for r in files.read_csv_decimal_comma(spark, str(path), SCHEMA).orderBy("k").collect()]
    assert got == [(1, "x;y", 1234.5), (2, "z", None)]


def test_files_without_line_breaks_in_fields_are_split(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,t,v\n" + "".join(f'{i},"a ""{i}""",{i}.5\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        one, many = (files.read_csv(spark, str(path), SCHEMA, line_breaks=x) for x in (True, False))
        pieces = lambda df: df.select(F.spark_partition_id()).distinct().count()
        assert pieces(one) == 1 and pieces(many) > 3
        assert many.exceptAll(one).isEmpty() and many.count() == one.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
