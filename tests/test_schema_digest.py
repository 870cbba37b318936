"""Projections of important fields."""

from trajet.functions import text as T
from pyspark.sql import functions as F


def test_projection(spark):
    rows = [
        ('{"b":[1,2,3,4,5,6],"a":"x\\"y","c":{"z":1,"y":[2]},"n":null,"t":true,"f":1.50}', '{"a":"x\\"y","b":[1,2,3,4,5,"…"],"n":null,"c":{"z":1,"y":[2]},"t":true}'),
        ('{"b":[1,2,3,4,5]}', '{"b":[1,2,3,4,5]}'),
        ('{"b":[null,"q",[7],{"k":0},false,9]}', '{"b":[null,"q",[7],{"k":0},false,"…"]}'),
        ("[1,2]", "{}"), ("{}", "{}"), ("7", "7"), ('"text"', '"text"'), ("no json", "no json"), (None, None),
        ("x" * 1000, "x" * 300 + T.TRUNCATION_MARKER + "x" * 300),
    ]
    df = spark.createDataFrame(rows, "output string, want string")
    for r in df.select("want", T.schema_digest(F.col("output"), ["a", "b", "missing", "n", "c", "t"]).alias("got")).collect():
        assert r["got"] == r["want"], (r["want"], r["got"])
