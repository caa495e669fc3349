"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

LINES = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("dir", T.StringType(), False),
    T.StructField("h", T.IntegerType(), False),
    T.StructField("w", T.IntegerType(), False),
    T.StructField("px", T.BinaryType(), False),
])

SLICES = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("slice_no", T.IntegerType(), False),
    T.StructField("beg", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False),
])

LABELLED = T.StructType([
    T.StructField("dir", T.StringType(), False),
    T.StructField("idx", T.LongType(), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("image_type", T.IntegerType(), False),
    T.StructField("import_flag", T.BooleanType(), False),
])

PREDICTIONS = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("slice_no", T.LongType(), False),
    T.StructField("label", T.IntegerType(), False),
    T.StructField("mid", T.LongType(), False),
])

SPANS = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("span_no", T.LongType(), False),
    T.StructField("beg", T.LongType(), False),
    T.StructField("end", T.LongType(), False),
])

METRICS = T.StructType([
    T.StructField("tag", T.StringType(), False),
    T.StructField("step", T.LongType(), False),
    T.StructField("value", T.DoubleType(), True),
])
