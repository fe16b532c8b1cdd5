"""Explicit schemas of forms and index tables; nothing is inferred."""

from pyspark.sql import types as T

FORM = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("code", T.StringType()),
        T.StructField("rev", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

#: Model whose vectors an index holds by default, and their length (fixed values).
MODEL, DIM = "intfloat/multilingual-e5-small", 384
