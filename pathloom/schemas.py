"""Explicit schemas of the tables that are read."""

from pyspark.ml.linalg import VectorUDT
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

URLS = StructType([StructField("id", LongType()), StructField("url", StringType())])
LABELS = StructType([StructField("id", LongType()), StructField("label", StringType())])
SPLIT_URLS = StructType([*URLS.fields, StructField("split_url", ArrayType(StringType()))])
RANKED_URLS = StructType([*SPLIT_URLS.fields, StructField("word_frequency_orders", ArrayType(LongType()))])
WORD_VECTORS = StructType([StructField("word", StringType()), StructField("vector", VectorUDT())])
CLUSTERED_URLS = StructType([*URLS.fields, StructField("cluster_id", IntegerType()), StructField("vector", VectorUDT())])
REJECTS = StructType([StructField("file", StringType()), StructField("line", StringType()), StructField("reason", StringType())])
