"""Schemas of the stored tables."""

from pyspark.sql import types as T

METRIC_ROW = T.StructType([
    T.StructField("slide", T.IntegerType()), T.StructField("category", T.StringType()),
    T.StructField("company", T.StringType()), T.StructField("metric1", T.StringType()),
    T.StructField("metric2", T.StringType()), T.StructField("source_tab", T.StringType()),
    T.StructField("source_link", T.StringType()), T.StructField("cur", T.DoubleType()),
    T.StructField("prior", T.DoubleType()), T.StructField("growth", T.DoubleType()),
])

EXTRACTED_VALUE = T.StructType([
    T.StructField("found", T.BooleanType()), T.StructField("cur", T.DoubleType()), T.StructField("prior", T.DoubleType()),
    T.StructField("source_form", T.StringType()), T.StructField("page_number", T.IntegerType()),
    T.StructField("evidence", T.StringType()), T.StructField("notes", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("page_number", T.IntegerType()), T.StructField("forms_detected", T.ArrayType(T.StringType())),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))), T.StructField("text", T.StringType()),
])

FILING = T.StructType([
    T.StructField("company", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("pdf_sha256", T.StringType()), T.StructField("pdf_size", T.LongType()),
    T.StructField("pages", T.ArrayType(PAGE)),
])

METRIC_SPEC = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("forms", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StructType([
        T.StructField("slide", T.IntegerType()), T.StructField("metric1", T.StringType()),
        T.StructField("metric2", T.StringType())]))),
])

HISTORY = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("entity", T.StringType()),
    T.StructField("fy_end", T.IntegerType()), T.StructField("value", T.DoubleType()),
])

SOURCE_ENTRY = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("file_type", T.StringType()),
    T.StructField("url_template", T.StringType()),
])
