"""Sources (A1-A3): typed readers and the normalisation the shop applies
when it maps database rows to catalogue objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VENDOR_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("tagline", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("logo", T.StringType()),
    T.StructField("primary_color", T.StringType()),
    T.StructField("secondary_color", T.StringType()),
    T.StructField("gradient", T.StringType()),
    T.StructField("card_gradient", T.StringType()),
    T.StructField("accent_color", T.StringType()),
    T.StructField("banner_image", T.StringType()),
    T.StructField("rating", T.DecimalType(3, 1)),
    T.StructField("review_count", T.IntegerType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("whatsapp", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("pos", T.LongType()),
])

PRODUCT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vendor", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("price", T.DecimalType(18, 2), False),
    T.StructField("original_price", T.DecimalType(18, 2)),
    T.StructField("in_stock", T.BooleanType()),
    T.StructField("badge", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("material", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("sizes", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),         # JSON text
    T.StructField("rating", T.DecimalType(3, 1)),
    T.StructField("image", T.StringType()),
    T.StructField("review_count", T.IntegerType()),
    T.StructField("pos", T.LongType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the schema's missing nullable columns as typed nulls (a source
    may omit optional columns; CSV cannot carry arrays or structs)."""
    have = set(df.columns)
    for f in schema.fields:
        if f.name not in have:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None, **options) -> DataFrame:
    """Read parquet / json / csv / orc without inference. Parquet and ORC
    carry their own schema; JSON is read with the given one; CSV columns are
    matched by their header name and cast (nested fields become null)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None and fmt == "json":
        r = r.schema(schema)
    elif fmt == "csv":
        r = r.option("header", options.get("header", "true")).option("inferSchema", "false")
    df = r.load(path)
    if schema is not None and fmt == "csv":     # columns are found by header name; others stay as text
        for f in schema.fields:
            nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            if f.name in df.columns and not nested:
                df = df.withColumn(f.name, F.col(f.name).cast(f.dataType))
    return conform(df, schema) if schema is not None else df


def load_vendors(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A1: read vendors and apply the catalogue defaults."""
    return normalize_vendors(read_table(spark, path, fmt, VENDOR_SCHEMA, **options))


def load_products(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A2: read products and apply the catalogue defaults."""
    return normalize_products(read_table(spark, path, fmt, PRODUCT_SCHEMA, **options))


def normalize_vendors(df: DataFrame) -> DataFrame:
    """A1: rating null/0 -> 5, review_count null -> 0, categories null -> [],
    empty page -> 'store.html?vendor=<id>'."""
    return (df.withColumn("rating", F.coalesce(F.nullif(F.col("rating"), F.lit(0)),
                                               F.lit(5)).cast("decimal(3,1)"))
              .withColumn("review_count", F.coalesce(F.col("review_count"), F.lit(0)).cast("int"))
              .withColumn("categories", F.coalesce(F.col("categories"), F.array().cast("array<string>")))
              .withColumn("page", F.coalesce(F.nullif(F.col("page"), F.lit("")),
                                             F.concat(F.lit("store.html?vendor="), F.col("id")))))


def normalize_products(df: DataFrame) -> DataFrame:
    """A2: sizes null -> [], review_count null -> 0, rating null/0 -> 5; original_price keeps
    null. A row without a price stays (J4 reports it); it can be listed but
    not ordered."""
    return (df.withColumn("price", F.col("price").cast("decimal(18,2)"))
              .withColumn("original_price", F.col("original_price").cast("decimal(18,2)"))
              .withColumn("sizes", F.coalesce(F.col("sizes"), F.array().cast("array<string>")))
              .withColumn("rating", F.coalesce(F.nullif(F.col("rating"), F.lit(0)), F.lit(5)).cast("decimal(3,1)"))
              .withColumn("review_count", F.coalesce(F.col("review_count"), F.lit(0)).cast("int")))


def drop_legacy_products(products: DataFrame, legacy_ids: DataFrame) -> DataFrame:
    """A3: remove retired ids. The retired list is a table; an anti join
    (AQE broadcasts it when small, else shuffles) - no driver-side set."""
    return products.join(legacy_ids.select("id").distinct(), "id", "left_anti")
