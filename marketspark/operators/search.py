"""Which products a browse request has to look at (B6, B7), by an inverted
index instead of pairing every request with its vendor's whole catalogue.

`search_index` lists each product under the empty string, under every run of
one, two and three characters of the fields that are searched, and under its
category. A request's text holds all its own three-character runs, so any of
them leads to every match; `cheapest_keys` takes the one that the fewest of
the vendor's products hold, or the request's categories if those hold fewer.
Requests with equal vendor, text, page kind and categories are one search.

Candidates are exact-checked by the caller. A hot vendor's entries are spread
over its keys; adaptive execution splits what a single key still holds. A
key that a search uses is one that its matches share, so the joined rows
differ from the results by the other filters only.

Odd input: null fields give no runs; a product without any field is listed
under the empty string; rows that repeat stay as many (entries name rows by
id and row hash); null vendors match nothing; characters are code points.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

RUN = 3                                       # characters of a run
SEARCH = ["vendor", "_q", "_store", "_cats"]
ENTRY = ["vendor", "by", "key"]


def _runs(field: Column, n: int) -> Column:
    """The runs of n characters of a text (null or shorter: none)."""
    some = F.transform(F.sequence(F.lit(1), F.char_length(field) - (n - 1)), lambda i: F.substring(field, i, F.lit(n)))
    return F.when(F.char_length(field) >= n, some).otherwise(F.array().cast("array<string>"))


def row_hash(products: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in products.columns])


def search_index(products: DataFrame, lengths: Iterable[int] = range(1, RUN + 1)) -> DataFrame:
    """(vendor, by, key, id, row, main): by 'text' or 'category'; main is
    false where only the description holds the run. lengths: of the runs
    that will be asked for."""
    runs = lambda c: F.flatten(F.array(F.array().cast("array<string>"), *[_runs(F.lower(F.col(c)), n) for n in lengths]))
    main = F.array_distinct(F.concat(F.array(F.lit("")), runs("name"), runs("category")))
    entry = lambda by, key, is_main: F.struct(F.lit(by).alias("by"), key.alias("key"), F.lit(is_main).alias("main"))
    p = products.select("vendor", "id", row_hash(products).alias("row"), "category", main.alias("_main"), runs("description").alias("_more"))
    entries = F.concat(F.transform("_main", lambda k: entry("text", k, True)),
                       F.transform(F.array_except("_more", "_main"), lambda k: entry("text", k, False)),
                       F.transform(F.array_compact(F.array("category")), lambda k: entry("category", k, True)))
    return p.filter(F.col("vendor").isNotNull()).select("vendor", "id", "row", F.explode(entries).alias("e")).select("vendor", "e.by", "e.key", "id", "row", "e.main")


def as_searches(requests: DataFrame) -> DataFrame:
    """requests with the columns that make two of them the same search."""
    store = F.coalesce(F.col("page") == "store", F.lit(False))
    q = F.coalesce(F.col("q"), F.lit(""))
    cats = F.sort_array(F.array_distinct(F.coalesce("categories", F.array().cast("array<string>"))))
    return requests.withColumns({"_store": store, "_q": F.lower(F.when(store, F.trim(q)).otherwise(q)), "_cats": cats})


def wanted_keys(searches: DataFrame) -> DataFrame:
    """The keys that each search might use: (search columns, by, key)."""
    text = F.when(F.char_length("_q") >= RUN, F.array_distinct(_runs(F.col("_q"), RUN))).otherwise(F.array("_q"))
    keys = F.concat(F.transform(text, lambda k: F.struct(F.lit("text").alias("by"), k.alias("key"))),
                    F.transform(F.array_compact("_cats"), lambda k: F.struct(F.lit("category").alias("by"), k.alias("key"))))
    return searches.select(*SEARCH, F.explode(keys).alias("k")).select(*SEARCH, "k.by", "k.key")


def cheapest_keys(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """The keys that each search uses: (search columns, by, key). Searches
    with a run that none of the vendor's products hold are gone: they match
    nothing."""
    held = entries.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("_all"), F.count_if("main").alias("_main"))
    n = F.coalesce(F.when(F.col("_store"), F.col("_main")).otherwise(F.col("_all")), F.lit(0))
    in_text = F.col("by") == "text"
    cost = wanted.join(held, ENTRY, "left").withColumn("_n", n).groupBy(*SEARCH).agg(
        F.min(F.when(in_text, F.struct("_n", "key"))).alias("_t"), F.sum(F.when(~in_text, F.col("_n"))).alias("_c"),
        F.collect_list(F.when(~in_text, F.col("key"))).alias("_keys"))
    by_text = (F.size("_cats") == 0) | (F.col("_t._n") <= F.coalesce(F.col("_c"), F.lit(0)))
    use = F.when(by_text, F.array(F.struct(F.lit("text").alias("by"), F.col("_t.key").alias("key")))).otherwise(
        F.transform("_keys", lambda k: F.struct(F.lit("category").alias("by"), k.alias("key"))))
    return cost.filter(F.col("_t._n") > 0).select(*SEARCH, F.explode(use).alias("k")).select(*SEARCH, "k.by", "k.key")


def candidates(searches: DataFrame, products: DataFrame) -> DataFrame:
    """(search columns, id, row) of the products that each search has to
    look at."""
    wanted = wanted_keys(searches.filter(F.col("vendor").isNotNull()).select(*SEARCH).distinct())
    # at most RUN numbers: lengths that no search asks for need no entries
    asked = searches.select(F.least(F.char_length("_q"), F.lit(RUN)).alias("n")).filter("n > 0").distinct().collect()
    entries = (search_index(products, sorted(x["n"] for x in asked)).join(wanted.select(*ENTRY).distinct(), ENTRY, "left_semi")
               .groupBy(*ENTRY, "id", "row").agg(F.max("main").alias("main")))
    ensure_checkpoint_dir(products.sparkSession)
    entries = entries.checkpoint(eager=True)  # counted, then joined
    return (cheapest_keys(wanted, entries).join(entries, ENTRY).filter(~F.col("_store") | F.col("main"))
            .select(*SEARCH, "id", "row"))
