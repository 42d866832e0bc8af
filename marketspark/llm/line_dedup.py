"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of the host's
pages that hold it, divided by the host's pages; lines above a boilerplate
ratio are dropped from the host's pages.

The ratio decides; only below ``min_pages`` pages that hold a line there is
nothing to tell boilerplate from a line used twice (on a host of five pages a
line of one page would be above any ratio under a fifth). Lines are
compared after normalising (lower-cased, white space collapsed, trimmed);
the kept lines stay as they were. Blank lines are never boilerplate.

Defined results for odd input: null text stays null and has no lines; a null
host is no site, its pages stay as they are; a page that loses all its lines
becomes empty text and stays a row; repeated rows are pages of their own; an
empty table gives no rows. Input columns named like the outputs are replaced
by them; working columns are prefixed ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .lines import line_counts, line_key, lines_of, with_host_lines

BOILERPLATE_RATIO = 0.1
MIN_PAGES = 3


def boilerplate_lines(pages: DataFrame, *, ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES,
                      host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(_ld_host, key, n_docs, pages): lines above the ratio of their host."""
    rows = pages.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("_ld_host"), F.col(text_col).alias("_ld_text"))
    totals = rows.groupBy("_ld_host").agg(F.count("*").alias("pages"))
    keyed = rows.select("_ld_host", F.transform(lines_of(F.col("_ld_text")), line_key).alias("_ld_keys"))
    counts = line_counts(keyed, "_ld_host", "_ld_keys").where(F.col("n_docs") >= min_pages)
    return (counts.join(totals, "_ld_host")
            .where((F.col("pages") >= min_pages) & (F.col("n_docs") > F.lit(ratio) * F.col("pages"))))


def drop_boilerplate(pages: DataFrame, *, ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES,
                     host_col: str = "source", text_col: str = "text") -> DataFrame:
    """pages with the boilerplate lines cut out of the text, and the columns
    n_lines and n_dropped."""
    bad = boilerplate_lines(pages, ratio=ratio, min_pages=min_pages, host_col=host_col, text_col=text_col)
    rows = pages.withColumn("_ld_host", F.col(host_col).cast("string"))
    rows = with_host_lines(rows, bad.select(F.col("_ld_host").cast("string").alias("_ld_host"), "key"), "_ld_host", "_ld_bad")
    text = F.col(text_col)
    kept = F.filter(lines_of(text), lambda x: F.coalesce(~F.array_contains(F.col("_ld_bad"), line_key(x)), F.lit(True)))
    rows = (rows.withColumn("_ld_kept", F.when(text.isNotNull() & (F.size("_ld_bad") > 0), kept))
            .withColumn("n_lines", F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
            .withColumn("n_dropped", F.when(F.col("_ld_kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_ld_kept")).cast("long"))
            .withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join("_ld_kept", "\n")).otherwise(text)))
    return rows.select(*[c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
