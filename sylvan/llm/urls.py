"""URL filters by dated lists, in DataFrame functions only.

A list is a table of dated entries: ``kind`` (host, domain or prefix), ``pattern``, ``verdict`` (block or allow),
``change`` (add or remove) and ``changed_at``. The entries of one list and pattern become validity intervals
``[valid_from, valid_to)``; each capture is then joined to the intervals that hold at its fetch time. The longest active
pattern decides; between equally long ones block beats allow, then the smallest list name and kind are told.

Cases: an entry with a null in any column but list_name is no entry; at one instant a removal beats an addition and block
beats allow. A capture with a null or unreadable URL, or a null time, matches nothing and is kept. Repeated captures are
judged each. Empty captures give no row, an empty list keeps all. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries as (key, list_name, kind, pattern, verdict, valid_from, valid_to); an open end is null."""
    e = entries.select(
        F.coalesce(F.col("list_name"), F.lit("")).alias("list_name"), F.lower("kind").alias("kind"), F.lower("pattern").alias("pattern"), F.lower("verdict").alias("verdict"), F.lower("change").alias("change"), F.col("changed_at").cast("timestamp").alias("changed_at")
    ).dropna()
    key = ("list_name", "kind", "pattern")
    # One change for each instant: a removal first, else block before allow.
    rank = F.when(F.col("change") == "remove", 0).when(F.col("verdict") == "block", 1).otherwise(2)
    steps = e.groupBy(*key, "changed_at").agg(F.min(rank).alias("rank"))
    after = Window.partitionBy(*key).orderBy("changed_at")
    spans = steps.withColumn("valid_to", F.lead("changed_at").over(after)).filter("rank > 0")
    return spans.select(
        F.concat_ws(":", "kind", "pattern").alias("key"), *key, F.when(F.col("rank") == 1, "block").otherwise("allow").alias("verdict"), F.col("changed_at").alias("valid_from"), "valid_to"
    )


def keys_of(url: F.Column) -> F.Column:
    """The entries that can match a URL: its host, each domain above it, and each prefix of host and path that ends where a
    part of the path does. Paths are taken as they are: "//" holds an empty part."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    parts = F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/")  # of "/a/b" an empty part, a and b
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n - i + 1), ".")))
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), domains, paths))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, host, fetched_at, n_active, verdict, list_name, kind, pattern) for each capture; verdict is block, allow or none."""
    rows = captures.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).cast("timestamp").alias("_at"))
    exploded = rows.select("_row", "_id", F.lower(F.regexp_extract("_url", HOST, 1)).alias("_host"), "_at", F.explode_outer(F.array_distinct(keys_of(F.col("_url")))).alias("_key"))
    spans = intervals(entries)
    active = (F.col("_key") == F.col("key")) & (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    best = F.min(F.when(F.col("key").isNotNull(), F.struct((-F.length("pattern")).alias("size"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("rank"), "list_name", "kind", "pattern")))
    judged = exploded.join(spans, active, "left").groupBy("_row", "_id", "_host", "_at").agg(F.count("key").alias("n_active"), best.alias("best"))
    return judged.select(
        F.col("_id").alias(id_col), F.nullif(F.col("_host"), F.lit("")).alias("host"), F.col("_at").alias(time_col), "n_active",
        F.when(F.col("best").isNull(), "none").when(F.col("best.rank") == 0, "block").otherwise("allow").alias("verdict"), F.col("best.list_name").alias("list_name"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"),
    )
