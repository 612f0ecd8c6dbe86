"""The thin queries opN_<name> and their SQL. Each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.util import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.pii import pii

    return pii(table(spark, sf_dir, "documents"))


#: Dated entries for the hosts of pages: a rule on md5(host) adds, removes and adds again.
ENTRIES_SQL = """
with hosts as (
  select distinct lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) as host from pages where url is not null
), marked as (
  select host, md5(host) as h from hosts where host <> ''
)
select 'hosts' as list_name, 'host' as kind, host as pattern, 'block' as verdict, 'add' as change, timestamp '2024-02-01 00:00:00' as changed_at from marked where substr(h, 1, 1) < '6'
union all select 'hosts', 'host', host, 'block', 'remove', timestamp '2024-05-01 00:00:00' from marked where substr(h, 1, 1) < '3'
union all select 'hosts', 'host', host, 'block', 'add', timestamp '2024-09-15 12:00:00' from marked where substr(h, 1, 1) < '2'
union all select 'trusted', 'domain', host, 'allow', 'add', timestamp '2024-04-10 06:30:00' from marked where substr(h, 2, 1) < '4'
union all select 'trusted', 'domain', host, 'allow', 'remove', timestamp '2024-11-01 00:00:00' from marked where substr(h, 2, 1) < '1'
union all select 'paths', 'prefix', concat(host, '/en'), 'block', 'add', timestamp '2024-03-01 00:00:00' from marked where substr(h, 3, 1) < '8'
union all select 'paths', 'prefix', concat(host, '/en'), 'allow', 'add', timestamp '2024-08-01 00:00:00' from marked where substr(h, 3, 1) < '2'
union all select 'suffixes', 'domain', 'example.org', 'block', 'add', timestamp '2024-10-01 00:00:00'
union all select 'suffixes', 'domain', 'example.org', 'block', 'remove', timestamp '2024-10-08 00:00:00'
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of pages, fetched through 2024 by a rule on page_id, against the lists of ENTRIES_SQL."""
    from sylvan.llm.urls import url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    entries = spark.sql(ENTRIES_SQL.replace("from pages", "from {pages}"), pages=pages)
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(527040)) * 60)
    return url_filter(pages.withColumn("fetched_at", fetched), entries).withColumn("fetched_at", F.unix_timestamp("fetched_at"))


OP10_SQL = f"""
with entries as ({ENTRIES_SQL}),
steps as (
  select list_name, kind, pattern, changed_at, min(case when change = 'remove' then 0 when verdict = 'block' then 1 else 2 end) as rank
  from entries group by all
), spans as (
  select *, lead(changed_at) over (partition by list_name, kind, pattern order by changed_at) as valid_to from steps
), captures as (
  select page_id, url, timestamp '2024-01-01 00:00:00' + to_minutes((page_id * 7919) % 527040) as fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) as host,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1)) as path
  from pages
), hits as (
  select c.page_id, s.*, row_number() over (partition by c.page_id order by length(s.pattern) desc, s.rank, s.list_name, s.kind, s.pattern) as place,
    count(*) over (partition by c.page_id) as n_active
  from captures c join spans s on s.rank > 0 and c.fetched_at >= s.changed_at and (s.valid_to is null or c.fetched_at < s.valid_to) and (
    s.kind = 'host' and c.host = s.pattern
    or s.kind = 'domain' and (c.host = s.pattern or ends_with(c.host, '.' || s.pattern))
    or s.kind = 'prefix' and (c.host || c.path = s.pattern or starts_with(c.host || c.path, s.pattern || '/')))
)
select c.page_id, c.host, cast(epoch(c.fetched_at) as bigint) as fetched_at, coalesce(h.n_active, 0) as n_active,
  case when h.rank is null then 'none' when h.rank = 1 then 'block' else 'allow' end as verdict, h.list_name, h.kind, h.pattern
from captures c left join hits h on h.page_id = c.page_id and h.place = 1
"""

OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as last from pages),
d as (select *, sha1(html) as hex from p),
bits as (
  select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
    (case when (g % 8) * 5 // 8 = ((g % 8) * 5 + 4) // 8
      then (cast('0x' || substr(hex, 2 * (g * 5 // 8) + 1, 2) as bigint) >> (8 - (g * 5) % 8 - 5)) & 31
      else ((cast('0x' || substr(hex, 2 * (g * 5 // 8) + 1, 2) as bigint) << ((g * 5) % 8 - 3)) | (cast('0x' || substr(hex, 2 * (g * 5 // 8) + 3, 2) as bigint) >> (11 - (g * 5) % 8))) & 31 end) + 1 as int), 1), '' order by g) as payload_digest
  from d, range(32) r(g) group by page_id
)
select d.page_id, cast(strlen(html) as bigint) as payload_bytes, payload_digest, case when d.page_id = last then 'response' else 'revisit' end as record_type,
  case when d.page_id = last then null else last end as refers_to
from d join bits using (page_id)
"""

#: Vocabulary files of public tokenizers.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.langmodel import language_model

    return language_model(spark, table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.ann import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.decontaminate import contaminated

    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.substrings import without_repeats

    return without_repeats(spark, table(spark, sf_dir, "documents"), length=200)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.jaccard import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"), k=3, num=90, den=100)


QUERIES: dict[str, Query] = {"op1_warc": op1_warc, "op2_pii": op2_pii, "op3_pieces": op3_pieces, "op4_lm_score": op4_lm_score, "op5_toxicity": op5_toxicity, "op6_nearest": op6_nearest, "op7_decontaminate": op7_decontaminate, "op8_substrings": op8_substrings, "op9_jaccard_join": op9_jaccard_join, "op10_url_filters": op10_url_filters}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op10_url_filters": OP10_SQL}
