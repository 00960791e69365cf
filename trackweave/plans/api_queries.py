"""The interface's functions as queries, those that list_queries and catalogue_queries don't cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing as L
from ..sources import fixtures as X
from ..sources.storage import read_table
from . import api
from .list_queries import WIRE_SQL

D = f"with {X.DOWNLOADS_SQL} "
#: Jobs out of suppliers: id, state by number, progress in eighths, a null here and there.
JOBS_SQL = """jobs as (select 'job' || s_suppkey as id, 'https://x/@c' || s_suppkey as channel_url, case when s_suppkey % 4 = 0 then null else s_name end as channel_name,
  case s_suppkey % 5 when 0 then 'pending' when 1 then 'processing' when 2 then 'completed' when 3 then 'failed' else 'cancelled' end as status, (s_suppkey % 100) / 8.0::double as progress,
  timestamp '2024-01-01' + s_nationkey * interval 1 hour as created_at, timestamp '2024-01-02' + s_suppkey * interval 1 minute as updated_at from supplier)"""
JOB_WIRE_SQL = """id, channel_url, channel_name, status, round(progress, 1) as progress, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') as updated_at"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed", "cancelled"))), (key % 5 + 1).cast("int"))
    return read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("job"), key.cast("string")).alias("id"), F.concat(F.lit("https://x/@c"), key.cast("string")).alias("channel_url"),
        F.when(key % 4 != 0, F.col("s_name")).alias("channel_name"), status.alias("status"), ((key % 100) / 8.0).alias("progress"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, s_nationkey)").alias("created_at"), F.expr("timestamp_ntz'2024-01-02' + make_dt_interval(0, 0, cast(s_suppkey as int))").alias("updated_at"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.downloads(spark, sf_dir).withColumn("updated_at", F.col("created_at"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.candidates(spark, sf_dir).select("url", "idx")


C_ = f"with {X.DOWNLOADS_SQL}, {X.CANDIDATES_SQL} "
ACTIVE = "('queued', 'downloading', 'processing', 'completed')"

QUERIES = {
    "api_list_downloads": (lambda s, d: api.list_downloads(_wide(s, d), "failed", "artist 1", 50, 10)[0].drop("updated_at"),
                           D + f"select {WIRE_SQL} from downloads where status = 'failed' and (title ilike '%artist 1%' or artist ilike '%artist 1%' or album ilike '%artist 1%') order by downloads.created_at desc, id desc limit 50 offset 10"),
    "api_get_download": (lambda s, d: api.get_download(_wide(s, d), 12).drop("updated_at"), D + f"select {WIRE_SQL} from downloads where id = 12"),
    "api_cancel_download": (lambda s, d: api.cancel_download(_wide(s, d), 13).groupBy("status").agg(F.count("*").alias("n")),
                            D + "select case when id = 13 and status in ('queued', 'downloading') then 'cancelled' else status end as status, count(*) as n from downloads group by 1"),
    "api_retry_all": (lambda s, d: api.retry_all(_wide(s, d)).groupBy("status").agg(F.count("*").alias("n")), D + "select case when status = 'failed' then 'queued' else status end as status, count(*) as n from downloads group by 1"),
    "api_existing_downloads": (lambda s, d: api.existing_downloads(_requests(s, d), _wide(s, d)).select("id", "url", "status", "progress"),
                               C_ + f"""select id, url, status, round(progress, 1) as progress from downloads where status in {ACTIVE} and url in (select url from candidates)
                               qualify row_number() over (partition by url order by created_at desc, id desc) = 1"""),
    "api_queue_channel": (lambda s, d: api.queue_channel(_requests(s, d).withColumnRenamed("idx", "pos"), X.downloads(s, d), "b1").groupBy("batch", "outcome").agg(F.count("*").alias("n")),
                          C_ + f""", ranked as (select *, row_number() over (partition by url order by idx) as rn from candidates)
                          select 'b1' as batch, case when rn > 1 or url in (select url from downloads where status in {ACTIVE}) then 'skipped' else 'queued' end as outcome, count(*) as n from ranked group by all"""),
    "api_batch_status": (lambda s, d: api.batch_status(api.queue_channel(_requests(s, d).withColumnRenamed("idx", "pos"), X.downloads(s, d), "b1"), "b1"),
                         C_ + f""", ranked as (select *, row_number() over (partition by url order by idx) as rn from candidates), o as (select idx, case when rn > 1 or url in (select url from downloads where status in {ACTIVE}) then 1 else 0 end as skip from ranked), q as (select idx, row_number() over (order by idx) as nth from o where skip = 0)
                         select * from (select 'b1' as batch, count(*) as total, count(*) filter (skip = 0) as queued, count(*) filter (skip = 1) as skipped, 0::bigint as failed, 100.0::double as progress from o)
                         left join (select nth, idx as download_id from q) on true"""),
    "api_list_jobs": (lambda s, d: api.list_jobs(jobs(s, d), 20, 5), f"with {JOBS_SQL} select {JOB_WIRE_SQL} from jobs order by jobs.created_at desc, id desc limit 20 offset 5"),
    "api_get_job": (lambda s, d: api.get_job(jobs(s, d), "job7"), f"with {JOBS_SQL} select {JOB_WIRE_SQL} from jobs where id = 'job7'"),
    "api_cancel_job": (lambda s, d: api.cancel_job(jobs(s, d), "job5").select("id", "status"),
                       f"with {JOBS_SQL} select id, case when id = 'job5' and status in ('pending', 'processing') then 'cancelled' else status end as status from jobs"),
    "api_jobs_running": (lambda s, d: L.any_with(jobs(s, d), ["pending", "processing"]), f"with {JOBS_SQL} select bool_or(status in ('pending', 'processing')) as \"any\" from jobs"),
    "api_initial_snapshot": (lambda s, d: api.initial_snapshot(_wide(s, d))[1],
                             D + """select count(*) as total, least(count(*), 500) as page_rows, 500::int as "limit", 0::int as "offset", least(count(*), 500) < count(*) as has_more from downloads"""),
}
