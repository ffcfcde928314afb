"""The registered queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netpen.adapters import duckdb_sql, view, views
from netpen.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(configure(spark), sf_dir)
        if oracle:
            ORACLES[name] = duckdb_sql(oracle)
        return run
    return register


# Rule calculation -----------------------------------------------------------------------------

_PLACED = """
with target as (
  select r.batch_id, r.business_date, b.cage_no, a.time_zone
  from calc_request r join fish_batch b on r.batch_id = b.batch_id
  join cage_sea_area a on b.cage_no = a.cage_no),
envelope as (
  select cage_no, business_date, min(start_at_utc) as day_start, max(end_at_utc) as day_end
  from tide_session group by cage_no, business_date),
inside as (
  select g.batch_id, g.business_date, g.cage_no, g.time_zone, o.obs_id, o.obs_no,
         o.observed_at_utc, o.feed_amount_kg
  from target g join envelope e on g.cage_no = e.cage_no and g.business_date = e.business_date
  join feed_observation o on o.batch_id = g.batch_id
   and o.observed_at_utc >= e.day_start and o.observed_at_utc < e.day_end),
in_tide as (
  select * from (
    select i.*, t.tide_id, t.tide_no, t.start_at_utc, t.end_at_utc,
           row_number() over (partition by i.obs_id, i.business_date
                              order by t.start_at_utc, t.tide_id) as pick,
           {LOCAL:i.time_zone,i.observed_at_utc} as local_time
    from inside i join tide_session t on t.cage_no = i.cage_no and t.business_date = i.business_date
     and i.observed_at_utc >= t.start_at_utc and i.observed_at_utc < t.end_at_utc) x where pick = 1),
matched as (
  select * from (
    select i.*, r.rule_id, r.rule_code, r.version_no, r.rule_type, r.coefficient,
           i.feed_amount_kg * r.coefficient as weighted,
           row_number() over (partition by i.obs_id, i.business_date
                              order by r.start_minute, r.rule_code) as rule_pick
    from in_tide i join ts_rule r on r.status = 'ENABLED' and (
      (r.start_minute < r.end_minute
       and hour(i.local_time) * 60 + minute(i.local_time) >= r.start_minute
       and hour(i.local_time) * 60 + minute(i.local_time) < r.end_minute)
      or (r.start_minute >= r.end_minute
       and (hour(i.local_time) * 60 + minute(i.local_time) >= r.start_minute
            or hour(i.local_time) * 60 + minute(i.local_time) < r.end_minute)))) y
  where rule_pick = 1)
"""


def _calc(spark: SparkSession, sf_dir: str):
    from netpen.plans.rulecalc import recalculate
    v = views(spark, sf_dir, "calc_request", "fish_batch", "cage_sea_area", "tide_session",
              "feed_observation", "ts_rule")
    return recalculate(v["calc_request"], v["fish_batch"], v["cage_sea_area"], v["tide_session"],
                       v["feed_observation"], v["ts_rule"])


@query("rule_calc_daily", _PLACED + """
select g.batch_id, g.cage_no, g.business_date,
       coalesce(n.obs_total, 0) as obs_total, coalesce(m.obs_matched, 0) as obs_matched,
       coalesce(n.obs_total, 0) - coalesce(m.obs_matched, 0) as obs_unmatched,
       cast(round(coalesce(m.peak, 0), 2) as decimal(18,2)) as peak_total_kg,
       cast(round(coalesce(m.flat, 0), 2) as decimal(18,2)) as flat_total_kg,
       cast(round(coalesce(m.valley, 0), 2) as decimal(18,2)) as valley_total_kg,
       cast(round(coalesce(m.total, 0), 2) as decimal(18,2)) as total_weighted_kg,
       (select concat('[', string_agg(concat(
          '{"ruleId":', rule_id, ',"ruleCode":"', rule_code, '","versionNo":', version_no, ',"ruleType":"', rule_type,
          '","startMinute":', start_minute, ',"endMinute":', end_minute, ',"coefficient":', cast(coefficient as decimal(12,4)), '}'),
          ',' order by start_minute, rule_code), ']') from ts_rule) as rule_snapshot
from target g
left join (select batch_id, business_date, count(*) as obs_total from inside
           group by batch_id, business_date) n
  on n.batch_id = g.batch_id and n.business_date = g.business_date
left join (select batch_id, business_date, count(*) as obs_matched,
                  sum(case when rule_type = 'PEAK' then weighted end) as peak,
                  sum(case when rule_type = 'FLAT' then weighted end) as flat,
                  sum(case when rule_type = 'VALLEY' then weighted end) as valley,
                  sum(weighted) as total
           from matched group by batch_id, business_date) m
  on m.batch_id = g.batch_id and m.business_date = g.business_date""")
def rule_calc_daily(spark, sf_dir):
    return _calc(spark, sf_dir).results


@query("rule_calc_detail", _PLACED + """
select batch_id, business_date, obs_id, obs_no, observed_at_utc,
       strftime(local_time, '%H:%M:%S') as obs_local_time, tide_id, tide_no,
       start_at_utc as tide_start_utc, end_at_utc as tide_end_utc, rule_id, rule_code,
       version_no as rule_version, rule_type, coefficient, feed_amount_kg,
       cast(weighted as decimal(18,8)) as weighted_kg
from matched""")
def rule_calc_detail(spark, sf_dir):
    return _calc(spark, sf_dir).details


@query("rule_calc_rejected", """
select distinct o.batch_id, cast(o.observed_at_utc as date) as business_date,
       case when b.batch_id is null then 'batch_missing' else 'no_sea_area' end as reason
from feed_observation o left join fish_batch b on o.batch_id = b.batch_id
left join cage_sea_area a on b.cage_no = a.cage_no
where a.cage_no is null""")
def rule_calc_rejected(spark, sf_dir):
    from netpen.plans.rulecalc import recalculate
    v = views(spark, sf_dir, "fish_batch", "cage_sea_area", "tide_session", "feed_observation",
              "ts_rule")
    requests = v["feed_observation"].select(
        "batch_id", F.col("observed_at_utc").cast("date").alias("business_date"))
    return recalculate(requests, v["fish_batch"], v["cage_sea_area"], v["tide_session"],
                       v["feed_observation"], v["ts_rule"]).rejected


@query("tide_overlaps", """
select b.tide_id, b.tide_no, b.cage_no, b.start_at_utc, b.end_at_utc
from tide_session b
where exists (select 1 from tide_session a where a.cage_no = b.cage_no
              and (a.start_at_utc < b.start_at_utc
                   or (a.start_at_utc = b.start_at_utc and a.tide_id < b.tide_id))
              and a.end_at_utc > b.start_at_utc)""")
def tide_overlaps_query(spark, sf_dir):
    from netpen.operators.ranges import tide_overlaps
    return tide_overlaps(view(spark, sf_dir, "tide_session")).select(
        "tide_id", "tide_no", "cage_no", "start_at_utc", "end_at_utc")


# Overview, latest rows, listings ----------------------------------------------------------------

_NEWEST_SURVIVAL = """
(select batch_id, report_id, report_time, alive_count, survival_rate from (
  select *, row_number() over (partition by batch_id order by report_time desc, report_id desc) as n
  from survival_report) x where n = 1)"""
_NEWEST_READING = """
(select sensor_id, reading_id, reading_time, metric_value from (
  select *, row_number() over (partition by sensor_id order by reading_time desc, reading_id desc) as n
  from sensor_reading) x where n = 1)"""
_POSTED = """
(select batch_id, cast(sum(amount_kg) as decimal(18,2)) as posted from feeding_record
 where posted = 1 group by batch_id)"""


@query("latest_survival", f"""
select batch_id, report_time, report_id, alive_count, survival_rate from {_NEWEST_SURVIVAL} l""")
def latest_survival_query(spark, sf_dir):
    from netpen.plans.overview import latest_survival
    return latest_survival(view(spark, sf_dir, "survival_report"))


@query("latest_reading", f"""
select sensor_id, reading_time, reading_id, metric_value from {_NEWEST_READING} l""")
def latest_reading_query(spark, sf_dir):
    from netpen.plans.overview import latest_reading
    return latest_reading(view(spark, sf_dir, "sensor_reading"))


@query("reading_counts", "select sensor_id, count(*) as reading_count from sensor_reading group by sensor_id")
def reading_counts_query(spark, sf_dir):
    from netpen.plans.overview import reading_counts
    return reading_counts(view(spark, sf_dir, "sensor_reading"))


@query("posted_feed_by_batch", f"""
select b.batch_id, coalesce(p.posted, cast(0 as decimal(18,2))) as posted_feed_kg
from fish_batch b left join {_POSTED} p on b.batch_id = p.batch_id""")
def posted_feed_query(spark, sf_dir):
    from netpen.plans.overview import posted_feed_by_batch
    v = views(spark, sf_dir, "fish_batch", "feeding_record")
    return posted_feed_by_batch(v["fish_batch"].select("batch_id"), v["feeding_record"])


@query("cage_feed_total", f"""
select b.cage_no, cast(sum(coalesce(p.posted, 0)) as decimal(18,2)) as posted_feed_kg
from fish_batch b left join {_POSTED} p on b.batch_id = p.batch_id
where b.status <> 'CLOSED' group by b.cage_no""")
def cage_feed_total_query(spark, sf_dir):
    from netpen.plans.overview import cage_feed_total
    v = views(spark, sf_dir, "fish_batch", "feeding_record")
    return cage_feed_total(v["fish_batch"], v["feeding_record"])


def _overview(spark, sf_dir):
    from netpen.plans.overview import cage_overview
    v = views(spark, sf_dir, "fish_batch", "feeding_record", "survival_report", "sensor",
              "sensor_reading", "harvest_batch")
    return cage_overview(*v.values())


@query("cage_overview_cages", f"""
select c.cage_no, coalesce(t.total, cast(0 as decimal(18,2))) as posted_feed_kg
from (select cage_no from fish_batch union select cage_no from sensor
      union select cage_no from harvest_batch) c
left join (select b.cage_no, cast(sum(coalesce(p.posted, 0)) as decimal(18,2)) as total
           from fish_batch b left join {_POSTED} p on b.batch_id = p.batch_id
           where b.status <> 'CLOSED' group by b.cage_no) t on c.cage_no = t.cage_no""")
def cage_overview_cages(spark, sf_dir):
    return _overview(spark, sf_dir).cages


@query("cage_overview_batches", f"""
select b.cage_no, b.batch_id, b.batch_no, b.species, b.fingerling_count, b.status, b.stocking_time,
       coalesce(p.posted, cast(0 as decimal(18,2))) as posted_feed_kg,
       l.survival_rate as latest_survival_rate
from fish_batch b left join {_POSTED} p on b.batch_id = p.batch_id
left join {_NEWEST_SURVIVAL} l on b.batch_id = l.batch_id
where b.status <> 'CLOSED'""")
def cage_overview_batches(spark, sf_dir):
    return _overview(spark, sf_dir).batches


@query("cage_overview_sensors", f"""
select s.cage_no, s.sensor_id, s.sensor_no, s.sensor_type, s.metric_unit, s.status,
       l.metric_value as latest_value, l.reading_time as latest_reading_time
from sensor s left join {_NEWEST_READING} l on s.sensor_id = l.sensor_id""")
def cage_overview_sensors(spark, sf_dir):
    return _overview(spark, sf_dir).sensors


@query("cage_overview_harvests", """
select cage_no, harvest_id, harvest_no, harvest_count, total_weight_kg, status, harvest_time
from harvest_batch""")
def cage_overview_harvests(spark, sf_dir):
    return _overview(spark, sf_dir).harvests


def _detail(spark, sf_dir):
    from netpen.plans.overview import batch_detail
    v = views(spark, sf_dir, "fish_batch", "feeding_record", "survival_report", "harvest_batch")
    return batch_detail(*v.values())


@query("batch_detail", f"""
select b.*, coalesce(p.posted, cast(0 as decimal(18,2))) as posted_feed_kg
from fish_batch b left join {_POSTED} p on b.batch_id = p.batch_id""")
def batch_detail_query(spark, sf_dir):
    return _detail(spark, sf_dir).batches


@query("batch_detail_records", """
select r.* from feeding_record r where r.batch_id in (select batch_id from fish_batch)""")
def batch_detail_records(spark, sf_dir):
    return _detail(spark, sf_dir).feeding_records


@query("batch_detail_reports", """
select r.* from survival_report r where r.batch_id in (select batch_id from fish_batch)""")
def batch_detail_reports(spark, sf_dir):
    return _detail(spark, sf_dir).survival_reports


@query("batch_detail_harvests", """
select r.* from harvest_batch r where r.batch_id in (select batch_id from fish_batch)""")
def batch_detail_harvests(spark, sf_dir):
    return _detail(spark, sf_dir).harvests


@query("post_pending", """
select record_id, record_no, batch_id, plan_id, amount_kg, feeding_time, 1 as posted,
       case when posted = 0 then timestamp '2024-03-01 02:00:00' else posted_time end as posted_time
from feeding_record""")
def post_pending_query(spark, sf_dir):
    from netpen.plans.posting import post_pending
    return post_pending(view(spark, sf_dir, "feeding_record"), "2024-03-01 02:00:00").records


@query("posting_count", "select count(*) as posted_count from feeding_record where posted = 0")
def posting_count(spark, sf_dir):
    from netpen.plans.posting import post_pending
    return post_pending(view(spark, sf_dir, "feeding_record"), "2024-03-01 02:00:00").posted_count


@query("deletable_batches", """
select b.batch_id,
       case when h.batch_id is null and f.batch_id is null then 1 else 0 end as deletable,
       case when h.batch_id is not null then 'accepted_harvest'
            when f.batch_id is not null then 'posted_feed' end as reason
from fish_batch b
left join (select distinct batch_id from harvest_batch where status = 'ACCEPTED') h on b.batch_id = h.batch_id
left join (select distinct batch_id from feeding_record where posted = 1) f on b.batch_id = f.batch_id""")
def deletable_batches_query(spark, sf_dir):
    from netpen.plans.deletable import deletable
    return deletable("fish_batch", views(spark, sf_dir, "fish_batch", "harvest_batch", "feeding_record"))


@query("deletable_sensors", """
select s.sensor_id, case when exists (select 1 from sensor_reading r where r.sensor_id = s.sensor_id)
                         then 0 else 1 end as deletable,
       case when exists (select 1 from sensor_reading r where r.sensor_id = s.sensor_id)
            then 'has_readings' end as reason
from sensor s""")
def deletable_sensors_query(spark, sf_dir):
    from netpen.plans.deletable import deletable
    return deletable("sensor", views(spark, sf_dir, "sensor", "sensor_reading"))


@query("deletable_records", """
select record_id, 1 - posted as deletable, case when posted = 1 then 'posted' end as reason
from feeding_record""")
def deletable_records_query(spark, sf_dir):
    from netpen.plans.deletable import deletable
    return deletable("feeding_record", views(spark, sf_dir, "feeding_record"))


@query("deletable_harvests", """
select harvest_id, case when status = 'ACCEPTED' then 0 else 1 end as deletable,
       case when status = 'ACCEPTED' then 'accepted' end as reason
from harvest_batch""")
def deletable_harvests_query(spark, sf_dir):
    from netpen.plans.deletable import deletable
    return deletable("harvest_batch", views(spark, sf_dir, "harvest_batch"))


@query("readings_in_range", """
select * from sensor_reading
where reading_time >= timestamp '2024-01-05 00:00:00' and reading_time <= timestamp '2024-01-12 12:00:00'""")
def readings_in_range(spark, sf_dir):
    from netpen.operators.listing import list_table
    return list_table("sensor_reading", view(spark, sf_dir, "sensor_reading"),
                      "2024-01-05 00:00:00", "2024-01-12 12:00:00")


@query("records_in_range", """
select * from feeding_record
where posted = 0 and feeding_time >= timestamp '1997-01-01 00:00:00'
  and feeding_time <= timestamp '1998-12-31 00:00:00'""")
def records_in_range(spark, sf_dir):
    from netpen.operators.listing import list_table
    return list_table("feeding_record", view(spark, sf_dir, "feeding_record"),
                      "1997-01-01 00:00:00", "1998-12-31 00:00:00", posted=0)


@query("list_batches", "select * from fish_batch where status = 'BREEDING'")
def list_batches(spark, sf_dir):
    from netpen.operators.listing import list_table
    return list_table("fish_batch", view(spark, sf_dir, "fish_batch"), status="BREEDING", cage_no="")


@query("list_plans", "select * from feeding_plan where status = 'ACTIVE'")
def list_plans(spark, sf_dir):
    from netpen.operators.listing import list_table
    return list_table("feeding_plan", view(spark, sf_dir, "feeding_plan"), status="ACTIVE")


@query("list_tides", "select * from tide_session where business_date = date '2024-01-10'")
def list_tides(spark, sf_dir):
    import datetime as dt
    from netpen.operators.listing import list_table
    return list_table("tide_session", view(spark, sf_dir, "tide_session"),
                      business_date=dt.date(2024, 1, 10))



@query("lookup_batches", """
select b.* from fish_batch b where b.batch_id in (select batch_id from survival_report)""")
def lookup_batches(spark, sf_dir):
    from netpen.operators.listing import lookup
    v = views(spark, sf_dir, "fish_batch", "survival_report")
    return lookup(v["fish_batch"], v["survival_report"], "batch_id")[0]


@query("lookup_missing", """
select distinct r.plan_id from feeding_record r
where r.plan_id is not null and not exists (select 1 from feeding_plan p where p.plan_id = r.plan_id)""")
def lookup_missing(spark, sf_dir):
    from netpen.operators.listing import lookup
    v = views(spark, sf_dir, "feeding_plan", "feeding_record")
    asked = v["feeding_record"].where(F.col("plan_id").isNotNull())
    return lookup(v["feeding_plan"], asked, "plan_id")[1]


# Observation import -----------------------------------------------------------------------------

IMPORT_NOW = "2024-06-01 00:00:00"

_JUDGED = """
judged as (
  select f.*,
    case when width = 7 then 'source_device' when width = 9 then '_row'
         when not regexp_full_match(voyage_no, '[A-Za-z0-9_-]{1,32}') then 'voyage_no'
         when not regexp_full_match(cage_no, '[A-Za-z0-9_-]{1,32}') then 'cage_no'
         when observed_at is null or observed_at > timestamp '2024-06-01 00:10:00' then 'observed_at'
         when feed_text <> '' and (feed is null or feed <= 0 or feed > 99999.99 or feed <> round(feed, 2)) then 'feed_amount_kg'
         when rate_text <> '' and (rate is null or rate < 0 or rate > 1) then 'survival_rate'
         when value_text <> '' and (val is null or val < 0) then 'sensor_value'
         when value_text <> '' and (device_text = '' or not regexp_full_match(device_text, '[A-Za-z0-9_-]{1,32}')) then 'source_device'
         when value_text <> '' and unit_text = '' then 'sensor_unit'
         when feed_text = '' and rate_text = '' and value_text = '' then '_row' end as err_field,
    case when width <> 8 then null
         when not regexp_full_match(voyage_no, '[A-Za-z0-9_-]{1,32}') then voyage_no
         when not regexp_full_match(cage_no, '[A-Za-z0-9_-]{1,32}') then cage_no
         when observed_at is null or observed_at > timestamp '2024-06-01 00:10:00' then time_text
         when feed_text <> '' and (feed is null or feed <= 0 or feed > 99999.99 or feed <> round(feed, 2)) then feed_text
         when rate_text <> '' and (rate is null or rate < 0 or rate > 1) then rate_text
         when value_text <> '' and (val is null or val < 0) then value_text
         when value_text <> '' and device_text <> '' and not regexp_full_match(device_text, '[A-Za-z0-9_-]{1,32}') then device_text
         end as err_raw,
    case when width <> 8 then 'column_count'
         when not regexp_full_match(voyage_no, '[A-Za-z0-9_-]{1,32}') then 'bad_key'
         when not regexp_full_match(cage_no, '[A-Za-z0-9_-]{1,32}') then 'bad_key'
         when time_text = '' then 'required' when observed_at is null then 'bad_time'
         when observed_at > timestamp '2024-06-01 00:10:00' then 'future_time'
         when feed_text <> '' and feed is null then 'not_a_number'
         when feed_text <> '' and feed <> round(feed, 2) then 'too_many_decimals'
         when feed_text <> '' and feed <= 0 then 'not_positive'
         when feed_text <> '' and feed > 99999.99 then 'out_of_range'
         when rate_text <> '' and rate is null then 'not_a_number'
         when rate_text <> '' and (rate < 0 or rate > 1) then 'out_of_range'
         when value_text <> '' and val is null then 'not_a_number'
         when value_text <> '' and val < 0 then 'negative'
         when value_text <> '' and device_text = '' then 'required'
         when value_text <> '' and not regexp_full_match(device_text, '[A-Za-z0-9_-]{1,32}') then 'bad_key'
         when value_text <> '' and unit_text = '' then 'required'
         when feed_text = '' and rate_text = '' and value_text = '' then 'no_measure' end as err_reason
  from (select *, try_cast(replace(time_text, 'T', ' ') as timestamp) as observed_at,
               try_cast(feed_text as decimal(30,6)) as feed, try_cast(rate_text as decimal(30,6)) as rate,
               try_cast(value_text as decimal(30,6)) as val from obs_field) f),
typed as (
  select *,
    case when err_field is null then concat(voyage_no, '|', cage_no, '|', strftime(observed_at, '%Y-%m-%dT%H:%M:%S'))
         else concat(voyage_no, '|', cage_no, '|', time_text) end as business_key,
    case when err_field is null then cast(feed as decimal(10,2)) end as feed_amount_kg,
    case when err_field is null then cast(rate as decimal(7,4)) end as survival_rate,
    case when err_field is null then cast(val as decimal(12,4)) end as sensor_value,
    case when err_field is null and val is not null then unit_text end as sensor_unit,
    case when err_field is null and val is not null then device_text end as source_device
  from judged)"""

# A true step-by-step fold over each key's rows.
_FOLD = "with recursive " + _JUDGED + """,
cages as (
  select c.cage_no, a.batch_id as active_batch, t.status as terminal_status,
         exists (select 1 from harvest_batch h where h.cage_no = c.cage_no and h.status = 'ACCEPTED') as accepted
  from (select distinct cage_no from fish_batch) c
  left join (select * from (select *, row_number() over (partition by cage_no order by stocking_time desc, batch_id) as n
             from fish_batch where status in ('BREEDING', 'MONITORING')) x where n = 1) a on a.cage_no = c.cage_no
  left join (select * from (select *, row_number() over (partition by cage_no order by stocking_time desc, batch_id) as n
             from fish_batch where status in ('HARVESTED', 'CLOSED')) x where n = 1) t on t.cage_no = c.cage_no),
ready as (
  select y.*, c.active_batch, c.terminal_status, coalesce(c.accepted, false) as accepted,
    case when y.sensor_value is null then null when s.sensor_no is null then 'device_missing'
         when s.cage_no <> y.cage_no then 'device_in_other_cage' when s.metric_unit <> y.sensor_unit then 'unit_differs'
         when s.status <> 'ONLINE' then concat('device_', lower(s.status)) end as device_reason,
    row_number() over (partition by y.business_key order by y.checksum, y.line_no) as pos
  from typed y left join cages c on c.cage_no = y.cage_no left join sensor s on s.sensor_no = y.source_device
  where y.err_field is null),
fold as (
  select k.business_key, cast(0 as bigint) as pos, cast(null as varchar) as checksum, cast(null as bigint) as line_no,
         cast(null as varchar) as outcome, cast(null as varchar) as reason,
         o.voyage_no is not null as here, o.feed_amount_kg as feed, o.survival_rate as rate, o.sensor_value as val,
         o.sensor_unit as unit, o.source_device as device, cast(r.batch_id as bigint) as rec_batch,
         cast(r.posted as int) as posted, cast(p.batch_id as bigint) as rep_batch
  from (select distinct business_key from ready) k
  left join stored_observation o
    on k.business_key = concat(o.voyage_no, '|', o.cage_no, '|', strftime(o.observed_at, '%Y-%m-%dT%H:%M:%S'))
  left join stored_record r on r.record_no = o.record_no
  left join stored_report p on p.report_no = o.report_no
  union all
  select z.business_key, z.pos, z.checksum, z.line_no, z.outcome, z.reason,
         z.here or z.outcome = 'SUCCESS',
         case when done and z.r_feed is not null then z.r_feed else z.feed end,
         case when done and z.r_rate is not null then z.r_rate else z.rate end,
         case when done and z.r_val is not null then z.r_val else z.val end,
         case when done and z.r_val is not null then z.r_unit else z.unit end,
         case when done and z.r_val is not null then z.r_device else z.device end,
         case when done and z.r_feed is not null then coalesce(z.rec_batch, z.active_batch) else z.rec_batch end,
         case when done and z.r_feed is not null then coalesce(z.posted, 0) else z.posted end,
         case when done and z.r_rate is not null then coalesce(z.rep_batch, z.active_batch) else z.rep_batch end
  from (
    select q.*, q.reason is null and not q.same as done,
           case when q.same then 'SKIPPED' when q.reason is not null then 'FAILED'
                when q.here then 'UPDATED' else 'SUCCESS' end as outcome
    from (
      select f.here, f.feed, f.rate, f.val, f.unit, f.device, f.rec_batch, f.posted, f.rep_batch,
             n.business_key, n.pos, n.checksum, n.line_no, n.feed_amount_kg as r_feed, n.survival_rate as r_rate,
             n.sensor_value as r_val, n.sensor_unit as r_unit, n.source_device as r_device, n.active_batch,
             f.here and (n.feed_amount_kg is null or (f.feed is not null and f.feed = n.feed_amount_kg))
               and (n.survival_rate is null or (f.rate is not null and f.rate = n.survival_rate))
               and (n.sensor_value is null or (f.val is not null and f.val = n.sensor_value
                    and f.unit = n.sensor_unit and f.device = n.source_device)) as same,
             case when n.device_reason is not null then n.device_reason
                  when not f.here then
                    case when (n.feed_amount_kg is not null or n.survival_rate is not null) and n.active_batch is null
                         then case when n.terminal_status is not null then 'batch_terminal' else 'no_active_batch' end end
                  when n.feed_amount_kg is not null and f.rec_batch is not null and f.posted = 1 then 'record_posted'
                  when n.feed_amount_kg is null and n.survival_rate is null then null
                  when n.accepted then 'harvest_accepted'
                  when b.status in ('HARVESTED', 'CLOSED') then 'linked_batch_terminal'
                  when n.active_batch is null and ((n.feed_amount_kg is not null and f.rec_batch is null)
                       or (n.survival_rate is not null and f.rep_batch is null))
                    then case when n.terminal_status is not null then 'batch_terminal' else 'no_active_batch' end end as reason
      from fold f join ready n on n.business_key = f.business_key and n.pos = f.pos + 1
      left join fish_batch b on b.batch_id = coalesce(f.rec_batch, f.rep_batch)) q) z),
decided as (
  select n.*, f.outcome, case when f.outcome = 'FAILED' then f.reason end as fail_reason
  from ready n join fold f on f.business_key = n.business_key and f.pos = n.pos),
numbered as (
  select checksum, line_no, raw_line, row_number() over (partition by checksum order by line_no) - 1 as data_idx
  from obs_line where trim(raw_line) <> ''),
ledger as (
  select l.checksum, l.line_no, cast(floor(n.data_idx / 1000) as bigint) as shard_index, l.business_key, l.outcome,
         l.field_name, l.raw_value, case when l.outcome = 'FAILED' then n.raw_line end as raw_line, l.error_reason
  from (
    select checksum, line_no, business_key, 'FAILED' as outcome, err_field as field_name, err_raw as raw_value,
           err_reason as error_reason
    from typed where err_field is not null
    union all
    select checksum, line_no, business_key, outcome,
           case when fail_reason = 'record_posted' then '_row' when fail_reason = 'unit_differs' then 'sensor_unit'
                when fail_reason like 'device%' then 'source_device' when fail_reason is not null then 'cage_no' end,
           case when fail_reason = 'record_posted' then null when fail_reason = 'unit_differs' then sensor_unit
                when fail_reason like 'device%' then source_device when fail_reason is not null then cage_no end,
           fail_reason
    from decided) l
  join numbered n on n.checksum = l.checksum and n.line_no = l.line_no)
"""
_OUTCOME_COUNTS = """count(*) as total_rows, count(*) filter (where outcome = 'SUCCESS') as success_count,
  count(*) filter (where outcome = 'UPDATED') as updated_count,
  count(*) filter (where outcome = 'SKIPPED') as skipped_count,
  count(*) filter (where outcome = 'FAILED') as failed_count,
  case when count(*) filter (where outcome = 'FAILED') = 0 then 'SUCCESS' else 'PARTIAL' end as status"""


@query("obs_validate", "with " + _JUDGED + """
select checksum, line_no, business_key, feed_amount_kg, survival_rate, sensor_value, sensor_unit,
       source_device, err_field, err_raw, err_reason from typed""")
def obs_validate(spark, sf_dir):
    from netpen.plans.validate import validate_rows
    from netpen.sources.obs_files import drop_blank
    return validate_rows(drop_blank(view(spark, sf_dir, "obs_line")), IMPORT_NOW).select(
        "checksum", "line_no", "business_key", "feed_amount_kg", "survival_rate", "sensor_value",
        "sensor_unit", "source_device", F.col("err.field").alias("err_field"),
        F.col("err.raw").alias("err_raw"), F.col("err.reason").alias("err_reason"))


def _stored_events(spark, sf_dir):
    """What stored observations, records and reports are built on, worked out once."""
    from netpen.session import stage
    return {"stored_event": stage(view(spark, sf_dir, "stored_event"), "stored-events")}


def _import(spark, sf_dir, given=None):
    from netpen.plans.importer import import_lines
    from netpen.sources.obs_files import number_data_lines
    v = views(spark, sf_dir, "fish_batch", "harvest_batch", "sensor", "stored_observation",
              "stored_record", "stored_report", "obs_line", given=given or _stored_events(spark, sf_dir))
    tables = {
        "fish_batch": v["fish_batch"], "harvest_batch": v["harvest_batch"], "sensor": v["sensor"],
        "cage_observation": v["stored_observation"], "feeding_record": v["stored_record"],
        "survival_report": v["stored_report"]}
    return import_lines(number_data_lines(v["obs_line"]), tables, IMPORT_NOW)


@query("obs_import_outcomes", _FOLD + "select * from ledger")
def obs_import_outcomes(spark, sf_dir):
    return _import(spark, sf_dir).ledger


@query("import_shard_summary", _FOLD + f"""
select checksum, shard_index, min(line_no) as start_line, max(line_no) as end_line, {_OUTCOME_COUNTS}
from ledger group by checksum, shard_index""")
def import_shard_summary(spark, sf_dir):
    return _import(spark, sf_dir).shards


@query("import_file_summary", _FOLD + f"select checksum, {_OUTCOME_COUNTS} from ledger group by checksum")
def import_file_summary(spark, sf_dir):
    return _import(spark, sf_dir).files


@query("import_first_failures", _FOLD + """
select checksum, line_no, shard_index, business_key, outcome, field_name, raw_value, raw_line, error_reason
from (select *, row_number() over (partition by checksum order by line_no) as n
      from ledger where outcome = 'FAILED') x where n <= 100""")
def import_first_failures(spark, sf_dir):
    return _import(spark, sf_dir).failures


@query("import_page", _FOLD + """
select * from ledger where checksum = 'file-2' and outcome = 'FAILED' order by line_no limit 50 offset 20""")
def import_page(spark, sf_dir):
    from netpen.operators.listing import outcome_page
    from netpen.session import stage
    return outcome_page(stage(_import(spark, sf_dir).ledger, "ledger"), "file-2", "failed", 50, 20)


@query("import_page_middle", _FOLD + """
select * from ledger order by line_no, checksum limit 1000 offset (select count(*) // 2 from ledger)""")
def import_page_middle(spark, sf_dir):
    from netpen.operators.listing import outcome_page
    from netpen.session import stage
    ledger = stage(_import(spark, sf_dir).ledger, "ledger")
    return outcome_page(ledger, limit=1000, offset=ledger.count() // 2)


_LAST_APPLIED = """,
applied as (
  select d.*, o.record_no as old_record, o.report_no as old_report, o.reading_no as old_reading,
         r.batch_id as old_record_batch, p.batch_id as old_report_batch
  from decided d
  left join stored_observation o on o.voyage_no = d.voyage_no and o.cage_no = d.cage_no and o.observed_at = d.observed_at
  left join stored_record r on r.record_no = o.record_no
  left join stored_report p on p.report_no = o.report_no
  where d.outcome in ('SUCCESS', 'UPDATED')),
last_feed as (select * from (select *, row_number() over (partition by business_key order by pos desc) as n
              from applied where feed_amount_kg is not null) x where n = 1),
last_rate as (select * from (select *, row_number() over (partition by business_key order by pos desc) as n
              from applied where survival_rate is not null) x where n = 1),
last_sensor as (select * from (select *, row_number() over (partition by business_key order by pos desc) as n
              from applied where sensor_value is not null) x where n = 1),
last_row as (select * from (select *, row_number() over (partition by business_key order by pos desc) as n
              from applied) x where n = 1)
"""


@query("import_feeding_records", _FOLD + _LAST_APPLIED + """
select case when old_record_batch is not null then old_record
            else concat('FR-', substr(sha256(business_key), 1, 29)) end as record_no,
       case when old_record_batch is null then active_batch end as batch_id,
       case when old_record_batch is null then cage_no end as cage_no,
       case when old_record_batch is null then 'IMPORT-CSV' end as feed_type,
       feed_amount_kg as amount_kg, observed_at as feeding_time,
       case when old_record_batch is null then 0 end as posted
from last_feed""")
def import_feeding_records(spark, sf_dir):
    return _import(spark, sf_dir).feeding_records


@query("import_survival_reports", _FOLD + _LAST_APPLIED + """
select case when old_report_batch is not null then old_report
            else concat('SR-', substr(sha256(l.business_key), 1, 29)) end as report_no,
       case when old_report_batch is null then active_batch end as batch_id,
       case when old_report_batch is null then l.cage_no end as cage_no,
       coalesce(cast(round(survival_rate * b.fingerling_count, 0) as int), 0) as alive_count,
       survival_rate, observed_at as report_time
from last_rate l left join fish_batch b on b.batch_id = coalesce(old_report_batch, active_batch)""")
def import_survival_reports(spark, sf_dir):
    return _import(spark, sf_dir).survival_reports


@query("import_sensor_readings", _FOLD + _LAST_APPLIED + """
select coalesce(old_reading, concat('RD-', substr(sha256(business_key), 1, 29))) as reading_no,
       s.sensor_id, s.cage_no, sensor_value as metric_value, observed_at as reading_time
from last_sensor l join sensor s on s.sensor_no = l.source_device""")
def import_sensor_readings(spark, sf_dir):
    return _import(spark, sf_dir).sensor_readings


_UPSERTED = _FOLD + _LAST_APPLIED + """
select coalesce(w.voyage_no, o.voyage_no) as voyage_no, coalesce(w.cage_no, o.cage_no) as cage_no,
       coalesce(w.observed_at, o.observed_at) as observed_at,
       coalesce(f.feed_amount_kg, o.feed_amount_kg) as feed_amount_kg,
       coalesce(r.survival_rate, o.survival_rate) as survival_rate,
       coalesce(s.sensor_value, o.sensor_value) as sensor_value,
       coalesce(s.sensor_unit, o.sensor_unit) as sensor_unit,
       coalesce(s.source_device, o.source_device) as source_device,
       case when f.business_key is null then o.record_no when f.old_record_batch is not null then f.old_record
            else concat('FR-', substr(sha256(w.business_key), 1, 29)) end as record_no,
       case when r.business_key is null then o.report_no when r.old_report_batch is not null then r.old_report
            else concat('SR-', substr(sha256(w.business_key), 1, 29)) end as report_no,
       case when s.business_key is null then o.reading_no
            else coalesce(s.old_reading, concat('RD-', substr(sha256(w.business_key), 1, 29))) end as reading_no,
       coalesce(w.checksum, o.import_id) as import_id
from last_row w left join last_feed f on f.business_key = w.business_key
left join last_rate r on r.business_key = w.business_key
left join last_sensor s on s.business_key = w.business_key
full outer join stored_observation o
  on o.voyage_no = w.voyage_no and o.cage_no = w.cage_no and o.observed_at = w.observed_at
"""


@query("import_upserted_observations", _UPSERTED)
def import_upserted_observations(spark, sf_dir):
    from netpen.sources.sinks import upsert_observations
    given = _stored_events(spark, sf_dir)
    return upsert_observations(view(spark, sf_dir, "stored_observation", given),
                               _import(spark, sf_dir, given).observations)


@query("newest_observations", f"""
select * from ({_UPSERTED}) u order by observed_at desc, voyage_no, cage_no limit 500""")
def newest_observations_query(spark, sf_dir):
    from netpen.operators.listing import newest_observations
    return newest_observations(import_upserted_observations(spark, sf_dir))


# Migration --------------------------------------------------------------------------------------

_HANDED = """(o_orderkey % 131 <> 0 and o_orderkey % 137 <> 0 and o_orderkey % 139 <> 0
              and o_orderkey % 149 <> 0 and o_orderkey % 151 <> 0)"""
_AUDIT = f"""
with stepped as (
  select *, lead(source_cage_no) over w as next_source, lead(occurred_at) over w as next_at,
         lead(cumulative_feed_kg) over w as next_feed, row_number() over w as rn
  from migration_event window w as (partition by chain_no order by seq_no)),
per_chain as (
  select chain_no, count(*) as n, bool_and(seq_no = rn) as seq_ok,
         arg_min(source_cage_no, seq_no) as first_source, arg_max(target_cage_no, seq_no) as last_target,
         bool_and(next_source is null or next_source = target_cage_no) as link_ok,
         bool_and(next_at is null or next_at > occurred_at) as time_ok,
         bool_and(next_feed is null or cumulative_feed_kg is null or next_feed >= cumulative_feed_kg) as feed_ok,
         bool_and({_HANDED}) as hand_ok,
         bool_and(o_orderkey % 131 <> 0 and o_orderkey % 137 <> 0) as read_ok
  from stepped group by chain_no),
audit as (
  select c.chain_no, c.batch_id, coalesce(n, 0) as event_count,
    case when coalesce(n, 0) = c.current_seq and coalesce(seq_ok, true) then 1 else 0 end as seq_continuous,
    case when n > 0 and origin_cage_no = first_source and current_cage_no = last_target and link_ok then 1 else 0 end as cage_linked,
    case when coalesce(time_ok, true) then 1 else 0 end as time_ordered,
    case when coalesce(hand_ok, true) then 1 else 0 end as handoff_equal,
    case when coalesce(feed_ok, true) then 1 else 0 end as feed_monotonic,
    case when coalesce(read_ok, true) then 1 else 0 end as snapshot_readable
  from migration_chain c left join per_chain p on p.chain_no = c.chain_no)
"""


@query("chain_audit", _AUDIT + """
select chain_no, batch_id, check_name, passed,
       case when check_name = 'SEQ_CONTINUOUS' then concat('events=', cast(event_count as varchar)) end as detail
from (
  select chain_no, batch_id, event_count, 'SEQ_CONTINUOUS' as check_name, seq_continuous as passed from audit
  union all select chain_no, batch_id, event_count, 'CAGE_LINKED', cage_linked from audit
  union all select chain_no, batch_id, event_count, 'TIME_ORDERED', time_ordered from audit
  union all select chain_no, batch_id, event_count, 'HANDOFF_EQUAL', handoff_equal from audit
  union all select chain_no, batch_id, event_count, 'FEED_MONOTONIC', feed_monotonic from audit
  union all select chain_no, batch_id, event_count, 'SNAPSHOT_READABLE', snapshot_readable from audit) x""")
def chain_audit(spark, sf_dir):
    from netpen.plans.audit import audit_chains
    v = views(spark, sf_dir, "migration_chain", "migration_event")
    return audit_chains(v["migration_chain"], v["migration_event"])


@query("chain_breaks", f"""
with stepped as (
  select e.*, lag(migration_no) over w as previous_no, lag(seq_no) over w as before_seq, lag(target_cage_no) over w as before_cage,
         lag(occurred_at) over w as before_at, lag(cumulative_feed_kg) over w as before_feed,
         o_orderkey % 131 <> 0 and o_orderkey % 137 <> 0 as readable, {_HANDED} as handed
  from migration_event e window w as (partition by chain_no order by seq_no, migration_no)),
checked as (
  select chain_no, seq_no, migration_no, previous_no, unnest([
    {{'check_name': 'SEQ_CONTINUOUS', 'broken': case when previous_no is null then seq_no <> 1 else seq_no <> before_seq + 1 end}},
    {{'check_name': 'CAGE_LINKED', 'broken': previous_no is not null and before_cage <> source_cage_no}},
    {{'check_name': 'TIME_ORDERED', 'broken': previous_no is not null and occurred_at <= before_at}},
    {{'check_name': 'HANDOFF_EQUAL', 'broken': not handed}},
    {{'check_name': 'FEED_MONOTONIC', 'broken': coalesce(cumulative_feed_kg < before_feed, false)}},
    {{'check_name': 'SNAPSHOT_READABLE', 'broken': not readable}}], recursive := true) from stepped),
placed as (
  select *, count(*) filter (not broken) over (partition by chain_no, check_name order by seq_no, migration_no) as island from checked),
runs as (select *, count(*) over (partition by chain_no, check_name, island) as size,
                row_number() over (partition by chain_no, check_name, island order by seq_no, migration_no) as place
         from placed where broken)
select chain_no, check_name, seq_no, migration_no, previous_no, case when place = 1 then size end as run_length from runs""")
def chain_breaks_query(spark, sf_dir):
    from netpen.plans.audit import chain_breaks
    v = views(spark, sf_dir, "migration_chain", "migration_event")
    return chain_breaks(v["migration_chain"], v["migration_event"])


@query("handoff_mismatches", f"""
select chain_no, migration_no, seq_no,
       case when o_orderkey % 131 <> 0 and o_orderkey % 137 <> 0 then 1 else 0 end as readable
from migration_event where not {_HANDED}""")
def handoff_mismatches_query(spark, sf_dir):
    from netpen.plans.audit import handoff_mismatches
    return handoff_mismatches(view(spark, sf_dir, "migration_event"))


@query("chains_by_cage", """
select origin_cage_no as cage_no, chain_no from migration_chain
union select current_cage_no, chain_no from migration_chain
union select source_cage_no, chain_no from migration_event
union select target_cage_no, chain_no from migration_event""")
def chains_by_cage_query(spark, sf_dir):
    from netpen.plans.audit import chains_by_cage
    v = views(spark, sf_dir, "migration_chain", "migration_event")
    return chains_by_cage(v["migration_chain"], v["migration_event"])


@query("history_by_cage", _AUDIT + """
select x.chain_no, x.batch_id, x.check_name, x.passed,
       case when x.check_name = 'SEQ_CONTINUOUS' then concat('events=', cast(x.event_count as varchar)) end as detail
from (
  select chain_no, batch_id, event_count, unnest([
    {'check_name': 'SEQ_CONTINUOUS', 'passed': seq_continuous}, {'check_name': 'CAGE_LINKED', 'passed': cage_linked},
    {'check_name': 'TIME_ORDERED', 'passed': time_ordered}, {'check_name': 'HANDOFF_EQUAL', 'passed': handoff_equal},
    {'check_name': 'FEED_MONOTONIC', 'passed': feed_monotonic}, {'check_name': 'SNAPSHOT_READABLE', 'passed': snapshot_readable}],
    recursive := true) from audit) x
where x.chain_no in (
  select chain_no from migration_chain where origin_cage_no = 'CAGE-3' or current_cage_no = 'CAGE-3'
  union select chain_no from migration_event where source_cage_no = 'CAGE-3' or target_cage_no = 'CAGE-3')""")
def history_by_cage_query(spark, sf_dir):
    from netpen.plans.audit import history_by_cage
    v = views(spark, sf_dir, "migration_chain", "migration_event")
    return history_by_cage(v["migration_chain"], v["migration_event"], "CAGE-3")


@query("segment_asof", """
select r.record_id, r.batch_id, r.feeding_time,
       coalesce(e.target_cage_no, f.source_cage_no, b.cage_no) as segment_cage_no,
       e.migration_no as segment_migration_no
from (select record_id, batch_id, feeding_time + interval 30 day as feeding_time from feeding_record) r
left join fish_batch b on b.batch_id = r.batch_id
left join (select batch_id, arg_min(source_cage_no, seq_no) as source_cage_no from migration_event group by batch_id) f
  on f.batch_id = r.batch_id
left join (select record_id, target_cage_no, migration_no from (
    select x.record_id, m.target_cage_no, m.migration_no,
           row_number() over (partition by x.record_id order by m.occurred_at desc, m.seq_no desc) as n
    from feeding_record x join migration_event m
      on m.batch_id = x.batch_id and m.occurred_at <= x.feeding_time + interval 30 day) y where n = 1) e
  on e.record_id = r.record_id""")
def segment_asof(spark, sf_dir):
    from netpen.plans.audit import place_on_timeline
    v = views(spark, sf_dir, "feeding_record", "fish_batch", "migration_event")
    facts = v["feeding_record"].select(
        "record_id", "batch_id", (F.col("feeding_time") + F.expr("interval 30 day")).alias("feeding_time"))
    return place_on_timeline(facts, "feeding_time", "record_id", v["fish_batch"], v["migration_event"])


# One side of a hand-off document; fields that are null are left out.
_SIDE = """concat('{{"cageNo":"', {0}, '","fishEstimateCount":', fish_estimate_count, ',"cumulativePostedFeedKg":', cumulative_feed_kg,
  ',"cumulativeUnpostedFeedKg":', cumulative_unposted_kg, ',"feedingRecordCount":', feeding_record_count,
  ',"postedRecordCount":', posted_record_count,
  case when latest_survival_rate is null then '' else concat(',"latestSurvivalRate":', latest_survival_rate) end,
  case when latest_survival_at is null then '' else concat(',"latestSurvivalAt":"', strftime(latest_survival_at, '%Y-%m-%dT%H:%M:%S'), '"') end,
  ',"feedingPlanCount":', feeding_plan_count, ',"movedSensorCount":', sensor_count, ',"retainedSensorCount":', {1}, '}}')"""
_WINNERS = """
with recursive met as (
  select q.request_id, q.migration_no, q.batch_id, trim(q.target_cage_no) as target_cage_no,
         case when trim(coalesce(q.transfer_type, '')) = '' then 'TRANSFER' else upper(trim(q.transfer_type)) end as transfer_type,
         q.occurred_at, q.operator_id, q.operator_name, q.remark, q.expected_batch_version, q.expected_chain_seq,
         b.batch_no, b.cage_no as first_cage, b.version as first_version, b.fingerling_count,
         c.chain_no, c.origin_cage_no, coalesce(c.current_seq, 0) as first_seq, coalesce(c.current_cage_no <> b.cage_no, false) as unlinked,
         case when not regexp_full_match(q.migration_no, '[A-Za-z0-9_-]{1,40}') then 'bad_migration_no'
              when q.occurred_at > timestamp '2024-06-01 00:00:01' then 'in_the_future'
              when q.transfer_type = 'SWAP' then 'bad_transfer_type'
              when b.batch_id is null then 'batch_missing'
              when b.status in ('HARVESTED', 'CLOSED') then 'batch_terminal' end as unsound
  from move_request q left join fish_batch b on b.batch_id = q.batch_id
  left join move_chain c on c.batch_id = q.batch_id),
turn as (
  select m.*, coalesce(o.held, cast([] as bigint[])) as held, u.migration_no is not null as used,
         row_number() over (order by request_id) as pos
  from met m left join (select cage_no, list(batch_id) as held from fish_batch where status in ('BREEDING', 'MONITORING')
                        group by cage_no) o on o.cage_no = m.target_cage_no
  left join (select distinct migration_no from used_number) u on u.migration_no = m.migration_no
  where unsound is null),
-- One request a step: where the moved batches are now, and the numbers granted.
fold as (
  select cast(0 as bigint) as pos, cast(null as bigint) as request_id, cast(null as varchar) as why, cast(null as varchar) as source_cage_no,
         cast(0 as bigint) as hop, cast([] as struct(b bigint, c varchar, h bigint)[]) as at, cast([] as varchar[]) as numbers
  union all
  select j.pos, j.request_id, j.why, j.source_cage_no, j.hop,
         case when j.why is null then list_append(list_filter(j.at, lambda m: m.b <> j.batch_id),
                                                  {'b': j.batch_id, 'c': j.target_cage_no, 'h': j.hop + 1}) else j.at end,
         case when j.why is null then list_append(j.numbers, j.migration_no) else j.numbers end
  from (
    select k.*, case when k.target_cage_no = k.source_cage_no then 'same_cage'
                     when len(list_filter(k.held, lambda b: not list_contains(list_transform(k.at, lambda m: m.b), b))) > 0
                       or list_contains(list_transform(k.at, lambda m: m.c), k.target_cage_no) then 'target_occupied'
                     when k.used or list_contains(k.numbers, k.migration_no) then 'migration_no_exists'
                     when k.expected_batch_version <> k.first_version + k.hop then 'batch_version_differs'
                     when k.unlinked then 'chain_head_differs'
                     when k.expected_chain_seq <> k.first_seq + k.hop then 'chain_seq_differs' end as why
    from (
      select t.*, f.at, f.numbers, coalesce(list_filter(f.at, lambda m: m.b = t.batch_id)[1].c, t.first_cage) as source_cage_no,
             coalesce(list_filter(f.at, lambda m: m.b = t.batch_id)[1].h, 0) as hop
      from fold f join turn t on t.pos = f.pos + 1) k) j),
winner as (
  select t.*, f.source_cage_no, cast(t.first_version + f.hop as int) as batch_version, cast(t.first_seq + f.hop + 1 as int) as seq_no, f.hop
  from fold f join turn t on t.request_id = f.request_id where f.why is null),
step as (
  select w.request_id, w.migration_no, w.source_cage_no, w.target_cage_no,
         (select min(n.request_id) from winner n where n.source_cage_no = w.target_cage_no and n.request_id > w.request_id) as next_id
  from winner w),
walk as (
  select s.sensor_id, (select min(n.request_id) from winner n where n.source_cage_no = s.cage_no) as request_id, 0 as hop
  from sensor s where s.status = 'ONLINE'
  union all
  select k.sensor_id, p.next_id, k.hop + 1 from walk k join step p on p.request_id = k.request_id where p.next_id is not null),
handed as (
  select w.migration_no, s.*, k.hop, 1 as moved, w.target_cage_no from walk k join winner w on w.request_id = k.request_id
  join sensor s on s.sensor_id = k.sensor_id
  union all
  select w.migration_no, s.*, 0, 0, w.target_cage_no from winner w join sensor s on s.cage_no = w.source_cage_no where s.status <> 'ONLINE')
"""


def _handoff(spark, sf_dir):
    from netpen.plans.migration import migration_handoff
    v = views(spark, sf_dir, "move_request", "fish_batch", "feeding_plan", "sensor", "sensor_reading",
              "feeding_record", "survival_report", "move_chain", "used_number")
    return migration_handoff(*v.values(), "2024-06-01 00:00:00")


@query("handoff_rejected", _WINNERS + """
select m.request_id, m.migration_no, coalesce(m.unsound, f.why) as reason
from met m left join fold f on f.request_id = m.request_id where coalesce(m.unsound, f.why) is not null""")
def handoff_rejected(spark, sf_dir):
    return _handoff(spark, sf_dir).rejected


@query("handoff_snapshot", _WINNERS + f"""
, told as (
select w.migration_no, w.batch_id, w.batch_no, coalesce(w.chain_no, concat('CHAIN-', w.batch_no)) as chain_no,
       coalesce(w.origin_cage_no, w.first_cage) as origin_cage_no, w.seq_no,
       w.transfer_type, w.source_cage_no, w.target_cage_no, w.occurred_at, w.batch_version, w.operator_id, w.operator_name, w.remark,
       coalesce(l.alive_count, w.fingerling_count) as fish_estimate_count,
       case when l.batch_id is null then 'FINGERLING' else 'LATEST_SURVIVAL' end as fish_estimate_basis,
       coalesce(f.posted, cast(0 as decimal(18,2))) as cumulative_feed_kg,
       coalesce(f.unposted, cast(0 as decimal(18,2))) as cumulative_unposted_kg,
       coalesce(f.n, 0) as feeding_record_count, coalesce(f.np, 0) as posted_record_count,
       l.survival_rate as latest_survival_rate, l.report_time as latest_survival_at,
       (select count(*) from feeding_plan p where p.batch_id = w.batch_id and p.status in ('ACTIVE', 'SUSPENDED')) as feeding_plan_count,
       (select count(*) from handed s where s.migration_no = w.migration_no and s.moved = 1) as sensor_count,
       (select count(*) from handed s where s.migration_no = w.migration_no and s.moved = 0) as retained_sensor_count
from winner w left join {_NEWEST_SURVIVAL} l on l.batch_id = w.batch_id
left join (select batch_id, cast(coalesce(sum(amount_kg) filter (where posted = 1), 0) as decimal(18,2)) as posted,
                  cast(coalesce(sum(amount_kg) filter (where posted = 0), 0) as decimal(18,2)) as unposted,
                  count(*) as n, count(*) filter (where posted = 1) as np
           from feeding_record group by batch_id) f on f.batch_id = w.batch_id)
select *, concat('{{"migrationNo":"', migration_no, '","chainNo":"', chain_no, '","seqNo":', seq_no, ',"transferType":"', transfer_type,
  '","batchId":', batch_id, ',"batchNo":"', batch_no, '","occurredAt":"', strftime(occurred_at, '%Y-%m-%dT%H:%M:%S'),
  '","fishEstimateBasis":"', fish_estimate_basis, '","source":', side(source_cage_no, retained_sensor_count),
  ',"target":', side(target_cage_no, 0), '}}') as snapshot_json
from told""".replace("side(source_cage_no, retained_sensor_count)", _SIDE.format("source_cage_no", "retained_sensor_count"))
    .replace("side(target_cage_no, 0)", _SIDE.format("target_cage_no", "0")))
def handoff_snapshot(spark, sf_dir):
    return _handoff(spark, sf_dir).events


@query("handoff_sensors", _WINNERS + f"""
select s.migration_no, s.sensor_id, s.sensor_no, s.sensor_type, s.metric_unit, s.status, cast(s.version + s.hop as int) as version,
       l.metric_value as latest_value, l.reading_time as latest_reading_at,
       coalesce(n.reading_count, 0) as reading_count, s.moved, s.target_cage_no
from handed s
left join {_NEWEST_READING} l on l.sensor_id = s.sensor_id
left join (select sensor_id, count(*) as reading_count from sensor_reading group by sensor_id) n on n.sensor_id = s.sensor_id""")
def handoff_sensors(spark, sf_dir):
    return _handoff(spark, sf_dir).sensors


@query("handoff_plans", _WINNERS + """
select w.migration_no, p.plan_id, p.plan_no, p.status, p.daily_amount_kg, cast(p.version + w.hop as int) as version, w.target_cage_no
from winner w join feeding_plan p on p.batch_id = w.batch_id where p.status in ('ACTIVE', 'SUSPENDED')""")
def handoff_plans(spark, sf_dir):
    return _handoff(spark, sf_dir).plans


@query("handoff_batches", _WINNERS + """
select w.batch_id, arg_max(target_cage_no, hop) as cage_no, cast(max(batch_version) + 1 as int) as version,
       arg_max(occurred_at, hop) as migrated_at, arg_max(migration_no, hop) as migration_no
from winner w group by w.batch_id""")
def handoff_batches(spark, sf_dir):
    return _handoff(spark, sf_dir).moved_batches


@query("handoff_moved_plans", _WINNERS + """
select p.plan_id, arg_max(w.target_cage_no, w.hop) as cage_no, cast(max(p.version + w.hop) + 1 as int) as version,
       arg_max(w.migration_no, w.hop) as migration_no
from winner w join feeding_plan p on p.batch_id = w.batch_id where p.status in ('ACTIVE', 'SUSPENDED') group by p.plan_id""")
def handoff_moved_plans(spark, sf_dir):
    return _handoff(spark, sf_dir).moved_plans


@query("handoff_moved_sensors", _WINNERS + """
select sensor_id, arg_max(target_cage_no, hop) as cage_no, cast(max(version + hop) + 1 as int) as version,
       arg_max(migration_no, hop) as migration_no
from handed where moved = 1 group by sensor_id""")
def handoff_moved_sensors(spark, sf_dir):
    return _handoff(spark, sf_dir).moved_sensors


@query("handoff_chains", _WINNERS + """
select coalesce(chain_no, concat('CHAIN-', batch_no)) as chain_no, batch_id, coalesce(any_value(origin_cage_no), any_value(first_cage)) as origin_cage_no,
       arg_max(target_cage_no, hop) as current_cage_no, max(seq_no) as current_seq
from winner group by coalesce(chain_no, concat('CHAIN-', batch_no)), batch_id""")
def handoff_chains(spark, sf_dir):
    return _handoff(spark, sf_dir).chains


@query("handoff_roundtrip", _WINNERS + """
select w.migration_no, w.source_cage_no, w.target_cage_no,
       (select count(*) from handed s where s.migration_no = w.migration_no and s.moved = 1) as moved_sensors,
       (select count(*) from handed s where s.migration_no = w.migration_no and s.moved = 0) as kept_at_source,
       (select count(*) from feeding_plan p where p.batch_id = w.batch_id and p.status in ('ACTIVE', 'SUSPENDED')) as target_plans
from winner w""")
def handoff_roundtrip(spark, sf_dir):
    from netpen.sources.snapshots import decode_handoff
    snap = F.col("snap")
    return _handoff(spark, sf_dir).events.select(
        "migration_no", decode_handoff(F.col("snapshot_json")).alias("snap")).select(
        "migration_no", snap["source"]["cageNo"].alias("source_cage_no"),
        snap["target"]["cageNo"].alias("target_cage_no"),
        snap["target"]["movedSensorCount"].alias("moved_sensors"),
        snap["source"]["retainedSensorCount"].alias("kept_at_source"),
        snap["target"]["feedingPlanCount"].alias("target_plans"))


# Registration and data quality ------------------------------------------------------------------

def _register(spark, sf_dir, kind, rows, *tables):
    from netpen.plans.register import register
    v = views(spark, sf_dir, rows, *tables)
    return register(kind, v[rows], v)


_JUDGED_RECORDS = """
with judged as (
  select n.*, coalesce(p.cage_no, b.cage_no) as cage_no,
    case when trim(n.feed_type) = '' then 'required:feed_type' when n.amount_kg <= 0 then 'not_positive:amount_kg'
         when n.feeding_time is null then 'required:feeding_time' when b.batch_id is null then 'batch_missing'
         when n.record_no in (select record_no from feeding_record) then 'key_exists'
         when n.plan_id is not null and p.plan_id is null then 'plan_missing'
         when n.plan_id is not null and p.batch_id <> n.batch_id then 'plan_of_other_batch'
         when n.plan_id is not null and p.status <> 'ACTIVE' then 'plan_not_active' end as first_reason
  from new_record n left join fish_batch b on b.batch_id = n.batch_id left join feeding_plan p on p.plan_id = n.plan_id),
final as (
  select *, case when first_reason is not null then first_reason
                 when row_number() over (partition by record_no, first_reason is null order by request_id) > 1 then 'key_exists' end as reason
  from judged)
"""


@query("register_records", _JUDGED_RECORDS + """
select request_id, record_no, batch_id, plan_id, feed_type, amount_kg, feeding_time, cage_no, 0 as posted
from final where reason is null""")
def register_records(spark, sf_dir):
    return _register(spark, sf_dir, "feeding_record", "new_record", "feeding_record", "fish_batch",
                     "feeding_plan").accepted


@query("register_records_rejected", _JUDGED_RECORDS + "select request_id, reason from final where reason is not null")
def register_records_rejected(spark, sf_dir):
    return _register(spark, sf_dir, "feeding_record", "new_record", "feeding_record", "fish_batch",
                     "feeding_plan").rejected


_JUDGED_REPORTS = """
with judged as (
  select n.*, b.cage_no, b.fingerling_count,
    case when n.survival_rate > 1 then 'out_of_range:survival_rate' when b.batch_id is null then 'batch_missing'
         when n.alive_count > b.fingerling_count then 'more_than_stocked'
         when n.report_no in (select report_no from survival_report) then 'key_exists' end as first_reason
  from new_report n left join fish_batch b on b.batch_id = n.batch_id),
final as (
  select *, case when first_reason is not null then first_reason
                 when row_number() over (partition by report_no, first_reason is null order by request_id) > 1 then 'key_exists' end as reason
  from judged)
"""


@query("register_reports", _JUDGED_REPORTS + """
select request_id, report_no, batch_id, alive_count,
       coalesce(survival_rate, cast((alive_count * 10000 * 2 + fingerling_count) // (fingerling_count * 2) as decimal(11,0)) * 0.0001::decimal(5,4))::decimal(7,4) as survival_rate,
       report_time, cage_no
from final where reason is null""")
def register_reports(spark, sf_dir):
    return _register(spark, sf_dir, "survival_report", "new_report", "survival_report", "fish_batch").accepted


@query("register_reports_rejected", _JUDGED_REPORTS + "select request_id, reason from final where reason is not null")
def register_reports_rejected(spark, sf_dir):
    return _register(spark, sf_dir, "survival_report", "new_report", "survival_report", "fish_batch").rejected


@query("register_readings_rejected", """
select request_id, reason from (
  select n.request_id,
    case when n.sensor_id is null then 'required:sensor_id' when n.metric_value < 0 then 'negative:metric_value'
         when s.sensor_id is null then 'sensor_missing'
         when n.reading_no in (select reading_no from sensor_reading) then 'key_exists'
         when s.status <> 'ONLINE' then 'sensor_not_online' end as reason
  from new_reading n left join sensor s on s.sensor_id = n.sensor_id) x where reason is not null""")
def register_readings_rejected(spark, sf_dir):
    return _register(spark, sf_dir, "sensor_reading", "new_reading", "sensor_reading", "sensor").rejected


_JUDGED_TIDES = """
with recursive judged as (
  select n.*, a.sea_area, a.time_zone,
    case when n.tide_no in (select tide_no from tide_session) then 'key_exists'
         when n.start_at_utc >= n.end_at_utc then 'start_not_before_end'
         when a.cage_no is null then 'no_sea_area'
         when exists (select 1 from tide_session t where t.cage_no = n.cage_no and t.start_at_utc < n.end_at_utc
                      and t.end_at_utc > n.start_at_utc) then 'overlaps_tide' end as early
  from new_tide n left join cage_sea_area a on a.cage_no = n.cage_no),
turn as (
  select request_id, cage_no, start_at_utc as s, end_at_utc as e, row_number() over (partition by cage_no order by request_id) as pos
  from judged where early is null),
-- One request of every cage a step; the tide numbers of these rows are unique.
fold as (
  select cage_no, cast(0 as bigint) as pos, cast(null as bigint) as request_id, false as ok,
         cast([] as struct(s timestamp, e timestamp)[]) as taken from (select distinct cage_no from turn) c
  union all
  select t.cage_no, t.pos, t.request_id, len(list_filter(f.taken, lambda x: x.s < t.e and x.e > t.s)) = 0,
         case when len(list_filter(f.taken, lambda x: x.s < t.e and x.e > t.s)) = 0
              then list_append(f.taken, {'s': t.s, 'e': t.e}) else f.taken end
  from fold f join turn t on t.cage_no = f.cage_no and t.pos = f.pos + 1),
final as (
  select j.*, case when early is not null then early when not f.ok then 'overlaps_tide' end as reason
  from judged j left join fold f on f.request_id = j.request_id)
"""


@query("register_tides", _JUDGED_TIDES + """
select request_id, tide_no, cage_no, start_at_utc, end_at_utc, sea_area, time_zone,
       cast({LOCAL:time_zone,start_at_utc} as date) as business_date
from final where reason is null""")
def register_tides(spark, sf_dir):
    return _register(spark, sf_dir, "tide_session", "new_tide", "tide_session", "cage_sea_area").accepted


@query("register_tides_rejected", _JUDGED_TIDES + "select request_id, reason from final where reason is not null")
def register_tides_rejected(spark, sf_dir):
    return _register(spark, sf_dir, "tide_session", "new_tide", "tide_session", "cage_sea_area").rejected


@query("register_rules", """
select n.request_id, n.rule_code, n.rule_type, n.start_minute, n.end_minute, n.coefficient, 'DRAFT' as status,
       cast(coalesce(v.newest, 0) + row_number() over (partition by n.rule_code order by n.request_id) as int) as version_no
from new_rule n left join (select rule_code, max(version_no) as newest from rule_version group by rule_code) v
  on v.rule_code = n.rule_code
where n.rule_type <> 'NIGHT' and n.coefficient >= 0 and n.start_minute between 0 and 1439
  and n.end_minute between 1 and 1440 and n.start_minute <> n.end_minute""")
def register_rules(spark, sf_dir):
    from netpen.plans.register import register
    v = views(spark, sf_dir, "new_rule", "rule_version")
    return register("ts_rule", v["new_rule"], {"ts_rule": v["rule_version"]}).accepted


@query("constraint_violations", """
select plan_id, 'daily_amount_kg' as field, 'not_positive' as code from feeding_plan where daily_amount_kg <= 0
union all
select plan_id, 'feed_frequency', 'not_positive' from feeding_plan where feed_frequency <= 0""")
def constraint_violations(spark, sf_dir):
    from netpen.plans.register import check_constraints
    return check_constraints("feeding_plan", view(spark, sf_dir, "feeding_plan"), "plan_id")


@query("unique_violations", """
select record_no, count(*) as n from (select record_no from feeding_record union all select record_no from new_record) x
group by record_no having count(*) > 1""")
def unique_violations(spark, sf_dir):
    from netpen.plans.register import duplicate_keys
    v = views(spark, sf_dir, "feeding_record", "new_record")
    return duplicate_keys("feeding_record", v["feeding_record"].select("record_no").unionByName(
        v["new_record"].select("record_no")))


@query("fk_violations", """
select request_id, batch_id from new_record where batch_id not in (select batch_id from fish_batch)""")
def fk_violations(spark, sf_dir):
    from netpen.plans.register import missing_parents
    v = views(spark, sf_dir, "new_record", "fish_batch")
    return missing_parents(v["new_record"], v["fish_batch"], "batch_id", "request_id").select(
        "request_id", "batch_id")


@query("rule_overlaps", """
with mins as (
  select rule_id, rule_code, version_no, start_minute, (start_minute + i) % 1440 as m
  from rule_version, generate_series(0, 1439) g(i)
  where i < case when end_minute <= start_minute then end_minute - start_minute + 1440 else end_minute - start_minute end),
ranked as (
  select a.rule_id, a.rule_code, a.version_no, b.rule_id as other_rule_id, b.rule_code as other_rule_code,
         row_number() over (partition by a.rule_id order by b.start_minute, b.rule_code, b.rule_id) as n
  from (select distinct m1.rule_id, m1.rule_code, m1.version_no, m2.rule_id as other
        from mins m1 join mins m2 on m1.m = m2.m and m1.rule_code <> m2.rule_code) a
  join rule_version b on b.rule_id = a.other)
select rule_id, rule_code, version_no, other_rule_id, other_rule_code from ranked where n = 1""")
def rule_overlaps_query(spark, sf_dir):
    from netpen.operators.ranges import rule_overlaps
    return rule_overlaps(view(spark, sf_dir, "rule_version"))


# Lifecycle --------------------------------------------------------------------------------------

_ALLOWED = """
(s.target_status = f.status
 or (f.status in ('BREEDING', 'MONITORING') and s.target_status in ('BREEDING', 'MONITORING', 'HARVESTED', 'CLOSED'))
 or (f.status = 'HARVESTED' and s.target_status = 'CLOSED'))"""
_STATUS_FOLD = f"""
with recursive steps as (
  select e.*, row_number() over (partition by e.batch_id order by e.event_time, e.event_id) as pos
  from batch_event e join fish_batch b on b.batch_id = e.batch_id),
fold as (
  select batch_id, cast(0 as bigint) as pos, cast(null as bigint) as event_id, status, cast(null as varchar) as status_before,
         true as ok from fish_batch
  union all
  select s.batch_id, s.pos, s.event_id, case when {_ALLOWED} then s.target_status else f.status end, f.status, {_ALLOWED}
  from fold f join steps s on s.batch_id = f.batch_id and s.pos = f.pos + 1)
"""


@query("lifecycle_replay", _STATUS_FOLD + """
select e.event_id, e.batch_id, e.event_time, e.target_status, f.status_before,
       case when f.ok then 1 else 0 end as accepted,
       case when f.event_id is null then 'entity_missing' when e.target_status = 'LOST' then 'bad_status'
            when not f.ok then 'illegal_move' end as reason
from batch_event e left join fold f on f.event_id = e.event_id""")
def lifecycle_replay(spark, sf_dir):
    from netpen.plans.lifecycle import replay_status
    v = views(spark, sf_dir, "fish_batch", "batch_event")
    return replay_status("fish_batch", v["fish_batch"], v["batch_event"]).events


@query("lifecycle_final", _STATUS_FOLD + """
select f.batch_id, arg_max(f.status, f.pos) as status, count(*) filter (where f.ok and f.event_id is not null) as moves
from fold f group by f.batch_id""")
def lifecycle_final(spark, sf_dir):
    from netpen.plans.lifecycle import replay_status
    v = views(spark, sf_dir, "fish_batch", "batch_event")
    known = v["batch_event"].join(v["fish_batch"].select("batch_id"), "batch_id", "left_semi")
    return replay_status("fish_batch", v["fish_batch"], known).final


_HARVEST_FOLD = f"""
with recursive steps as (
  select *, row_number() over (partition by batch_id order by event_time, event_id) as pos from (
    select e.event_id, e.batch_id, e.event_time, e.target_status, cast(null as bigint) as harvest_id, false as closed_before
    from batch_event e join fish_batch b on b.batch_id = e.batch_id
    union all
    select a.event_id, h.batch_id, a.event_time, 'HARVESTED', a.harvest_id, h.status = 'ACCEPTED'
    from acceptance a join harvest_batch h on h.harvest_id = a.harvest_id) x),
fold as (
  select batch_id, cast(0 as bigint) as pos, cast(null as bigint) as event_id, status, true as ok,
         cast([] as bigint[]) as done, cast(null as varchar) as reason from fish_batch
  union all
  select g.batch_id, g.pos, g.event_id, case when g.why is null then g.target_status else g.status end, g.why is null,
         case when g.why is null and g.harvest_id is not null then list_append(g.done, g.harvest_id) else g.done end, g.why
  from (
    select s.batch_id, s.pos, s.event_id, s.target_status, s.harvest_id, f.status, f.done,
           case when s.harvest_id is not null and s.closed_before then 'already_accepted'
                when not {_ALLOWED} then case when s.harvest_id is null then 'illegal_move' else 'batch_closed' end
                when s.harvest_id is not null and list_contains(f.done, s.harvest_id) then 'already_accepted' end as why
    from fold f join steps s on s.batch_id = f.batch_id and s.pos = f.pos + 1) g)
"""


@query("harvest_acceptance", _HARVEST_FOLD + """
select a.event_id, a.harvest_id, h.batch_id, a.event_time,
       case when h.harvest_id is not null and f.reason is null then 1 else 0 end as accepted,
       case when h.harvest_id is null then 'harvest_missing' else f.reason end as reason
from acceptance a left join harvest_batch h on h.harvest_id = a.harvest_id left join fold f on f.event_id = a.event_id""")
def harvest_acceptance(spark, sf_dir):
    from netpen.plans.lifecycle import replay_harvests
    v = views(spark, sf_dir, "fish_batch", "harvest_batch", "acceptance", "batch_event")
    return replay_harvests(*v.values())[0]


_PLAN_MOVES = """
(s.target_status = f.status or (f.status in ('ACTIVE', 'SUSPENDED') and s.target_status in ('ACTIVE', 'SUSPENDED', 'FINISHED')))"""
_SENSOR_MOVES = "s.target_status in ('ONLINE', 'OFFLINE', 'MAINTENANCE')"


def _status_replay(key: str, entities: str, events: str, allowed: str, bad: str) -> str:
    """Every event of an entity after the other, from its stored status."""
    return f"""
with recursive steps as (
  select e.*, row_number() over (partition by e.{key} order by e.event_time, e.event_id) as pos
  from {events} e join {entities} b on b.{key} = e.{key}),
fold as (
  select {key}, cast(0 as bigint) as pos, cast(null as bigint) as event_id, status, cast(null as varchar) as status_before,
         true as ok from {entities}
  union all
  select s.{key}, s.pos, s.event_id, case when {allowed} then s.target_status else f.status end, f.status, {allowed}
  from fold f join steps s on s.{key} = f.{key} and s.pos = f.pos + 1)
select e.event_id, e.{key}, e.event_time, e.target_status, f.status_before,
       case when f.ok then 1 else 0 end as accepted,
       case when f.event_id is null then 'entity_missing' when e.target_status = '{bad}' then 'bad_status'
            when not f.ok then 'illegal_move' end as reason
from {events} e left join fold f on f.event_id = e.event_id"""


@query("plan_replay", _status_replay("plan_id", "feeding_plan", "plan_event", _PLAN_MOVES, "GONE"))
def plan_replay(spark, sf_dir):
    from netpen.plans.lifecycle import replay_status
    v = views(spark, sf_dir, "feeding_plan", "plan_event")
    return replay_status("feeding_plan", v["feeding_plan"], v["plan_event"]).events


@query("sensor_replay", _status_replay("sensor_id", "sensor", "sensor_event", _SENSOR_MOVES, "BROKEN"))
def sensor_replay(spark, sf_dir):
    from netpen.plans.lifecycle import replay_status
    v = views(spark, sf_dir, "sensor", "sensor_event")
    return replay_status("sensor", v["sensor"], v["sensor_event"]).events


@query("rule_replay", """
with recursive steps as (
  select e.event_id, e.rule_id, e.action, r.rule_code, r.status as stored,
         row_number() over (partition by r.rule_code order by e.event_time, e.event_id) as pos
  from rule_event e join rule_version r on r.rule_id = e.rule_id),
-- Per code: versions enabled so far, the one enabled last, versions retired so far.
fold as (
  select rule_code, cast(0 as bigint) as pos, cast(null as bigint) as event_id, cast(null as varchar) as reason,
         cast([] as bigint[]) as used, cast(null as bigint) as holder, cast([] as bigint[]) as gone
  from (select distinct rule_code from rule_version) c
  union all
  select g.rule_code, g.pos, g.event_id, g.why,
         case when g.why is null and g.action = 'ENABLE' then list_append(g.used, g.rule_id) else g.used end,
         case when g.why is null and g.action = 'ENABLE' then g.rule_id else g.holder end,
         case when g.why is null and g.action = 'RETIRE' then list_append(g.gone, g.rule_id) else g.gone end
  from (
    select s.*, f.used, f.holder, f.gone,
           case when s.action = 'ENABLE' and (s.stored <> 'DRAFT' or list_contains(f.used, s.rule_id)) then 'not_draft'
                when s.action = 'RETIRE' and (list_contains(f.gone, s.rule_id) or not (
                  coalesce(f.holder = s.rule_id, false) or (f.holder is null and s.stored = 'ENABLED'))) then 'not_enabled'
                when s.action = 'PAUSE' then 'bad_action' end as why
    from fold f join steps s on s.rule_code = f.rule_code and s.pos = f.pos + 1) g)
select e.event_id, e.rule_id, e.event_time, e.action,
       case when f.event_id is not null and f.reason is null then 1 else 0 end as accepted,
       case when f.event_id is null then 'rule_missing' else f.reason end as reason
from rule_event e left join fold f on f.event_id = e.event_id""")
def rule_replay(spark, sf_dir):
    from netpen.plans.lifecycle import replay_rules
    v = views(spark, sf_dir, "rule_version", "rule_event")
    return replay_rules(v["rule_version"], v["rule_event"])


@query("rule_history", """
select rule_id, rule_code, version_no, enabled_time,
       least(retired_time, lead(enabled_time) over (partition by rule_code order by enabled_time, rule_id)) as retired_time
from rule_version where enabled_time is not null""")
def rule_history_query(spark, sf_dir):
    from netpen.plans.lifecycle import rule_history
    return rule_history(view(spark, sf_dir, "rule_version"))


_ENABLING = """
with recursive mins as (
  select rule_id, rule_code, status, list((start_minute + i) % 1440) as m
  from draft_rule, generate_series(0, 10) g(i)
  where i < case when end_minute <= start_minute then end_minute - start_minute + 1440 else end_minute - start_minute end
  group by rule_id, rule_code, status),
turn as (select q.request_id, d.*, row_number() over (order by q.request_id) as pos
         from rule_wish q join mins d on d.rule_id = q.rule_id where d.status = 'DRAFT'),
-- One request a step: the rules enabled by then, and the drafts enabled in the run.
fold as (
  select cast(0 as bigint) as pos, cast(null as bigint) as request_id, cast(null as bigint) as rule_id, cast(null as varchar) as why,
         (select list({'c': rule_code, 'm': m}) from mins where status = 'ENABLED') as live, cast([] as bigint[]) as done
  union all
  select j.pos, j.request_id, j.rule_id, j.why,
         case when j.why is null then list_append(list_filter(j.live, lambda x: x.c <> j.rule_code), {'c': j.rule_code, 'm': j.m}) else j.live end,
         case when j.why is null then list_append(j.done, j.rule_id) else j.done end
  from (select t.*, f.live, f.done,
               case when list_contains(f.done, t.rule_id) then 'not_draft'
                    when len(list_filter(f.live, lambda x: x.c <> t.rule_code and list_has_any(x.m, t.m))) > 0
                      then 'overlaps_enabled_rule' end as why
        from fold f join turn t on t.pos = f.pos + 1) j),
j3 as (select q.request_id, q.rule_id, d.rule_code,
              case when d.rule_id is null then 'rule_missing' when d.status <> 'DRAFT' then 'not_draft' else f.why end as reason
       from rule_wish q left join draft_rule d on d.rule_id = q.rule_id left join fold f on f.request_id = q.request_id),
stays as (select rule_code, arg_max(rule_id, request_id) as rule_id from j3 where reason is null group by rule_code)
"""


def _enabling(spark, sf_dir):
    from netpen.plans.lifecycle import enable_rules
    v = views(spark, sf_dir, "draft_rule", "rule_wish")
    return enable_rules(v["draft_rule"], v["rule_wish"], "2024-06-01 00:00:00")


@query("enable_rules", _ENABLING + """
select d.rule_id, d.rule_code, d.version_no, d.start_minute, d.end_minute,
       case when c.rule_id <> d.rule_id and (t.rule_id is not null or d.status = 'ENABLED') then 'RETIRED'
            when t.rule_id is not null then 'ENABLED' else d.status end as status,
       case when t.rule_id is not null then timestamp '2024-06-01 00:00:00' end as enabled_time,
       case when c.rule_id <> d.rule_id and (t.rule_id is not null or d.status = 'ENABLED') then timestamp '2024-06-01 00:00:00' end as retired_time
from draft_rule d left join (select rule_id from j3 where reason is null) t on t.rule_id = d.rule_id
left join stays c on c.rule_code = d.rule_code""")
def enable_rules_query(spark, sf_dir):
    return _enabling(spark, sf_dir).rules


@query("enable_rules_rejected", _ENABLING + "select request_id, rule_id, reason from j3 where reason is not null")
def enable_rules_rejected(spark, sf_dir):
    return _enabling(spark, sf_dir).rejected


# Sinks ------------------------------------------------------------------------------------------

@query("replace_results", """
with day_sum as (
  select batch_id, cast(feeding_time as date) as business_date, cast(sum(amount_kg) as decimal(18,2)) as kg
  from feeding_record group by all),
posted_sum as (
  select batch_id, cast(feeding_time as date) as business_date, cast(sum(amount_kg) as decimal(18,2)) as kg
  from feeding_record where posted = 1 group by all)
select d.batch_id, d.business_date, coalesce(p.kg, d.kg) as kg
from day_sum d left join posted_sum p on p.batch_id = d.batch_id and p.business_date = d.business_date""")
def replace_results_query(spark, sf_dir):
    from netpen.sources.sinks import replace_results
    records = view(spark, sf_dir, "feeding_record")
    per_day = lambda df: df.groupBy("batch_id", F.to_date("feeding_time").alias("business_date")).agg(
        F.sum("amount_kg").cast("decimal(18,2)").alias("kg"))
    return replace_results(per_day(records), per_day(records.where(F.col("posted") == 1)))


@query("append_events", """
select migration_no, chain_no, seq_no from migration_event e
where o_orderkey % 3 = 0
  and not exists (select 1 from migration_event x where x.o_orderkey % 3 <> 0 and x.chain_no = e.chain_no and x.seq_no = e.seq_no)""")
def append_events_query(spark, sf_dir):
    from netpen.sources.sinks import append_events
    events = view(spark, sf_dir, "migration_event")
    key = ["migration_no", "chain_no", "seq_no"]
    copies = events.select(F.concat(F.lit("ZZ-"), "migration_no").alias("migration_no"), "chain_no", "seq_no")
    return append_events(events.where(F.col("o_orderkey") % 3 != 0).select(*key), events.select(*key).unionByName(copies))


@query("derived_numbers", """
select business_key, concat('FR-', substr(sha256(business_key), 1, 29)) as record_no
from (select concat(voyage_no, '|', cage_no, '|', strftime(observed_at, '%Y-%m-%dT%H:%M:%S')) as business_key
      from stored_observation) x""")
def derived_numbers(spark, sf_dir):
    from netpen.functions.text import business_key, derived_no
    key = business_key(F.col("voyage_no"), F.col("cage_no"), F.col("observed_at"))
    return view(spark, sf_dir, "stored_observation").select(
        key.alias("business_key"), derived_no("FR-", key).alias("record_no"))
