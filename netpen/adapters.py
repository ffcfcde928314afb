"""Domain views over the TPC-H-like sample tables.

Each view is one SQL text that Spark and DuckDB both read. Four spellings differ between the two
and are written as placeholders: ``{TS}`` (timestamp literal type), ``{EXPLODE:n}`` (rows 0..n),
``{LOCAL:zone,time}`` (local time of a UTC time) and ``{ISO:time}`` (ISO text to the second).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SAMPLE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

VIEWS: dict[str, str] = {
    "fish_batch": """
        select c_custkey as batch_id, concat('FB-', cast(c_custkey as string)) as batch_no,
               concat('CAGE-', cast(c_nationkey as string)) as cage_no, c_mktsegment as species,
               cast(1000 + c_custkey % 9000 as int) as fingerling_count,
               cast(c_acctbal as decimal(10,2)) as average_weight_g,
               case when c_nationkey = 24 then case when c_custkey % 2 = 0 then 'HARVESTED' else 'CLOSED' end
                    when c_custkey % 10 < 4 then 'BREEDING' when c_custkey % 10 < 8 then 'MONITORING'
                    when c_custkey % 10 = 8 then 'HARVESTED' else 'CLOSED' end as status,
               {TS} '2024-01-01 00:00:00' - interval 1 day * cast(c_custkey % 365 as int) as stocking_time,
               cast(c_custkey % 3 as int) as version
        from customer""",
    "feeding_plan": """
        select c_custkey * 2 as plan_id, concat('FP-', cast(c_custkey * 2 as string)) as plan_no,
               c_custkey as batch_id, concat('CAGE-', cast(c_nationkey as string)) as cage_no,
               'PELLET' as feed_type, cast(c_acctbal as decimal(10,2)) as daily_amount_kg,
               cast(c_custkey % 5 as int) as feed_frequency, date '2024-01-01' as start_date,
               case when c_custkey % 53 = 0 then date '2023-12-31' else date '2024-06-30' end as end_date,
               case when c_custkey % 4 = 1 then 'SUSPENDED' when c_custkey % 4 = 2 then 'FINISHED'
                    else 'ACTIVE' end as status, cast(0 as int) as version
        from customer
        union all
        select c_custkey * 2 + 1, concat('FP-', cast(c_custkey * 2 + 1 as string)), c_custkey,
               concat('CAGE-', cast(c_nationkey as string)), 'MASH', cast(c_acctbal as decimal(10,2)),
               cast(2 as int), date '2024-02-01', date '2024-07-31',
               case when c_custkey % 6 < 3 then 'ACTIVE' else 'FINISHED' end, cast(1 as int)
        from customer where c_custkey % 2 = 0""",
    "feeding_record": """
        select o_orderkey as record_id, concat('FR-', cast(o_orderkey as string)) as record_no,
               o_custkey as batch_id,
               case when o_orderkey % 3 = 0 then o_custkey * 2 when o_orderkey % 7 = 0 then o_custkey * 2 + 3
                    end as plan_id,
               cast(o_totalprice as decimal(10,2)) as amount_kg, o_orderdate as feeding_time,
               case when o_orderstatus = 'F' then 1 else 0 end as posted,
               case when o_orderstatus = 'F' then o_orderdate + interval 1 day end as posted_time
        from orders""",
    "sensor": """
        select user_id as sensor_id, concat('S-', cast(user_id as string)) as sensor_no,
               concat('CAGE-', cast(user_id % 27 as string)) as cage_no,
               case when user_id % 2 = 0 then 'OXYGEN' else 'TEMPERATURE' end as sensor_type,
               case when user_id % 3 = 0 then 'C' else 'mg/L' end as metric_unit,
               case when user_id % 10 = 9 then 'OFFLINE' when user_id % 10 = 8 then 'MAINTENANCE'
                    else 'ONLINE' end as status, cast(user_id % 2 as int) as version
        from (select distinct user_id from events) u""",
    "sensor_reading": """
        select event_id as reading_id, concat('RD-', cast(event_id as string)) as reading_no,
               user_id as sensor_id, concat('CAGE-', cast(user_id % 27 as string)) as cage_no,
               cast(value as decimal(12,4)) as metric_value, ts as reading_time
        from events""",
    "survival_report": """
        select event_id as report_id, concat('SR-', cast(event_id as string)) as report_no,
               user_id as batch_id,
               cast(floor((1000 + user_id % 9000) * (80 + event_id % 20) * 0.01) as int) as alive_count,
               cast(0.80 + cast(event_id % 20 as decimal(4,0)) * 0.01 as decimal(7,4)) as survival_rate,
               ts as report_time
        from events""",
    "harvest_batch": """
        select o_orderkey as harvest_id, concat('HB-', cast(o_orderkey as string)) as harvest_no,
               o_custkey as batch_id, concat('CAGE-', cast(c_nationkey as string)) as cage_no,
               cast(500 + o_orderkey % 9000 as int) as harvest_count,
               cast(o_totalprice as decimal(12,2)) as total_weight_kg, o_orderdate as harvest_time,
               case when o_orderkey % 2 = 0 and c_nationkey % 3 = 0 then 'ACCEPTED' else 'PENDING' end as status
        from orders join customer on o_custkey = c_custkey""",
    "feed_observation": """
        select event_id as obs_id, concat('OB-', cast(event_id as string)) as obs_no,
               user_id as batch_id, ts as observed_at_utc, cast(value as decimal(10,3)) as feed_amount_kg
        from events""",
    "cage_sea_area": """
        select concat('CAGE-', cast(n_nationkey as string)) as cage_no, n_name as sea_area,
               case n_regionkey when 0 then 'Africa/Cairo' when 1 then 'America/New_York'
                    when 2 then 'Asia/Shanghai' when 3 then 'Europe/Paris' else 'UTC' end as time_zone
        from nation where n_nationkey <> 23""",
    "ts_rule": """
        select cast(rule_id as bigint) as rule_id, rule_code, cast(1 as int) as version_no, rule_type,
               cast(start_minute as int) as start_minute, cast(end_minute as int) as end_minute,
               cast(coefficient as decimal(12,4)) as coefficient, 'ENABLED' as status
        from (values (1, 'PEAK-DAY', 'PEAK', 360, 600, 1.5), (2, 'FLAT-DAY', 'FLAT', 600, 1080, 1.0),
                     (3, 'VALLEY-EVE', 'VALLEY', 1080, 1320, 0.8), (4, 'PEAK-NIGHT', 'PEAK', 1320, 120, 1.2))
             as r(rule_id, rule_code, rule_type, start_minute, end_minute, coefficient)""",
    # Every 6 hours, 5 hours long; every fifth cage also has a tide across each day's first gap.
    "tide_slot": """
        select n_nationkey, {EXPLODE:149} as slot from nation where n_nationkey <> 23""",
    "tide_session": """
        select t.tide_id, concat('T-', cast(t.tide_id as string)) as tide_no, t.cage_no, a.sea_area,
               a.time_zone, t.start_at_utc, t.end_at_utc,
               cast({LOCAL:a.time_zone,t.start_at_utc} as date) as business_date
        from (select cast(n_nationkey as bigint) * 1000 + slot as tide_id,
                     concat('CAGE-', cast(n_nationkey as string)) as cage_no,
                     case when slot < 120 then {TS} '2024-01-01 00:00:00' + interval 1 hour * cast(slot * 6 as int)
                          else {TS} '2024-01-01 04:00:00' + interval 1 day * cast(slot - 120 as int) end
                       + interval 1 minute * cast(n_nationkey as int) as start_at_utc,
                     case when slot < 120 then {TS} '2024-01-01 05:00:00' + interval 1 hour * cast(slot * 6 as int)
                          else {TS} '2024-01-01 07:30:00' + interval 1 day * cast(slot - 120 as int) end
                       + interval 1 minute * cast(n_nationkey as int) as end_at_utc
              from tide_slot where slot < 120 or n_nationkey % 5 = 0) t
        join cage_sea_area a on t.cage_no = a.cage_no""",
    "calc_request": """
        select o.batch_id, t.business_date
        from (select distinct batch_id from feed_observation) o
        join fish_batch b on o.batch_id = b.batch_id
        join (select distinct cage_no, business_date from tide_session) t on b.cage_no = t.cage_no""",
    # Observation lines: up to four lines per event, with every kind of fault in turn.
    "obs_variant": """
        select event_id, ts, user_id, value, {EXPLODE:3} as k from events""",
    "obs_field": """
        select event_id, k, concat('file-', cast((event_id + case when k = 3 then 1 else 0 end) % 4 as string)) as checksum,
               {TS} '2024-02-01 00:00:00' as file_time, event_id * 8 + k + 2 as line_no,
               case when event_id % 97 = 3 then 'VOY 1' else concat('VOY-', cast(event_id % 7 as string)) end as voyage_no,
               case when event_id % 97 = 0 then 'BAD CAGE'
                    else concat('CAGE-', cast(user_id % 27 as string)) end as cage_no,
               case when event_id % 89 = 0 then 'not-a-time' when event_id % 89 = 1 then ''
                    when event_id % 89 = 2 then '2099-01-01T00:00:00'
                    when event_id % 5 = 1 then replace({ISO:ts}, 'T', ' ')
                    else {ISO:ts} end as time_text,
               case when k = 3 or event_id % 6 = 0 then '' when event_id % 83 = 0 then 'abc'
                    when event_id % 79 = 0 then '-1.00' when event_id % 73 = 0 then '1.234'
                    when event_id % 61 = 0 then '100000.00' when event_id % 59 = 0 then '1E1'
                    when k = 0 then cast(cast(value as decimal(10,2)) as string)
                    else cast(cast(cast(value as decimal(10,2)) + 1 as decimal(10,2)) as string) end as feed_text,
               case when event_id % 71 = 0 then '1.5' when event_id % 69 = 1 then 'x' when event_id % 3 = 0 then ''
                    when k = 1 and event_id % 44 = 0 then '0.9000' else '0.9500' end as rate_text,
               case when event_id % 2 = 0 and k < 3 then '' when event_id % 43 = 1 then '-3'
                    when k = 3 then '7.25' else '6.8' end as value_text,
               case when (event_id % 2 = 0 and k < 3) or event_id % 41 = 1 then ''
                    when user_id % 3 = 0 then 'C' else 'mg/L' end as unit_text,
               case when (event_id % 2 = 0 and k < 3) or event_id % 47 = 1 then ''
                    when event_id % 51 = 1 then 'bad device!' when event_id % 37 = 0 then 'S-GHOST'
                    else concat('S-', cast(user_id as string)) end as device_text,
               case when event_id % 67 = 0 then 7 when event_id % 67 = 1 then 9 else 8 end as width
        from obs_variant
        where k = 0 or (k = 1 and event_id % 11 = 0) or (k = 2 and event_id % 22 = 0)
           or (k = 3 and event_id % 33 = 0)""",
    "obs_line": """
        select checksum, file_time, line_no,
               concat(voyage_no, ',', case when event_id % 13 = 0 then concat(' ', cage_no, ' ') else cage_no end, ',',
                      time_text, ',',
                      case when event_id % 13 = 0 then concat('"', feed_text, '"') else feed_text end, ',',
                      rate_text, ',', value_text, ',', unit_text,
                      case when width = 7 then '' else concat(',', device_text) end,
                      case when width = 9 then ',EXTRA' else '' end) as raw_line
        from obs_field
        union all
        select concat('file-', cast(event_id % 4 as string)), {TS} '2024-02-01 00:00:00', event_id * 8 + 9, '   '
        from events where event_id % 101 = 0""",
    # Every event was observed before: one in five at the time that the lines name, the others in an earlier season.
    "stored_time": """
        select event_id, user_id, value,
               date_trunc('second', case when event_id % 5 = 0 then ts else ts - interval 400 day end) as observed_at
        from events""",
    "stored_event": """
        select * from (
          select event_id, user_id, concat('VOY-', cast(event_id % 7 as string)) as voyage_no,
                 concat('CAGE-', cast(user_id % 27 as string)) as cage_no, observed_at,
                 cast(value as decimal(10,2)) + case when event_id % 10 = 0 then 1 else 0 end as feed,
                 row_number() over (partition by event_id % 7, user_id % 27, observed_at order by event_id) as pick
          from stored_time) x
        where pick = 1""",
    "stored_observation": """
        select voyage_no, cage_no, cast(observed_at as {TS}) as observed_at,
               case when event_id % 6 <> 0 then cast(feed as decimal(10,2)) end as feed_amount_kg,
               case when event_id % 3 <> 0 then cast(0.95 as decimal(7,4)) end as survival_rate,
               case when event_id % 2 = 1 then cast(6.8 as decimal(12,4)) end as sensor_value,
               case when event_id % 2 = 1 then case when user_id % 3 = 0 then 'C' else 'mg/L' end end as sensor_unit,
               case when event_id % 2 = 1 then concat('S-', cast(user_id as string)) end as source_device,
               case when event_id % 6 <> 0 then concat('FR-ST-', cast(event_id as string)) end as record_no,
               case when event_id % 3 <> 0 then concat('SR-ST-', cast(event_id as string)) end as report_no,
               case when event_id % 2 = 1 then concat('RD-ST-', cast(event_id as string)) end as reading_no,
               'earlier' as import_id
        from stored_event""",
    "stored_record": """
        select concat('FR-ST-', cast(event_id as string)) as record_no, user_id as batch_id,
               case when event_id % 15 = 0 or event_id % 25 = 0 then 1 else 0 end as posted
        from stored_event where event_id % 6 <> 0""",
    "stored_report": """
        select concat('SR-ST-', cast(event_id as string)) as report_no, user_id as batch_id
        from stored_event where event_id % 3 <> 0""",
    # Migration events with gaps, broken links, clock and feed faults, and faulty snapshots.
    "move_hop": """
        select o_orderkey, o_custkey, o_orderdate, cast(o_totalprice as decimal(18,2)) as price,
               row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n,
               lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before_key
        from orders""",
    "migration_event": """
        select concat('MG-', cast(o_orderkey as string)) as migration_no,
               concat('CHAIN-FB-', cast(o_custkey as string)) as chain_no, o_custkey as batch_id,
               cast(case when o_custkey % 7 = 0 and n > 3 then n + 1 else n end as int) as seq_no,
               concat('CAGE-', cast((case when o_orderkey % 113 = 0 then o_orderkey + 1
                                          else coalesce(before_key, o_custkey) end) % 25 as string)) as source_cage_no,
               concat('CAGE-', cast(o_orderkey % 25 as string)) as target_cage_no,
               case when o_orderkey % 101 = 0 then o_orderdate - interval 400 day else o_orderdate end as occurred_at,
               case when o_orderkey % 127 <> 0 then
                 cast(sum(case when o_orderkey % 117 = 0 then -1 else 1 end * price)
                      over (partition by o_custkey order by o_orderdate, o_orderkey
                            rows between unbounded preceding and current row) as decimal(18,2)) end as cumulative_feed_kg,
               case when o_orderkey % 131 = 0 then '{"source": {"fishEsti'
                    when o_orderkey % 137 = 0 then concat('{"source": {"fishEstimateCount": ', cast(n as string), '}}')
                    else concat('{"migrationNo": "MG-', cast(o_orderkey as string),
                                '", "source": {"fishEstimateCount": ', cast(n as string),
                                ', "cumulativePostedFeedKg": 10.50, "movedSensors": [{"id": 1}], "feedingPlanCount": 2}',
                                ', "target": {"fishEstimateCount": ', cast(n + case when o_orderkey % 139 = 0 then 1 else 0 end as string),
                                ', "cumulativePostedFeedKg": ', case when o_orderkey % 149 = 0 then '10.51' else '10.5' end,
                                ', "movedSensors": [', case when o_orderkey % 151 = 0 then '' else '{"id": 1}' end,
                                '], "feedingPlanCount": 2}}') end as snapshot_json,
               o_orderkey
        from move_hop""",
    "migration_chain": """
        select concat('CHAIN-FB-', cast(c_custkey as string)) as chain_no, c_custkey as batch_id,
               case when c_custkey % 11 = 0 then 'CAGE-X' else coalesce(f.source_cage_no, 'CAGE-0') end as origin_cage_no,
               case when c_custkey % 13 = 0 then 'CAGE-X' else coalesce(l.target_cage_no, 'CAGE-0') end as current_cage_no,
               cast(coalesce(l.seq_no, 0) as int) as current_seq
        from customer
        left join (select * from (select chain_no, source_cage_no, row_number() over (partition by chain_no order by seq_no) as r
                   from migration_event) a where r = 1) f on f.chain_no = concat('CHAIN-FB-', cast(c_custkey as string))
        left join (select * from (select chain_no, target_cage_no, seq_no, row_number() over (partition by chain_no order by seq_no desc) as r
                   from migration_event) b where r = 1) l on l.chain_no = concat('CHAIN-FB-', cast(c_custkey as string))""",
    # Migration requests over the batches; cages from 25 on are empty.
    "move_request": """
        select c_custkey as request_id,
               case when c_custkey % 41 = 0 then 'MQ 1' when c_custkey % 43 = 0 then 'MQ-43'
                    else concat('MQ-', cast(c_custkey as string)) end as migration_no,
               case when c_custkey % 47 = 0 then c_custkey + 1000000 when c_custkey % 9 = 4 then c_custkey - 1
                    else c_custkey end as batch_id,
               concat(' CAGE-', cast(case when c_custkey % 8 = 0 then c_nationkey when c_custkey % 8 = 1 then c_custkey % 25
                                          else 25 + c_custkey % 40 end as string)) as target_cage_no,
               case when c_custkey % 5 = 0 then ' replace ' when c_custkey % 37 = 0 then 'SWAP' when c_custkey % 5 = 1 then ''
                    end as transfer_type,
               case when c_custkey % 31 = 0 then {TS} '2024-06-01 00:00:02'
                    else {TS} '2024-05-01 00:00:00' end as occurred_at,
               cast(7 as bigint) as operator_id, 'keeper' as operator_name,
               case when c_custkey % 10 = 3 then cast(0 as int) end as expected_batch_version,
               case when c_custkey % 12 = 5 then cast(1 as int) end as expected_chain_seq, cast(null as string) as remark
        from customer""",
    "move_chain": """
        select concat('CHAIN-FB-', cast(c_custkey as string)) as chain_no, c_custkey as batch_id, 'CAGE-0' as origin_cage_no,
               case when c_custkey % 22 = 0 then 'CAGE-X' else concat('CAGE-', cast(c_nationkey as string)) end as current_cage_no,
               cast(c_custkey % 4 as int) as current_seq
        from customer where c_custkey % 2 = 0""",
    "used_number": """
        select concat('MQ-', cast(c_custkey as string)) as migration_no from customer where c_custkey % 17 = 0""",
    # Order key and line number repeat in the sample: each row gets a line number of its own.
    "order_line": """
        select l_orderkey, l_linenumber + 7 * (row_number() over (
                   partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_shipdate) - 1)
                   as l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate
        from lineitem""",
    # Registration requests with every kind of fault in turn.
    "new_record": """
        select l_orderkey * 1000 + l_linenumber as request_id,
               case when l_orderkey % 50 = 0 then concat('FR-', cast(l_orderkey as string))
                    when l_orderkey % 60 = 1 then concat('NR-same-', cast(l_suppkey as string))
                    else concat('NR-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) end as record_no,
               cast(l_partkey as bigint) as batch_id,
               case when l_linenumber % 3 = 0 then cast(l_partkey as bigint) * 2
                    when l_linenumber % 7 = 2 then cast(l_partkey as bigint) * 2 + 2 end as plan_id,
               case when l_orderkey % 97 = 0 then ' ' else 'PELLET' end as feed_type,
               case when l_orderkey % 89 = 0 then cast(-1 as decimal(10,2)) else cast(l_quantity as decimal(10,2)) end as amount_kg,
               case when l_orderkey % 83 <> 0 then l_shipdate end as feeding_time
        from order_line""",
    "new_report": """
        select o_orderkey as request_id,
               case when o_orderkey % 50 = 0 then concat('SR-', cast(o_orderkey as string))
                    else concat('SN-', cast(o_orderkey - o_orderkey % 2 as string)) end as report_no,
               case when o_orderkey % 59 = 0 then o_custkey + 1000000 else o_custkey end as batch_id,
               cast(o_orderkey % 3000 as int) as alive_count,
               case when o_orderkey % 71 = 0 then cast(1.2 as decimal(7,4)) when o_orderkey % 4 = 0 then cast(0.9 as decimal(7,4))
                    end as survival_rate, o_orderdate as report_time
        from orders""",
    "new_reading": """
        select o_orderkey as request_id,
               case when o_orderkey % 40 = 0 then concat('RD-', cast(o_orderkey as string))
                    else concat('RN-', cast(o_orderkey as string)) end as reading_no,
               case when o_orderkey % 91 <> 0 then o_custkey % 200 end as sensor_id,
               case when o_orderkey % 83 = 0 then cast(-0.5 as decimal(12,4)) else cast(o_totalprice as decimal(12,4)) end as metric_value,
               o_orderdate as reading_time
        from orders""",
    "new_tide": """
        select o_orderkey as request_id,
               case when o_orderkey % 70 = 0 then 'T-5' else concat('TN-', cast(o_orderkey as string)) end as tide_no,
               concat('CAGE-', cast(o_custkey % 27 as string)) as cage_no,
               {TS} '2024-01-01 00:00:00' + interval 1 minute * cast(o_orderkey * 37 % 400000 as int) as start_at_utc,
               {TS} '2024-01-01 00:00:00' + interval 1 minute * cast(o_orderkey * 37 % 400000
                 + case when o_orderkey % 61 = 0 then 0 else 20 + o_orderkey % 100 end as int) as end_at_utc
        from orders""",
    "rule_version": """
        select cast(p_partkey as bigint) as rule_id, concat('R-', cast(p_partkey % 200 as string)) as rule_code,
               cast(1 + floor(p_partkey / 200) as int) as version_no,
               case when p_partkey % 7 <> 0 then {TS} '2023-01-01 00:00:00' + interval 1 day * cast(p_partkey * 13 % 700 as int) end as enabled_time,
               case when p_partkey % 5 = 0 then {TS} '2023-06-01 00:00:00' + interval 1 day * cast(p_partkey * 13 % 700 as int) end as retired_time,
               cast(p_partkey * 7 % 1440 as int) as start_minute, cast(1 + p_partkey * 11 % 1440 as int) as end_minute,
               case when p_partkey % 7 = 0 or p_partkey % 3 = 1 then 'DRAFT' when p_partkey % 5 = 0 then 'RETIRED'
                    else 'ENABLED' end as status
        from part""",
    # Short rules; one in forty is enabled, so that drafts meet some of them.
    "draft_rule": """
        select cast(p_partkey as bigint) as rule_id, concat('D-', cast(p_partkey % 150 as string)) as rule_code,
               cast(1 + floor(p_partkey / 150) as int) as version_no,
               cast(p_partkey * 37 % 1440 as int) as start_minute,
               cast(1 + (p_partkey * 37 + p_partkey % 5) % 1440 as int) as end_minute,
               case when p_partkey % 40 = 0 then 'ENABLED' when p_partkey % 9 = 1 then 'RETIRED' else 'DRAFT' end as status,
               cast(null as {TS}) as enabled_time, cast(null as {TS}) as retired_time
        from part""",
    # Requests to enable them: some drafts are asked for several times.
    "rule_wish": """
        select p_partkey as request_id,
               cast(case when p_partkey % 59 = 0 then -1 when p_partkey % 5 = 0 then 1 + p_partkey % 97
                         else p_partkey * 7 % 1999 + 1 end as bigint) as rule_id
        from part""",
    "new_rule": """
        select l_orderkey * 1000 + l_linenumber as request_id, concat('R-', cast(l_partkey % 300 as string)) as rule_code,
               case when l_orderkey % 31 = 0 then 'NIGHT' when l_linenumber % 2 = 0 then 'PEAK' else 'FLAT' end as rule_type,
               cast(l_orderkey % 1450 as int) as start_minute, cast(l_partkey % 1450 as int) as end_minute,
               cast(case when l_orderkey % 37 = 0 then -1 else l_linenumber end as decimal(12,4)) as coefficient
        from order_line""",
    # Status changes.
    "batch_event": """
        select o_orderkey as event_id, case when o_orderkey % 67 = 0 then o_custkey + 1000000 else o_custkey end as batch_id,
               o_orderdate as event_time,
               case when o_orderkey % 30 = 5 then 'CLOSED' when o_orderkey % 30 = 11 then 'LOST'
                    when o_orderkey % 12 = 4 then 'HARVESTED' when o_orderkey % 2 = 0 then 'MONITORING' else 'BREEDING' end as target_status
        from orders""",
    "plan_event": """
        select o_orderkey as event_id, case when o_orderkey % 73 = 0 then -1 else o_custkey * 2 + o_orderkey % 3 % 2 end as plan_id,
               o_orderdate as event_time,
               case when o_orderkey % 29 = 3 then 'GONE' when o_orderkey % 31 = 5 then 'FINISHED'
                    when o_orderkey % 2 = 0 then 'SUSPENDED' else 'ACTIVE' end as target_status
        from orders""",
    "sensor_event": """
        select event_id, case when event_id % 79 = 0 then -1 else user_id end as sensor_id, ts as event_time,
               case event_id % 5 when 0 then 'ONLINE' when 1 then 'OFFLINE' when 2 then 'MAINTENANCE' when 3 then 'ONLINE'
                    else 'BROKEN' end as target_status
        from events""",
    "acceptance": """
        select cast(10000000000 + harvest_id * 2 as bigint) as event_id, harvest_id, harvest_time as event_time from harvest_batch
        union all
        select cast(10000000001 + harvest_id * 2 as bigint), case when harvest_id % 5 = 0 then -1 else harvest_id end, harvest_time + interval 10 day
        from harvest_batch where harvest_id % 3 = 0""",
    "rule_event": """
        select l_orderkey * 1000 + l_linenumber as event_id,
               case when l_orderkey % 101 = 0 then -1 else cast(l_partkey as bigint) end as rule_id, l_shipdate as event_time,
               case when l_orderkey % 103 = 0 then 'PAUSE' when l_orderkey % 3 = 0 then 'RETIRE' else 'ENABLE' end as action
        from order_line""",
}

_ENGINES = {
    "spark": {
        "TS": "timestamp_ntz",
        "EXPLODE": "explode(sequence(0, {0}))",
        "LOCAL": "convert_timezone('UTC', {0}, {1})",
        "ISO": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")",
    },
    "duckdb": {
        "TS": "timestamp",
        "EXPLODE": "unnest(generate_series(0, {0}))",
        "LOCAL": "timezone({0}, timezone('UTC', {1}))",
        "ISO": "strftime({0}, '%Y-%m-%dT%H:%M:%S')",
    },
}


def render(text: str, engine: str) -> str:
    spell = _ENGINES[engine]

    def replace(match: re.Match) -> str:
        arguments = (match.group(2) or "").split(",")
        return spell[match.group(1)].format(*arguments)

    return re.sub(r"\{(TS|EXPLODE|LOCAL|ISO)(?::([^}]*))?\}", replace, text)


def _mentioned(text: str, names: list[str]) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", " ", text)))
    return [name for name in names if name in words]


def _needed(text: str, given: Mapping[str, object] = {}) -> list[str]:
    """Views the text uses, each after the views it is built on, of which ``given`` ones have none."""
    ordered: list[str] = []

    def visit(body: str) -> None:
        for name in _mentioned(body, list(VIEWS)):
            if name not in ordered:
                if name not in given:
                    visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(text)
    return ordered


def duckdb_sql(body: str) -> str:
    """``body`` with the views it uses in front, in DuckDB's spelling."""
    parts = [f"{name} as ({VIEWS[name]})" for name in _needed(body)]
    body = body.strip()
    recursive = "recursive " if body.lower().startswith("with recursive ") else ""
    if body.lower().startswith("with "):
        body = body[len("with recursive "):] if recursive else body[len("with "):]
        head = ", ".join([*parts, ""])
    else:
        head = ", ".join(parts) + " "
    return render(f"with {recursive}{head}{body}" if parts or recursive else body, "duckdb")


def view(spark: SparkSession, sf_dir: str, name: str, given: Mapping[str, DataFrame] = {}) -> DataFrame:
    """One domain view as a DataFrame over the parquet files; ``given`` holds rows of views that were worked out before."""
    body = f"select * from {name}"
    needed = _needed(body, given)
    built = [v for v in needed if v not in given]
    names = {v: f"given_{uuid.uuid4().hex}" for v in needed if v in given}
    tables = _mentioned(" ".join([body, *(VIEWS[v] for v in built)]), SAMPLE_TABLES)
    parts = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    parts += [f"{v} as (select * from {names[v]})" if v in given else f"{v} as ({VIEWS[v]})" for v in needed]
    for v, temporary in names.items():
        given[v].createOrReplaceTempView(temporary)
    try:
        return spark.sql(render(f"with {', '.join(parts)} {body}", "spark"))
    finally:
        for temporary in names.values():
            spark.catalog.dropTempView(temporary)


def views(spark: SparkSession, sf_dir: str, *names: str, given: Mapping[str, DataFrame] = {}) -> dict[str, DataFrame]:
    return {name: view(spark, sf_dir, name, given) for name in names}
