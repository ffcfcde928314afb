"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
DATE, TIME = T.DateType(), T.TimestampNTZType()


def dec(precision: int, scale: int) -> T.DecimalType:
    return T.DecimalType(precision, scale)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


FISH_BATCH = _table(
    batch_id=LONG, batch_no=TEXT, cage_no=TEXT, species=TEXT, fingerling_count=INT,
    average_weight_g=dec(10, 2), status=TEXT, stocking_time=TIME, version=INT,
    migrated_at=TIME, migration_no=TEXT,
)
FEEDING_PLAN = _table(
    plan_id=LONG, plan_no=TEXT, batch_id=LONG, cage_no=TEXT, feed_type=TEXT,
    daily_amount_kg=dec(10, 2), feed_frequency=INT, start_date=DATE, end_date=DATE,
    status=TEXT, version=INT,
)
SENSOR = _table(
    sensor_id=LONG, sensor_no=TEXT, cage_no=TEXT, sensor_type=TEXT, metric_unit=TEXT,
    depth_m=dec(6, 2), install_time=TIME, status=TEXT, version=INT,
)
SENSOR_READING = _table(
    reading_id=LONG, reading_no=TEXT, sensor_id=LONG, cage_no=TEXT,
    metric_value=dec(12, 4), reading_time=TIME, migration_no=TEXT,
)
FEEDING_RECORD = _table(
    record_id=LONG, record_no=TEXT, batch_id=LONG, plan_id=LONG, cage_no=TEXT, feed_type=TEXT,
    amount_kg=dec(10, 2), feeding_time=TIME, posted=INT, posted_time=TIME, migration_no=TEXT,
)
SURVIVAL_REPORT = _table(
    report_id=LONG, report_no=TEXT, batch_id=LONG, cage_no=TEXT, alive_count=INT,
    survival_rate=dec(7, 4), report_time=TIME,
)
HARVEST_BATCH = _table(
    harvest_id=LONG, harvest_no=TEXT, batch_id=LONG, cage_no=TEXT, harvest_count=INT,
    total_weight_kg=dec(12, 2), harvest_time=TIME, status=TEXT, accepted_time=TIME,
)
# Links to the three derived records are by business number, so they need no identity column.
CAGE_OBSERVATION = _table(
    voyage_no=TEXT, cage_no=TEXT, observed_at=TIME, feed_amount_kg=dec(10, 2),
    survival_rate=dec(7, 4), sensor_value=dec(12, 4), sensor_unit=TEXT, source_device=TEXT,
    record_no=TEXT, report_no=TEXT, reading_no=TEXT, import_id=TEXT,
)
CAGE_SEA_AREA = _table(cage_no=TEXT, sea_area=TEXT, time_zone=TEXT)
TS_RULE = _table(
    rule_id=LONG, rule_code=TEXT, version_no=INT, rule_type=TEXT, start_minute=INT,
    end_minute=INT, coefficient=dec(12, 4), status=TEXT, enabled_time=TIME, retired_time=TIME,
)
TIDE_SESSION = _table(
    tide_id=LONG, tide_no=TEXT, cage_no=TEXT, sea_area=TEXT, time_zone=TEXT,
    start_at_utc=TIME, end_at_utc=TIME, business_date=DATE,
)
FEED_OBSERVATION = _table(
    obs_id=LONG, obs_no=TEXT, cage_no=TEXT, batch_id=LONG, observed_at_utc=TIME,
    feed_amount_kg=dec(10, 3),
)
MIGRATION_CHAIN = _table(
    chain_no=TEXT, batch_id=LONG, origin_cage_no=TEXT, current_cage_no=TEXT, current_seq=INT,
)
MIGRATION_EVENT = _table(
    migration_no=TEXT, chain_no=TEXT, batch_id=LONG, seq_no=INT, transfer_type=TEXT,
    source_cage_no=TEXT, target_cage_no=TEXT, occurred_at=TIME, operator_id=LONG,
    operator_name=TEXT, fish_estimate_count=INT, cumulative_feed_kg=dec(18, 2),
    latest_survival_rate=dec(7, 4), feeding_plan_count=INT, feeding_record_count=INT,
    sensor_count=INT, batch_version=INT, snapshot_json=TEXT, remark=TEXT,
)
IMPORT_FILE = _table(
    checksum=TEXT, file_path=TEXT, status=TEXT, total_rows=LONG, success_count=LONG,
    updated_count=LONG, skipped_count=LONG, failed_count=LONG, error_message=TEXT,
)

TABLES = {
    "fish_batch": FISH_BATCH,
    "feeding_plan": FEEDING_PLAN,
    "sensor": SENSOR,
    "sensor_reading": SENSOR_READING,
    "feeding_record": FEEDING_RECORD,
    "survival_report": SURVIVAL_REPORT,
    "harvest_batch": HARVEST_BATCH,
    "cage_observation": CAGE_OBSERVATION,
    "cage_sea_area": CAGE_SEA_AREA,
    "ts_rule": TS_RULE,
    "tide_session": TIDE_SESSION,
    "feed_observation": FEED_OBSERVATION,
    "migration_chain": MIGRATION_CHAIN,
    "migration_event": MIGRATION_EVENT,
    "import_file": IMPORT_FILE,
}

RULE_SNAPSHOT = T.ArrayType(_table(
    ruleId=LONG, ruleCode=TEXT, versionNo=INT, ruleType=TEXT, startMinute=INT, endMinute=INT,
    coefficient=dec(12, 4),
))
_PLAN_REF = _table(id=LONG, planNo=TEXT, status=TEXT, dailyAmountKg=dec(10, 2), version=INT)
_SENSOR_REF = _table(
    id=LONG, sensorNo=TEXT, sensorType=TEXT, metricUnit=TEXT, status=TEXT,
    latestValue=dec(12, 4), latestReadingAt=TEXT, readingCount=LONG, moved=T.BooleanType(),
    version=INT,
)
_SIDE = _table(
    cageNo=TEXT, fishEstimateCount=INT, cumulativePostedFeedKg=dec(18, 2),
    cumulativeUnpostedFeedKg=dec(18, 2), feedingRecordCount=LONG, postedRecordCount=LONG,
    latestSurvivalRate=dec(7, 4), latestSurvivalAt=TEXT, feedingPlanCount=LONG,
    feedingPlans=T.ArrayType(_PLAN_REF), movedSensors=T.ArrayType(_SENSOR_REF),
    retainedSensors=T.ArrayType(_SENSOR_REF), movedSensorCount=LONG, retainedSensorCount=LONG,
)
HANDOFF_SNAPSHOT = _table(
    migrationNo=TEXT, chainNo=TEXT, seqNo=INT, transferType=TEXT, batchId=LONG, batchNo=TEXT,
    occurredAt=TEXT, fishEstimateBasis=TEXT, source=_SIDE, target=_SIDE,
)
