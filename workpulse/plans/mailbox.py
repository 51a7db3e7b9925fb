"""Messages, rejected rows, sync runs and accounts over the driver's tables; the same SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .facts import table

_MESSAGE = "concat('m', cast(event_id - event_id % 3 AS varchar(20)))"
MAIL_SQL = f"""
SELECT event_id % 5 + 1 AS owner_user_id, concat('RPT-', cast(event_id AS varchar(20))) AS report_id,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE {_MESSAGE} END AS message_id, concat('doc-', cast(event_id AS varchar(20))) AS document_id,
       CASE WHEN event_id % 4 = 0 THEN 'paste' WHEN event_id % 4 = 1 THEN 'attachment' WHEN event_id % 31 = 2 THEN NULL ELSE 'email' END AS source,
       CASE WHEN event_id % 37 = 0 THEN NULL ELSE concat('Report on ', event_type) END AS subject,
       concat('u', cast(user_id AS varchar(20)), '@example.com') AS sender,
       CASE WHEN user_id % 6 = 0 THEN NULL ELSE concat('NATION_', cast(user_id % 25 AS varchar(20))) END AS department,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS received_at, ts AS processed_at,
       CASE WHEN event_id % 3 = 0 THEN 'NO_DATA' ELSE 'PROCESSED' END AS processing_status,
       CASE WHEN event_id % 7 = 0 THEN 'REVIEW_REQUIRED' WHEN event_id % 7 = 1 THEN 'UNSUPPORTED_FORMAT' WHEN event_id % 7 = 2 THEN 'NON_REPORT'
            WHEN event_id % 7 = 3 THEN NULL WHEN event_id % 7 = 4 THEN 'POSSIBLE_REPORT' ELSE 'DEPARTMENTAL_REPORT' END AS classification,
       CASE WHEN event_id % 11 = 0 THEN 'A report was detected in the picture' WHEN event_id % 11 = 1 THEN NULL ELSE 'no table' END AS evidence,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE cast(event_id % 3 AS int) END AS tables_found, cast(event_id % 23 AS int) AS rows_extracted,
       CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 0 ELSE cast(event_id % 21 AS int) END AS rows_inserted,
       cast(event_id % 4 AS int) AS rows_skipped, cast(event_id % 5 AS int) AS rows_rejected, cast(event_id % 9 AS int) AS detector_version
FROM events
"""
REJECTIONS_SQL = f"""
SELECT event_id % 5 + 1 AS owner_user_id, event_id AS rejection_id, concat('doc-', cast(event_id AS varchar(20))) AS document_id,
       CASE WHEN event_id % 2 = 0 THEN concat('GM-', {_MESSAGE}) WHEN event_id % 5 = 0 THEN NULL ELSE concat('RPT-', cast(event_id AS varchar(20))) END AS report_id,
       CASE WHEN event_id % 8 = 0 THEN 'IMAGE_REVIEW_REQUIRED' WHEN event_id % 8 = 1 THEN 'INVALID_DATE' WHEN event_id % 8 = 2 THEN 'ATTACHMENT_NOT_A_REPORT' ELSE 'UNKNOWN_STATUS' END AS rejection_reason,
       concat('Unrecognised status "', event_type, '" in a row') AS rejection_detail, ts AS logged_at, CASE WHEN event_id % 3 = 0 THEN 'Closed' ELSE 'Open' END AS resolution_status
FROM events WHERE event_type <> 'click'
"""
RUNS_SQL = """
SELECT event_id AS run_id, event_id % 5 + 1 AS owner_user_id, user_id % 40 AS account_id, ts AS started_at,
       CASE WHEN event_id % 6 = 0 THEN 'FAILED' WHEN event_id % 6 = 1 THEN 'REAUTH_REQUIRED' ELSE 'OK' END AS status, cast(event_id % 60 AS int) AS messages_scanned,
       cast(event_id % 12 AS int) AS reports_found, CASE WHEN event_id % 6 = 0 THEN concat('timeout; ', event_type, '; timeout') END AS error_message
FROM events
"""
ACCOUNTS_SQL = """
SELECT c_custkey % 40 AS account_id, c_custkey % 5 + 1 AS owner_user_id, c_name AS address, c_acctbal > 0 AS active,
       CASE WHEN c_custkey % 4 = 0 THEN 'REAUTH_REQUIRED' ELSE 'OK' END AS last_sync_status FROM customer WHERE c_custkey <= 36
"""


def _over(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, MAIL_SQL, "events")


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, REJECTIONS_SQL, "events")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, RUNS_SQL, "events")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, ACCOUNTS_SQL, "customer")


def with_mail(sql: str) -> str:
    return f"WITH mail AS ({MAIL_SQL}), rejections AS ({REJECTIONS_SQL}), runs AS ({RUNS_SQL}), accounts AS ({ACCOUNTS_SQL}) {sql}"
