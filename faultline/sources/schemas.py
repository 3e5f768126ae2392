"""Table schemas. Nothing is inferred at read time."""

from __future__ import annotations

RUN = (
    "regression_run_id BIGINT, project_ref INT, regression_ref INT, regression_status STRING,"
    " changelist BIGINT, iteration INT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ,"
    " username STRING, client STRING, log_directory STRING"
)
TEST_OBJECT_RUN = (
    "test_object_run_id BIGINT, regression_run_ref BIGINT, test_object_ref BIGINT,"
    " test_status_ref STRING, arch_ref STRING, conf_ref STRING, test_group_ref STRING,"
    " start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, cpu_time DOUBLE, sim_time DOUBLE,"
    " num_error INT, num_warning INT, host STRING, random_seed BIGINT,"
    " failed_job_run_ref BIGINT, mem_usage DOUBLE, lsf_req_mb INT"
)
JOB_RUN = (
    "job_run_id BIGINT, regression_run_id BIGINT, job_run_name STRING, status STRING,"
    " host STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, cpu_time DOUBLE,"
    " num_warning INT, num_error INT"
)
JOB_CMD = (
    "job_cmd_id BIGINT, regression_run_ref BIGINT, job_run_ref BIGINT, cmd STRING,"
    " log_file STRING, exit_code INT,"
    " start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, host STRING"
)
LOG_LINES = "log_file STRING, line_no INT, line STRING"
ISSUE = (
    "issue_key STRING, project STRING, summary STRING, description STRING, status STRING,"
    " resolution STRING, priority STRING, created STRING, updated STRING, assignee STRING,"
    " reporter STRING, labels ARRAY<STRING>, components ARRAY<STRING>,"
    " fix_versions ARRAY<STRING>"
)
COMMENT = (
    "issue_key STRING, seq BIGINT, author STRING, body STRING, created STRING, updated STRING"
)
ISSUE_LINK = (
    "src_key STRING, dst_key STRING, direction STRING, outward STRING, inward STRING"
)
