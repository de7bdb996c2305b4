"""Named result queries over the results of the operators they belong to: what a dashboard shows of the given tables."""

from __future__ import annotations

from lakeloom.plans import metadata, operations, platform, results
from lakeloom.plans.toolkit import TOOLS, tool

assert platform.NODES and operations.HEALTH and metadata.MODEL  # the operators' queries are in TOOLS

#: result query: (its table, the operator's query that fills it, the table's columns from that one's, its result columns)
ASKED = {
    "showback": ("cost_showback", "cost_showback", "month, team, model, cost_kind, actor_type, usd", "month:s team:s model:s cost_kind:s actor_type:s usd:d"),
    "business_case": ("cost_business_case", "cost_business_case", "month, days, legacy_days, legacy_usd, new_usd, overlap_usd AS reconcile_usd", "month:s days:l legacy_days:l legacy_usd:d new_usd:d reconcile_usd:d"),
    "cost_months": ("cost_months", "month_pools", "month, days, usd AS compute_usd, usd AS storage_usd, usd AS stated_usd, usd AS shared_usd", "month:s days:l compute_usd:d storage_usd:d stated_usd:d shared_usd:d"),
    "quotas": ("cost_quotas", "usage_quotas", "user AS user_name, 'core' AS team, active_days, p95_daily AS p95_daily_bytes, max_query AS max_query_bytes, daily_quota AS daily_quota_bytes, query_limit AS query_limit_bytes, active_days AS statements", "user_name:s team:s active_days:l p95_daily_bytes:l max_query_bytes:l daily_quota_bytes:l query_limit_bytes:l statements:l"),
    "hotspots": ("cost_hotspots", "scan_hotspots", "table_name, filter_column AS column_name, reads, reads AS table_rows, rows AS rows_scanned, bytes AS bytes_scanned, 'ts' AS sorting_key, suggestion", "table_name:s column_name:s reads:l table_rows:l rows_scanned:l bytes_scanned:l sorting_key:s suggestion:s"),
    "incident_metrics": ("incident_metrics", "incident_metrics", "metric, dimension, value", "metric:s dimension:s value:d"),
    "grades": ("reconcile_grades", "grade_planted", "1 AS night, expected, detected, true_positives, correctly_classified", "night:l expected:l detected:l true_positives:l correctly_classified:l"),
    "incident_nights": ("incident_invocations", "incident_runs", "run_id, run_id AS detected_at, checks_run", "run_id:l detected_at:l invocations:l checks_run:l"),
    "owners_by_team": ("node_ownership", "registry_resolve", "team, CASE WHEN ambiguous THEN 'standard' ELSE 'critical' END AS tier", "team:s datasets:l critical:l"),
    "incident_checks": ("incident_check_events", "artifact_failures", "check_type, subject AS incident_id", "check_type:s failing_checks:l incidents:l"),
}

#: The same results in DuckDB's SQL, of the table {t}.
SHOWN = {
    "incident_nights": "SELECT run_id, min(detected_at) AS detected_at, count(*) AS invocations, sum(checks_run) AS checks_run FROM {t} GROUP BY ALL",
    "owners_by_team": "SELECT team, count(*) AS datasets, count(*) FILTER (WHERE tier = 'critical') AS critical FROM {t} GROUP BY ALL",
    "incident_checks": "SELECT check_type, count(*) AS failing_checks, count(DISTINCT incident_id) AS incidents FROM {t} GROUP BY ALL",
}


def _add(name: str, table: str, operator: str, columns: str, spec: str) -> None:
    plan, _, sql = TOOLS[operator]
    each = [c.strip() for c in columns.split(", ")]
    shown = SHOWN.get(name, "SELECT * FROM {t}").format(t=f"(SELECT {columns} FROM ({sql}))")

    def ask(t):
        return results.ask(name, {table: plan(t).selectExpr(*each)})

    ask.__name__ = f"result_{name}"
    tool(spec, shown)(ask)


for _name, _of in ASKED.items():
    _add(_name, *_of)
