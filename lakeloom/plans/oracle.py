"""The models in DuckDB's SQL, for comparison, and the columns that queries return.

``COLUMNS`` names each model's result columns with a type letter: l long, d double (money and ratios), s string,
t date, z timestamp, b boolean.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.warehouse import ROLLUPS
from lakeloom.sources.company import COUNTRY_SQL, RAW, raw_sql

SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "t": "date", "z": "timestamp_ntz", "b": "boolean"}
DUCK_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "DATE", "z": "TIMESTAMP", "b": "BOOLEAN"}

COLUMNS = {
    "stg_customers": "customer_id:l first_name:s last_name:s email_raw:s email:s phone:s country:s referral_source:s signed_up_at:z _loaded_at:z",
    "stg_orders": "order_id:l customer_id:l ordered_at:z order_date:t status:s channel:s discount_code:s has_discount:b currency:s _loaded_at:z",
    "stg_order_items": "order_item_id:l order_id:l line_number:l product_id:l quantity:l unit_price:d line_amount:d _loaded_at:z",
    "stg_payments": "payment_id:l order_id:l payment_method:s payment_status:s amount:d paid_at:z _loaded_at:z is_late_arriving:b",
    "stg_products": "product_id:l product_name:s category:s unit_price:d unit_cost:d is_active:b created_at:z _loaded_at:z",
    "stg_web_sessions": "session_id:l customer_id:l started_at:z session_date:t device:s landing_page:s traffic_source:s campaign_id:l pageviews:l duration_seconds:l converted:b _loaded_at:z",
    "stg_support_tickets": "ticket_id:l customer_id:l order_id:l category:s priority:s ticket_status:s created_at:z resolved_at:z satisfaction_score:l _loaded_at:z",
    "stg_marketing_campaigns": "campaign_id:l campaign_name:s channel:s start_date:t end_date:t planned_days:l budget:d _loaded_at:z",
    "stg_marketing_spend": "spend_id:l campaign_id:l spend_date:t spend:d impressions:l clicks:l _loaded_at:z",
    "int_customer_id_map": "customer_id:l canonical_customer_id:l",
    "int_customers_deduplicated": "customer_id:l first_name:s last_name:s email:s phone:s country:s referral_source:s signed_up_at:z duplicate_accounts:l",
    "int_order_items_enriched": "order_item_id:l order_id:l ordered_at:z order_status:s line_number:l product_id:l product_name:s category:s quantity:l unit_price:d line_amount:d line_cost:d line_margin:d",
    "int_order_totals": "order_id:l item_lines:l units:l gross_amount:d cost_amount:d line_margin_amount:d",
    "int_orders_enriched": "order_id:l customer_id:l canonical_customer_id:l ordered_at:z order_date:t status:s channel:s discount_code:s has_discount:b item_lines:l units:l gross_amount:d cost_amount:d discount_amount:d country:s net_amount:d margin_amount:d",
    "int_payments_by_order": "order_id:l payment_count:l paid_amount:d refunded_amount:d first_paid_at:z last_paid_at:z has_late_payment:b",
    "int_order_payment_status": "order_id:l ordered_at:z order_date:t order_status:s channel:s gross_amount:d net_amount:d paid_amount:d refunded_amount:d payment_count:l has_late_payment:b payment_status:s",
    "int_customer_orders": "canonical_customer_id:l first_order_at:z last_order_at:z order_count:l lifetime_revenue:d",
    "int_customer_segments": "canonical_customer_id:l lifetime_revenue:d order_count:l value_segment:s is_lapsed:b",
    "int_sessions_enriched": "session_id:l customer_id:l canonical_customer_id:l started_at:z session_date:t device:s landing_page:s traffic_source:s campaign_id:l campaign_name:s campaign_channel:s pageviews:l duration_seconds:l converted:b is_known_visitor:b",
    "int_sessions_daily": "session_date:t device:s traffic_source:s sessions:l known_visitor_sessions:l engaged_sessions:l converted_sessions:l pageviews:l duration_seconds:l",
    "int_campaign_attribution": "order_id:l ordered_at:z net_amount:d touch_session_id:l campaign_id:l attributed_channel:s touch_at:z",
    "int_campaign_performance_daily": "campaign_id:l campaign_name:s channel:s activity_date:t spend:d impressions:l clicks:l sessions:l attributed_orders:l attributed_revenue:d",
    "int_product_sales_daily": "product_id:l category:s sale_date:t units:l revenue:d margin:d",
    "int_tickets_enriched": "ticket_id:l customer_id:l canonical_customer_id:l order_id:l order_channel:s category:s priority:s ticket_status:s created_at:z resolved_at:z satisfaction_score:l resolution_hours:d",
    "int_ticket_resolution": "ticket_id:l created_at:z category:s priority:s ticket_status:s order_channel:s resolution_hours:d satisfaction_score:l sla_hours:l breached_sla:b",
    "sales_fct_orders": "order_id:l customer_id:l ordered_at:z order_date:t status:s channel:s country:s discount_code:s has_discount:b item_lines:l units:l gross_amount:d discount_amount:d net_amount:d",
    "sales_fct_order_items": "order_item_id:l order_id:l ordered_at:z order_status:s product_id:l product_name:s category:s quantity:l unit_price:d line_amount:d line_margin:d",
    "sales_fct_daily_sales": "order_date:t orders:l customers:l net_revenue:d avg_order_value:d cancelled_orders:l",
    "sales_channel_performance": "order_month:t channel:s orders:l net_revenue:d avg_order_value:d discount_share:d return_rate:d",
    "sales_dim_customers": "customer_id:l first_name:s last_name:s email:s country:s country_name:s region:s referral_source:s signed_up_at:z duplicate_accounts:l first_order_at:z last_order_at:z order_count:l lifetime_revenue:d value_segment:s is_lapsed:b",
    "sales_customer_cohorts": "cohort_month:t months_since_signup:l active_customers:l",
    "marketing_dim_campaigns": "campaign_id:l campaign_name:s channel:s start_date:t end_date:t planned_days:l budget:d",
    "marketing_fct_attributed_orders": "order_id:l ordered_at:z net_amount:d campaign_id:l campaign_name:s attributed_channel:s touch_at:z hours_from_touch:l",
    "marketing_fct_daily_spend": "activity_date:t channel:s spend:d impressions:l clicks:l sessions:l attributed_orders:l attributed_revenue:d",
    "marketing_fct_campaign_performance": "campaign_id:l campaign_name:s channel:s start_date:t end_date:t budget:d spend:d impressions:l clicks:l sessions:l attributed_orders:l attributed_revenue:d return_on_ad_spend:d",
    "marketing_fct_sessions": "session_id:l started_at:z session_date:t device:s landing_page:s traffic_source:s campaign_id:l campaign_channel:s is_known_visitor:b pageviews:l duration_seconds:l converted:b",
    "marketing_acquisition_funnel": "month:t referral_source:s signups:l first_orders:l",
    "finance_fct_gross_margin": "order_id:l ordered_at:z order_date:t channel:s country:s net_amount:d cost_amount:d margin_amount:d margin_pct:d",
    "finance_fct_marketing_spend": "spend_month:t channel:s spend:d attributed_revenue:d",
    "finance_fct_payments_reconciliation": "order_id:l ordered_at:z order_date:t order_status:s channel:s gross_amount:d paid_amount:d refunded_amount:d payment_count:l has_late_payment:b payment_status:s outstanding_amount:d",
    "finance_fct_refunds": "order_id:l ordered_at:z order_date:t channel:s net_amount:d refunded_amount:d refund_missing:b",
    "finance_fct_revenue": "order_id:l recognized_at:z order_date:t status:s channel:s country:s gross_amount:d discount_amount:d recognized_revenue:d returned_revenue:d",
    "finance_fct_revenue_monthly": "revenue_month:t orders:l gross_revenue:d discounts:d recognized_revenue:d returned_revenue:d",
    "product_dim_products": "product_id:l product_name:s category:s unit_price:d unit_cost:d is_active:b first_sold_date:t last_sold_date:t lifetime_units:l lifetime_revenue:d",
    "product_fct_product_sales_daily": "product_id:l category:s sale_date:t units:l revenue:d margin:d",
    "product_fct_conversion_funnel": "activity_date:t device:s sessions:l known_visitor_sessions:l engaged_sessions:l converted_sessions:l conversion_rate:d",
    "product_fct_sessions_engagement": "session_date:t device:s sessions:l engaged_sessions:l converted_sessions:l pageviews:l avg_duration_seconds:d",
    "product_fct_support_tickets": "ticket_id:l created_at:z category:s priority:s ticket_status:s order_channel:s resolution_hours:d sla_hours:l breached_sla:b satisfaction_score:l",
    "product_fct_ticket_sla": "ticket_month:t category:s priority:s tickets:l resolved_tickets:l breached_tickets:l avg_resolution_hours:d avg_satisfaction:d",
    "finance_fct_revenue_v0": "order_id:l ordered_at:z channel:s revenue:d",
    "finance_rpt_payment_methods_2025": "payment_method:s payments:l amount:d",
    "finance_rpt_q3_close_reconciliation": "order_status:s payment_status:s orders:l gross_amount:d paid_amount:d",
    "marketing_fct_campaign_attribution_v1": "campaign_id:l first_touch_orders:l first_touch_revenue:d",
    "marketing_fct_email_campaign_roi": "campaign_id:l campaign_name:s spend:d clicks:l click_through_rate:d",
    "marketing_rpt_utm_sources_legacy": "session_date:t legacy_source_group:s sessions:l",
    "product_fct_sessions_v1": "session_id:l customer_id:l started_at:z device:s pageviews:l duration_seconds:l converted:b",
    "product_ml_features_churn_poc": "customer_id:l lifetime_revenue:d order_count:l is_lapsed:b support_tickets:l",
    "product_rpt_ticket_backlog_experiment": "category:s priority:s open_tickets:l",
    "sales_dim_customers_old_crm": "customer_id:l first_name:s last_name:s email:s country:s signed_up_at:z",
    "sales_fct_orders_backfill_2025q1": "order_id:l customer_id:l canonical_customer_id:l ordered_at:z order_date:t status:s channel:s discount_code:s has_discount:b item_lines:l units:l gross_amount:d cost_amount:d discount_amount:d country:s net_amount:d margin_amount:d",
    "sales_rpt_weekly_orders_legacy": "order_week:t orders:l net_revenue:d",
}


def mean(x: str) -> str:
    """Mean of cents, half away from zero, in whole numbers (no negative values occur here)."""
    return f"((2 * CAST(sum({x}) * 100 AS HUGEINT) + count({x})) // nullif(2 * count({x}), 0)) / 100.0"


def month(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS DATE)"


PAID, SIX = "status IN ('completed', 'shipped')", ("spend", "impressions", "clicks", "sessions", "attributed_orders", "attributed_revenue")

SQL = {
    "stg_customers": "SELECT * REPLACE (lower(trim(email, ' ')) AS email, ifnull(referral_source, 'unknown') AS referral_source), email AS email_raw FROM cur_customers",
    "stg_orders": "SELECT *, ordered_at::DATE AS order_date, discount_code IS NOT NULL AS has_discount FROM cur_orders",
    "stg_order_items": "SELECT *, quantity * unit_price AS line_amount FROM cur_order_items",
    "stg_payments": "SELECT * RENAME (status AS payment_status, created_at AS paid_at), _loaded_at - created_at > INTERVAL 24 HOURS AS is_late_arriving FROM cur_payments",
    "stg_products": "SELECT * FROM cur_products",
    "stg_web_sessions": "SELECT *, started_at::DATE AS session_date, ifnull(utm_source, 'direct') AS traffic_source FROM cur_web_sessions",
    "stg_support_tickets": "SELECT * RENAME (status AS ticket_status) FROM cur_support_tickets",
    "stg_marketing_campaigns": "SELECT *, end_date - start_date AS planned_days FROM cur_marketing_campaigns",
    "stg_marketing_spend": "SELECT * FROM cur_marketing_spend",
    "int_customer_id_map": "SELECT c.customer_id, f.id AS canonical_customer_id FROM stg_customers c JOIN (SELECT email, arg_min(customer_id, (signed_up_at, customer_id)) AS id FROM stg_customers GROUP BY ALL) f USING (email)",
    "int_customers_deduplicated": "SELECT c.*, n - 1 AS duplicate_accounts FROM stg_customers c JOIN (SELECT canonical_customer_id AS id, count(*) AS n FROM int_customer_id_map GROUP BY ALL) ON id = customer_id",
    "int_order_items_enriched": "SELECT i.*, o.ordered_at, o.status AS order_status, p.product_name, p.category, quantity * p.unit_cost AS line_cost, line_amount - quantity * p.unit_cost AS line_margin FROM stg_order_items i, stg_orders o, stg_products p WHERE i.order_id = o.order_id AND i.product_id = p.product_id",
    "int_order_totals": "SELECT order_id, count(*) AS item_lines, sum(quantity) AS units, sum(line_amount) AS gross_amount, sum(line_cost) AS cost_amount, sum(line_margin) AS line_margin_amount FROM int_order_items_enriched GROUP BY ALL",
    "int_orders_enriched": "SELECT *, gross_amount - discount_amount AS net_amount, gross_amount - discount_amount - cost_amount AS margin_amount FROM (SELECT o.*, m.canonical_customer_id, t.* EXCLUDE (order_id), CAST(CASE WHEN has_discount THEN round(gross_amount * 0.10::DECIMAL(4,2), 2) ELSE 0 END AS DECIMAL(18,2)) AS discount_amount, c.country FROM stg_orders o JOIN int_order_totals t ON t.order_id = o.order_id LEFT JOIN int_customer_id_map m ON m.customer_id = o.customer_id LEFT JOIN stg_customers c ON c.customer_id = m.canonical_customer_id)",
    "int_payments_by_order": "SELECT order_id, count(*) AS payment_count, sum(CASE payment_status WHEN 'succeeded' THEN amount END) AS paid_amount, sum(CASE payment_status WHEN 'refunded' THEN amount END) AS refunded_amount, min(paid_at) AS first_paid_at, max(paid_at) AS last_paid_at, bool_or(is_late_arriving) AS has_late_payment FROM stg_payments GROUP BY ALL",
    "int_order_payment_status": "SELECT o.order_id, ordered_at, order_date, status AS order_status, channel, gross_amount, net_amount, ifnull(paid_amount, 0) AS paid_amount, ifnull(refunded_amount, 0) AS refunded_amount, ifnull(payment_count, 0) AS payment_count, ifnull(has_late_payment, FALSE) AS has_late_payment, CASE WHEN status = 'pending' OR status = 'cancelled' THEN 'not_due' WHEN status = 'returned' AND p.refunded_amount IS NOT NULL THEN 'refunded' WHEN p.order_id IS NULL THEN 'missing' WHEN gross_amount - ifnull(p.paid_amount, 0) <= 0.01 THEN 'paid' ELSE 'underpaid' END AS payment_status FROM int_orders_enriched o LEFT JOIN int_payments_by_order p ON p.order_id = o.order_id",
    "int_customer_orders": f"SELECT canonical_customer_id, min(ordered_at) AS first_order_at, max(ordered_at) AS last_order_at, count(*) AS order_count, sum(CASE WHEN {PAID} THEN net_amount END) AS lifetime_revenue FROM int_orders_enriched WHERE status != 'cancelled' AND canonical_customer_id IS NOT NULL GROUP BY ALL",
    "int_customer_segments": "SELECT canonical_customer_id, order_count, ifnull(lifetime_revenue, 0) AS lifetime_revenue, CASE WHEN lifetime_revenue >= 2000 THEN 'vip' WHEN lifetime_revenue >= 500 THEN 'regular' ELSE 'occasional' END AS value_segment, last_order_at < (SELECT max(last_order_at) FROM int_customer_orders) - INTERVAL 90 DAYS AS is_lapsed FROM int_customer_orders",
    "int_sessions_enriched": "SELECT s.*, m.canonical_customer_id, c.campaign_name, c.channel AS campaign_channel, s.customer_id IS NOT NULL AS is_known_visitor FROM stg_web_sessions s LEFT JOIN int_customer_id_map m ON m.customer_id = s.customer_id LEFT JOIN stg_marketing_campaigns c ON c.campaign_id = s.campaign_id",
    "int_sessions_daily": "SELECT session_date, device, traffic_source, count(*) AS sessions, count_if(is_known_visitor) AS known_visitor_sessions, count_if(pageviews >= 3) AS engaged_sessions, count_if(converted) AS converted_sessions, sum(pageviews) AS pageviews, sum(duration_seconds) AS duration_seconds FROM int_sessions_enriched GROUP BY ALL",
    "touches": f"SELECT o.order_id, o.ordered_at, o.net_amount, s.session_id AS touch_session_id, s.campaign_id, s.campaign_channel AS attributed_channel, s.started_at AS touch_at FROM int_orders_enriched o JOIN int_sessions_enriched s ON s.canonical_customer_id = o.canonical_customer_id AND s.started_at <= o.ordered_at WHERE o.{PAID} AND s.campaign_id IS NOT NULL",
    "int_campaign_attribution": "SELECT * FROM touches WHERE ordered_at - INTERVAL 7 DAYS < touch_at QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY touch_at DESC, touch_session_id DESC) = 1",
    "int_campaign_performance_daily": f"SELECT d.campaign_id, c.campaign_name, c.channel, d.activity_date, {', '.join(f'ifnull(d.{m}, 0) AS {m}' for m in SIX)} FROM (SELECT * FROM (SELECT campaign_id, spend_date AS activity_date, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks FROM stg_marketing_spend GROUP BY ALL) FULL JOIN (SELECT campaign_id, session_date AS activity_date, count(*) AS sessions FROM int_sessions_enriched WHERE campaign_id IS NOT NULL GROUP BY ALL) USING (campaign_id, activity_date) FULL JOIN (SELECT campaign_id, ordered_at::DATE AS activity_date, count(*) AS attributed_orders, sum(net_amount) AS attributed_revenue FROM int_campaign_attribution GROUP BY ALL) USING (campaign_id, activity_date)) d JOIN stg_marketing_campaigns c ON c.campaign_id = d.campaign_id",
    "int_product_sales_daily": "SELECT product_id, category, ordered_at::DATE AS sale_date, sum(quantity) AS units, sum(line_amount) AS revenue, sum(line_margin) AS margin FROM int_order_items_enriched WHERE order_status IN ('completed', 'shipped') GROUP BY ALL",
    "int_tickets_enriched": "SELECT t.*, m.canonical_customer_id, o.channel AS order_channel, ((date_diff('minute', created_at, resolved_at) * 200 + 60) // 120) / 100.0 AS resolution_hours FROM stg_support_tickets t LEFT JOIN int_customer_id_map m ON m.customer_id = t.customer_id LEFT JOIN stg_orders o ON o.order_id = t.order_id",
    "int_ticket_resolution": "SELECT *, CASE WHEN resolution_hours IS NOT NULL THEN resolution_hours > sla_hours END AS breached_sla FROM (SELECT *, CASE WHEN priority = 'urgent' THEN 4 WHEN priority = 'high' THEN 24 WHEN priority = 'normal' THEN 72 ELSE 168 END AS sla_hours FROM int_tickets_enriched)",
    "sales_fct_orders": "SELECT * REPLACE (canonical_customer_id AS customer_id) FROM int_orders_enriched",
    "sales_fct_order_items": "SELECT * FROM int_order_items_enriched",
    "sales_fct_daily_sales": f"SELECT order_date, count(*) AS orders, count(DISTINCT customer_id) AS customers, sum(CASE WHEN {PAID} THEN net_amount END) AS net_revenue, {mean('net_amount')} AS avg_order_value, count_if(status = 'cancelled') AS cancelled_orders FROM sales_fct_orders GROUP BY ALL",
    "sales_channel_performance": f"SELECT {month('ordered_at')} AS order_month, channel, count(*) AS orders, sum(CASE WHEN {PAID} THEN net_amount END) AS net_revenue, {mean('net_amount')} AS avg_order_value, round(count_if(has_discount) / count(*), 4) AS discount_share, round(count_if(status = 'returned') / count(*), 4) AS return_rate FROM sales_fct_orders GROUP BY ALL",
    "sales_dim_customers": "SELECT c.*, cc.country_name, cc.region, o.first_order_at, o.last_order_at, ifnull(o.order_count, 0) AS order_count, ifnull(s.lifetime_revenue, 0) AS lifetime_revenue, ifnull(s.value_segment, 'prospect') AS value_segment, ifnull(s.is_lapsed, FALSE) AS is_lapsed FROM int_customers_deduplicated c LEFT JOIN int_customer_orders o ON o.canonical_customer_id = c.customer_id LEFT JOIN int_customer_segments s ON s.canonical_customer_id = c.customer_id LEFT JOIN country_codes cc ON cc.country = c.country",
    "sales_customer_cohorts": f"SELECT cohort_month, date_diff('month', cohort_month, order_month) AS months_since_signup, count(*) AS active_customers FROM (SELECT customer_id, {month('signed_up_at')} AS cohort_month FROM sales_dim_customers) JOIN (SELECT DISTINCT customer_id, {month('ordered_at')} AS order_month FROM sales_fct_orders WHERE status != 'cancelled') USING (customer_id) WHERE cohort_month <= order_month GROUP BY ALL",
    "marketing_dim_campaigns": "SELECT * FROM stg_marketing_campaigns",
    "marketing_fct_attributed_orders": "SELECT a.*, c.campaign_name, date_diff('hour', touch_at, ordered_at) AS hours_from_touch FROM int_campaign_attribution a JOIN marketing_dim_campaigns c ON c.campaign_id = a.campaign_id",
    "marketing_fct_daily_spend": f"SELECT activity_date, channel, {', '.join(f'sum({m}) AS {m}' for m in SIX)} FROM int_campaign_performance_daily GROUP BY ALL",
    "marketing_fct_campaign_performance": f"SELECT c.*, {', '.join(f'ifnull(t.{m}, 0) AS {m}' for m in SIX)}, CASE WHEN t.attributed_orders > 0 THEN round(t.attributed_revenue::DOUBLE / nullif(t.spend::DOUBLE, 0), 4) END AS return_on_ad_spend FROM marketing_dim_campaigns c LEFT JOIN (SELECT campaign_id, {', '.join(f'sum({m}) AS {m}' for m in SIX)} FROM int_campaign_performance_daily GROUP BY ALL) t ON t.campaign_id = c.campaign_id",
    "marketing_fct_sessions": "SELECT * FROM int_sessions_enriched",
    "marketing_acquisition_funnel": f"SELECT month, referral_source, sum(s) AS signups, sum(f) AS first_orders FROM (SELECT {month('signed_up_at')} AS month, referral_source, 1 AS s, 0 AS f FROM int_customers_deduplicated UNION ALL SELECT {month('first_order_at')}, c.referral_source, 0, 1 FROM int_customer_orders o JOIN int_customers_deduplicated c ON c.customer_id = o.canonical_customer_id) GROUP BY ALL",
    "finance_fct_gross_margin": f"SELECT *, round(margin_amount::DOUBLE / nullif(net_amount::DOUBLE, 0), 4) AS margin_pct FROM int_orders_enriched WHERE {PAID}",
    "finance_fct_marketing_spend": f"SELECT {month('activity_date')} AS spend_month, channel, sum(spend) AS spend, sum(attributed_revenue) AS attributed_revenue FROM int_campaign_performance_daily GROUP BY ALL",
    "finance_fct_payments_reconciliation": "SELECT *, CASE payment_status WHEN 'missing' THEN gross_amount - paid_amount WHEN 'underpaid' THEN gross_amount - paid_amount ELSE 0 END AS outstanding_amount FROM int_order_payment_status",
    "finance_fct_refunds": "SELECT *, payment_status = 'missing' AS refund_missing FROM int_order_payment_status WHERE order_status = 'returned'",
    "finance_fct_revenue": "SELECT * RENAME (ordered_at AS recognized_at), CASE status WHEN 'returned' THEN 0 ELSE net_amount END AS recognized_revenue, CASE status WHEN 'returned' THEN net_amount ELSE 0 END AS returned_revenue FROM int_orders_enriched WHERE status NOT IN ('pending', 'cancelled')",
    "finance_fct_revenue_monthly": f"SELECT {month('recognized_at')} AS revenue_month, count(*) AS orders, sum(gross_amount) AS gross_revenue, sum(discount_amount) AS discounts, sum(recognized_revenue) AS recognized_revenue, sum(returned_revenue) AS returned_revenue FROM finance_fct_revenue GROUP BY ALL",
    "product_dim_products": "SELECT p.*, s.first_sold_date, s.last_sold_date, ifnull(s.n, 0) AS lifetime_units, ifnull(s.r, 0) AS lifetime_revenue FROM stg_products p LEFT JOIN (SELECT product_id, min(sale_date) AS first_sold_date, max(sale_date) AS last_sold_date, sum(units) AS n, sum(revenue) AS r FROM int_product_sales_daily GROUP BY ALL) s ON s.product_id = p.product_id",
    "product_fct_product_sales_daily": "SELECT * FROM int_product_sales_daily",
    "product_fct_conversion_funnel": "SELECT session_date AS activity_date, device, count(*) AS sessions, count_if(is_known_visitor) AS known_visitor_sessions, count_if(pageviews >= 3) AS engaged_sessions, count_if(converted) AS converted_sessions, round(count_if(converted) / count(*), 4) AS conversion_rate FROM int_sessions_enriched GROUP BY ALL",
    "product_fct_sessions_engagement": "SELECT session_date, device, sum(x.sessions) AS sessions, sum(x.engaged_sessions) AS engaged_sessions, sum(x.converted_sessions) AS converted_sessions, sum(x.pageviews) AS pageviews, round(sum(x.duration_seconds)::DOUBLE / sum(x.sessions)::DOUBLE, 2) AS avg_duration_seconds FROM int_sessions_daily x GROUP BY ALL",
    "product_fct_support_tickets": "SELECT * FROM int_ticket_resolution",
    "product_fct_ticket_sla": f"SELECT {month('created_at')} AS ticket_month, category, priority, count(*) AS tickets, count(resolution_hours) AS resolved_tickets, count(*) FILTER (WHERE breached_sla) AS breached_tickets, {mean('resolution_hours::DECIMAL(12,2)')} AS avg_resolution_hours, {mean('satisfaction_score')} AS avg_satisfaction FROM product_fct_support_tickets GROUP BY ALL",
    "finance_fct_revenue_v0": "SELECT *, net_amount AS revenue FROM int_orders_enriched WHERE status NOT IN ('pending', 'cancelled')",
    "finance_rpt_payment_methods_2025": "SELECT payment_method, count(*) AS payments, sum(amount) AS amount FROM stg_payments GROUP BY ALL",
    "finance_rpt_q3_close_reconciliation": "SELECT order_status, payment_status, count(*) AS orders, sum(gross_amount) AS gross_amount, sum(paid_amount) AS paid_amount FROM int_order_payment_status WHERE year(ordered_at) = 1997 AND quarter(ordered_at) = 3 GROUP BY ALL",
    "marketing_fct_campaign_attribution_v1": "SELECT campaign_id, count(*) AS first_touch_orders, sum(net_amount) AS first_touch_revenue FROM (SELECT * FROM touches QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY touch_at, touch_session_id) = 1) GROUP BY ALL",
    "marketing_fct_email_campaign_roi": "SELECT s.campaign_id, c.campaign_name, sum(s.spend) AS spend, sum(s.clicks) AS clicks, round(sum(s.clicks)::DOUBLE / nullif(sum(s.impressions)::DOUBLE, 0), 4) AS click_through_rate FROM stg_marketing_spend s JOIN stg_marketing_campaigns c ON c.campaign_id = s.campaign_id AND c.channel = 'email' GROUP BY ALL",
    "marketing_rpt_utm_sources_legacy": "SELECT session_date, CASE traffic_source WHEN 'email' THEN 'crm' WHEN 'direct' THEN 'other' ELSE 'paid' END AS legacy_source_group, count(*) AS sessions FROM stg_web_sessions GROUP BY ALL",
    "product_fct_sessions_v1": "SELECT * FROM stg_web_sessions",
    "product_ml_features_churn_poc": "SELECT canonical_customer_id AS customer_id, lifetime_revenue, order_count, is_lapsed, (SELECT count(*) FROM int_tickets_enriched t WHERE t.canonical_customer_id = s.canonical_customer_id) AS support_tickets FROM int_customer_segments s",
    "product_rpt_ticket_backlog_experiment": "SELECT category, priority, count(*) AS open_tickets FROM stg_support_tickets WHERE ticket_status != 'closed' GROUP BY ALL",
    "sales_dim_customers_old_crm": "SELECT * REPLACE (email_raw AS email) FROM stg_customers",
    "sales_fct_orders_backfill_2025q1": "SELECT * FROM int_orders_enriched WHERE year(ordered_at) = 1997 AND quarter(ordered_at) = 1",
    "sales_rpt_weekly_orders_legacy": "SELECT CAST(date_trunc('week', ordered_at) AS DATE) AS order_week, count(*) AS orders, sum(net_amount) AS net_revenue FROM int_orders_enriched WHERE status != 'cancelled' GROUP BY ALL",
    "country_codes": COUNTRY_SQL,
}

for _name, (_key, _) in RAW.items():
    SQL[f"raw_{_name}"] = raw_sql(_name)
    SQL[f"cur_{_name}"] = f"SELECT * FROM raw_{_name} QUALIFY row_number() OVER (PARTITION BY {_key} ORDER BY _loaded_at DESC, _seq DESC) = 1"

for _family, (_source, _time, _dimensions, _grains, _measures) in ROLLUPS.items():
    _make = {"count": lambda c: "count(*)", "distinct": lambda c: f"count(DISTINCT {c})", "sum": lambda c: f"sum(x.{c})", "count_if": lambda c: f"count(*) FILTER (WHERE {c})"}
    for _grain in _grains:
        for _d in _dimensions:
            _list = ", ".join(f"{mean(f'{c}::DECIMAL(18,2)') if how == 'mean' else _make[how](c)} AS {n}" for n, how, c in _measures)
            _unit = {"daily": "day", "weekly": "week", "monthly": "month"}[_grain]
            SQL[f"{_family}_{_grain}_by_{_d}"] = f"SELECT CAST(date_trunc('{_unit}', {_time}) AS DATE) AS period_start, {_d}, {_list} FROM {_source} x GROUP BY ALL"
            _money = {"net_revenue", "avg_order_value", "revenue", "margin", "attributed_revenue", "spend", "recognized_revenue", "returned_revenue", "cost", "refunded_amount", "avg_resolution_hours"}
            COLUMNS[f"{_family}_{_grain}_by_{_d}"] = f"period_start:t {_d}:s " + " ".join(f"{n}:{'d' if n in _money else 'l'}" for n, _, _ in _measures)


def columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """The named columns with comparable types (decimals as doubles)."""
    return df.select(*[F.col(c).cast(SPARK_TYPES[t]).alias(c) for c, t in columns(spec)])


def statement(body: str, spec: str) -> str:
    """A query over models as one SQL statement: the models it needs come first, each once."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if name in SQL and name not in needed:
                visit(SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    out = ", ".join(f"CAST({c} AS {DUCK_TYPES[t]}) AS {c}" for c, t in columns(spec))
    return f"WITH {parts + ', ' if parts else ''}_result AS ({body}) SELECT {out} FROM _result"


def plain(body: str, spec: str) -> str:
    """A query over test tables, with comparable types."""
    return f"SELECT {', '.join(f'CAST({c} AS {DUCK_TYPES[t]}) AS {c}' for c, t in columns(spec))} FROM ({body}) _result"
