"""Who pays: shares of pools, attribution of queries to teams, viewer splits, showback, and advice drawn from the log.

The query log (``records``) has query_id, actor, actor_type, node_id, started_at, tables (array), rows_scanned,
bytes_scanned, query_kind. ``nodes`` has unique_id, resource_type, relation, name, attached_node; ``owners`` unique_id,
team, owner; ``members`` person, team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.cost import CONSUMERS, share

NOBODY, PLATFORM = "unattributed", "platform"


def month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def compute_shares(records: DataFrame, pools: DataFrame) -> DataFrame:
    """query_id, month, usd: each query's share of its month's pool (month, usd) by the bytes it read."""
    rows = records.select("query_id", month("started_at").alias("month"), F.coalesce("bytes_scanned", F.lit(0)).alias("_w"))
    rows = rows.join(pools.select("month", F.col("usd").alias("_total")), "month")
    return share(rows, "_total", "_w", ["month"], "query_id").select("query_id", "month", "usd")


def storage_shares(sizes: DataFrame, pools: DataFrame) -> DataFrame:
    """month, table_name, usd: each table's share of its month's storage pool by uncompressed bytes."""
    rows = sizes.join(pools.select("month", F.col("usd").alias("_total")), "month")
    return share(rows, "_total", "bytes", ["month"], "table_name").select("month", "table_name", "usd")


def estimated(records: DataFrame, overhead_ms: int = 50, bytes_per_second: int = 200_000_000) -> DataFrame:
    """query_id, modeled_ms, table_bytes: a query's modelled time, and its bytes dealt out evenly over its tables, the
    first taking what is left over; a query without tables has one share."""
    read, n = F.coalesce(F.col("bytes_scanned"), F.lit(0)).cast("long"), F.greatest(F.size(F.coalesce("tables", F.array())), F.lit(1))
    first = F.expr("_read DIV _n + _read % _n")
    rows = records.select("query_id", read.alias("_read"), n.cast("long").alias("_n"))
    rest = F.array_repeat(F.expr("_read DIV _n"), F.col("_n").cast("int") - 1)
    return rows.select("query_id", F.expr(f"{overhead_ms} + (_read * 1000) DIV {bytes_per_second}").alias("modeled_ms"), F.concat(F.array(first), rest).alias("table_bytes"))


def attribute(records: DataFrame, nodes: DataFrame, owners: DataFrame, members: DataFrame, lead: str) -> DataFrame:
    """query_id, cost_kind, team, owner, subject of every query: a build's cost goes to the owner of its model (a test's
    to the model it checks, one of no model to the platform), a load's to the source's owner, reconciliation to the
    platform as migration, a dashboard's to its owner, all else to the team of the person who asked."""
    tests = nodes.where("resource_type = 'test'").select(F.col("unique_id").alias("node_id"), F.lit(True).alias("_test"), "attached_node")
    kind = F.col("actor_type")
    rows = records.select("query_id", "actor", "actor_type", "node_id").join(tests, "node_id", "left")
    built = F.when(F.col("_test"), F.col("attached_node")).otherwise(F.col("node_id"))
    known = kind.isin("dbt", "ingestion", "maintenance", "reconcile", "dashboard")
    rows = rows.withColumn("subject", F.when(kind == "dbt", built).when(known, F.col("node_id")))
    rows = rows.join(owners.select(F.col("unique_id").alias("subject"), F.col("team").alias("_team"), F.col("owner").alias("_owner")), "subject", "left")
    rows = rows.join(members.select(F.col("person").alias("actor"), F.col("team").alias("_home")), "actor", "left")
    platform = (kind == "reconcile") | ((kind == "dbt") & F.col("subject").isNull())
    team = F.when(platform, F.lit(PLATFORM)).when(known, F.coalesce("_team", F.lit(NOBODY))).otherwise(F.coalesce("_home", F.lit(NOBODY)))
    owner = F.when(platform, F.lit(lead)).when(known, F.coalesce("_owner", F.lit(NOBODY))).otherwise(F.col("actor"))
    cost = F.when(kind == "reconcile", "migration").when(kind.isin("dbt", "ingestion", "maintenance"), "production").otherwise("consumption")
    return rows.select("query_id", cost.alias("cost_kind"), team.alias("team"), owner.alias("owner"), "subject")


def viewer_weights(records: DataFrame, views: DataFrame, members: DataFrame) -> DataFrame:
    """query_id, team, views: the teams that opened a refreshed dashboard in the refresh's month. ``views`` has
    viewed_at, exposure, person; people of no team count for nobody."""
    seen = views.join(members, "person").groupBy(F.col("exposure").alias("node_id"), month("viewed_at").alias("month"), "team").agg(F.count(F.lit(1)).alias("views"))
    mine = records.where("actor_type = 'dashboard'").select("query_id", "node_id", month("started_at").alias("month"))
    return mine.join(seen, ["node_id", "month"]).select("query_id", "team", "views")


def paid_by(costs: DataFrame, weights: DataFrame, attributions: DataFrame) -> DataFrame:
    """query_id, model, team, usd: a query's cost (query_id, model, usd), cut at 12 digits among its viewers' teams and
    the rest to the one with most views; without viewers its team pays it all."""
    rows = costs.withColumnRenamed("usd", "_usd").join(weights, "query_id")
    split = share(rows, "_usd", "views", ["query_id", "model"], "team", down=True).select("query_id", "model", "team", "usd")
    alone = costs.join(weights.select("query_id").distinct(), "query_id", "left_anti").join(attributions.select("query_id", "team"), "query_id")
    return split.unionAll(alone.select("query_id", "model", "team", F.col("usd").cast("decimal(30,12)")))


def showback(costs: DataFrame, records: DataFrame, attributions: DataFrame, weights: DataFrame, storage: DataFrame) -> DataFrame:
    """month, team, model, cost_kind, actor_type, usd: all that was paid, with storage (month, team, usd) as rows of its
    own."""
    rows = paid_by(costs, weights, attributions).join(records.select("query_id", "actor_type", month("started_at").alias("month")), "query_id")
    rows = rows.join(attributions.select("query_id", "cost_kind"), "query_id")
    keys = ["month", "team", "model", "cost_kind", "actor_type"]
    cube = rows.groupBy(*keys).agg(F.sum("usd").alias("usd"))
    stored = storage.groupBy("month", "team").agg(F.sum("usd").alias("usd"))
    return cube.unionByName(stored.select("month", "team", F.lit("cluster").alias("model"), F.lit("storage").alias("cost_kind"), F.lit("storage").alias("actor_type"), "usd"))


def dashboards(records: DataFrame, views: DataFrame, members: DataFrame, attributions: DataFrame, paid: DataFrame) -> DataFrame:
    """node_id, refreshes, views, usd, owner_share: what a dashboard cost, how often it was opened, and how much of the
    cost stays with the team that owns it."""
    mine = records.where("actor_type = 'dashboard'").select("query_id", "node_id")
    own = attributions.select("query_id", F.col("team").alias("_own"))
    cost = paid.join(mine, "query_id").join(own, "query_id").groupBy("node_id").agg(
        F.countDistinct("query_id").alias("refreshes"), F.sum("usd").alias("usd"), F.sum(F.when(F.col("team") == F.col("_own"), F.col("usd")).otherwise(F.lit(0))).alias("_kept")
    )
    seen = views.join(members, "person").groupBy(F.col("exposure").alias("node_id")).agg(F.count(F.lit(1)).alias("views"))
    part = F.round(F.col("_kept").cast("double") / F.nullif(F.col("usd").cast("double"), F.lit(0.0)), 4)
    return cost.join(seen, "node_id", "left").select("node_id", "refreshes", F.coalesce("views", F.lit(0)).alias("views"), "usd", part.alias("owner_share"))


def business_case(days: DataFrame, cutover: Column, old_monthly: float, new_monthly: float) -> DataFrame:
    """month, days, legacy_days, legacy_usd, new_usd, overlap_usd of a window of days (``day``): the old system is paid
    until the cutover day, that day included (always, if it is null); what the new one cost on those days is overlap."""
    length = F.dayofmonth(F.last_day("day"))
    rows = days.select("day", month("day").alias("month"), length.alias("_length"), F.coalesce(F.col("day") <= cutover, F.lit(True)).alias("_both"))
    rows = rows.groupBy("month", "_length").agg(F.count(F.lit(1)).alias("days"), F.count_if("_both").alias("legacy_days"))
    part = lambda usd, n: F.lit(usd).cast("decimal(20,6)") * F.col(n) / F.col("_length")
    rows = rows.withColumns({"legacy_usd": F.round(part(old_monthly, "legacy_days"), 6), "new_usd": F.round(part(new_monthly, "days"), 6)})
    overlap = F.round(F.col("new_usd") * F.col("legacy_days") / F.col("days"), 6)
    return rows.select("month", "days", "legacy_days", "legacy_usd", "new_usd", overlap.alias("overlap_usd"))


def payback(case: DataFrame, old_monthly: float, new_monthly: float) -> DataFrame:
    """overlap_usd, monthly_saving, payback_months (null where nothing is saved)."""
    out = case.agg(F.sum("overlap_usd").alias("overlap_usd")).withColumn("monthly_saving", F.lit(old_monthly - new_monthly))
    months = F.round(F.col("overlap_usd").cast("double") / F.nullif(F.col("monthly_saving"), F.lit(0.0)), 1)
    return out.withColumn("payback_months", F.when(F.col("monthly_saving") > 0, months))


def unused_tables(records: DataFrame, nodes: DataFrame, owners: DataFrame, paths: DataFrame, end: Column, lookbacks: list[int]) -> DataFrame:
    """lookback_days, unique_id, relation, team, owner of models that builds write and that no person or dashboard has
    read in the last days, nor anything made from them (``paths``: ancestor, node)."""
    about = nodes.select(F.col("unique_id").alias("node_id"), "resource_type", "attached_node")
    built = records.where("actor_type = 'dbt' AND query_kind = 'Insert'").select("node_id").distinct().join(about, "node_id")
    built = built.select(F.when(F.col("resource_type") == "test", F.col("attached_node")).otherwise(F.col("node_id")).alias("unique_id")).distinct()
    models = nodes.where("resource_type = 'model'").select("unique_id", "relation").join(built, "unique_id", "left_semi")
    reads = records.where(F.col("actor_type").isin(*CONSUMERS)).select("started_at", F.explode("tables").alias("relation"))
    newest = reads.join(nodes.select("relation", "unique_id"), "relation").groupBy("unique_id").agg(F.max("started_at").alias("_at"))
    below = paths.join(newest.withColumnRenamed("unique_id", "node"), "node").groupBy(F.col("ancestor").alias("unique_id")).agg(F.max("_at").alias("_below"))
    last = models.join(newest, "unique_id", "left").join(below, "unique_id", "left").withColumn("_last", F.greatest("_at", "_below"))
    each = last.withColumn("lookback_days", F.explode(F.array(*[F.lit(d) for d in lookbacks])))
    idle = each.where(~F.coalesce(F.col("_last") >= end - F.make_dt_interval(F.col("lookback_days")), F.lit(False)))
    named = idle.join(owners, "unique_id", "left")
    return named.select("lookback_days", "unique_id", "relation", F.coalesce("team", F.lit(NOBODY)).alias("team"), F.coalesce("owner", F.lit(NOBODY)).alias("owner"))


def incremental_candidates(costs: DataFrame, nodes: DataFrame, paths: DataFrame, changed_in_place: list[str], top: int = 15) -> DataFrame:
    """rank, unique_id, usd, sources, blocked_by of the dearest models (unique_id, usd) that are still built in full:
    one can be built by increments if no source above it changes rows in place. ``nodes`` has materialized too."""
    full = nodes.where("resource_type = 'model' AND coalesce(materialized, 'table') NOT IN ('incremental', 'view')").select("unique_id")
    dear = costs.join(full, "unique_id", "left_semi").orderBy(F.desc("usd"), "unique_id").limit(top)  # a report's length
    best = F.array_sort(F.collect_list(F.struct((-F.col("usd")).alias("u"), F.col("unique_id").alias("i"))))
    ranked = dear.agg(best.alias("_b")).select(F.posexplode("_b").alias("_at", "_x")).select((F.col("_at") + 1).alias("rank"), F.col("_x.i").alias("unique_id"), (-F.col("_x.u")).alias("usd"))
    above = paths.join(nodes.where("resource_type = 'source'").select(F.col("unique_id").alias("ancestor"), "name"), "ancestor")
    above = above.groupBy(F.col("node").alias("unique_id")).agg(F.array_sort(F.collect_set("name")).alias("sources"))
    out = ranked.join(above, "unique_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    moving = F.array(*[F.lit(s) for s in changed_in_place]).cast("array<string>")
    return out.select("rank", "unique_id", "usd", "sources", F.array_intersect("sources", moving).alias("blocked_by"))
