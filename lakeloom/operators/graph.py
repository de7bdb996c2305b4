"""Lineage graphs, ownership rules, and incidents grouped by their root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import discard, stored

#: Bytes of rules up to which they are broadcast.
RULE_BYTES = 8 << 20
#: Rows that one task of a closure holds.
TASK_ROWS = 250_000


def build(nodes: DataFrame) -> DataFrame:
    """Edges parent_id, child_id of ``nodes`` (unique_id, depends_on); parents that are no node are left out."""
    pairs = nodes.select(F.explode("depends_on").alias("parent_id"), F.col("unique_id").alias("child_id")).distinct()
    return pairs.join(nodes.select(F.col("unique_id").alias("parent_id")), "parent_id", "left_semi")


def edge_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """parent_id, child_id, parent_type, child_type."""
    kind = lambda end: nodes.select(F.col("unique_id").alias(f"{end}_id"), F.col("resource_type").alias(f"{end}_type"))
    return edges.join(kind("parent"), "parent_id").join(kind("child"), "child_id").select("parent_id", "child_id", "parent_type", "child_type")


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows by keys, in as many partitions as leave about ``TASK_ROWS`` of ``n`` rows in each. Such a number stands,
    however well the rows compress, so a task's memory does not rise with the table."""
    return rows.repartition(max(1, -(-n // TASK_ROWS)), *keys)


def held(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``wanted``, by a hash table of those: the rows pass unsorted, however many share a key."""
    return rows.join(wanted.hint("shuffle_hash"), key, "left_semi")


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, node, depth (the shortest) of every pair joined by a path, once, by doubling the reach each round: a
    graph of depth d takes log2(d) rounds, whatever d is. Each round is written out, so plans stay small.

    A shortest path longer than the reach begins with a shortest one of just the reach, so only those are continued, and
    when there are none all is found. They are the hash table; the paths that may follow them, of which very many begin
    at one node, pass by it."""
    pairs = edges.select(F.col("parent_id").alias("ancestor"), F.col("child_id").alias("node"))
    paths, reach = stored(dealt(pairs, pairs.count(), "ancestor", "node").distinct().withColumn("depth", F.lit(1)), "closure"), 1
    while n := paths.where(F.col("depth") == reach).count():
        a, b = dealt(paths.where(F.col("depth") == reach), n, "node").hint("shuffle_hash").alias("a"), paths.alias("b")
        longer = b.join(a, F.col("a.node") == F.col("b.ancestor")).select("a.ancestor", "b.node", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        longer = stored(longer, "closure-longer")
        if more := longer.count():
            every = dealt(paths.unionAll(longer), paths.count() + more, "ancestor", "node")
            old, paths = paths, stored(every.groupBy("ancestor", "node").agg(F.min("depth").alias("depth")), "closure")
            discard(old)
        discard(longer)
        reach *= 2
    return paths


def nearest_failed(paths: DataFrame, failed: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, nearest (failed ancestor of least depth, ties to the least id) for those of ``nodes`` (the failed ones)
    that have one."""
    up = held(held(paths, failed.select(F.col("node").alias("ancestor")), "ancestor"), failed if nodes is None else nodes, "node")
    return up.groupBy("node").agg(F.min(F.struct("depth", "ancestor"))["ancestor"].alias("nearest"))


def roots(paths: DataFrame, failed: DataFrame) -> DataFrame:
    """node, root: follow the nearest failed ancestors to one that has none. Pointers jump to the pointer's pointer,
    so the rounds grow with the logarithm of the longest chain; each is written out."""
    near = stored(failed.join(nearest_failed(paths, failed), "node", "left").select("node", F.coalesce("nearest", "node").alias("root")), "roots")
    while True:
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("_over"))
        further = stored(near.join(jump, "root").select("node", F.col("_over").alias("root"), (F.col("_over") != F.col("root")).alias("_moved")), "roots")
        discard(near)
        near = further.drop("_moved")
        near._written_to = further._written_to
        if further.where("_moved").isEmpty():
            return near


def shared_failures(paths: DataFrame, root_of: DataFrame) -> DataFrame:
    """node, root of the failed nodes below more than one root: a row for every root above."""
    every = root_of.select(F.col("root").alias("ancestor")).distinct()
    inner = root_of.select("node").join(every.withColumnRenamed("ancestor", "node"), "node", "left_anti")
    above = held(held(paths, every, "ancestor"), inner, "node").select("node", F.col("ancestor").alias("root"))
    many = above.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node")
    return above.join(many, "node", "left_semi")


def group_failures(paths: DataFrame, events: DataFrame, skipped: DataFrame) -> DataFrame:
    """root, n_events, failed_nodes, skipped, shared (sorted lists): the failures of a run by their root. ``events`` has
    check_id and subject, ``skipped`` node; skipped nodes go to the root of their nearest failed ancestor."""
    failed = events.select(F.col("subject").alias("node")).distinct()
    root_of = roots(paths, failed)
    lists = events.join(root_of, events["subject"] == root_of["node"]).groupBy("root").agg(
        F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("subject")).alias("failed_nodes")
    )
    idle = skipped.select("node").distinct().join(failed, "node", "left_anti")
    near = nearest_failed(paths, failed, idle)
    near = near.join(root_of.select(F.col("node").alias("nearest"), "root"), "nearest").groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("skipped"))
    both = shared_failures(paths, root_of).groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("shared"))
    out = lists.join(near, "root", "left").join(both, "root", "left")
    none = F.array().cast("array<string>")
    return out.select("root", "n_events", "failed_nodes", F.coalesce("skipped", none).alias("skipped"), F.coalesce("shared", none).alias("shared"))


def impact(paths: DataFrame, tiers: DataFrame) -> DataFrame:
    """node, consumers, weight: downstream nodes with their tier weights (tests left out). A path stands once in
    ``paths``, so paths are counted, not the nodes in a set of them."""
    own = tiers.where(F.col("kind") != "test").groupBy("node").agg(F.sum("weight").alias("weight"))
    use = dealt(paths, paths.count(), "node").join(own.hint("shuffle_hash"), "node")
    return use.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("consumers"), F.sum("weight").alias("weight"))


def severity(score: Column, high: float = 150, low: float = 45) -> Column:
    return F.when(score >= high, "SEV1").when(score >= low, "SEV2").otherwise("SEV3")


def scored(paths: DataFrame, tiers: DataFrame, root_multiplier: int = 3) -> DataFrame:
    """node, consumers, score, severity of every dataset as a root: its own tier's weight some times, and the tiers'
    weights of all that read it, near or far."""
    own = tiers.where(F.col("kind") != "test").select("node", F.col("weight").alias("_own"))
    found = own.join(impact(paths, tiers).hint("shuffle_hash"), "node", "left").na.fill(0, ["consumers", "weight"])
    found = found.withColumn("score", F.lit(root_multiplier) * F.col("_own") + F.col("weight"))
    return found.select("node", "consumers", "score", severity(F.col("score")).alias("severity"))


#: A shell pattern's tokens: a character set (a ] that comes first, also after !, belongs to it) or one character.
TOKENS = r"(?s)(\[(?:!.|[^!])[^\]]*\]|.)"
#: The same for specificity, which knows no !.
PLAIN_TOKENS = r"(?s)(\[.[^\]]*\]|.)"


def is_wild(token: Column) -> Column:
    return token.isin("*", "?") | (F.length(token) > 2)


def glob_regex(pattern: Column) -> Column:
    """A shell pattern (*, ?, [set], [!set]; an unclosed [ is itself) as an anchored regular expression."""

    def of(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        no = inner.startswith("!")
        members = F.regexp_replace(F.when(no, F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner), r"([\\\[\]&^~])", r"\\$1")
        kind = F.when(no, F.lit("[^")).otherwise(F.lit("["))
        return (
            F.when(x == "*", F.lit(".*")).when(x == "?", F.lit("."))
            .when(F.length(x) > 2, F.concat(kind, members, F.lit("]")))
            .otherwise(F.regexp_replace(x, r"([^A-Za-z0-9_])", r"\\$1"))
        )

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(TOKENS), F.lit(1)), of), ""), F.lit("$"))


def specific(rules: DataFrame) -> DataFrame:
    """Rules with _literal (literal characters) and _wild (wildcards; a character set is one) of ``match``."""
    every = F.regexp_extract_all("match", F.lit(PLAIN_TOKENS), F.lit(1))
    return rules.withColumns({"_literal": F.size(F.filter(every, lambda x: ~is_wild(x))), "_wild": F.size(F.filter(every, is_wild))})


def candidates(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Every node with every rule that matches it. Rules are written by hand: up to ``RULE_BYTES`` they are broadcast,
    more are dealt out instead and each part of them sees the nodes."""
    found = specific(rules).withColumn("_regex", glob_regex(F.col("match")))
    size = found.agg(F.sum(F.octet_length("_regex") + 64)).first()[0] or 0
    if size <= RULE_BYTES:
        return nodes.join(F.broadcast(found), F.expr("node RLIKE _regex")).drop("_regex")
    parts = -(-size // RULE_BYTES)
    out = None
    for k in range(parts):
        mine = nodes.join(F.broadcast(found.where(F.pmod(F.xxhash64("match"), F.lit(parts)) == k)), F.expr("node RLIKE _regex")).drop("_regex")
        out = mine if out is None else out.unionAll(mine)
    return out


def resolve(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """node, the columns of the most specific rule (most literal characters, then fewest wildcards, then the first
    pattern), ambiguous: the first two are equally specific."""
    columns = [c for c in rules.columns if c != "match"]
    hit = candidates(nodes.select("node").distinct(), rules)
    order = F.struct((-F.col("_literal")).alias("a"), F.col("_wild").alias("w"), F.col("match").alias("m"), *columns)
    best = hit.groupBy("node").agg(F.min(order).alias("_b"))
    again = hit.join(best, "node").where((F.col("_literal") == -F.col("_b.a")) & (F.col("_wild") == F.col("_b.w")))
    tied = again.groupBy("node").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return best.join(tied, "node").select("node", F.col("_b.m").alias("match"), *[F.col(f"_b.{c}").alias(c) for c in columns], "ambiguous")


def rule_problems(rules: DataFrame, members: DataFrame) -> DataFrame:
    """match, problem of the rules (match, owner, team, backup) that name no team, an owner not on it, or a backup who
    is not another member. ``members`` has team and person."""
    teams = members.groupBy("team").agg(F.collect_set("person").alias("_people"))  # a team's people
    found = rules.join(teams, "team", "left")
    bad = (F.col("backup") == F.col("owner")) | ~F.array_contains("_people", F.col("backup"))
    problem = (
        F.when(F.col("_people").isNull(), "unknown team")
        .when(~F.array_contains("_people", F.col("owner")), "owner is not a member")
        .when(F.col("backup").isNotNull() & bad, "backup is not another member")
    )
    return found.select("match", problem.alias("problem")).where(F.col("problem").isNotNull())


def registry_check(nodes: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """level, subject, finding: rules with problems, nodes (node, kind, declared_owner) without an owner, of ambiguous
    ownership or whose exposure declares another owner, and rules that match nothing."""
    resolved = nodes.join(resolve(nodes, rules), "node", "left")
    about = (
        F.when(F.col("match").isNull(), "has no owner")
        .when(F.col("ambiguous"), "has ambiguous ownership")
        .when((F.col("kind") == "exposure") & ~F.col("declared_owner").eqNullSafe(F.col("owner")), "declares another owner")
    )
    row = lambda level, subject, finding: (F.lit(level).alias("level"), subject.alias("subject"), finding.alias("finding"))
    of_rules = rule_problems(rules, members).select(*row("error", F.col("match"), F.col("problem")))
    of_nodes = resolved.withColumn("_f", about).where(F.col("_f").isNotNull()).select(*row("error", F.col("node"), F.col("_f")))
    idle = rules.join(candidates(nodes.select("node"), rules).select("match").distinct(), "match", "left_anti")
    return of_rules.unionAll(of_nodes).unionAll(idle.select(*row("warning", F.col("match"), F.lit("matches no dataset"))))


def coverage(nodes: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """kind, n_nodes, n_owned, n_teams: a node is owned by a rule that is unambiguous and names a real team and member."""
    broken = rule_problems(rules, members).select("match", F.lit(True).alias("_broken"))
    found = nodes.join(resolve(nodes, rules), "node", "left").join(broken, "match", "left")
    owned = F.col("match").isNotNull() & ~F.col("ambiguous") & F.col("_broken").isNull()
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(owned).alias("n_owned"), F.countDistinct(F.when(owned, F.col("team"))).alias("n_teams"))


def starter_rules(names: DataFrame, least: int = 3) -> DataFrame:
    """match, n_nodes: patterns that cover every node, for a registry to begin with: the part of the name up to the
    first _ where ``least`` or more nodes share it, the whole name for all others."""
    prefix = F.regexp_extract("node", r"^([^_]+)_", 1)
    rows = names.select("node", prefix.alias("_p"))
    n = rows.where("_p <> ''").groupBy("_p").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= least)
    alone = rows.join(n.select("_p"), "_p", "left_anti").select(F.col("node").alias("match"), F.lit(1).cast("long").alias("n_nodes"))
    return n.select(F.concat("_p", F.lit("_*")).alias("match"), "n_nodes").unionAll(alone)
