"""Comparison of two tables: canonical rows, hashes, segmented and joined differences, classes, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import stored

NULL = "\\N"
FANOUT_BITS = 4


@dataclass(frozen=True)
class Rule:
    """How a column is rendered: its kind (int, decimal, bool, ts, date, text) and what is forgiven."""

    kind: str
    scale: int = 2
    rtrim: bool = False
    casefold: bool = False


def canonical(c: str, rule: Rule) -> Column:
    """Text of a value, the same on every engine; null is a mark that no text renders to."""
    x = F.col(c)
    if rule.kind == "decimal":
        x = F.round(x.cast("decimal(38,10)"), rule.scale).cast(f"decimal(38,{rule.scale})").cast("string")
    elif rule.kind == "ts":
        x = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif rule.kind == "text":
        x = F.regexp_replace(x, "\\u0000+$", "")
        x = F.rtrim(x) if rule.rtrim else x
        x = F.lower(x) if rule.casefold else x
        x = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    else:
        x = x.cast("string")
    return F.coalesce(x, F.lit(NULL))


def hashed(rows: DataFrame, key: Sequence[str], rules: Mapping[str, Rule]) -> DataFrame:
    """All columns with row_key, row_text, bucket (32 bits of the key's hash), h1 and h2 (64 bits of the row's)."""
    row_key = F.concat_ws("|", *[canonical(k, rules[k]) for k in key])
    row = F.concat_ws("|", *[canonical(c, r) for c, r in rules.items()])
    out = rows.withColumns({"row_key": row_key, "row_text": row})
    part = lambda x, at: F.conv(F.substring(F.md5(x), at, 8), 16, 10).cast("long")
    return out.withColumns({"bucket": part(F.col("row_key").cast("binary"), 1), "h1": part(F.col("row_text").cast("binary"), 1), "h2": part(F.col("row_text").cast("binary"), 9)})


def summary(rows: DataFrame, depth: int) -> DataFrame:
    """Rows and hash sums per segment at a depth (16 segments more per level)."""
    segment = F.shiftright("bucket", 32 - FANOUT_BITS * depth) if depth else F.lit(0).cast("long")
    return rows.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("h1"), F.sum(F.col("h2").cast("decimal(38,0)")).alias("h2")
    )


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Segments whose summaries differ."""
    both = a.alias("a").join(b.alias("b"), "segment", "full")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n_rows", "h1", "h2")])
    return both.where(~same).select("segment")


KEYED = ("row_key", "row_text", "bucket", "h1", "h2")


def descend(source: DataFrame, target: DataFrame, leaf_rows: int = 256, max_depth: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hashed rows of both sides that lie in differing segments, and what each level compared (level, n_segments,
    n_rows of the source below them). Rows are hashed once and written; from then on a level is an aggregate over three
    numbers a row, cut down to the segments that differed above. Segments travel as a table, never as a driver list."""
    sides = [stored(side.select(*KEYED), "diff-side") for side in (source, target)]
    n, depth, inside, levels = sides[0].count(), 0, None, []
    while True:
        depth += 1
        sums = [summary(below(side, inside, depth - 1), depth) for side in sides]
        levels.append(sums[0].agg(F.lit(depth).alias("level"), F.count(F.lit(1)).alias("n_segments"), F.sum("n_rows").alias("n_rows")))
        inside = stored(differing(*sums), "diff-segments")
        if inside.isEmpty() or depth == max_depth or n <= leaf_rows * 16**depth:
            break
    return below(sides[0], inside, depth), below(sides[1], inside, depth), reduce(DataFrame.unionAll, levels)


def below(side: DataFrame, segments: DataFrame | None, depth: int) -> DataFrame:
    """The rows of a side within some segments of a depth."""
    if segments is None:
        return side
    return side.join(segments, F.shiftright(side["bucket"], 32 - FANOUT_BITS * depth) == segments["segment"], "left_semi")


def row_differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """row_key, n_source, n_target, kind: missing, extra, duplicate_key or changed."""
    folded = [
        side.groupBy("row_key").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("row_text").alias(f"t_{name}"))
        for name, side in (("source", source), ("target", target))
    ]
    both = folded[0].join(folded[1], "row_key", "full").na.fill(0, ["n_source", "n_target"])
    kind = (
        F.when(F.col("n_target") == 0, "missing")
        .when(F.col("n_source") == 0, "extra")
        .when((F.col("n_source") > 1) | (F.col("n_target") > 1), "duplicate_key")
        .when(F.col("t_source") != F.col("t_target"), "changed")
    )
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("row_key", "n_source", "n_target", "kind")


def single(side: DataFrame) -> DataFrame:
    """The keys that a side holds once."""
    return side.groupBy("row_key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("row_key")


def cell_differences(source: DataFrame, target: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """row_key, column_name, kind, a, b (canonical texts) of the cells that differ in keys both sides hold once."""
    cells = lambda side: F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r.kind).alias("k"), canonical(c, r).alias("v")) for c, r in rules.items()])
    once = []
    for name, side in (("a", source), ("b", target)):
        single = side.withColumn("_cells", cells(side)).groupBy("row_key").agg(F.count(F.lit(1)).alias("_n"), F.first("_cells").alias(name))
        once.append(single.where("_n = 1").drop("_n"))
    both = once[0].join(once[1], "row_key").where(F.col("a") != F.col("b"))
    pairs = F.explode(F.arrays_zip("a", "b")).alias("x")
    out = both.select("row_key", pairs).where(F.col("x.a.v") != F.col("x.b.v"))
    return out.select("row_key", F.col("x.a.c").alias("column_name"), F.col("x.a.k").alias("kind"), F.col("x.a.v").alias("a"), F.col("x.b.v").alias("b"))


class Connector(Protocol):
    """One side of a comparison: what a descent asks of a system, whichever it is."""

    def summary(self, depth: int, within: DataFrame | None) -> DataFrame: ...

    def fetch(self, depth: int, within: DataFrame | None) -> DataFrame: ...

    def keys_after(self, mark: Column) -> DataFrame: ...


class TableConnector:
    """A connector over a table of this engine, as of a watermark if it has one."""

    def __init__(self, rows: DataFrame, key: Sequence[str], rules: Mapping[str, Rule], changed_at: str | None = None, mark: Column | None = None):
        self.changed_at, self.all = changed_at, rows
        self.rows = hashed(rows if mark is None else as_of(rows, changed_at, mark), key, rules)
        self.key, self.rules = key, rules

    def summary(self, depth: int, within: DataFrame | None = None) -> DataFrame:
        return summary(below(self.rows, within, depth - 1), depth)

    def fetch(self, depth: int, within: DataFrame | None = None) -> DataFrame:
        return below(self.rows, within, depth)

    def keys_after(self, mark: Column) -> DataFrame:
        return in_flight(hashed(self.all, self.key, self.rules), self.changed_at, mark, ["row_key"])


def other_fold(wall: Column, zone: str) -> tuple[Column, Column]:
    """Both instants that a wall clock time can mean in a zone (the second is null if there is one)."""
    u, hour = F.to_utc_timestamp(wall, zone), F.expr("INTERVAL '1' HOUR")
    later = F.from_utc_timestamp(u + hour, zone) == wall
    earlier = (F.from_utc_timestamp(u - hour, zone) == wall) | (F.from_utc_timestamp(u, zone) != wall)
    return u, F.when(later, u + hour).when(earlier, u - hour)


def rounded_forms(x: Column, scale: Column | int) -> Column:
    """All that rounding or truncating a decimal at a scale can leave of it: half up, half to even, towards zero, and
    through a binary float (scaled, which rounds, then truncated or rounded). As whole numbers of 10^-scale."""
    step = F.pow(F.lit(10.0), F.lit(scale) if isinstance(scale, int) else scale)
    exact = x * step.cast("decimal(12,0)")
    whole = "decimal(38,0)"
    lower = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast(whole)
    real = x.cast("double") * step
    return F.array(F.round(exact, 0).cast(whole), F.bround(exact, 0).cast(whole), lower, (F.signum(real) * F.floor(F.abs(real))).cast(whole), F.rint(real).cast(whole))


def classified(cells: DataFrame, zone: str = "America/New_York", tolerance: str = "0.01", scale: int = 2) -> DataFrame:
    """The cells with their class: rounding, timezone_shift, whitespace, case_only or value_mismatch. A difference within
    the tolerance is rounding only if rounding one value at the column's scale gives the other; a timestamp is shifted
    if reading one as wall clock time of the zone gives the other."""
    a, b, kind = F.col("a"), F.col("b"), F.col("kind")
    no_null = (a != NULL) & (b != NULL)
    da, db = (x.try_cast("decimal(28,10)") for x in (a, b))
    near = F.abs(da - db) <= F.lit(tolerance).cast("decimal(10,4)")
    units = lambda x: (x * F.lit(10**scale)).cast("decimal(38,10)")
    holds = lambda x, y: F.exists(rounded_forms(x, scale), lambda form: form.cast("decimal(38,10)") == units(y))
    near = near & (holds(da, db) | holds(db, da))
    ta, tb = (F.regexp_replace(x, "Z$", "").try_cast("timestamp") for x in (a, b))
    shifted = F.lit(False)
    for x, y in ((ta, tb), (tb, ta)):
        for instant in other_fold(x, zone):
            shifted = shifted | F.coalesce(instant == y, F.lit(False))
    name = (
        F.when(~no_null, "value_mismatch")
        .when((kind == "decimal") & F.coalesce(near, F.lit(False)), "rounding")
        .when((kind == "ts") & shifted, "timezone_shift")
        .when((kind == "text") & (F.trim(a) == F.trim(b)), "whitespace")
        .when((kind == "text") & (F.lower(a) == F.lower(b)), "case_only")
        .otherwise("value_mismatch")
    )
    return cells.withColumn("class", name)


def as_of(rows: DataFrame, changed_at: str, mark: Column) -> DataFrame:
    """Rows as of a watermark: those changed later are left out; a row that never changed is always compared."""
    return rows.where(~F.coalesce(F.col(changed_at) > mark, F.lit(False)))


def in_flight(rows: DataFrame, changed_at: str, mark: Column, key: Sequence[str]) -> DataFrame:
    """Keys of the rows changed after the watermark: what the target lacks or has more of there is no defect."""
    return rows.where(F.col(changed_at) > mark).select(*key).distinct()


def without_in_flight(differences: DataFrame, moving: DataFrame) -> DataFrame:
    """Row differences against a source as of its watermark: a row that only the target holds is in_flight, not extra,
    if its key (row_key) changed in the source since."""
    known = moving.select("row_key", F.lit(True).alias("_moving"))
    kind = F.when(F.col("_moving").isNotNull() & (F.col("kind") == "extra"), "in_flight").otherwise(F.col("kind"))
    return differences.join(known, "row_key", "left").withColumn("kind", kind).drop("_moving")


def discrepancies(differences: DataFrame, cells: DataFrame) -> DataFrame:
    """One stream: row_key, column_name (null for whole rows), class, of missing, extra and duplicate rows and of cells."""
    whole = differences.where(F.col("kind").isin("missing", "extra", "duplicate_key")).select("row_key", F.lit(None).cast("string").alias("column_name"), F.col("kind").alias("class"))
    return whole.unionAll(cells.select("row_key", "column_name", "class"))


def column_rates(found: DataFrame, in_both: Column, columns: Sequence[str]) -> DataFrame:
    """column_name, n_differing, match_rate of every compared column; ``in_both`` counts the keys both sides hold once."""
    every = found.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    n = found.where(F.col("column_name").isNotNull()).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_differing"))
    out = every.join(n, "column_name", "left").na.fill(0, ["n_differing"])
    return out.withColumn("match_rate", F.round(F.coalesce(1 - F.col("n_differing") / F.nullif(in_both, F.lit(0)), F.lit(1.0)), 6))


def class_limits(found: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """class, n, max_n, passes of every class that has a limit."""
    every = found.sparkSession.createDataFrame(list(limits.items()), "class string, max_n long")
    n = found.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "class", "left").na.fill(0, ["n"]).select("class", "n", "max_n", (F.col("n") <= F.col("max_n")).alias("passes"))


def grade(truth: DataFrame, found: DataFrame, forgiven: Mapping[str, set[str]] | None = None) -> DataFrame:
    """expected, detected, true_positives, correctly_classified, equivalent_under_policy, recall, precision, accuracy of
    discrepancies against planted ones (row_key, column_name, class). ``forgiven`` names, per column, the classes that
    the column's rendering hides (case_only, whitespace): those are not expected."""
    pairs = [F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for c, ks in (forgiven or {}).items() for k in sorted(ks)]
    hidden = F.array_contains(F.array(*pairs), F.struct(F.col("column_name").alias("c"), F.col("class").alias("k"))) if pairs else F.lit(False)
    hidden = F.coalesce(hidden, F.lit(False))
    cell = lambda rows, name: rows.select("row_key", F.coalesce("column_name", F.lit("")).alias("column_name"), F.col("class").alias(name))
    want = cell(truth.where(~hidden), "_want").dropDuplicates(["row_key", "column_name"])
    got = cell(found, "_got").dropDuplicates(["row_key", "column_name"])
    both = want.join(got, ["row_key", "column_name"], "full")
    hit = F.col("_want").isNotNull() & F.col("_got").isNotNull()
    out = both.agg(
        F.count("_want").alias("expected"), F.count("_got").alias("detected"), F.count_if(hit).alias("true_positives"), F.count_if(hit & (F.col("_want") == F.col("_got"))).alias("correctly_classified")
    )
    out = out.crossJoin(truth.agg(F.count_if(hidden).alias("equivalent_under_policy")))  # one row each
    rate = lambda n, d: F.round(F.coalesce(F.col(n) / F.nullif(F.col(d), F.lit(0)), F.lit(1.0)), 6)
    return out.withColumns({"recall": rate("true_positives", "expected"), "precision": rate("true_positives", "detected"), "accuracy": rate("correctly_classified", "true_positives")})


def schema_drift(source: DataFrame, target: DataFrame, key: Sequence[str], changed_at: str | None = None) -> list[tuple[str, str]]:
    """(column, problem) of what keeps two tables from being compared: columns without a counterpart, keys that are
    absent, a change time that is none. Only schemas are read."""
    a, b = ({f.name: f.dataType.typeName() for f in x.schema} for x in (source, target))
    out = [(c, "missing in target") for c in a if c not in b] + [(c, "missing in source") for c in b if c not in a]
    out += [(k, "key is absent") for k in key if k not in a or k not in b]
    if changed_at is not None and not a.get(changed_at, "absent").startswith("timestamp"):
        out.append((changed_at, "change time is no timestamp"))
    return sorted(out)


def transfers(levels: DataFrame, n_source: Column, n_target: Column, fetched: Column) -> DataFrame:
    """moved, naive, saved_share: the summaries and rows that a descent moved against moving both tables whole."""
    out = levels.agg(F.sum("n_segments").alias("_s")).select((2 * F.col("_s") + fetched).alias("moved"), (n_source + n_target).alias("naive"))
    return out.withColumn("saved_share", F.round(1 - F.col("moved") / F.nullif(F.col("naive"), F.lit(0)), 6))


def explained(needed: DataFrame, lineage: DataFrame, upstream: DataFrame, found: DataFrame) -> DataFrame:
    """report, explained, causes: a report's difference is explained if each of its differing columns (``needed``:
    report, column_name) reads a raw column with a discrepancy, or a table with missing or extra rows (``found``:
    table_name, source_column, null for whole rows). ``lineage`` has report, column_name, table_name, source_column;
    reports without any are explained by a difference in one of their tables (``upstream``: report, table_name)."""
    cells = found.where(F.col("source_column").isNotNull()).select("table_name", "source_column", F.concat("table_name", F.lit("."), "source_column").alias("_cell")).distinct()
    whole = found.where(F.col("source_column").isNull()).select("table_name", F.concat("table_name", F.lit(" (rows)")).alias("_row")).distinct()
    traced = lineage.select("report").distinct()
    causes = F.array_compact(F.array("_cell", "_row"))
    columns = needed.join(traced, "report", "left_semi").join(lineage, ["report", "column_name"], "left")
    columns = columns.join(cells, ["table_name", "source_column"], "left").join(whole, "table_name", "left")
    columns = columns.groupBy("report", "column_name").agg(F.array_distinct(F.flatten(F.collect_list(causes))).alias("_c"))
    first = columns.groupBy("report").agg(F.min(F.size("_c") > 0).alias("explained"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_c")))).alias("causes"))
    tables = upstream.join(found.select("table_name").distinct(), "table_name", "left_semi").groupBy("report").agg(F.array_sort(F.collect_set("table_name")).alias("causes"))
    rest = needed.select("report").distinct().join(traced, "report", "left_anti").join(tables, "report", "left")
    rest = rest.select("report", F.col("causes").isNotNull().alias("explained"), F.coalesce("causes", F.array().cast("array<string>")).alias("causes"))
    return first.unionAll(rest)


def pair_verdict(differences: DataFrame, cells: DataFrame, n_source: Column, n_target: Column, min_row_rate: float = 0.999, lag_hours: Column | None = None, max_lag_hours: float = 26) -> DataFrame:
    """n_source, n_target, row_match_rate, failures (list): a pair fails if too few of the source's rows match, if the
    counts differ by more than the rows found, or if the source lags too far behind. ``n_source`` and ``n_target`` are
    scalars of the two tables (a source as of its watermark)."""
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    one = F.lit(1)
    rows = differences.agg(
        of("missing", one).alias("_missing"), of("extra", one).alias("_extra"), of("in_flight", one).alias("_moving"),
        of("duplicate_key", F.col("n_source")).alias("_twice"), of("duplicate_key", F.col("n_target") - F.col("n_source")).alias("_more"),
    )
    rows = rows.crossJoin(cells.agg(F.countDistinct("row_key").alias("_changed"))).withColumns({"n_source": n_source, "n_target": n_target})
    matched = F.col("n_source") - F.col("_missing") - F.col("_twice") - F.col("_changed")
    rows = rows.withColumn("row_match_rate", F.round(F.coalesce(matched / F.nullif(F.col("n_source"), F.lit(0)), F.lit(1.0)), 6))
    accounted = F.col("_extra") + F.col("_moving") - F.col("_missing") + F.col("_more")
    late = F.lit(False) if lag_hours is None else lag_hours > max_lag_hours
    failures = F.array_compact(F.array(
        F.when(F.col("n_target") - F.col("n_source") != accounted, "unaccounted rows"),
        F.when(late, "watermark lag"),
        F.when(F.col("row_match_rate") < min_row_rate, "row match rate"),
    ))
    return rows.select("n_source", "n_target", "row_match_rate", failures.alias("failures"))


def night_record(nights: DataFrame, per_class: int = 20) -> tuple[DataFrame, DataFrame]:
    """Of one night's discrepancies (night, pair, row_key, column_name, class): counts by class, and examples."""
    by = ["night", "pair", "class"]
    counts = nights.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("row_key", "column_name"))
    return counts, nights.withColumn("example", rank).where(F.col("example") <= per_class)


def verdict(rows: DataFrame, n_source: Column, min_match: float = 0.999) -> DataFrame:
    """n_source, n_differing, match_rate and whether the pair passes, from the row differences."""
    out = rows.agg(F.countDistinct("row_key").alias("n_differing"), n_source.alias("n_source"))
    rate = F.round(1 - F.col("n_differing") / F.nullif(F.col("n_source"), F.lit(0)), 6)
    return out.withColumn("match_rate", rate).withColumn("passes", rate >= min_match)


def top_examples(cells: DataFrame, per_class: int = 20) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("class").orderBy("row_key", "column_name"))
    return cells.withColumn("example", rank).where(F.col("example") <= per_class)


def clean_streak(nights: DataFrame, night: str, clean: str, needed: int, *by: str) -> DataFrame:
    """First night on which ``needed`` clean nights in a row are reached, per ``by``."""
    order = W.partitionBy(*by).orderBy(night)
    island = F.sum((~F.col(clean)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = nights.withColumn("_island", island).where(clean)
    length = F.row_number().over(W.partitionBy(*by, "_island").orderBy(night))
    return rows.withColumn("_length", length).where(F.col("_length") == needed).groupBy(*by).agg(F.min(night).alias("cutover_night"))
