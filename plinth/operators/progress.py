"""Progress, activity and maintenance decisions as expressions over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Windows, thresholds and delays in seconds.
RATE_SAMPLES, MIN_SPAN, BASELINE_LEAST = 16, 1.0, 8
DEGRADED_AFTER, STALLED_AFTER, COLLAPSE_RATIO = 60.0, 300.0, 0.25
COALESCE_MIN, COALESCE_MAX, COOLING_MAX, FRESHNESS, MOST_PENDING = 2.0, 30.0, 120.0, 300.0, 10_000


def list_limit(raw=None, default: int = 200, most: int = 5000) -> int:
    try:
        return min(max(int(raw), 0), most)
    except (TypeError, ValueError):
        return default


def list_offset(raw=None) -> int:
    try:
        return max(int(raw), 0)
    except (TypeError, ValueError):
        return 0


def window_rate(samples: DataFrame, by: list[str], order: list[str], at: str, done: str) -> DataFrame:
    """samples with rate: of the last RATE_SAMPLES, null for one sample, a span under MIN_SPAN seconds or no advance."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(RATE_SAMPLES - 1), 0)
    span, gain = F.col(at) - F.first(at).over(w), F.col(done) - F.first(done).over(w)
    return samples.withColumns({"_s": span, "_g": gain}).withColumn("rate", F.when((F.col("_s") >= MIN_SPAN) & (F.col("_g") > 0), F.col("_g") / F.col("_s"))).drop("_s", "_g")


def progress_windows(samples: DataFrame, by: str, at: str, step: str, done: str, least_gap: float = 0.25) -> DataFrame:
    """samples with part, which rises where the step changes or the count falls; of samples nearer than least_gap to the one before only the last stays."""
    w = Window.partitionBy(by).orderBy(at)
    reset = (F.lag(step).over(w) != F.col(step)) | (F.lag(done).over(w) > F.col(done))
    marked = samples.withColumn("_r", F.coalesce(reset, F.lit(False)).cast("int")).withColumn("part", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")
    soon = F.lead(at).over(Window.partitionBy(by, "part").orderBy(at)) - F.col(at) < least_gap
    return marked.withColumn("_soon", F.coalesce(soon, F.lit(False))).filter("not _soon").drop("_soon")


def baseline_rate(rates: DataFrame, by: str) -> DataFrame:
    """(by, baseline): the median of rates, null for fewer than BASELINE_LEAST."""
    return rates.groupBy(by).agg(F.when(F.count("rate") >= BASELINE_LEAST, F.median("rate")).alias("baseline"))


def degradation(idle: Column, rate: Column, baseline: Column) -> Column:
    """healthy, degraded or stalled by the age of the freshest signal and the rate against its baseline."""
    slow = F.coalesce((baseline > 0) & (rate / baseline <= COLLAPSE_RATIO), F.lit(False))
    return F.when(idle >= STALLED_AFTER, "stalled").when((idle >= DEGRADED_AFTER) | slow, "degraded").otherwise("healthy")


def estimate(rate: Column, done: Column, total: Column) -> tuple[Column, Column]:
    """(rate, seconds left), rounded; null where the rate or the total isn't known."""
    return F.round(rate, 3), F.when(rate > 0, F.round((total - done) / rate, 1))


def backoff(exponent: Column, base: float, cap: float, fraction: float, unit: Column) -> Column:
    """base * 2^exponent, at most cap, spread by fraction with unit from 0 to 1."""
    plain = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(exponent, F.lit(62))), F.lit(cap))
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), plain + plain * fraction * (2 * unit - 1)))


def coalesce_delay(pending: DataFrame, by: list[str], last_run: float = 0.0) -> DataFrame:
    """(by, delay) of pending (by, path, first_at, latest_at, kinds): longer for fast arrival, repeats, many paths and long runs."""
    n, events = F.count("*"), F.sum(F.size("kinds"))
    span = F.greatest(F.max("latest_at") - F.min("first_at"), F.lit(1.0))
    facts = pending.groupBy(*by).agg(n.alias("n"), events.alias("e"), span.alias("s"))
    weight = 0.4 * F.least(F.col("e") / F.col("s") / 10, F.lit(1.0)) + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("n") / F.col("e")) + 0.2 * F.least(F.col("n") / 1000, F.lit(1.0)) + 0.2 * min(last_run / COOLING_MAX, 1.0)
    return facts.select(*by, (COALESCE_MIN + (COALESCE_MAX - COALESCE_MIN) * F.least(F.lit(1.0), weight)).alias("delay"))


def pressure(critical: dict[str, Column], elevated: dict[str, Column]) -> Column:
    """(tier, findings): 2 with any critical finding, 1 with any elevated one, else 0."""

    def found(conditions: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items())))

    hard, soft = found(critical), found(elevated)
    return F.when(F.size(hard) > 0, F.struct(F.lit(2).alias("tier"), hard.alias("findings"))).when(F.size(soft) > 0, F.struct(F.lit(1).alias("tier"), soft.alias("findings"))).otherwise(F.struct(F.lit(0).alias("tier"), F.array().cast("array<string>").alias("findings")))


def store_failures(failures: DataFrame, at_once: list[str], repeated: list[str]) -> DataFrame:
    """(finding): kinds that are critical at once, and repeatable ones that occur twice or more."""
    n = failures.groupBy("kind").agg(F.count("*").alias("n"))
    once = n.filter(F.col("kind").isin(*at_once)).select(F.concat(F.lit("store_"), "kind").alias("finding"))
    return once.unionByName(n.filter(F.col("kind").isin(*repeated) & (F.col("n") >= 2)).select(F.concat(F.lit("store_"), "kind", F.lit("_repeated")).alias("finding")))


def job_summary(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """(dimension, value, n): counts by each key in one pass over jobs."""
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys)))
    return jobs.select(parts.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def matching_jobs(jobs: DataFrame, equal: dict[str, str] | None = None, prefix: tuple[str, str] | None = None, since: tuple[str, object] | None = None, text: str | None = None, text_columns: list[str] = ()) -> DataFrame:
    """All the conditions that are given; text is sought in text_columns, whatever the case."""
    for name, value in (equal or {}).items():
        jobs = jobs.filter(F.col(name) == value)
    if prefix:
        jobs = jobs.filter(F.col(prefix[0]).startswith(prefix[1]))
    if since:
        jobs = jobs.filter(F.col(since[0]) >= F.lit(since[1]))
    return jobs.filter(F.contains(F.lower(F.concat_ws(" ", *text_columns)), F.lit(text.lower()))) if text else jobs


def sorted_records(records: DataFrame, field: str, tie: str, descending: bool = False, priority: list[str] | None = None) -> DataFrame:
    """By a field, or by its place in priority; equal ones by tie."""
    key = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col(field)), F.lit(0)), F.lit(len(priority) + 1)) if priority else F.col(field)
    return records.orderBy(key.desc() if descending else key, tie)


def within_cycle(decisions: DataFrame, order: list, most: int, eligible: str = "eligible") -> DataFrame:
    """decisions with act: the first most eligible ones. A list of decisions, not of rows."""
    nth = F.sum(F.col(eligible).cast("int")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return decisions.withColumn("act", F.col(eligible) & (nth <= most))


def sweep(archives: DataFrame, now: float, retention: float, most_bytes: int) -> DataFrame:
    """archives (name, at, bytes) with verdict: expired by age, evicted (oldest first) until the rest fits most_bytes, else kept."""
    aged = archives.withColumn("_old", F.lit(now) - F.col("at") > retention)
    newer = F.sum("bytes").over(Window.partitionBy("_old").orderBy(F.desc("at"), "name").rowsBetween(Window.unboundedPreceding, 0))
    return aged.withColumn("verdict", F.when(F.col("_old"), "expired").when(newer > most_bytes, "evicted").otherwise("kept")).drop("_old")


def orphan_decision(status: Column, age_hours: Column, grace_hours: Column, held: Column) -> Column:
    return F.when(held, "held").when(status != "orphaned", "live").when(age_hours.isNull(), "pending").when(age_hours >= grace_hours, "reclaim").otherwise("pending")


def advance_stamps(stamps: DataFrame, unreferenced: DataFrame, now: str) -> DataFrame:
    """(name, since): the clock of names that stay unreferenced goes on, that of new ones starts now; others are dropped."""
    return unreferenced.select("name").join(stamps, "name", "left").select("name", F.coalesce("since", F.lit(now)).alias("since"))


def activity_stamps(observed: DataFrame, by: str, cycle: str, count: str, at: str) -> DataFrame:
    """(by, cycle, idle_since): the time at which the count was last seen to change, cycle after cycle."""
    w = Window.partitionBy(by).orderBy(cycle)
    changed = F.coalesce(F.lag(count).over(w) != F.col(count), F.lit(True))
    return observed.withColumn("idle_since", F.last(F.when(changed, F.col(at)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(by, cycle, "idle_since")


def namespaces(collections: DataFrame, manifest: DataFrame) -> DataFrame:
    """(prefix, collections, points, root, status): collections (name, points) by their prefix, with the manifest's root; unknown prefixes are unattributed."""
    prefix = F.regexp_extract("name", r"^(r[0-9a-f]{12}_)", 1)
    found = collections.withColumn("prefix", prefix).filter("prefix <> ''").groupBy("prefix").agg(F.count("*").alias("collections"), F.sum("points").alias("points"))
    return found.join(manifest, "prefix", "left").withColumn("status", F.when(F.col("root").isNull(), "unattributed").otherwise("attributed"))


def kind_points(collections: DataFrame, suffix: str) -> DataFrame:
    return collections.agg(F.sum(F.when(F.col("name").rlike(rf"{suffix}(_g[0-9A-Za-z]+)?$"), F.col("points"))).alias("points"))


def plan_reconcile(entries: DataFrame, target: int, cap: int) -> DataFrame:
    """The cap largest entries (name, setting, bytes) whose setting isn't target; unknown sizes count as none."""
    return entries.filter(F.col("setting") != target).orderBy(F.desc(F.coalesce("bytes", F.lit(0))), "name").limit(cap)


def readiness(facts: DataFrame) -> DataFrame:
    """(usable, freshness, authoritative) of sources' facts (usable, freshness): any, the worst, and whether all are usable and current."""
    order = F.array(*map(F.lit, ("current", "updating", "unverifiable", "rebuild_required")))
    worst = F.max(F.array_position(order, F.col("freshness")))
    return facts.agg(F.bool_or("usable").alias("usable"), F.element_at(order, worst.cast("int")).alias("freshness"), F.bool_and(F.col("usable") & (F.col("freshness") == "current")).alias("authoritative"))


def claim(live: Column, claimed: Column) -> Column:
    return F.when(live.isNull(), "unverifiable").when(live >= claimed, "consistent").otherwise("shrunken")


def shortfall(published: Column, live: Column) -> Column:
    return F.when(live < published, published - live)


def fair_choice(ready: DataFrame, after: str | None) -> DataFrame:
    """The one key to run: the earliest deadline; of equal ones the next after the last choice, in a circle."""
    turn = (F.col("key") <= F.lit(after)).cast("int") if after is not None else F.lit(0)
    return ready.orderBy("deadline", turn, "key").limit(1)


def hit_freshness(hits: DataFrame, current: DataFrame) -> DataFrame:
    """hits (path, digest) with verdict: current, content_changed, file_missing or unverifiable. current: (path, now, readable)."""
    joined = hits.join(current, "path", "left")
    return joined.withColumn("verdict", F.when(F.col("readable").isNull(), "file_missing").when(~F.col("readable"), "unverifiable").when(F.col("now") == F.col("digest"), "current").otherwise("content_changed")).drop("now", "readable")
