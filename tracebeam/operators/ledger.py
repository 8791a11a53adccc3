"""Cost ledger, savings, budget and fix-audit aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebeam.functions.texts import strip, truncate
from tracebeam.functions.times import instant, trailing
from tracebeam.operators.skew import first_per_key, range_blocks, running_total, salted_join
from tracebeam.session import materialize

# Fixed value: characters of a file that go into a fix context.
MAX_FILE_CHARS = 2000

# Bar width of the day report, confidence gate of fixes, size of an embed-only call.
BAR_WIDTH = 30
FIX_CONFIDENCE_GATE = 0.6
EMBED_ONLY_TOKENS = 100

# The two forms in which a reply may hold a diff.
FENCED_DIFF = r"(?s)```(?:diff|patch)?\n(.*?)\n```"
BARE_DIFF = r"(?s)(--- [^\n]+\n\+\+\+ [^\n]+\n@@.*)"


def cost_totals(costs: DataFrame, as_of, days: int = 30) -> DataFrame:
    return trailing(costs, "ts", days, as_of).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_usd"),
        F.count(F.lit(1)).alias("calls"),
    )


def cost_by(costs: DataFrame, dim: str, as_of, days: int = 30) -> DataFrame:
    """Spend per provider, tier or any other column, largest first."""
    recent = trailing(costs, "ts", days, as_of)
    return recent.groupBy(dim).agg(F.sum("cost_usd").alias("cost_usd")).orderBy(
        F.desc("cost_usd"), dim
    )


def cost_by_day(costs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Spend per UTC day in order, with a bar scaled to the most expensive day."""
    daily = trailing(costs, "ts", days, as_of).groupBy(F.to_date("ts").alias("day")).agg(
        F.sum("cost_usd").alias("cost_usd")
    )
    # one row per day of the window, so a single frame over all of them stays small
    top = F.max("cost_usd").over(Window.partitionBy(F.lit(0)))
    bar = F.when(top > 0, F.floor(F.col("cost_usd") / top * BAR_WIDTH)).otherwise(0)
    return daily.withColumn("bar", bar.cast("int")).orderBy("day")


def cost_aggregates(costs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Totals and splits by provider, tier and day in one pass (``dim``, ``name``)."""
    recent = trailing(costs, "ts", days, as_of).select(
        "provider", "tier", F.to_date("ts").alias("day"), "cost_usd"
    )
    sets = [["provider"], ["tier"], ["day"], []]
    grouped = recent.groupingSets(sets, "provider", "tier", "day").agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.count(F.lit(1)).alias("calls"),
        F.grouping_id().alias("_set"),
    )
    dim = (
        F.when(F.col("_set") == 0b011, "provider").when(F.col("_set") == 0b101, "tier")
        .when(F.col("_set") == 0b110, "day").otherwise("total")
    )
    name = F.coalesce("provider", "tier", F.col("day").cast("string"), F.lit("all"))
    return grouped.select(dim.alias("dim"), name.alias("name"), "cost_usd", "calls")


def spend_today(costs: DataFrame, as_of) -> DataFrame:
    today = F.to_date(instant(as_of))
    return costs.where(F.to_date("ts") == today).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd")
    )


def budget_status(costs: DataFrame, daily_budget: float, as_of) -> DataFrame:
    """Today's spend and whether the budget is used up (then the cheaper profile applies)."""
    return spend_today(costs, as_of).select(
        "spent_usd", F.lit(float(daily_budget)).alias("budget_usd"),
        (F.col("spent_usd") >= daily_budget).alias("downgrade"),
    )


def running_spend(costs: DataFrame, daily_budget: float) -> DataFrame:
    """Spend of the day before each call, and whether that call already runs over budget.

    Calls are cut into ranges of (ts, id), so even a burst within one second is summed by several
    tasks; only one row per range is carried across the day.
    """
    cut = range_blocks(costs.withColumn("day", F.to_date("ts")), ["ts", "id"])
    total = running_total(
        cut, ["day"], ["ts", "id"], F.col("cost_usd"), "_spent", block=F.col("_block")
    )
    before = F.col("_spent") - F.col("cost_usd")
    return total.withColumn("spent_before", before).withColumn(
        "downgrade", F.col("spent_before") >= daily_budget
    ).drop("_spent")


def memory_savings(memories: DataFrame, costs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Money the answer cache saved, from recorded hits and costs; one row, one pass."""
    fresh = trailing(memories, "created_at", days, as_of).select(
        F.col("recall_hits").alias("hits"), F.col("cost_usd").alias("fresh"),
        F.lit(None).cast("double").alias("cached"),
    )
    cached = trailing(costs, "ts", days, as_of).where(
        (F.col("tier") == "embed") & (F.col("input_tokens") < EMBED_ONLY_TOKENS)
    ).select(
        F.lit(None).cast("bigint").alias("hits"), F.lit(None).cast("double").alias("fresh"),
        F.col("cost_usd").alias("cached"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    one = fresh.unionByName(cached).agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("cache_hits"),
        zero(F.avg("fresh")).alias("avg_fresh"),
        zero(F.avg("cached")).alias("avg_cached"),
    )
    per_hit = F.greatest(F.col("avg_fresh") - F.col("avg_cached"), F.lit(0.0))
    measured = F.col("cache_hits") > 0
    return one.select(
        "cache_hits",
        F.lit(days).alias("window_days"),
        F.round("avg_fresh", 6).alias("avg_fresh_usd"),
        F.round("avg_cached", 6).alias("avg_cached_usd"),
        F.round(F.col("cache_hits") * per_hit, 4).alias("saved_usd"),
        F.when(
            measured & (F.col("avg_fresh") > 0), F.round(per_hit / F.col("avg_fresh") * 100, 2)
        ).alias("savings_pct"),
        measured.alias("measured"),
    )


def ab_savings(costs: DataFrame, cold_from, warm_from) -> DataFrame:
    """Cold pass against warm pass: totals, money and token saving, hit rate, in one pass."""
    warm = F.col("ts") >= instant(warm_from)
    cold = ~warm
    tokens = F.col("input_tokens") + F.col("output_tokens")
    sums = costs.where(F.col("ts") >= instant(cold_from)).agg(
        *[
            expr.alias(f"{name}_{what}")
            for name, on in (("cold", cold), ("warm", warm))
            for what, expr in (
                ("usd", F.coalesce(F.sum(F.when(on, F.col("cost_usd"))), F.lit(0.0))),
                ("tokens", F.coalesce(F.sum(F.when(on, tokens)), F.lit(0))),
                ("calls", F.count_if(on)),
            )
        ]
    )

    def saving(what: str) -> Column:
        c, w = F.col(f"cold_{what}"), F.col(f"warm_{what}")
        return F.when(c > 0, (c - w) / c * 100)

    return sums.select(
        "*",
        saving("usd").alias("usd_saving_pct"),
        saving("tokens").alias("token_saving_pct"),
        saving("calls").alias("hit_rate_pct"),
    )


def classify_fix(df: DataFrame, confidence_gate: float = FIX_CONFIDENCE_GATE) -> DataFrame:
    """Outcome of a proposed fix from its sandbox run and confidence."""
    sandbox = F.col("sandbox_outcome")
    return df.withColumn(
        "outcome",
        F.when(sandbox == "not_run", "proposed")
        .when(
            (sandbox == "tests_passed") & (F.col("confidence_score") >= confidence_gate), "accepted"
        )
        .when(sandbox.isin("tests_failed", "apply_failed"), "rejected")
        .otherwise("inconclusive"),
    )


def fix_confidence(top_causes: DataFrame, replay_confidence: DataFrame) -> DataFrame:
    """The weaker of top cause and replay confidence, to four decimals; zero without causes."""
    best = top_causes.groupBy("incident_id").agg(F.max("confidence").alias("top"))
    return replay_confidence.join(best, "incident_id", "left").select(
        "incident_id",
        F.coalesce(F.bround(F.least("top", "score"), 4), F.lit(0.0)).alias("confidence_score"),
    )


def fix_context(
    causes: DataFrame, services: DataFrame, max_files: int = 5, files: DataFrame | None = None,
    max_chars: int = MAX_FILE_CHARS,
) -> DataFrame:
    """Files to look at per incident: of the first ``max_files`` causes, the cause's own file or
    the first file of its service, each once.

    A service is looked up in the environment of the cause (in any, by name, if causes have none). With
    ``files`` (path, source) each file comes with its ``body``, cut to ``max_chars``; files that are not
    there are left out. Only texts of the paths chosen are read, sorted and joined.
    """
    by_env = ["env_key"] if "env_key" in causes.columns else []
    first_file = first_per_key(
        services.select(
            F.col("name").alias("service_name"),
            F.try_element_at("file_paths", F.lit(1)).alias("service_file"), "env_key",
        ),
        [*by_env, "service_name"], [F.asc("env_key"), F.asc("service_file")], 1,
    ).select(*by_env, "service_name", "service_file")
    own = F.col("file_path") if "file_path" in causes.columns else F.lit(None).cast("string")
    path = F.coalesce(F.nullif(own, F.lit("")), F.col("service_file"))
    near = causes.where(F.col("rank") <= max_files).join(first_file, [*by_env, "service_name"], "left")
    found = near.withColumn("path", path).where(F.col("path").isNotNull())
    chosen = first_per_key(found, ["incident_id", "path"], [F.asc("rank")], 1).select(
        "incident_id", "path", "rank", "kind", "confidence"
    )
    if files is None:
        return chosen
    chosen = materialize(chosen, "fix-context")
    wanted = files.select("path", "source").join(chosen.select("path").distinct(), "path", "left_semi")
    bodies = first_per_key(wanted, ["path"], [F.asc("source")], 1).select(
        "path", truncate(F.col("source"), max_chars, f"... [truncated at {max_chars} chars]").alias("body")
    )
    # one file may serve many incidents
    return salted_join(chosen, bodies, ["path"], ["incident_id"])


def parse_diffs(replies: DataFrame) -> DataFrame:
    """Diff body (fenced or bare), files it touches and a headline per reply."""
    text = F.col("reply")
    grab = lambda pattern: F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))
    body = F.coalesce(grab(FENCED_DIFF), grab(BARE_DIFF))
    diff = F.coalesce(F.concat(body, F.lit("\n")), F.lit(""))
    lines = F.split(F.col("diff"), "\r\n|\n|\r")
    added = F.filter(lines, lambda x: F.startswith(x, F.lit("+++ ")))
    kept = F.filter(added, lambda x: ~F.startswith(x, F.lit("+++ /dev/null")))
    files = F.transform(kept, lambda x: strip(F.regexp_replace(x, r"^\+\+\+ (b/)?", "")))
    headline = F.coalesce(
        F.concat(F.lit("patches "), F.regexp_replace(F.try_element_at(added, F.lit(1)), r"^\+\+\+ ", "")),
        F.substring(F.try_element_at(lines, F.lit(1)), 1, 120),
    )
    return replies.withColumn("diff", diff).withColumn(
        "files", F.array_distinct(files)
    ).withColumn("headline", F.when(F.col("diff") != "", headline))


def fix_audit_for(audit: DataFrame, incident_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Audit rows of one incident, or of each; with ``limit`` the newest of each, ranked."""
    if incident_id is not None:
        audit = audit.where(F.col("incident_id") == incident_id)
    if limit is None:
        return audit
    return first_per_key(
        audit, ["incident_id"], [F.desc("ts"), F.desc("id")], limit, rank="rank"
    )


def recent_fixes(audit: DataFrame, limit: int = 20) -> DataFrame:
    return audit.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def fix_aggregates(audit: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Count and cost per outcome and in all."""
    return (
        trailing(audit, "ts", days, as_of).rollup("outcome")
        .agg(F.count(F.lit(1)).alias("fixes"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
        .select(F.coalesce("outcome", F.lit("(total)")).alias("outcome"), "fixes", "cost_usd")
    )
