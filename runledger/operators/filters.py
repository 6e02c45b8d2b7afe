"""Search, recency, presets."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY
from ..functions.timing import moment_like
from ..functions.wildcards import column_like, pattern_list, validation_message
from .jobs import TEAM_TAG, latest_jobs, tag_text

# Named time ranges in days; anything else counts as 7.
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90}
DEFAULT_RANGE_DAYS = 7
# A hot block of jobs (one team, or all of them) is spread over this many tasks.
BLOCK_SALTS = 16
# The jobs that one pattern list selects meet its presets in this many parts.
LIST_SALTS = 128
# More jobs than these make their name hot.
SHARED_BY = 1000
GRAM = 3


def recent_jobs(health: DataFrame, as_of_ts: datetime, hours: int) -> DataFrame:
    """Jobs whose last run started within ``hours`` before ``as_of_ts``."""
    cutoff = moment_like(health, "last_run_time", as_of_ts - timedelta(hours=hours))
    return health.filter(F.col("last_run_time") >= cutoff)


def search_jobs(health: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of the job's name or id."""
    if not text.strip():
        return health
    needle = F.lit(text.lower())
    return health.filter(
        F.lower("job_name").contains(needle) | F.col("job_id").cast("string").contains(needle)
    )


def validate_patterns(presets: DataFrame) -> DataFrame:
    """Every pattern of every preset with its error message, NULL when usable."""
    pattern = F.explode(F.split(F.coalesce("job_name_patterns", F.lit("")), ","))
    return presets.select("id", pattern.alias("pattern")).withColumn("message", validation_message(F.col("pattern")))


def list_presets(presets: DataFrame) -> DataFrame:
    """Shared presets, newest first."""
    return presets.filter("is_shared").orderBy(F.col("created_at").desc(), "id")


def apply_preset_changes(presets: DataFrame, upserts: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    """Preset table after a batch of inserts, updates and deletes; columns new to either side are kept."""
    changed = upserts.select("id").unionByName(deleted_ids.select("id"))
    kept = presets.join(changed, "id", "left_anti")
    return kept.unionByName(upserts, allowMissingColumns=True)


def preset_ranges(presets: DataFrame, as_of: date) -> DataFrame:
    """Adds ``range_start`` and ``range_end``; custom ranges use the preset's own dates."""
    end = F.coalesce(F.col("end_date").try_cast("date"), F.lit(as_of))
    days = F.lit(DEFAULT_RANGE_DAYS)
    for name, length in RANGE_DAYS.items():
        days = F.when(F.col("time_range") == name, length).otherwise(days)
    custom = (F.col("time_range") == "custom") & F.col("start_date").isNotNull()
    start = F.when(custom, F.col("start_date").try_cast("date")).otherwise(F.date_sub(end, days))
    return presets.withColumn("range_end", end).withColumn("range_start", start)


def _grams(text: Column) -> Column:
    """Distinct three-letter pieces of a name; none for shorter names."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    pieces = F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _pattern_gram(pattern: Column) -> Column:
    """First three letters of the first literal stretch of a pattern that has as many, else NULL."""
    stretches = F.filter(F.split(F.lower(pattern), r"[*?]+"), lambda s: F.length(s) >= GRAM)
    return F.substring(F.get(stretches, F.lit(0)), 1, GRAM)


def _all_salts(salts: int = BLOCK_SALTS) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


def _salt(*columns: str, salts: int = BLOCK_SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def matching_names(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of distinct ``pattern`` and distinct ``job_name`` where the name matches, with the other columns of ``names``.

    A pattern meets only names that contain a letter triple it demands, as an equi-join; a
    pattern without one meets all names through the '*' block. Every block of names is spread
    by a salt, for which the (short) pattern list is repeated.
    """
    pattern = F.col("pattern")
    wanted = patterns.select(
        "pattern",
        column_like(pattern).alias("like"),
        F.coalesce(_pattern_gram(pattern), F.lit("*")).alias("block"),
        _all_salts().alias("salt"),
    )
    blocks = F.concat(F.array(F.lit("*")), _grams(F.lower("job_name")))
    offered = names.select("*", _salt("job_name").alias("salt"), F.explode(blocks).alias("block"))
    return (
        offered.join(wanted, ["block", "salt"])
        .filter(F.ilike(F.col("job_name"), F.col("like")))
        .select("pattern", *names.columns)
    )


def _preset_lists(wanted: DataFrame) -> DataFrame:
    """One row per preset with patterns, all its patterns in one sorted list; presets without any as they are."""
    same = ["preset_id", "preset_team", "preset_job", "range_start", "range_end"]
    listed = wanted.filter(F.size("patterns") > 0).groupBy(*same)
    patterns = F.array_sort(F.array_distinct(F.flatten(F.collect_list("patterns"))))
    return listed.agg(patterns.alias("patterns")).unionByName(wanted.filter(F.size("patterns") == 0))


def _blocks(teams: Column) -> Column:
    """Jobs of all teams, and those of each of ``teams``."""
    return F.explode(F.concat(F.array(F.lit("all")), F.transform(teams, lambda t: F.concat(F.lit("team:"), t))))


def _matching_lists(patterns: DataFrame, lists: DataFrame, known: DataFrame) -> DataFrame:
    """For every ``job_name`` and ``block`` the distinct ``patterns`` lists that match, and how many ``jobs`` have the name."""
    names = known.groupBy("job_name").agg(F.count("*").alias("jobs"), F.collect_set("team").alias("teams"))
    pairs = matching_names(patterns, names).select("pattern", "job_name", "jobs", _blocks(F.col("teams")).alias("block"))
    by_pattern = lists.withColumn("pattern", F.explode("patterns"))
    return pairs.join(by_pattern, ["pattern", "block"]).drop("pattern").distinct()


def apply_presets(presets: DataFrame, jobs: DataFrame, as_of: date, ids: list[str] | None = None) -> DataFrame:
    """Jobs selected by every preset, or by those named in ``ids``: its team, its job and any of its name patterns.

    Presets that name a job meet the jobs of that id. The others select by team and pattern list
    alone: a list is matched once per distinct name, a job meets each distinct list of its team and
    of all teams once, and only then, without a further condition, the presets that have the list:
    their pairs are the result and may be many. Every join is an equi-join.
    """
    chosen = presets if ids is None else presets.filter(F.col("id").isin(ids))
    given = preset_ranges(chosen, as_of).select(
        F.col("id").alias("preset_id"),
        F.col("team").alias("preset_team"),
        F.col("job_id").alias("preset_job"),
        pattern_list(F.col("job_name_patterns")).alias("patterns"),
        "range_start",
        "range_end",
    )
    wanted = _preset_lists(given)
    name = F.coalesce("name", F.concat(F.lit("job-"), F.col("job_id").cast("string")))
    known = latest_jobs(jobs).select(*JOB_KEY, name.alias("job_name"), tag_text(TEAM_TAG).alias("team"))
    columns = ["preset_id", *JOB_KEY, "job_name", "range_start", "range_end"]

    of_job = wanted.filter(F.col("preset_job").isNotNull()).withColumn("salt", _all_salts())
    in_team = F.col("preset_team").isNull() | F.col("team").eqNullSafe(F.col("preset_team"))
    matched = (F.size("patterns") == 0) | F.exists("patterns", lambda p: F.ilike(F.col("job_name"), column_like(p)))
    by_id = known.withColumn("salt", _salt(*JOB_KEY)).withColumn("preset_job", F.col("job_id").cast("string"))
    with_job = by_id.join(of_job, ["preset_job", "salt"]).filter(in_team & matched).select(*columns)

    team = F.concat(F.lit("team:"), "preset_team")
    of_block = wanted.filter(F.col("preset_job").isNull()).withColumn("block", F.coalesce(team, F.lit("all")))
    offered = known.withColumn("block", _blocks(F.array_compact(F.array("team")))).drop("team")
    patterns = given.filter(F.col("preset_job").isNull()).select(F.explode("patterns").alias("pattern")).distinct()
    lists = of_block.filter(F.size("patterns") > 0).select("block", "patterns").distinct()
    fitting = _matching_lists(patterns, lists, known)
    # A name that many jobs share is copied to all salts, any other name to salt -1; a job looks at both.
    copies = F.when(F.col("jobs") > SHARED_BY, F.sequence(F.lit(0), F.lit(BLOCK_SALTS - 1))).otherwise(F.array(F.lit(-1)))
    dealt = offered.withColumn("salt", F.explode(F.array(F.lit(-1), _salt(*JOB_KEY))))
    listed = dealt.join(fitting.withColumn("salt", F.explode(copies)), ["job_name", "block", "salt"])
    unlisted = offered.withColumn("patterns", F.array().cast("array<string>"))
    selecting = unlisted.unionByName(listed.select(*unlisted.columns)).withColumn("salt", _salt(*JOB_KEY, salts=LIST_SALTS))
    dealt_presets = of_block.withColumn("salt", _all_salts(LIST_SALTS))
    # A fixed number of tasks, as few rows in make many rows out, and bytes read do not tell how much
    # work a task has. The merge hint: the copies look small enough to broadcast, but may not be.
    parts, on = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["block", "patterns", "salt"]
    met = selecting.repartition(parts, *on).join(dealt_presets.repartition(parts, *on).hint("merge"), on)
    return with_job.unionByName(met.select(*columns))
