"""Analytics of serving benchmarks: latencies, run summaries, telemetry, selection of variants and profiles, traces."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.mercator import HALF
from gridloom.functions.ranks import running, uniform
from gridloom.functions.shared import spread, written
from gridloom.operators import quantiles

#: What a run must keep to; the values of the published study.
ACCEPTANCE = {"hit_view_p95_seconds": 2.0, "render_view_p95_seconds": 5.0, "max_view_error_fraction": 0.01, "minimum_headroom_fraction": 0.25, "minimum_hit_fraction": 0.99}
LATENCIES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latencies(rows: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    """p50, p95 and p99 by linear interpolation at (n - 1) q."""
    return quantiles.summary(rows, keys, value, LATENCIES)


def nearest_ranks(rows: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    """p50, p95 and p99 as values that occur: the first whose share of rows reaches q."""
    return quantiles.summary(rows, keys, value, LATENCIES, discrete=True)


def run_summary(requests: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """requests, rates, errors, bytes, hits and latencies of each run, over requests (ok, cache, bytes, seconds)."""
    n = F.count("*")
    hits = F.count_if(F.col("cache") == "HIT")
    facts = [
        n.alias("requests"), (n / seconds).alias("requests_per_second"), F.count_if(~F.col("ok")).alias("errors"), (F.count_if(~F.col("ok")) / n).alias("error_fraction"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("response_bytes"), hits.alias("hits"), (hits / n).alias("hit_fraction"), F.count_distinct("user").alias("users"),
    ]
    return quantiles.summary(requests, keys, "seconds", LATENCIES, facts)


def cache_counts(requests: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a map of cache result to requests; keys' counts are reduced before they meet."""
    each = requests.groupBy(*keys, "cache").agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("cache", F.lit("")).alias("key"), F.col("n").alias("value"))))).alias("cache_counts"))


def validity_issues(summary: DataFrame, acceptance: dict = ACCEPTANCE, load_cpus: float = 4.0) -> DataFrame:
    """The summary with issues (an array) and valid; needs scenario, requests, views, exhausted, hit_fraction, lag_p95, cpu_p95."""
    issues = F.array_compact(F.array(
        F.when((F.col("requests") == 0) | (F.col("views") == 0), "no_network_samples"),
        F.when(F.col("exhausted") > 0, "finite_miss_trace_exhausted"),
        F.when((F.col("scenario") == "hit") & (F.col("hit_fraction") < acceptance["minimum_hit_fraction"]), "cache_hit_contract_failed"),
        F.when((F.coalesce("lag_p95", F.lit(0.0)) > 0.05) | (F.coalesce("cpu_p95", F.lit(0.0)) > load_cpus * 0.85), "generator_saturation"),
    ))
    return summary.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def deltas(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each sample with the change of `value` since the one before in its key, null for the first."""
    return samples.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def telemetry_summary(samples: DataFrame, keys: list[str], cpus: float, memory_gib: float) -> DataFrame:
    """p95 of processor use, throttled seconds, peaks and first-to-last differences of the measurement phase.

    samples: phase, monotonic, usage_usec, throttled_usec, memory_bytes, rss_bytes, heap_bytes,
    file_bytes, cache_bytes, available_bytes, io_bytes, gc_seconds. Steps without time are left out.
    """
    run = Window.partitionBy(*keys).orderBy("monotonic")
    rows = samples.where("phase = 'measurement'")
    dt = F.col("monotonic") - F.lag("monotonic").over(run)
    rows = rows.withColumn("dt", dt).withColumn("used", F.col("usage_usec") - F.lag("usage_usec").over(run)).withColumn("held", F.col("throttled_usec") - F.lag("throttled_usec").over(run))
    moved = F.col("dt") > 0
    change = lambda c: F.max_by(c, "monotonic") - F.min_by(c, "monotonic")
    rows = rows.withColumn("busy", F.when(moved, F.col("used") / 1e6 / F.col("dt") / cpus))
    made = quantiles.summary(rows, keys, "busy", {"cpu_utilization_p95": 0.95}, [
        F.count("*").alias("samples"),
        F.sum(F.when(moved, F.greatest(F.lit(0), F.coalesce("held", F.lit(0))) / 1e6)).alias("cpu_throttled_seconds"),
        F.max("memory_bytes").alias("peak_memory_bytes"), F.max("rss_bytes").alias("peak_rss_bytes"), F.max("heap_bytes").alias("peak_heap_bytes"), F.max("file_bytes").alias("peak_file_cache_bytes"),
        F.max("cache_bytes").alias("peak_cache_bytes"), F.min("available_bytes").alias("available_min_bytes"), change("io_bytes").alias("io_delta"), change("gc_seconds").alias("gc_delta"),
    ])
    complete = F.col("cpu_utilization_p95").isNotNull() & F.col("peak_memory_bytes").isNotNull() & F.col("peak_rss_bytes").isNotNull() & F.col("peak_heap_bytes").isNotNull()
    return made.withColumn("memory_utilization_peak", F.col("peak_memory_bytes") / (memory_gib * 2.0**30)).withColumn("complete", complete)


def job_matrix(variants: DataFrame, profiles: DataFrame, scenarios: list[str], repetitions: int, users: list[int]) -> DataFrame:
    """All cells of a study with a stable id. The dimensions are short lists, so a cross product is the result itself."""
    cells = variants.select("variant").crossJoin(profiles.select("profile"))
    cells = cells.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios]))).withColumn("users", F.explode(F.array(*[F.lit(u) for u in users])))
    cells = cells.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    return cells.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "variant", "profile", "scenario", "users", "repetition"), 256), 1, 16))


def _complete(runs: DataFrame, key: str, required: list[tuple[str, int]]) -> DataFrame:
    """Keys whose (scenario, repetition) are exactly the required ones: relational division by counting."""
    spark = runs.sparkSession
    need = F.broadcast(spark.createDataFrame(required, "scenario string, repetition int"))
    cells = runs.select(key, "scenario", "repetition").distinct().join(need.withColumn("needed", F.lit(1)), ["scenario", "repetition"], "left")
    n = len(set(required))
    return cells.groupBy(key).agg(F.count("needed").alias("good"), F.count("*").alias("all")).where((F.col("good") == n) & (F.col("all") == n)).select(key)


def shortlist(runs: DataFrame, required: list[tuple[str, int]]) -> DataFrame:
    """The best variant of each class (lossless or not) by mean error, mean p95, then name; only complete matrices compete.

    runs: variant, lossless, scenario, repetition, valid, error_fraction, p95.
    """
    good = runs.where("valid")
    scored = good.join(_complete(good, "variant", required), "variant").groupBy("lossless", "variant").agg(F.avg("error_fraction").alias("error"), F.avg("p95").alias("p95"))
    best = F.min(F.struct("error", "p95", "variant"))
    return scored.where("variant <> 'none'").groupBy("lossless").agg(best.alias("b")).select("lossless", "b.variant", "b.error", "b.p95")


def qualify(runs: DataFrame, required: list[tuple[str, int]], acceptance: dict = ACCEPTANCE) -> DataFrame:
    """(variant, profile, cpus, memory_gib, reasons, qualifies) of capacity runs; reasons name what fails, sorted.

    runs: variant, profile, cpus, memory_gib, scenario, repetition, valid, p95, error_fraction, cpu_p95, memory_peak.
    """
    limit = F.when(F.col("scenario") == "hit", acceptance["hit_view_p95_seconds"]).otherwise(acceptance["render_view_p95_seconds"])
    head = 1 - acceptance["minimum_headroom_fraction"]
    over = lambda c, v: F.col(c).isNull() | v
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce("valid", F.lit(False)), "invalid, unfinished or synthetic evidence"), F.when(over("p95", F.col("p95") >= limit), "view latency target"),
        F.when(F.col("error_fraction") >= acceptance["max_view_error_fraction"], "view error target"), F.when(over("cpu_p95", F.col("cpu_p95") > head), "CPU headroom"),
        F.when(over("memory_peak", F.col("memory_peak") > head), "memory headroom"),
    ))
    spark = runs.sparkSession
    need = F.broadcast(spark.createDataFrame(required, "scenario string, repetition int").withColumn("needed", F.lit(1)))
    rows = runs.withColumn("why", reasons).join(need, ["scenario", "repetition"], "left")
    n = len(set(required))
    keys = ["variant", "profile", "cpus", "memory_gib"]
    made = rows.groupBy(*keys).agg(
        F.flatten(F.collect_set("why")).alias("why"), F.count("*").alias("rows"), F.count_distinct(F.when(F.col("needed") == 1, F.struct("scenario", "repetition"))).alias("cells"), F.count_if(F.col("needed").isNull()).alias("other")
    )
    gap = F.when((F.col("rows") != n) | (F.col("cells") != n) | (F.col("other") > 0), F.array(F.lit("incomplete scenario/repetition matrix"))).otherwise(F.array().cast("array<string>"))
    return made.withColumn("reasons", F.array_sort(F.array_distinct(F.concat("why", gap)))).select(*keys, "reasons", (F.size("reasons") == 0).alias("qualifies"))


def smallest_profiles(decisions: DataFrame) -> DataFrame:
    """The qualifying profile of each variant with the fewest processors, then the least memory."""
    best = F.min(F.struct("cpus", "memory_gib", "profile"))
    return decisions.where("qualifies").groupBy("variant").agg(best.alias("b")).select("variant", "b.profile", "b.cpus", "b.memory_gib")


def repeated_means(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg(F.when(F.col("valid"), F.col("p95"))).alias("mean_p95"), F.count_if("valid").alias("valid_runs"), F.count("*").alias("runs"))


#: Values of a key that one row may hold to draw from; draws of larger keys are joined with their ranked values.
HELD = 65_536
#: Resamples of a key that one row draws.
AT_ONCE = 10


def _held_means(held: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(key, r, mean) of keys whose values fit in a row each: rows of a key's sorted values and AT_ONCE resamples are dealt, so draws are looked up where they are made."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = held.groupBy("key").agg(F.sort_array(F.collect_list("v")).alias("vs")).where(F.size("vs") > 1)
    # a given number of partitions is kept: the rows are few, their draws are not
    dealt = sorted_.select("key", "vs", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(AT_ONCE))).alias("low")).repartition(parts, "key", "low")
    draws = dealt.select("key", "vs", F.explode(F.sequence("low", F.least(F.col("low") + AT_ONCE, F.lit(resamples)) - 1)).alias("r"))
    draws = draws.select("key", "vs", "r", F.explode(F.sequence(F.lit(0), F.size("vs") - 1)).alias("d"))
    at = F.floor(uniform(seed, F.col("key"), F.col("r"), F.col("d")) * F.size("vs")).cast("int")
    return draws.select("key", "r", F.get("vs", at).alias("v")).groupBy("key", "r").agg(F.avg("v").alias("mean"))


def _joined_means(held: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The same of keys of any size: values are ranked by ranges, each starts one draw of every resample where it lies, and draws are joined with the values."""
    ranked = running(held, ["key", "v"])
    first = ranked.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ranked = ranked.join(first, "key").select("key", "n", (F.col("place") - F.col("first")).alias("i"), "v")
    draws = ranked.where("n > 1").select("key", "n", F.col("i").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    drawn = draws.select("key", "r", F.floor(uniform(seed, F.col("key"), F.col("r"), F.col("d")) * F.col("n")).alias("i"))
    return drawn.join(ranked.select("key", "i", "v").hint("merge"), ["key", "i"]).groupBy("key", "r").agg(F.avg("v").alias("mean"))


def bootstrap(runs: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 1234) -> DataFrame:
    """(key, n, low, high): the 95 % interval of the mean of a key's repeated runs, by resampling; null under two runs.

    Draw d of resample r takes the value of that rank which a hash of (seed, key, r, d) points at, so results are the
    same on every run. Keys of up to HELD values are dealt as rows that hold them, a row for each AT_ONCE resamples; of larger keys
    each ranked value starts its draws where it lies, and they meet the values in a shuffle. Hashes are `resamples` times the runs.
    """
    rows = written(runs.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")))
    every, held = rows.groupBy("key").agg(F.count("v").alias("n")), rows.where("v is not null")
    if (every.agg(F.max("n")).first()[0] or 0) <= HELD:
        means = _held_means(held, resamples, seed)
    else:
        sized = held.join(every, "key")
        small, large = (sized.where(c).select("key", "v") for c in (F.col("n") <= HELD, F.col("n") > HELD))
        means = _held_means(small, resamples, seed).unionByName(_joined_means(large, resamples, seed))
    spread = means.groupBy("key").agg(*[F.percentile("mean", q).alias(c) for q, c in ((0.025, "low"), (0.975, "high"))])
    return every.join(spread, "key", "left").select(F.col("key").alias(key), "n", "low", "high")


def seed_prefix(weights: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """The rows of a shuffled order up to the one whose running weight reaches the fraction: kept if the sum before it is short.

    weights has a row per metatile of one workload; the running sum is taken range by range of the order.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    placed = running(weights, order, add="weight").drop("place")
    return placed.join(F.broadcast(total), F.lit(True)).where(F.col("before") < F.col("total") * fraction).drop("total")


def metatile_weights(views: DataFrame, size: int = 4) -> DataFrame:
    """(z, x, y, weight): how often the tiles of each metatile are asked for in views with an array of tiles."""
    tile = views.select(F.explode("tiles").alias("t"))
    return tile.groupBy(F.col("t.z").alias("z"), F.floor(F.col("t.x") / size).alias("x"), F.floor(F.col("t.y") / size).alias("y")).agg(F.count("*").alias("weight"))


def tile_reuse(views: DataFrame) -> DataFrame:
    """Each view with needed and reused: the tiles that the user's view before lacked or had; a failed one counts as none."""
    run = Window.partitionBy("user").orderBy("view")
    empty = F.slice("tiles", 1, 0)
    held = F.coalesce(F.when(F.lag("ok").over(run), F.lag("tiles").over(run)), empty)
    rows = views.withColumn("held", held)
    return rows.withColumn("needed", F.array_except("tiles", "held")).withColumn("reused", F.array_intersect("tiles", "held")).drop("held")


def round_robin(pool: DataFrame, order: list[str], users: int) -> DataFrame:
    """The pool dealt to users in turn."""
    return running(pool, order, place="user").withColumn("user", F.pmod("user", F.lit(users)).cast("int"))


#: How often a view comes about in each way.
ACTIONS = {"pan": 0.55, "zoom": 0.25, "revisit": 0.1, "relocate": 0.1}
#: Views that a revisit reaches back.
REVISITED = 8


def make_traces(users: DataFrame, regions: list[tuple[str, float, float]], zooms: tuple[int, int], views: int, extent: tuple[float, float, float, float], viewport: tuple[int, int] = (1280, 720), think: tuple[float, float] = (0.5, 2.5), seed: int = 7) -> DataFrame:
    """(user, view, action, zoom, x, y, region, think): a reproducible session of each user, all in column expressions.

    users: user long. regions: name and Mercator metres of their centres; a user starts in one. A view pans by 0.6 of
    the width and 0.4 of the height of the viewport, changes the zoom by one, returns to one of the last REVISITED
    views, or moves to a region. Centres stay so far inside the extent (west, south, east, north in metres) that
    the viewport does too, at a zoom deep enough for that. Every choice is a hash of seed, user, view and what is chosen.
    """
    half = HALF
    fit = max(0, *[math.ceil(math.log2(n * 2 * half / (256 * (b - a)))) for n, a, b in ((viewport[0], extent[0], extent[2]), (viewport[1], extent[1], extent[3]))])
    spots = F.array(*[F.struct(F.lit(n).alias("region"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, x, y in regions])

    def kept(action, zoom, x, y, region, view):
        """One view, with its zoom and centre inside the extent."""
        z = F.greatest(F.lit(fit), zoom).cast("int")
        metre = F.lit(2 * half / 256) / F.pow(F.lit(2.0), z)
        inside = lambda v, n, a, b: F.greatest(F.lit(a) + metre * (n / 2), F.least(F.lit(b) - metre * (n / 2), v))
        return F.struct(
            view.cast("int").alias("view"), action.alias("action"), z.alias("zoom"), inside(x, viewport[0], extent[0], extent[2]).alias("x"),
            inside(y, viewport[1], extent[1], extent[3]).alias("y"), region.alias("region"),
        )

    u = lambda view, what: uniform(seed, F.col("user"), view, what)
    place = lambda view: F.element_at(spots, (F.floor(u(view, "region") * len(regions)) + 1).cast("int"))
    home = place(F.lit(-1))
    low, high = zooms
    start = kept(F.lit("start"), F.lit(low) + F.floor(u(F.lit(-1), "zoom") * (high - low + 1)), home["x"], home["y"], home["region"], F.lit(-1))

    # every hash of a view once; what follows from the views before is left to the fold
    chances = lambda view: F.struct(view.alias("view"), *[u(view, c).alias(c) for c in ("action", "back", "region", "across", "up", "turn")])

    def step(seen, c):
        last, view, action = F.element_at(seen, -1), c["view"], F.lit(None).cast("string")
        for name, stop in reversed(list(zip(ACTIONS, itertools.accumulate(ACTIONS.values()), strict=True))):
            action = F.when(c["action"] < stop, name).otherwise(F.lit(name) if name == list(ACTIONS)[-1] else action)
        back = F.element_at(seen, -(F.floor(c["back"] * F.greatest(F.lit(1), F.least(view, F.lit(REVISITED)))) + 1).cast("int"))
        there = F.element_at(spots, (F.floor(c["region"] * len(regions)) + 1).cast("int"))
        metre = F.lit(2 * half / 256) / F.pow(F.lit(2.0), last["zoom"])
        along = F.when(c["across"] < 0.5, -1.0).otherwise(1.0) * metre * (0.6 * viewport[0])
        up = (F.floor(c["up"] * 3) - 1) * metre * (0.4 * viewport[1])
        turn = F.when(c["turn"] < 0.5, -1).otherwise(1)
        by = lambda pan, zoom, revisit, relocate: F.when(action == "pan", pan).when(action == "zoom", zoom).when(action == "revisit", revisit).otherwise(relocate)
        return F.concat(seen, F.array(kept(
            action, by(last["zoom"], F.greatest(F.lit(low), F.least(F.lit(high), last["zoom"] + turn)), back["zoom"], last["zoom"]), by(last["x"] + along, last["x"], back["x"], there["x"]),
            by(last["y"] + up, last["y"], back["y"], there["y"]), by(last["region"], last["region"], back["region"], there["region"]), view,
        )))

    sessions = spread(users).select("user", F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(views - 1)), chances), F.array(start), step).alias("views"))
    rows = sessions.select("user", F.explode(F.slice("views", 2, views)).alias("v")).select("user", "v.*")
    return rows.withColumn("think", F.lit(think[0]) + uniform(seed, F.col("user"), F.col("view"), "think") * (think[1] - think[0]))


def audit_rollup(events: DataFrame, agent: str = "aws-sdk-java/") -> DataFrame:
    """Per object: requests, bytes, whether all were range reads, and misses, of the storage client's GetObject calls."""
    own = events.where(F.col("user_agent").startswith(agent) & (F.col("api") == "GetObject"))
    return own.groupBy("object").agg(
        F.count("*").alias("requests"), F.sum(F.coalesce("content_length", F.lit(0))).alias("bytes"), F.bool_and(F.col("range").isNotNull()).alias("all_ranged"), F.count_if(F.col("status") == 404).alias("missing")
    )


def request_flags(requests: DataFrame, slow_ms: float = 5000.0) -> DataFrame:
    """Requests with slow, failed and flagged (either, once)."""
    failed = ~F.col("ok") | F.coalesce(F.col("status") >= 400, F.lit(False))
    return requests.withColumn("slow", F.col("total_ms") >= slow_ms).withColumn("failed", failed).withColumn("flagged", F.col("slow") | F.col("failed"))


def attempts(log: DataFrame, most: int = 3) -> DataFrame:
    """Per tile: attempts, whether any succeeded, and whether it was given up after `most`."""
    return log.groupBy("tile").agg(F.max("attempt").alias("attempts"), F.bool_or("ok").alias("done")).withColumn("failed", ~F.col("done") & (F.col("attempts") >= most))


def final_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("phase").agg(F.count("*").alias("cells"), F.sum("views").alias("views"), F.sum("requests").alias("requests"), F.sum("failed_views").alias("failed_views"), F.max("p95").alias("worst_p95"))


def common_snapshot(files: DataFrame, pattern: str = r"-(\d{6})\.osm\.pbf") -> DataFrame:
    """The newest date that every region has a file of; region, name in, one row or none out."""
    dated = files.select("region", F.explode(F.regexp_extract_all("name", F.lit(pattern), F.lit(1))).alias("date")).distinct()
    regions = files.agg(F.count_distinct("region").alias("regions"))
    return dated.groupBy("date").agg(F.count("*").alias("n")).join(F.broadcast(regions), F.col("n") == F.col("regions")).agg(F.max("date").alias("date")).where("date is not null")


def flattened(summary: DataFrame, between: str = "_") -> DataFrame:
    """A nested summary as flat columns: a field of a struct is named after both."""

    def leaves(kind, path: tuple[str, ...]):
        for f in kind.fields:
            if hasattr(f.dataType, "fields"):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return summary.select(*[F.col(".".join(f"`{x}`" for x in path)).alias(between.join(path)) for path in leaves(summary.schema, ())])


def variant_report(variants: DataFrame, compatibility: DataFrame, quality: DataFrame) -> DataFrame:
    """Every variant with whether it can be served and its quality; status says why one can't be recommended.

    variants: variant. compatibility: variant, compatible, full_data. quality: variant, psnr. A variant whose
    compatibility was only seen on samples is downgraded.
    """
    rows = variants.select("variant").join(compatibility, "variant", "left").join(quality, "variant", "left")
    status = F.when(F.col("compatible").isNull(), "unprobed").when(~F.col("compatible"), "incompatible").when(~F.coalesce("full_data", F.lit(False)), "downgraded").when(F.col("psnr").isNull(), "unmeasured").otherwise("ok")
    return rows.select("variant", F.coalesce("compatible", F.lit(False)).alias("compatible"), "psnr", status.alias("status"))


def matrix_totals(cells: DataFrame, seconds: float) -> DataFrame:
    """Cells and hours of each phase of a study, with a last row for all."""
    return cells.rollup("phase").agg(F.count("*").alias("cells"), (F.count("*") * seconds / 3600).alias("hours"))


def status_counts(log: DataFrame) -> DataFrame:
    """Rows of each status."""
    return log.groupBy("status").agg(F.count("*").alias("n"))
