"""The registered queries of the gap analytics, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, strings
from ..operators import classify, ingest, match, smooth, spine, survival, thresholds, trend
from ..operators.frontier import GROUP, best_per_key, cumulative_rank, frontier, records_with_baseline, strict_records
from ..schema import to_canonical
from ..operators.spacing import packed, spaced
from ..sources import blocks, files, linked, scores
from . import publish
from .bindings import as_of, events, orders, table, with_draws

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Small parameter tables, as adapters would have them.
PRICE_OVERRIDES = [("Supplier#000000001", "Open weights"), ("Supplier#000000002", "API access")]


def query(f: Query) -> Query:
    if f.__name__ in _QUERIES:
        raise ValueError(f"two queries are named {f.__name__}")
    _QUERIES[f.__name__] = f
    return f


def _r(c: str | Column, places: int = 6, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, places).alias(name or c)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def front(spark: SparkSession, sf: str) -> DataFrame:
    return frontier(orders(spark, sf))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return match.first_catchup(front(spark, sf), as_of())


# frontiers


@query
def cumulative_rank_events(spark, sf):
    return cumulative_rank(events(spark, sf)).select("benchmark_id", "model", "rank")


@query
def cumulative_rank_top_n(spark, sf):
    return cumulative_rank(events(spark, sf), top=3).filter("rank is not null").select("benchmark_id", "model", "rank")


@query
def frontier_with_ties(spark, sf):
    return front(spark, sf).select("benchmark_id", "is_laggard", "model", "date", "score")


@query
def frontier_events(spark, sf):
    return frontier(events(spark, sf)).select("benchmark_id", "is_laggard", "model", "date", "score")


@query
def strict_records_orders(spark, sf):
    return strict_records(orders(spark, sf)).select("benchmark_id", "is_laggard", "model", "date", "score")


@query
def records_since_baseline(spark, sf):
    return records_with_baseline(orders(spark, sf), F.lit("1995-06-01").cast("date")).select("benchmark_id", "is_laggard", "model", "date", "score")


@query
def best_variant_per_key(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return best_per_key(rows, ["l_partkey"], "l_extendedprice", [F.col("l_orderkey"), F.col("l_linenumber")])


@query
def argmax_first_tie(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return best_per_key(rows, ["l_suppkey"], "l_quantity", [F.col("l_orderkey"), F.col("l_linenumber")])


# catching up


@query
def first_catchup_analytical(spark, sf):
    return rounded(gaps(spark, sf))


@query
def first_catchup_threshold(spark, sf):
    return rounded(match.first_catchup(front(spark, sf).withColumn("score_std", F.lit(None).cast("double")), as_of()))


@query
def unmatched_age(spark, sf):
    return gaps(spark, sf).filter("not matched").select("benchmark_id", "lead_model", "gap_days", _r("gap_months"))


@query
def match_counts(spark, sf):
    return gaps(spark, sf).groupBy("benchmark_id").agg(F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_unmatched"), F.bool_or(F.col("match_type") == "analytical").alias("any_analytical"))


@query
def frontier_match_pairs(spark, sf):
    return match.frontier_match_map(strict_records(orders(spark, sf)))


@query
def frontier_match_map(spark, sf):
    maps = match.match_map(match.frontier_match_map(strict_records(orders(spark, sf))))
    return maps.select("benchmark_id", F.size("matches").cast("bigint").alias("n_laggards"), F.size(F.map_filter("matches", lambda k, v: v.isNotNull())).cast("bigint").alias("n_matched"))


def _draws(spark, sf):
    """Each vector's draws and those of the next one of its label."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("x"))
    ids = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("a"))  # vectors stay out of the window
    ids = ids.withColumn("b", F.lead("a").over(Window.partitionBy("label").orderBy("a"))).filter("b is not null")
    return ids.join(v, "a").join(v.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")


@query
def paired_probability(spark, sf):
    return _draws(spark, sf).select("a", "b", _r(match.prob_exceeds(F.col("x"), F.col("y")), 6, "probability"))


@query
def caught_up_draws(spark, sf):
    p = match.prob_exceeds(F.col("x"), F.col("y"))
    none = F.lit(None).cast("double")
    caught = match.caught_up(F.lit(0.0), none, F.lit(100.0), none, probability=p)
    return _draws(spark, sf).select("a", "b", caught.alias("caught"), match.match_method(none, none, p).alias("method"))


@query
def matched_semi(spark, sf):
    leaders = front(spark, sf).filter("not is_laggard")
    return match.with_matched_flag(leaders, gaps(spark, sf), True).select("benchmark_id", "model", "date", "score")


@query
def unmatched_semi(spark, sf):
    leaders = front(spark, sf).filter("not is_laggard")
    return match.with_matched_flag(leaders, gaps(spark, sf), False).select("benchmark_id", "model", "date", "score")


@query
def unmatched_anti(spark, sf):
    o = orders(spark, sf)
    return match.preserve_missing(o.filter("benchmark_id <> 'P'"), o.filter("benchmark_id <> 'F'"), "benchmark_id").groupBy("benchmark_id").agg(F.count("*").alias("n"), _r(F.sum("score"), 2, "total"))


@query
def nearest_event(spark, sf):
    f = front(spark, sf)
    return match.nearest_event(f.filter("is_laggard"), f.filter("not is_laggard"))


@query
def prev_gap(spark, sf):
    return match.previous_gap(gaps(spark, sf)).select("benchmark_id", "lead_model", _r("gap_months"), _r("prev_gap_months"))


@query
def step_vertices(spark, sf):
    return rounded(match.step_vertices(gaps(spark, sf)))


@query
def region_framing_gap(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    framed = o.filter(F.col("r_name").isin("ASIA", "AMERICA"))
    rows = to_canonical(framed, {"benchmark_id": "o_orderstatus", "model": "o_orderkey", "date": F.col("o_orderdate").cast("date"), "score": "o_totalprice", "is_laggard": F.col("r_name") == "ASIA"})
    return rounded(match.first_catchup(frontier(rows), as_of()))


# calendars


@query
def daily_gap_series(spark, sf):
    return rounded(spine.daily_gap(front(spark, sf)))


@query
def gap_metrics(spark, sf):
    return rounded(spine.gap_metrics(spine.daily_gap(front(spark, sf))))


@query
def gap_metrics_windowed(spark, sf):
    bounds = [F.lit(d).cast("date") for d in ("1997-01-01", "1997-12-31")]
    return rounded(spine.gap_metrics(spine.daily_gap(front(spark, sf), start=bounds[0], end=bounds[1])))


@query
def gap_metrics_overall(spark, sf):
    """All statuses as one benchmark: the headline number."""
    f = frontier(orders(spark, sf).withColumn("benchmark_id", F.lit("all")).withColumn("score_std", F.lit(None).cast("double")))
    return rounded(spine.gap_metrics(spine.daily_gap(f)))


@query
def vertical_gap_daily(spark, sf):
    return rounded(spine.vertical_daily(front(spark, sf)))


@query
def historical_monthly_gap(spark, sf):
    return rounded(spine.historical_gap(front(spark, sf), as_of()))


@query
def month_spine_clamped(spark, sf):
    """Month steps from the 31st: a short month's day stays."""
    bounds = table(spark, sf, "region").select(F.col("r_name").alias("benchmark_id"), F.date_add(F.lit("2023-12-27").cast("date"), F.col("r_regionkey")).alias("a"), F.lit("2025-06-30").cast("date").alias("z"))
    return spine.month_spine(bounds, "a", "z").select("benchmark_id", "day")


@query
def statistics_row(spark, sf):
    f = front(spark, sf)
    return rounded(spine.statistics(f, match.first_catchup(f, as_of()), spine.gap_metrics(spine.daily_gap(f))))


# thresholds


def _points(spark, sf):
    return thresholds.threshold_datapoints(orders(spark, sf), as_of())


@query
def threshold_first_crosser(spark, sf):
    return rounded(_points(spark, sf).drop("accepted"))


@query
def threshold_accepted_pairs(spark, sf):
    return rounded(_points(spark, sf).filter("accepted").select("benchmark_id", "threshold", "lead_model", "lag_model", "gap_days", "gap_months"))


@query
def threshold_summary(spark, sf):
    return rounded(thresholds.threshold_summary(_points(spark, sf)))


@query
def threshold_pooled_medians(spark, sf):
    access = F.when(F.col("benchmark_id") == "P", F.lit("private")).otherwise(F.lit("public"))
    return rounded(thresholds.pooled_medians(_points(spark, sf), access))


@query
def threshold_pool_sorted(spark, sf):
    order = Window.orderBy("lag_date", "benchmark_id", "threshold")
    return _points(spark, sf).filter("accepted").select("benchmark_id", "lag_date", _r("threshold"), F.row_number().over(order).cast("bigint").alias("position"))


@query
def auto_grid(spark, sf):
    return rounded(thresholds.auto_grid(orders(spark, sf)))


@query
def auto_grid_percent(spark, sf):
    return rounded(thresholds.auto_grid(_discounts(spark, sf, 900.0).unionByName(_discounts(spark, sf, 1.0).withColumn("benchmark_id", F.lit("share")))))


@query
def validity_floor(spark, sf):
    return rounded(thresholds.validity_floor(events(spark, sf)))


@query
def kernel_smooth(spark, sf):
    points = _points(spark, sf).filter("accepted").select(F.col("lag_date").alias("date"), F.col("gap_months").alias("value"), F.lit("all").alias("pool"))
    return rounded(smooth.kernel_smooth(points, ["pool"], bandwidth=180.0, min_weight=1.0))


@query
def kernel_smooth_bootstrap(spark, sf):
    points = _points(spark, sf).filter("accepted").select(F.col("lag_date").alias("date"), F.col("gap_months").alias("value"), F.lit("all").alias("pool"))
    return rounded(smooth.kernel_smooth_bootstrap(points, ["pool"], bandwidth=180.0, min_weight=1.0))


# trends


def _discounts(spark, sf, times: float):
    rows = table(spark, sf, "lineitem")
    return to_canonical(rows, {"benchmark_id": "l_returnflag", "model": "l_orderkey", "date": F.col("l_shipdate").cast("date"), "score": F.col("l_discount") * times, "is_laggard": F.col("l_linestatus") == "O"})


@query
def trend_linear_exponential(spark, sf):
    return rounded(trend.trends(orders(spark, sf), ["benchmark_id"]), 4)


@query
def trend_frontier(spark, sf):
    return rounded(trend.trends(front(spark, sf), ["benchmark_id", "is_laggard"]), 4)


@query
def trend_logit(spark, sf):
    return rounded(trend.trends(_discounts(spark, sf, 900.0), ["benchmark_id"], bounded=True), 4)


@query
def trend_split_periods(spark, sf):
    return rounded(trend.trends(trend.with_periods(orders(spark, sf), ["benchmark_id"]), ["benchmark_id", "period"]), 4)


@query
def trend_fixed_split(spark, sf):
    return rounded(trend.trends(trend.with_periods(orders(spark, sf), ["benchmark_id"], F.lit("1997-04-01").cast("date")), ["benchmark_id", "period"]), 4)


@query
def trend_gap_point(spark, sf):
    return rounded(trend.trend_gap(front(spark, sf)), 4)


@query
def trend_gap_log(spark, sf):
    return rounded(trend.trend_gap(front(spark, sf), "log"), 4)


@query
def trend_gap_bootstrap(spark, sf):
    return rounded(trend.trend_gap_bootstrap(frontier(orders(spark, sf).withColumn("benchmark_id", F.lit("all"))), n_boot=2000), 4)


@query
def lag_bracket_linear(spark, sf):
    return rounded(trend.lag_bracket(front(spark, sf)))


@query
def lag_bracket_log(spark, sf):
    return rounded(trend.lag_bracket(front(spark, sf), "log"))


@query
def lag_bracket_logit(spark, sf):
    return rounded(trend.lag_bracket(frontier(_discounts(spark, sf, 900.0)), "logit"))


# the current gap


@query
def lognormal_prior(spark, sf):
    return rounded(survival.lognormal_prior(gaps(spark, sf), ["benchmark_id"]))


@query
def current_gap_estimate(spark, sf):
    return rounded(survival.current_gap(gaps(spark, sf), ["benchmark_id"]), 4)


@query
def current_gap_oldest(spark, sf):
    return rounded(survival.current_gap(gaps(spark, sf), ["benchmark_id"], survival=False), 4)


@query
def current_gap_first_match(spark, sf):
    return rounded(survival.current_gap(gaps(spark, sf), ["benchmark_id"], prior_from_first_match=True), 4)


@query
def lognormal_pdf_grid(spark, sf):
    """The prior's density of each benchmark, from half a month to 20 months."""
    return rounded(survival.lognormal_density(survival.lognormal_prior(gaps(spark, sf), ["benchmark_id"]), ["benchmark_id"], 0.5, 20.0))


# classification and ingest


@query
def classify_three_valued(spark, sf):
    label = F.when(F.col("p_size") % 4 == 0, "Open weights (restricted)").when(F.col("p_size") % 4 == 1, " API access ").when(F.col("p_size") % 4 == 2, "Unreleased")
    return table(spark, sf, "part").select("p_partkey", classify.classify_label(label).alias("is_open"), classify.contains_mark(label).alias("is_open_old"))


@query
def classify_chain(spark, sf):
    size = F.col("p_size") % 7
    own, index, over = F.when(size == 0, "Open weights"), F.when(size == 1, "API access"), F.when(size == 2, "Hosted access (no API)")
    kind = classify.classify_chain(own, index, over, F.col("p_name"), F.col("p_brand"), open_names=["1"], closed_orgs=["brand#1"], open_orgs=["brand#2", "brand#3"])
    return table(spark, sf, "part").select("p_partkey", kind.alias("is_open"))


@query
def classify_accessible(spark, sf):
    access = F.when(F.col("p_size") % 3 == 0, "Open weights").when(F.col("p_size") % 3 == 1, "API access")
    kind = classify.classify_accessible(access, F.array("p_brand", "p_type"), ["Open weights"], ["brand#2"])
    return table(spark, sf, "part").select("p_partkey", kind.alias("is_open"))


@query
def region_keywords(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", classify.contains_any(F.col("r_name"), ["asia", "east"]).alias("is_a"), classify.contains_any(F.col("r_name"), ["america"]).alias("is_b"))


@query
def two_sided_difference(spark, sf):
    f = front(spark, sf)
    lead, lag = match.sides(f)
    both = lead.join(lag, "benchmark_id")
    kind = lambda m: classify.differs_two_sided(F.col("lag_score"), F.col("lag_score_std"), F.col("lead_score"), F.col("lead_score_std"), missing_differs=m)
    return both.select("benchmark_id", "lead_model", "lag_model", kind(True).alias("differs"), kind(False).alias("differs_strict"))


@query
def backfill_two_key(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" (Sep 2025)"))).otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    ref = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))
    return ingest.backfill_two_keys(c, ref, "name", {"segment": "kind", "balance": "balance"}, [F.col("balance")])


@query
def override_blank_only(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("API access").alias("label"))
    return ingest.override_blank(s, spark.createDataFrame(PRICE_OVERRIDES, "key string, value string"), "s_name", "label")


@query
def version_precedence_merge(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    one = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return ingest.precedence_merge([one("F"), one("O")], "o_custkey").select("o_custkey", "top", F.col("version").cast("bigint").alias("version"))


@query
def key_set_diff(spark, sf):
    o = table(spark, sf, "orders")
    return ingest.key_sets(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_custkey")


@query
def preserve_missing(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return match.preserve_missing(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query
def nested_props_projection(spark, sf):
    e = table(spark, sf, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.size(F.map_keys(m)).cast("bigint").alias("n_keys"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: m[k]), ",").alias("vals"))


@query
def coalesced_scaled_score(spark, sf):
    rows = table(spark, sf, "lineitem")
    pick = F.coalesce(F.when(F.col("l_orderkey") % 3 == 0, F.col("l_discount")), F.when(F.col("l_orderkey") % 3 == 1, F.col("l_tax")), F.col("l_quantity"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", _r(ingest.scaled(pick, 100.0), 6, "score"))


@query
def std_from_ci(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", _r(ingest.std_from_interval(F.col("s_acctbal") - F.col("s_suppkey"), F.col("s_acctbal") + F.col("s_suppkey")), 6, "std"))


@query
def coerced_numbers_dates(spark, sf):
    text = F.when(F.col("s_suppkey") % 3 == 0, "n/a").otherwise(F.format_string("%.2f", "s_acctbal"))
    date = F.when(F.col("s_suppkey") % 2 == 0, "2024-02-30").otherwise("2024-02-29")
    return table(spark, sf, "supplier").select("s_suppkey", ingest.number(text).alias("value"), ingest.day(date).alias("day"))


# counts, sorts, strings


@query
def count_distinct_per_task(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n"))


@query
def label_buckets(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("labels"))
    return o


@query
def top_k_tasks(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(10)


@query
def sort_nulls_last(spark, sf):
    g = gaps(spark, sf)
    up = F.row_number().over(Window.orderBy(F.col("lag_date").asc_nulls_last(), "benchmark_id", "lead_model"))
    down = F.row_number().over(Window.orderBy(F.col("lag_date").desc_nulls_last(), "benchmark_id", "lead_model"))
    return g.select("benchmark_id", "lead_model", up.cast("bigint").alias("up"), down.cast("bigint").alias("down"))


@query
def enumerated_order(spark, sf):
    known = F.array(F.lit("P"), F.lit("F"))
    place = F.coalesce(F.nullif(F.array_position(known, F.col("benchmark_id")), F.lit(0).cast("bigint")), F.lit(1000))
    counts = orders(spark, sf).groupBy("benchmark_id").agg(F.count("*").alias("n"))
    return counts.select("benchmark_id", "n", F.row_number().over(Window.orderBy(place, "benchmark_id")).cast("bigint").alias("position"))


@query
def ages_descending(spark, sf):
    g = gaps(spark, sf).filter("not matched").groupBy("benchmark_id").agg(F.sort_array(F.collect_list("gap_days"), asc=False).alias("a"))
    return g.select("benchmark_id", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("ages"))


@query
def suffix_strip(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" (Sep 2025)"))).otherwise(F.concat("p_name", F.lit(" (beta)")))
    return table(spark, sf, "part").select("p_partkey", strings.strip_dated_suffix(name).alias("stripped"), strings.short_name(name).alias("short"))


@query
def id_normalize(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["gpt_5_2025_08_07", "o1", "claude_3_5_sonnet_20240620", "llama_2_inspect"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    same = [("o1", "o1_elicited"), ("claude_3_5_sonnet_20240620", "claude_3_5_sonnet")]
    return table(spark, sf, "part").select("p_partkey", strings.normalize_id(raw, dated=["gpt_5"], same=same).alias("id"), strings.by_prefix(raw, [("gpt", "A"), ("claude", "B")]).alias("organization"))


@query
def display_name(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ["gpt_4o_mini", "deepseek-r1_inspect", "o3_4o mini-x"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", strings.display_name(raw, [("Gpt", "GPT"), ("Deepseek", "DeepSeek"), ("4O", "4o")]).alias("name"), strings.escape_html(F.concat(F.lit("<b>&'"), "p_brand")).alias("html"))


@query
def date_functions(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", trend.ordinal(d).cast("bigint").alias("ordinal"), dates.month_label(d).alias("month"), dates.quarter_label(d).alias("quarter"), dates.add_fractional_months(d, F.lit(2.5)).alias("later"), dates.parse_date(F.date_format(d, "MM/dd/yyyy")).alias("parsed"))


@query
def source_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# paired draws in the daily gaps, the history and the match map


@query
def gap_metrics_draws(spark, sf):
    return rounded(spine.gap_metrics(spine.daily_gap(with_draws(front(spark, sf), spark, sf), draws="draws")))


@query
def historical_gap_draws(spark, sf):
    return rounded(spine.historical_gap(with_draws(front(spark, sf), spark, sf), as_of(), draws="draws"))


@query
def frontier_match_draws(spark, sf):
    return match.frontier_match_map(with_draws(strict_records(orders(spark, sf)), spark, sf), draws="draws")


# settings by benchmark

#: Thresholds that count, floor and tolerance of a benchmark; null means the default.
REVIEW = [("F", [100_000.0, 200_000.0, 300_000.0], None, 150_000.0, 0.0), ("O", None, [150_000.0, 250_000.0], None, None)]


def _review(spark):
    return spark.createDataFrame(REVIEW, "benchmark_id string, thresholds array<double>, accepted array<double>, floor double, tolerance double")


@query
def threshold_settings(spark, sf):
    points = thresholds.threshold_datapoints(orders(spark, sf), as_of(), settings=_review(spark))
    return rounded(points)


@query
def first_catchup_settings(spark, sf):
    """Scores alone, by each benchmark's own tolerance: one has to be met exactly."""
    f = publish.with_settings(front(spark, sf).withColumn("score_std", F.lit(None).cast("double")), _review(spark))
    return rounded(match.first_catchup(f, as_of(), threshold=F.col("lead_tolerance")))


#: Which benchmarks are pooled, and their data access.
POOLED = [("F", True, "public"), ("O", True, "private"), ("P", False, "public")]


def _pool(spark, sf):
    return thresholds.threshold_pool(_points(spark, sf), publish.full_settings(spark.createDataFrame(POOLED, "benchmark_id string, keep boolean, access string")))


@query
def threshold_pool(spark, sf):
    return rounded(_pool(spark, sf))


@query
def threshold_pool_summary(spark, sf):
    return rounded(thresholds.pool_summary(_pool(spark, sf)))


@query
def threshold_pool_trends(spark, sf):
    return rounded(thresholds.pool_trends(_pool(spark, sf), bandwidth=180.0, min_weight=1.0, n_boot=1000))


@query
def threshold_config(spark, sf):
    own = publish.full_settings(_review(spark).join(spark.createDataFrame(POOLED, "benchmark_id string, keep boolean, access string"), "benchmark_id", "full"))
    config = thresholds.threshold_config(thresholds.threshold_datapoints(orders(spark, sf), as_of(), settings=own), own)
    return rounded(config.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",") for c in ("thresholds", "accepted")}))


# framings and lists


def _framed(spark, sf):
    """Orders by their customers' regions, in two framings at once."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.select(F.col("o_orderstatus").alias("benchmark_id"), F.col("o_orderkey").alias("model"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").cast("double").alias("score"), F.lit(None).cast("double").alias("score_std"), "r_name")
    at = lambda *names: F.col("r_name").isin(*names)
    return publish.framings(rows, {"east": (at("ASIA"), at("AMERICA")), "south": (at("AFRICA", "MIDDLE EAST"), at("EUROPE", "AMERICA"))}).drop("r_name")


@query
def framing_history(spark, sf):
    return rounded(spine.historical_gap(frontier(_framed(spark, sf)), as_of()))


@query
def framing_matches(spark, sf):
    return match.frontier_match_map(strict_records(_framed(spark, sf)))


@query
def model_list(spark, sf):
    return publish.model_list(orders(spark, sf)).select("benchmark_id", "model", "date", "score", "is_laggard", "on_frontier")


# what sources need


@query
def round_two_places(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 8).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", numbers.round_exact(F.col("x")).alias("rounded"))


@query
def region_flags(spark, sf):
    regions = {"in_asia": ["CHINA", "JAPAN"], "in_west": ["UNITED STATES", "CANADA"]}
    return table(spark, sf, "nation").select("n_nationkey", *classify.region_flags(F.col("n_name"), regions))


@query
def open_by_id(spark, sf):
    x = F.concat(F.lower(F.translate("p_name", " ", "_")), F.when(F.col("p_partkey") % 2 == 0, F.lit("_inspect")).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", classify.open_by_id(x, ["^a", "e$"]).alias("is_open"))


@query
def column_defaults(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit(" ")).alias("name"))
    return ingest.renamed(ingest.with_defaults(rows, {"segment": "Unknown", "name": "Nobody"}), {"segment": "market", "absent": "x"})


@query
def index_lookup(spark, sf):
    """Each part by its brand's first known size."""
    parts = table(spark, sf, "part")
    index = parts.select(F.concat(F.lit(" "), "p_brand").alias("brand"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).alias("size"), "p_partkey")
    return ingest.lookup(parts.select("p_partkey", "p_brand"), index, "p_brand", "brand", "size", [F.col("p_partkey")]).select("p_partkey", "size")


@query
def spaced_labels(spark, sf):
    """Order totals that a logarithmic axis can label, by status and order key's last digit."""
    rows = table(spark, sf, "orders").select(F.concat("o_orderstatus", F.lit("-"), F.col("o_orderkey") % 10).alias("benchmark_id"), (F.col("o_totalprice") * 1.0).alias("score"))
    return spaced(rows, "benchmark_id", "score", 0.2)


@query
def fractional_dates(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_timestamp(F.lit("2023-12-31 18:00:00")).alias("then"))
    return rows.select("event_id", _r(dates.fractional_days(F.col("ts"), F.col("then")), 6, "days"), dates.floor_days(F.col("ts"), F.col("then")).alias("whole_days"))


@query
def quarter_ticks(spark, sf):
    ends = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("z"))
    return ends.select("o_orderstatus", F.explode(dates.quarter_ticks(F.col("a"), F.col("z"))).alias("tick"))


@query
def nested_metric(spark, sf):
    """A metric that is a number in some entries and a struct with an interval in others."""
    v = F.col("value")
    struct = F.concat(F.lit('{"m": {"s": {"estimate": '), v, F.lit(', "ci_low": '), v - 1, F.lit(', "ci_high": '), v + 2, F.lit("}}}"))
    plain = F.concat(F.lit('{"m": {"s": '), v, F.lit("}}"))
    rows = table(spark, sf, "events").filter("value is not null").select("event_id", F.when(F.col("user_id") % 2 == 0, struct).otherwise(plain).alias("entry"))
    score, low, high = files.metric(F.col("entry"), "m.s")
    return rows.select("event_id", _r(score, 6, "score"), _r(ingest.std_from_interval(low, high), 6, "score_std"))


# the older notebook's variants


@query
def notebook_horizontal_levels(spark, sf):
    """The gap at 100 levels between both frontiers, in months of 30.5 days."""
    m = thresholds.level_matches(front(spark, sf))
    return m.select("benchmark_id", F.col("i").cast("bigint").alias("i"), _r("level", 4), _r(F.datediff("lag_date", "lead_date") / F.lit(30.5), 6, "gap_months"))


@query
def notebook_vertical(spark, sf):
    daily = spine.vertical_daily(front(spark, sf))
    return rounded(daily.groupBy("benchmark_id").agg(F.avg("vertical").alias("mean"), F.stddev_samp("vertical").alias("std"), F.percentile("vertical", F.lit(0.05)).alias("low"), F.percentile("vertical", F.lit(0.95)).alias("high")), 4)


@query
def notebook_level_walk(spark, sf):
    """The same levels, with laggards that are dropped on the way up."""
    m = thresholds.level_walk(front(spark, sf))
    return m.select("benchmark_id", F.col("i").cast("bigint").alias("i"), _r("level", 4), _r(F.datediff("lag_date", "lead_date") / F.lit(30.5), 6, "gap_months"))


@query
def label_lanes(spark, sf):
    """Labels of each frontier's records in two lanes, 600 wide from its first date to its last."""
    rows = strict_records(orders(spark, sf))
    ends = rows.groupBy("benchmark_id").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    x = F.datediff("date", "a") * 600.0 / F.greatest(F.datediff("z", "a"), F.lit(1))
    half = F.length(F.col("model").cast("string")) * 3.4 + 6
    boxes = rows.join(ends, "benchmark_id").select("benchmark_id", "is_laggard", "model", (x - half).alias("x0"), (x + half).alias("x1"))
    return packed(boxes, ["benchmark_id", "is_laggard"], "x0", "x1", ["x0", "model"]).select("benchmark_id", "is_laggard", "model", F.col("lane").cast("bigint").alias("lane"))


# linked tables and versioned documents, as the given tables have them


def _linked(spark, sf) -> dict[str, DataFrame]:
    """Parts as tasks, order lines as scores of runs, customers as models of groups by nation."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    runs = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"), (F.col("l_partkey") % 50).alias("task_id"), F.col("o_custkey").alias("model_id"), F.col("o_orderstatus").alias("status"))
    scores = line.filter("l_linenumber % 7 > 0").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"), F.col("l_returnflag").alias("scorer"), F.col("l_extendedprice").alias("mean"), F.lit(0.0).alias("stderr"))
    tasks = table(spark, sf, "part").filter("p_partkey < 55").select(F.col("p_partkey").alias("task_id"), F.concat_ws("/", F.lower("p_brand"), F.lower("p_name"), F.col("p_partkey")).alias("path"))
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("group_id"), F.when(F.col("n_regionkey") == 0, "Open weights").when(F.col("n_regionkey") == 1, "API access").when(F.col("n_regionkey") == 2, "Hosted").alias("accessibility"))
    return {"tasks": tasks, "runs": runs, "scores": scores, "groups": groups}


@query
def task_paths(spark, sf):
    return linked.task_paths(_linked(spark, sf)["tasks"]).select("path", F.col("position").cast("bigint").alias("position"))


@query
def available_tasks(spark, sf):
    t = _linked(spark, sf)
    configured = t["tasks"].filter("task_id % 3 = 0").select(F.concat(F.lit("b"), "task_id").alias("benchmark_id"), "path")
    missing = configured.select(F.concat(F.lit("x"), "benchmark_id").alias("benchmark_id"), F.concat("path", F.lit("?")).alias("path"))
    return linked.available_tasks(t["tasks"], t["runs"], configured.unionByName(missing))


@query
def exploration_report(spark, sf):
    """Exact numbers, and whether the sketches lie within three standard errors or their rank error."""
    t = _linked(spark, sf)
    out = linked.exploration(t["tasks"], t["runs"], t["scores"], recommended=30)
    best = t["runs"].join(t["scores"].groupBy("run_id").agg(F.max("mean").alias("best")), "run_id").select("task_id", "best")
    ranks = best.join(out.select("task_id", "low", "median", "high"), "task_id").groupBy("task_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("best") <= F.col(c)).alias(f"le_{c}") for c in ("low", "median", "high")), *(F.count_if(F.col("best") < F.col(c)).alias(f"lt_{c}") for c in ("low", "median", "high")))
    slack = F.col("n") / linked.QUANTILE_ACCURACY + 1
    near = [(F.col(f"lt_{c}") <= q * F.col("n") + slack) & (F.col(f"le_{c}") >= q * F.col("n") - slack) for c, q in (("low", 0.1), ("median", 0.5), ("high", 0.9))]
    checked = out.join(ranks, "task_id", "left").withColumn("quantiles_within", F.coalesce(near[0] & near[1] & near[2], F.lit(True)))
    models_within = F.abs(F.col("about_models") - F.col("n_models")) <= 3 * linked.DISTINCT_ERROR * F.col("n_models") + 1
    return checked.select("task_id", "path", "n_runs", "n_scores", "n_models", "n_unscored", "recommended", models_within.alias("models_within"), "quantiles_within")


@query
def accessibility_report(spark, sf):
    return linked.accessibility_report(_linked(spark, sf)["groups"])


def _versions(spark, sf) -> DataFrame:
    """Customers' orders as two versions of documents, a hundred customers in each: JSON, and block YAML."""
    o = table(spark, sf, "orders").filter("o_orderstatus in ('F', 'O')").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"), F.max(F.col("o_orderdate").cast("date")).alias("day"))
    plain = F.col("o_custkey") % 2 == 0
    number = lambda c: F.format_string("%.2f", c)
    as_json = F.format_string('"c%d": {"release_date": "%s", "metrics": {"p50_horizon_length": %s, "is_sota": %s}}', "o_custkey", F.col("day").cast("string"), F.when(plain, number("top")).otherwise(F.format_string('{"estimate": %s, "ci_low": %s}', number("top"), number("low"))), F.when(plain, "true").otherwise("false"))
    as_yaml = F.format_string("  c%d:\n    release_date: %s # latest\n    metrics:\n      p50_horizon_length:%s\n      is_sota: %s\n", "o_custkey", F.col("day").cast("string"), F.when(plain, F.concat(F.lit(" "), number("top"))).otherwise(F.format_string("\n        estimate: %s\n        ci_low: %s", number("top"), number("low"))), F.when(plain, "true").otherwise("false"))
    first = F.col("o_orderstatus") == "F"
    parts = o.select(F.when(first, "1.0").otherwise("1.1").alias("version"), F.expr("o_custkey div 100").cast("string").alias("file"), F.when(first, as_json).otherwise(as_yaml).alias("part"))
    docs = parts.groupBy("version", "file").agg(F.array_sort(F.collect_list("part")).alias("p"))
    figure = F.size("p")
    text = F.when(F.col("version") == "1.0", F.format_string('{"results": {%s}, "doubling_time_in_days": {"all_time_stitched": {"point_estimate": %d}}}', F.array_join("p", ", "), figure)).otherwise(F.concat(F.lit("doubling_time_in_days:\n  all_time: {point_estimate: "), figure, F.lit(", ci_low: 1}\n  from_2023:\n    point_estimate: n/a\nresults:\n"), F.array_join("p", "")))
    texts = docs.select(F.concat_ws("/", "version", "file").alias("file"), text.alias("text"))
    return blocks.json_documents(texts).select(F.split("file", "/")[0].alias("version"), F.split("file", "/")[1].alias("file"), "json")


@query
def merged_versions(spark, sf):
    out = files.merged_versions(_versions(spark, sf), F.col("id"))
    return out.select("key", "version", F.array_join("in_versions", ",").alias("in_versions"), "date", "score", "low", "is_sota", F.expr("variant_get(entry, '$.release_date', 'string')").alias("release_date"))


@query
def version_metadata(spark, sf):
    """The figures of the first hundred customers' documents."""
    out = files.document_metadata(_versions(spark, sf).filter("file = '0'"))
    return out.select("version", F.array_join("versions", ",").alias("versions"), "doubling_days", "doubling_low", "doubling_high", "recent_doubling_days", F.expr("variant_get(rest, '$.doubling_time_in_days.from_2023.point_estimate', 'string')").alias("kept"))


# adapters, on tables of strings as files have them


@query
def score_table_ingest(spark, sf):
    """Customers as a score table: the best variant of each model, dates backfilled, blank labels overridden."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    number = lambda x: F.format_string("%.2f", x)
    rows = c.select(
        F.concat(F.lit("m-"), k % 700).alias("Model"), F.when(k % 5 > 0, number("c_acctbal")).otherwise("n/a").alias("eci"), number(F.col("c_acctbal") - 10).alias("eci_ci_low"), F.when(k % 3 == 0, number(F.col("c_acctbal") + 5)).alias("eci_ci_high"),
        F.when(k % 2 == 0, F.concat(F.lit("2023-"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("-15"))).alias("Version release date"), F.when(k % 3 == 0, "Open weights").when(k % 3 == 1, "API access").otherwise(" ").alias("Model accessibility"),
    )
    reference = c.filter("c_custkey < 350").select(F.concat(F.lit("m-"), k).alias("Model"), F.col("c_mktsegment").alias("Organization"), F.lit("2022-05-01").alias("Publication date"))
    overrides = c.filter("c_custkey < 700 and c_custkey % 2 = 0").select(F.concat(F.lit("m-"), k).alias("key"), F.lit("Open weights (restricted)").alias("value"))
    return rounded(scores.model_scores(rows, "index", reference=reference, overrides=overrides))


@query
def benchmark_table_ingest(spark, sf):
    """Order lines as a benchmark's table: the first known score on its scale, rows without what is needed left out."""
    k = F.col("l_orderkey")
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, sf, "lineitem").select(
        F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" v"), "l_partkey")).alias("Model version"), F.when(k % 2 == 0, text("l_discount")).when(k % 7 == 0, "x").alias("mean_score"), F.when(k % 3 == 0, text("l_quantity")).alias("Best score (across scorers)"),
        F.when(k % 13 > 0, F.col("l_shipdate").cast("date").cast("string")).alias("Release date"), F.when(k % 5 > 0, text("l_tax")).alias("stderr"), "l_returnflag",
    )
    kind = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    return rounded(scores.benchmark_scores(rows, "lines", kind))


@query
def resolved_task(spark, sf):
    """Tasks by their path, by an alternate path, by a keyword, and by none of them."""
    tasks = _linked(spark, sf)["tasks"]
    exact = tasks.filter("task_id = 20").first()["path"]
    looks = {"path": (exact, ["x"], ["gear"]), "alternate": ("x", ["y", exact], ["gear"]), "keyword": ("x", ["y"], ["GEAR", "brand"]), "none": ("x", [], ["nowhere"])}
    found = [scores.resolve_task(tasks, *look).select(F.lit(name).alias("look"), "task_id") for name, look in looks.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query
def run_scores(spark, sf):
    """The best score of each model over the successful runs of three tasks."""
    t = _linked(spark, sf)
    released = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("release_date"))
    models = released.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("model_id"), "release_date", F.col("c_nationkey").alias("group_id"))
    groups = t["groups"].join(table(spark, sf, "nation"), F.col("group_id") == F.col("n_nationkey")).select("group_id", "accessibility", F.array("n_name").alias("organizations"))
    runs = t["runs"].withColumn("status", F.when(F.col("status") == "F", "success").otherwise("failed"))
    kind = classify.classify_accessible(F.col("accessibility"), F.col("organizations"), ["Open weights"], ["india", "japan"])
    return rounded(scores.run_scores(t["tasks"].filter("task_id in (7, 8, 9)"), runs, t["scores"], models, groups, "runs", kind, scorers=["A", "R"]))


@query
def latest_draws(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("model"), F.col("embedding").cast("array<double>").alias("draws"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("source_hash"), (F.col("vec_id") % 2).alias("seed"), F.size("embedding").alias("n_samples"))
    return scores.latest_draws(v, "a", 0, 64).select("model", F.size("draws").cast("bigint").alias("n"), _r(F.col("draws")[0], 6, "first"))


@query
def available_benchmarks(spark, sf):
    return scores.available_benchmarks(orders(spark, sf)).withColumn("position", F.col("position").cast("bigint"))


@query
def published_documents(spark, sf):
    """What the published documents of all benchmarks hold, read back from their JSON."""
    docs = publish.documents(publish.analyse(orders(spark, sf), as_of()))
    n = lambda section: F.size(F.from_json(F.get_json_object("document", f"$.{section}"), "array<string>")).cast("bigint")
    value = lambda p, kind: F.get_json_object("document", f"$.{p}").cast(kind)
    return docs.select("benchmark_id", n("models").alias("n_models"), n("gaps").alias("n_gaps"), n("thresholds").alias("n_thresholds"), value("threshold_summary.n_accepted", "bigint").alias("n_accepted"), _r(value("current_gap.min_gap", "double"), 4, "min_gap"), value("statistics.total_matched", "bigint").alias("n_matched"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


__all__ = ["GROUP", "queries"]
