"""Registry of the result-verification queries and their DuckDB equivalents.

The domain's tables are not among the driver's, so each query maps an operator
to those tables (see the comment above it): a unit is a customer, an order, a
part or a supplier, its candidates are order lines or brands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.operators import anomalies, compare, dashboard, denormalise, spatial, statistics, verify
from veritally.sources import scans, sinks
from veritally.streaming import snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its function's name, with the SQL that should give the same."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Rates of a unit's parts, fences and flags -------------------------------------------------
# Unit: a customer; turn_out: their orders; invalid: those pending (P), blank: those open (O).


def customer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return orders.groupBy(F.col("o_custkey").alias("unit_id")).agg(F.count("*").alias("turn_out"), status("P").alias("invalid"), status("O").alias("blank"), status("F").alias("counted"))


def part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit: a part; turn_out: its order lines; wasted: those returned or accepted back."""
    lines = table(spark, sf_dir, "lineitem")
    wasted = F.count_if(F.col("l_returnflag").isin("R", "A"))
    return lines.groupBy(F.col("l_partkey").alias("unit_id")).agg(F.count("*").alias("turn_out"), wasted.alias("wasted"))


def order_turnout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit: an order; registered: its total price, came: the sum of its lines' prices."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.sum("l_extendedprice").alias("came"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("registered"))
    return lines.join(orders, "unit_id").where("registered > 0 and came > 0")


def _fence_sql(source: str, value: str) -> str:
    return f"""
    fence as (select avg({value}) mean, stddev_samp({value}) sd, quantile_cont({value}, 0.25) q1, quantile_cont({value}, 0.5) q2, quantile_cont({value}, 0.75) q3 from {source}),
    summary as (select *, q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from fence)"""


CUSTOMERS = """units as (select o_custkey unit_id, count(*) turn_out, count(*) filter (o_orderstatus = 'P') invalid, count(*) filter (o_orderstatus = 'O') blank,
    count(*) filter (o_orderstatus = 'F') counted from orders group by 1)"""
PARTS = "units as (select l_partkey unit_id, count(*) turn_out, count(*) filter (l_returnflag in ('R', 'A')) wasted from lineitem group by 1)"
TURNOUT = """units as (select l_orderkey unit_id, sum(l_extendedprice) came from lineitem group by 1),
    rates as (select unit_id, round_even(came / o_totalprice * 100, 2) rate from units join orders on o_orderkey = unit_id where o_totalprice > 0 and came > 0)"""


def _rates_sql(units: str, part: str) -> str:
    return f"{units}, rates as (select *, round_even({part} / turn_out * 100, 2) rate from units where turn_out > 0)"


def _outliers_sql(rates: str, columns: str, two_sided: bool = False) -> str:
    low = "or rate < lo" if two_sided else ""
    return f"""with {rates}, {_fence_sql("rates", "rate")}
    select {columns}, rate, round(case when sd > 0 then (rate - mean) / sd else 0.0 end, 2) z, case when rate > hi then 'high' when rate < lo then 'low' else 'normal' end flag
    from rates, summary where rate > hi {low}"""


def _report_sql(rates: str, two_sided: bool = False) -> str:
    low = "or rate < lo" if two_sided else ""
    return f"""with {rates}, {_fence_sql("rates", "rate")}
    select round(mean, 2) mean, round(q2, 2) median, round(sd, 2) stdev, round(q1, 2) q1, round(q3, 2) q3, round(q3 - q1, 2) iqr, round(lo, 2) lower_fence, round(hi, 2) upper_fence,
      (select count(*) from rates) total, (select count(*) from rates where rate > hi {low}) outlier_count from summary"""


@query(_outliers_sql(_rates_sql(CUSTOMERS, "invalid"), "unit_id, turn_out, invalid"))
def invalid_rate_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.rate_outliers(customer_units(spark, sf_dir), "invalid", "turn_out").select("unit_id", "turn_out", "invalid", "rate", "z", "flag")


@query(_outliers_sql(_rates_sql(CUSTOMERS, "blank"), "unit_id, turn_out, blank"))
def blank_rate_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.rate_outliers(customer_units(spark, sf_dir), "blank", "turn_out").select("unit_id", "turn_out", "blank", "rate", "z", "flag")


@query(f"""with {_rates_sql(PARTS, "wasted")}, {_fence_sql("rates", "rate")} select unit_id, turn_out, wasted, rate from rates, summary where rate > hi""")
def wasted_rate_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomalies.rate_outliers(part_units(spark, sf_dir), "wasted", "turn_out")
    return found.select("unit_id", "turn_out", "wasted", "rate").orderBy(F.desc("rate"), "unit_id")


def _turnout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_turnout(spark, sf_dir).withColumn("rate", stats.rate(F.col("came"), F.col("registered")))


@query(_outliers_sql(TURNOUT, "unit_id", two_sided=True))
def turnout_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomalies.fenced(_turnout(spark, sf_dir), "rate", two_sided=True, wide=True).where("is_outlier")
    return found.select("unit_id", "rate", "z", "flag").orderBy("z", "unit_id")


@query(_report_sql(TURNOUT, two_sided=True))
def turnout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.fence_report(_turnout(spark, sf_dir), "rate", two_sided=True, wide=True)


@query(_report_sql(_rates_sql(CUSTOMERS, "invalid")))
def invalid_rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.fence_report(anomalies.rated(customer_units(spark, sf_dir), "invalid", "turn_out"), "rate")


@query(_report_sql(_rates_sql(CUSTOMERS, "blank")))
def blank_rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.fence_report(anomalies.rated(customer_units(spark, sf_dir), "blank", "turn_out"), "rate")


@query(_report_sql(_rates_sql(PARTS, "wasted")))
def wasted_rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.fence_report(anomalies.rated(part_units(spark, sf_dir), "wasted", "turn_out"), "rate")


@query("""select l_orderkey unit_id, round(sum(l_extendedprice) / any_value(o_totalprice) * 100, 4) turnout_rate from lineitem join orders on l_orderkey = o_orderkey
    group by 1 having sum(l_extendedprice) / any_value(o_totalprice) * 100 > 95 and any_value(o_totalprice) > 0 and sum(l_extendedprice) > 0""")
def turnout_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify.turnout_over(order_turnout(spark, sf_dir), "came", "registered", 0.95)
    return found.select("unit_id", stats.round_half_up("turnout_rate", 4).alias("turnout_rate"))


@query("""with t as (select sum(l_extendedprice) came, any_value(o_totalprice) registered from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey)
    select 'registered' eligible, true present, count(*) filter (came > 0 and registered > 0 and came / registered * 100 > 95) findings from t union all select 'unheard_of', false, null""")
def turnout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold check by the columns it is given: none where one is missing."""
    out = []
    for eligible in ("registered", "unheard_of"):
        found = verify.turnout_over(order_turnout(spark, sf_dir), "came", eligible)
        rows = spark.range(1).select(F.lit(None).cast("bigint").alias("findings")) if found is None else found.agg(F.count("*").alias("findings"))
        out.append(rows.select(F.lit(eligible).alias("eligible"), F.lit(found is not None).alias("present"), "findings"))
    return out[0].unionByName(out[1])


@query("select count(*) votes, count(*) in_range, count(*) skewed, 'violates' uniform from orders")
def synthetic_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic votes for every order: uniform ones violate the first-digit law."""
    rows = scans.with_synthetic_votes(table(spark, sf_dir, "orders"), "o_orderkey")
    one = rows.agg(F.count("*").alias("votes"), F.count_if(F.col("uniform").between(1000, 9998)).alias("in_range"), F.count_if(F.col("skewed") >= 0).alias("skewed"))
    return one.crossJoin(F.broadcast(anomalies.benford_test(rows, "uniform").select(F.col("interpretation").alias("uniform"))))


def _histogram_sql(rates: str, edges: tuple) -> str:
    last = len(edges) - 2
    bins = ", ".join(f"({i}, {edges[i]}, {edges[i + 1]})" for i in range(last + 1))
    return f"""with {rates}, bins(bin, lo, hi) as (values {bins})
    select bin::int bin, lo || '-' || hi || '%' "label", count(rate) count from bins left join rates on rate >= lo and (rate < hi or bin = {last} and rate <= hi) group by all"""


@query(_histogram_sql(_rates_sql(CUSTOMERS, "invalid"), stats.EDGES["turnout"]))
def rate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(anomalies.rated(customer_units(spark, sf_dir), "invalid", "turn_out"), "rate", stats.EDGES["turnout"])


@query(_histogram_sql(_rates_sql(CUSTOMERS, "invalid"), stats.EDGES["invalid"]))
def invalid_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(anomalies.rated(customer_units(spark, sf_dir), "invalid", "turn_out"), "rate", stats.EDGES["invalid"])


@query(_histogram_sql(_rates_sql(CUSTOMERS, "blank"), stats.EDGES["blank"]))
def blank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(anomalies.rated(customer_units(spark, sf_dir), "blank", "turn_out"), "rate", stats.EDGES["blank"])


@query(_histogram_sql(_rates_sql(PARTS, "wasted"), stats.EDGES["wasted"]))
def wasted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(anomalies.rated(part_units(spark, sf_dir), "wasted", "turn_out"), "rate", stats.EDGES["wasted"])


# --- Winners and margins ------------------------------------------------------------------------
# Unit: an order, its candidates: its lines, their votes: the quantity.

LINE_ORDER = "l_quantity desc, l_linenumber, l_partkey, l_suppkey"
RACES = f"""places as (select l_orderkey unit_id, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by {LINE_ORDER}) place from lineitem),
    races as (select unit_id, max(l_linenumber) filter (place = 1) winner, max(l_quantity) filter (place = 1) winner_votes, max(l_quantity) filter (place = 2) second_votes,
      count(*) n_candidates, sum(l_quantity) total_votes from places group by 1)"""
DOMINANCE = f"""{RACES}, shares as (select *, round_even(winner_votes / total_votes * 100, 2) rate, case when second_votes is null then 0.0 else round_even((winner_votes - second_votes) / total_votes * 100, 2) end margin_pct
    from races where total_votes > 0 and winner_votes > 0)"""


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "unit_id")
    order = [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return anomalies.leaders(lines, "unit_id", order, "l_quantity", "l_linenumber")


@query(f"with {DOMINANCE} select unit_id, winner, winner_votes, rate winner_pct, margin_pct from shares where rate > 60")
def winner_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomalies.winner_dominance(races(spark, sf_dir)).where("is_extreme")
    return found.select("unit_id", "winner", "winner_votes", "winner_pct", "margin_pct").orderBy(F.desc("winner_pct"), "unit_id")


@query(f"with {DOMINANCE} select round(avg(rate), 2) mean, round(stddev_samp(rate), 2) stdev, count(*) total, count(*) filter (rate > 60) extreme_count from shares")
def dominance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomalies.winner_dominance(races(spark, sf_dir))
    return rows.agg(stats.round_half_up(F.avg("winner_pct"), 2).alias("mean"), stats.round_half_up(F.stddev_samp("winner_pct"), 2).alias("stdev"), F.count("*").alias("total"), F.count_if("is_extreme").alias("extreme_count"))


@query(_histogram_sql(DOMINANCE.replace("shares as", "rates as"), stats.EDGES["dominance"]))
def dominance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(anomalies.winner_dominance(races(spark, sf_dir)), "winner_pct", stats.EDGES["dominance"])


@query(f"""with {RACES} select unit_id, winner_votes - second_votes margin_votes, round_even((winner_votes - second_votes) / total_votes * 100, 2) margin_pct, n_candidates
    from races where n_candidates >= 2 and total_votes > 0 and round_even((winner_votes - second_votes) / total_votes * 100, 2) < 3""")
def close_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.close_races(races(spark, sf_dir)).select("unit_id", "margin_votes", "margin_pct", "n_candidates").orderBy("margin_pct", "unit_id")


# --- Progress and sums ----------------------------------------------------------------------------
# Counted: a customer's finished orders (F); paused: most of them open.

PROGRESS = f"with {CUSTOMERS}, progress as (select *, turn_out - counted remaining, round_even(counted / turn_out * 100, 2) percent_count from units)"


@query(f"{PROGRESS} select unit_id, remaining, percent_count from progress where percent_count < 100 order by percent_count, unit_id limit 20")
def counting_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomalies.counting_progress(customer_units(spark, sf_dir), "counted", "turn_out").where("percent_count < 100")
    return rows.orderBy("percent_count", "unit_id").limit(20).select("unit_id", "remaining", "percent_count")


@query(f"{PROGRESS} select count(*) total, count(*) filter (percent_count >= 100) complete, count(*) filter (percent_count < 100) incomplete, count(*) filter (blank * 2 > turn_out) paused from progress")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomalies.counting_progress(customer_units(spark, sf_dir), "counted", "turn_out")
    return anomalies.progress_summary(rows, F.col("blank") * 2 > F.col("turn_out"))


@query("""with u as (select l_orderkey unit_id, max(l_linenumber) turn_out, count(*) filter (l_returnflag = 'N') valid, count(*) filter (l_returnflag = 'R') invalid, count(*) filter (l_returnflag = 'A') blank from lineitem group by 1)
    select unit_id, turn_out, abs(valid + invalid + blank - turn_out) difference, round_even(abs(valid + invalid + blank - turn_out) / turn_out * 100, 2) pct_diff from u where turn_out > 0 and valid + invalid + blank <> turn_out""")
def turnout_sum_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnout: the highest line number; valid, invalid, blank: lines by return flag."""
    flag = lambda s: F.count_if(F.col("l_returnflag") == s)
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.max("l_linenumber").alias("turn_out"), flag("N").alias("valid"), flag("R").alias("invalid"), flag("A").alias("blank"))
    return anomalies.sum_errors(units, F.col("valid") + F.col("invalid") + F.col("blank"), F.col("turn_out")).select("unit_id", "turn_out", "difference", "pct_diff")


SUMS = """with sums as (select l_orderkey unit_id, round(sum(l_extendedprice), 4) candidate_sum from lineitem group by 1),
    errors as (select unit_id, round(abs(candidate_sum - o_totalprice), 4) difference, round_even(abs(candidate_sum - o_totalprice) / o_totalprice * 100, 2) pct_diff from sums join orders on o_orderkey = unit_id
      where o_totalprice > 0 and abs(candidate_sum - o_totalprice) > 0.005)"""


def _candidate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = order_turnout(spark, sf_dir).withColumn("came", stats.round_half_up("came", 4))
    rows = anomalies.sum_errors(units, F.col("came"), F.col("registered"), tolerance=0.005)
    return rows.withColumn("difference", stats.round_half_up("difference", 4))


@query(f"{SUMS} select unit_id, difference, pct_diff from errors order by difference desc, unit_id limit 30")
def candidate_sum_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_sums(spark, sf_dir).select("unit_id", "difference", "pct_diff").orderBy(F.desc("difference"), "unit_id").limit(30)


@query(f"{SUMS} select count(*) errors, count(*) filter (pct_diff > 10) over_ten_percent from errors")
def candidate_sum_error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_sums(spark, sf_dir).agg(F.count("*").alias("errors"), F.count_if(F.col("pct_diff") > 10).alias("over_ten_percent"))


# --- First digits -----------------------------------------------------------------------------------
# Votes: an order's total price, whole part.

DIGITS = """d as (select substr(cast(floor(o_totalprice) as bigint)::varchar, 1, 1)::int digit, count(*) n from orders where o_totalprice >= 10 group by 1),
    t as (select sum(n)::bigint total from d),
    rows as (select digit, coalesce(n, 0) n, total, log10(1 + 1.0 / digit) e from (select unnest(range(1, 10))::int digit) left join d using (digit), t),
    x as (select sum((n - total * e) ** 2 / (total * e)) x, max(total) total from rows)"""


@query(f"""with {DIGITS} select digit, n observed_count, round_even(n / total * 100, 2) observed_pct, round_even(e * 100, 2) expected_pct, round_even((n / total - e) * 100, 2) deviation from rows""")
def benford_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.benford_digits(table(spark, sf_dir, "orders"), "o_totalprice").drop("total", "expected_share")


@query(f"""with {DIGITS} select total, round(x, 2) chi_square, 15.507::double critical_value, x < 15.507 passes from x""")
def benford_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = anomalies.benford_test(table(spark, sf_dir, "orders"), "o_totalprice")
    return test.select("total", stats.round_half_up("chi_square", 2).alias("chi_square"), "critical_value", "passes")


@query("""with d as (select substr(cast(l_quantity as bigint)::varchar, 1, 1)::int digit, count(*) n from lineitem where l_quantity >= 1 group by 1), t as (select sum(n)::bigint total from d),
    x as (select sum((coalesce(n, 0) - total * log10(1 + 1.0 / digit)) ** 2 / (total * log10(1 + 1.0 / digit))) x, max(total) total from (select unnest(range(1, 10))::int digit) left join d using (digit), t),
    p as (select total, x, exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6) p from x)
    select total, round(x, 4) chi_square, round(p, 6) p_value, p > 0.05 conforms, case when p > 0.05 then 'conforms' when p > 0.01 then 'suspicious' else 'violates' end interpretation, total >= 30 valid from p""")
def benford_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = anomalies.benford_test(table(spark, sf_dir, "lineitem"), "l_quantity", least=1, least_rows=30)
    return test.select("total", stats.round_half_up("chi_square", 4).alias("chi_square"), stats.round_half_up("p_value", 6).alias("p_value"), "conforms", "interpretation", "valid")


# --- Provinces -----------------------------------------------------------------------------------------
# Province: a customer, unit: an order, winner: its status, turnout: its lines' prices of its price, invalid: returned lines.


PROVINCES = """l as (select l_orderkey k, sum(l_extendedprice) came, count(*) n, count(*) filter (l_returnflag = 'R') r from lineitem group by 1),
    u as (select o_custkey province, o_orderkey k, o_orderstatus winner, round_even(came / o_totalprice * 100, 2) t, r / n * 100 i from orders join l on k = o_orderkey),
    p as (select province, winner, count(*) n, min(k) seen from u where winner <> '' group by 1, 2), b as (select *, row_number() over (partition by province order by n desc, seen) place from p),
    g as (select province, sum(n)::bigint total_cons, count(*) unique_winners, max(winner) filter (place = 1) dominant_party, max(n) filter (place = 1) dominant_count from b group by 1),
    q as (select province, case when t > 0 then floor(t * 1e8 + 0.5)::bigint end t8, case when t > 0 then floor(t * 1e4 + 0.5)::hugeint end t4, floor(i * 1e8 + 0.5)::bigint i8 from u),
    s as (select province, count(t8) n, sum(t8)::hugeint t8, sum(t4) t4, sum(t4 * t4) tt, count(i8) m, sum(i8)::hugeint i8 from q group by 1),
    a as (select province, coalesce((2 * t8 + n * 10000000) // (2 * n * 10000000) / 10.0, 0.0) avg_turnout,
      coalesce(case when n > 1 then floor(sqrt((n * tt - t4 * t4)::double / (n * (n - 1))::double) / 1e3 + 0.5) / 10.0 end, 0.0) turnout_stdev, coalesce((2 * i8 + m * 1000000) // (2 * m * 1000000) / 100.0, 0.0) avg_invalid_rate from s),
    r as (select *, case when unique_winners = 1 and total_cons >= 3 then 'monopoly' when turnout_stdev > 10 then 'high_variation' end pattern, round(dominant_count / total_cons * 100, 1) dominant_pct from g join a using (province))"""


def province_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("came"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("province"), F.col("o_orderstatus").alias("winner"), "o_totalprice")
    return orders.join(lines, "k").withColumn("t", stats.rate(F.col("came"), F.col("o_totalprice")))


@query(f"with {PROVINCES} select province, pattern, total_cons, unique_winners, dominant_party, dominant_count, dominant_pct, avg_turnout, turnout_stdev, avg_invalid_rate from r where pattern is not null")
def province_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.province_patterns(province_units(spark, sf_dir), "province", "winner", "t", "r", "n", "k")


@query(f"with {PROVINCES} select province, total_cons, dominant_party, row_number() over (order by total_cons desc, province) - 1 place from r where pattern = 'monopoly'")
def monopoly_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provinces of one party, those with the most units first, with their place in that order."""
    rows = anomalies.province_patterns(province_units(spark, sf_dir), "province", "winner", "t", "r", "n", "k").where("pattern = 'monopoly'")
    placed = stats.with_ordinal(rows, F.desc("total_cons"), "province", name="place")
    return placed.select("province", "total_cons", "dominant_party", F.col("place").cast("bigint").alias("place"))


# --- Flags ----------------------------------------------------------------------------------------------


def flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    dominant = anomalies.winner_dominance(races(spark, sf_dir)).where("is_extreme")
    return anomalies.all_flags(
        [
            anomalies.flags(anomalies.fenced(_turnout(spark, sf_dir), "rate", two_sided=True, wide=True).where("is_outlier"), "turnout", "unit_id", "rate", "z"),
            anomalies.rate_flags(customer_units(spark, sf_dir), {"invalid": "invalid", "blank": "blank"}, "turn_out", "unit_id"),
            anomalies.rate_flags(part_units(spark, sf_dir), {"wasted": "wasted"}, "turn_out", "unit_id"),
            anomalies.flags(dominant, "dominance", "unit_id", "winner_pct"),
        ]
    )


def _flag_part(category: str, rates: str, severe: str, condition: str, flag: str) -> str:
    return f"""select unit_id::varchar unit_id, '{category}' category, {flag} flag, rate::double "value", '{category} ' || format('{{:,.2f}}', rate::double) || '%' detail,
    case when {severe} then 'high' else 'medium' end severity from (with {rates}, {_fence_sql("rates", "rate")} select *, round(case when sd > 0 then (rate - mean) / sd else 0.0 end, 2) z from rates, summary) where {condition}"""


FLAGS = " union all ".join(
    [
        _flag_part("turnout", TURNOUT, "abs(z) > 3", "rate > hi or rate < lo", "case when rate > hi then 'high' else 'low' end"),
        _flag_part("invalid", _rates_sql(CUSTOMERS, "invalid"), "rate > 8", "rate > hi", "'high'"),
        _flag_part("blank", _rates_sql(CUSTOMERS, "blank"), "rate > 10", "rate > hi", "'high'"),
        _flag_part("wasted", _rates_sql(PARTS, "wasted"), "rate > 20", "rate > hi", "'high'"),
        _flag_part("dominance", DOMINANCE.replace("shares as", "rates as"), "rate > 70", "rate > 60", "'extreme'"),
    ]
)


@query(FLAGS)
def all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_table(spark, sf_dir)


@query(f"""select unit_id, count(*) n_flags, string_agg(category, ',' order by category) categories, case when bool_or(severity = 'high') then 'high' else 'medium' end worst from ({FLAGS}) group by 1""")
def flags_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.flags_by_unit(flag_table(spark, sf_dir))


@query(f"select count(*) flags, count(distinct unit_id) flagged_units, count(distinct category) categories from ({FLAGS})")
def flagged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_table(spark, sf_dir).agg(F.count("*").alias("flags"), F.count_distinct("unit_id").alias("flagged_units"), F.count_distinct("category").alias("categories"))


@query(f"""select unit_id, string_agg(category || ':' || flag || ':' || severity, ',' order by category, flag) flags, max("value") highest from ({FLAGS}) group by 1""")
def unit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's nested flags, written out."""
    rows = anomalies.flag_lists(flag_table(spark, sf_dir))
    text = F.transform("flags", lambda f: F.concat_ws(":", f["category"], f["flag"], f["severity"]))
    return rows.select("unit_id", F.array_join(text, ",").alias("flags"), F.array_max(F.transform("flags", lambda f: f["value"])).alias("highest"))


# --- Two sources -------------------------------------------------------------------------------------------
# Unit: a supplier, candidates: brands, votes: quantity sold. The second source is made from the
# first: more of Brand#1 by the supplier's number, no Brand#2 where it is divisible by 11.

ADDED = {1: 3, 2: 30, 3: 150}
DIFF = """official as (select l_suppkey unit_id, p_brand name, sum(l_quantity)::bigint votes from lineitem join part on l_partkey = p_partkey group by 1, 2),
    citizen as (select unit_id, name, votes + case when name <> 'Brand#1' then 0 when unit_id % 5 = 1 then 3 when unit_id % 5 = 2 then 30 when unit_id % 5 = 3 then 150 else 0 end votes
      from official where not (name = 'Brand#2' and unit_id % 11 = 0)),
    both_sides as (select unit_id from official intersect select unit_id from citizen),
    diff as (select unit_id, name, coalesce(o.votes, 0) official_votes, coalesce(c.votes, 0) citizen_votes, abs(coalesce(o.votes, 0) - coalesce(c.votes, 0)) difference,
      case when coalesce(o.votes, 0) = coalesce(c.votes, 0) and coalesce(o.votes, 0) > 0 then 'matching' when coalesce(o.votes, 0) = 0 and coalesce(c.votes, 0) > 0 then 'missing_in_official'
        when coalesce(c.votes, 0) = 0 and coalesce(o.votes, 0) > 0 then 'missing_in_citizen' when coalesce(o.votes, 0) <> coalesce(c.votes, 0) then 'discrepant' else 'empty' end status
      from official o full join citizen c using (unit_id, name) where unit_id in (select unit_id from both_sides))"""


def _compared_sql(policy: str = "code") -> str:
    p = compare.POLICIES[policy]

    def over(votes: float | None, share: float | None) -> str:
        parts = [f"d > {votes}"] * (votes is not None) + [f"d / t * 100 > {share}"] * (share is not None)
        return " or ".join(parts)

    missing = " or m > 0" if p.missing_is_critical else ""
    return f"""{DIFF}, sums as (select unit_id, sum(official_votes)::bigint official_total, sum(citizen_votes)::bigint citizen_total, sum(difference)::bigint candidate_abs_diff,
      count(*) filter (status = 'matching') n_matching, count(*) filter (official_votes <> citizen_votes) n_discrepant, count(*) filter (status = 'missing_in_official') n_missing_official,
      count(*) filter (status = 'missing_in_citizen') n_missing_citizen from diff group by 1),
    parts as (select *, abs(official_total - citizen_total) d, official_total t, n_missing_official + n_missing_citizen m from sums),
    compared as (select * exclude (d, t, m), d difference, case when d = 0 then 'IDENTICAL' when {over(p.critical_votes, p.critical_percent)}{missing} then 'CRITICAL'
      when {over(p.significant_votes, p.significant_percent)} then 'SIGNIFICANT' else 'MINOR' end "level" from parts)"""


COMPARED = _compared_sql()


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("unit_id"), F.col("p_brand").alias("name"))
    official = sold.agg(F.sum("l_quantity").cast("bigint").alias("votes"))
    citizen = scans.perturbed(official, "unit_id", ADDED, 5, "name", "Brand#1").where("not (name = 'Brand#2' and unit_id % 11 = 0)")
    return official, citizen


def compared(spark: SparkSession, sf_dir: str, policy: str = "code") -> DataFrame:
    return compare.compare_units(compare.candidate_diff(*sources(spark, sf_dir)), policy=compare.POLICIES[policy])


@query(f"""with {DIFF} select unit_id, name, official_votes, citizen_votes, difference, status from diff""")
def compare_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = compare.candidate_diff(*sources(spark, sf_dir))
    return diff.select("unit_id", "name", "official_votes", "citizen_votes", "difference", "status")


@query(f"""with {DIFF} select unit_id, name, official_votes, citizen_votes, status from diff where status like 'missing%'""")
def missing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.candidate_diff(*sources(spark, sf_dir)).where("status like 'missing%'").select("unit_id", "name", "official_votes", "citizen_votes", "status")


@query(f"""with {COMPARED} select *, case "level" when 'IDENTICAL' then 0 when 'MINOR' then 1 when 'SIGNIFICANT' then 2 else 3 end::int level_rank from compared""")
def compare_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)


@query(" union all ".join(f"""select '{p}' policy, "level", count(*) units from (with {_compared_sql(p)} select * from compared) group by 2""" for p in compare.POLICIES))
def compare_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.policy_levels(compared(spark, sf_dir))


@query(
    f"with {COMPARED} select count(*) total, "
    + ", ".join(f"""count(*) filter ("level" = '{x}') {x.lower()}, round_even(count(*) filter ("level" = '{x}') / count(*) * 100, 2) {x.lower()}_pct""" for x in compare.LEVELS)
    + " from compared"
)
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.summarise(compared(spark, sf_dir))


@query(f"""with {COMPARED} select unit_id, official_total, citizen_total, difference, 'high' priority, 'CRITICAL: ' || format('{{:,}}', difference) || ' votes apart' note from compared where "level" = 'CRITICAL'""")
def critical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.notes(compared(spark, sf_dir)).where("level = 'CRITICAL'")
    return rows.select("unit_id", "official_total", "citizen_total", "difference", "priority", "note").orderBy("unit_id")


@query(f"""with {COMPARED} select "level", count(*) units, sum(difference)::bigint total_difference, max(difference) largest from compared group by 1""")
def level_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.level_groups(compared(spark, sf_dir))


@query(f"""with {COMPARED} select "level", unit_id, difference from compared""")
def level_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.level_members(compared(spark, sf_dir))


@query(f"""with {COMPARED} select unit_id, difference > 0 has_discrepancy, case when "level" = 'CRITICAL' then 'high' end priority, case when difference > 0 then "level" || ': ' || format('{{:,}}', difference) || ' votes apart' end note from compared""")
def unit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.notes(compared(spark, sf_dir)).select("unit_id", "has_discrepancy", "priority", "note")


@query(f"""with {DIFF} select unit_id, name, official_votes official, citizen_votes citizen, difference, difference > 10 suspicious from diff where official_votes <> citizen_votes""")
def discrepant_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's nested list of differing candidates, one row each."""
    rows = compare.discrepant_parties(compare.candidate_diff(*sources(spark, sf_dir)))
    return rows.select("unit_id", F.explode("parties").alias("p")).select("unit_id", "p.*")


@query(f"""with {DIFF} select unit_id, count(*) filter (status = 'matching') matching, coalesce(string_agg(name, ',' order by name) filter (official_votes <> citizen_votes), '') discrepant,
    coalesce(string_agg(name, ',' order by name) filter (status = 'missing_in_official'), '') missing_in_official, coalesce(string_agg(name, ',' order by name) filter (status = 'missing_in_citizen'), '') missing_in_citizen from diff group by 1""")
def compare_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.details(compare.candidate_diff(*sources(spark, sf_dir)))
    return rows.select("unit_id", F.size("matching").cast("bigint").alias("matching"), *[F.array_join(c, ",").alias(c) for c in ("discrepant", "missing_in_official", "missing_in_citizen")])


@query(f"""with {COMPARED}, checks as (select 'critical' c, count(*) filter ("level" = 'CRITICAL') n from compared union all select 'missing', sum(n_missing_official + n_missing_citizen) from compared union all select 'uncounted', count(*) filter (official_total = 0) from compared)
    select 'now' generated_at, count(*) checks, count(*) filter (n > 0) with_findings, string_agg(c, ',' order by c) filter (n > 0) names from checks""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the comparison, and which of them found something."""
    one = compared(spark, sf_dir).agg(F.count_if(F.col("level") == "CRITICAL").alias("critical"), F.sum(F.col("n_missing_official") + F.col("n_missing_citizen")).alias("missing"), F.count_if(F.col("official_total") == 0).alias("uncounted"))
    return sinks.audit_report(one.unpivot([], ["critical", "missing", "uncounted"], "check", "findings"), "now")


NATIONS = "places as (select s_suppkey unit_id, n_name province from supplier join nation on s_nationkey = n_nationkey)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("unit_id"), F.col("n_name").alias("province"))


@query(f"""with {COMPARED}, {NATIONS} select coalesce(province, 'unknown') province, count(*) units, count(*) filter ("level" = 'IDENTICAL') "identical", count(*) filter (difference > 0) discrepancies, count(*) filter ("level" = 'CRITICAL') critical
    from compared left join places using (unit_id) group by 1""")
def compare_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = denormalise.with_lookup(compared(spark, sf_dir), places(spark, sf_dir), "unit_id", "province", F.lit("unknown"))
    return compare.by_group(rows, "province")


PAGE = 3


@query(f"""with {COMPARED}, {NATIONS}, n as (select coalesce(province, 'unknown') province, unit_id from compared left join places using (unit_id)),
    p as (select *, (row_number() over (partition by province order by unit_id) - 1) // {PAGE} page, count(*) over (partition by province) units from n)
    select province, page, units, string_agg(unit_id, ',' order by unit_id) members from p group by all""")
def nation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's nested list of compared units, in pages, written out."""
    rows = denormalise.with_lookup(compared(spark, sf_dir), places(spark, sf_dir), "unit_id", "province", F.lit("unknown"))
    text = F.array_join(F.transform("members", lambda u: u.cast("string")), ",")
    return compare.group_members(rows, "province", page_rows=PAGE).withColumn("members", text)


# A customer's place: its number on a sheet of forty columns; the measure: its balance, higher to the right.

SPOTS = "spots as (select c_custkey % 40 x, c_custkey // 40 % 60 y, c_acctbal + 1000 * (c_custkey % 40) v from customer where c_acctbal is not null)"


@query(f"""with {SPOTS}, cells as (select floor(x / 5.0)::bigint cx, floor(y / 5.0)::bigint cy, v - (select avg(v) from spots) z from spots), c as (select cx, cy, count(*) n, sum(z) s, sum(z * z) m2, sum(z ** 4) m4 from cells group by 1, 2),
    near as (select cx + i cx, cy + j cy, sum(n) nn, sum(s) ss from c, (select unnest([-1, 0, 1]) i), (select unnest([-1, 0, 1]) j) group by 1, 2),
    t as (select sum(n)::double n, sum(n * (nn - 1))::double w, sum(n * (nn - 1) ** 2)::double d, sum(m2) m2, sum(m4) m4, sum(s * ss - m2) p from c join near using (cx, cy)), e as (select *, -1 / (n - 1) e, n * p / (w * m2) i, n * m4 / (m2 * m2) b from t),
    r as (select *, (n * ((n * n - 3 * n + 3) * 2 * w - n * 4 * d + 3 * w * w) - b * ((n * n - n) * 2 * w - 2 * n * 4 * d + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - e * e v from e)
    select n::bigint units, (w / 2)::bigint pairs, round(i, 6) moran_i, round(e, 6) expected, round((i - e) / sqrt(v), 4) z from r""")
def spatial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = table(spark, sf_dir, "customer").where("c_acctbal is not null"), F.col("c_custkey")
    found = spatial.morans_i(rows, k % 40, F.floor(k / 40) % 60, F.col("c_acctbal") + 1000 * (k % 40), 5.0)
    return found.select("units", "pairs", *[stats.round_half_up(c, 6).alias(c) for c in ("moran_i", "expected")], stats.round_half_up("z", 4).alias("z"))


@query(f"""with {SPOTS} select count(*) > 0 tested, 19 permutations, 0 as_far from spots""")
def spatial_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend to the right is farther from chance than all permutations."""
    rows, k = table(spark, sf_dir, "customer").where("c_acctbal is not null"), F.col("c_custkey")
    found = spatial.permutation_test(rows, k % 40, F.floor(k / 40) % 60, F.col("c_acctbal") + 1000 * (k % 40), 5.0, permutations=19)
    return found.select(F.col("moran_i").isNotNull().alias("tested"), "permutations", "as_far")


@query(f"""with {COMPARED}, {NATIONS} select unit_id, province, "level", difference from compared join places using (unit_id) where "level" in ('SIGNIFICANT', 'CRITICAL')""")
def level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir).join(places(spark, sf_dir), "unit_id")
    return dashboard.level_filter(rows, "significant").select("unit_id", "province", "level", "difference")


@query(f"""with {COMPARED}, {NATIONS} select unit_id, province, "level" from compared join places using (unit_id) where "level" in ('MINOR', 'SIGNIFICANT', 'CRITICAL') and province = 'NATION_3'""")
def province_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir).join(places(spark, sf_dir), "unit_id")
    return dashboard.level_filter(rows, "any", "NATION_3").select("unit_id", "province", "level")


@query(f"""with {COMPARED} select case when difference = 0 then 'none' when difference < 100 then 'low' when difference < 1000 then 'medium' else 'high' end band,
    case "level" when 'IDENTICAL' then 'matching' else lower("level") end badge, count(*) units from compared group by 1, 2""")
def diff_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir).select(dashboard.difference_band(F.col("difference")).alias("band"), dashboard.badge(F.col("level")).alias("badge"))
    return rows.groupBy("band", "badge").agg(F.count("*").alias("units"))


@query(f"""with {COMPARED}, {NATIONS} select province, count(*) problem_units from places where unit_id in (select unit_id from compared where "level" in ('SIGNIFICANT', 'CRITICAL')) group by 1 order by 2 desc, 1 limit 10""")
def semi_problem_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.problem_groups(compared(spark, sf_dir), places(spark, sf_dir), "unit_id", "province")


@query("""select ts::date "day", count(*) compared, count(*) filter (event_type = 'error') critical_found from events group by 1""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.timeline(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "error")


# --- Statistical tests ------------------------------------------------------------------------------------------
# Swing: a customer's order value in 1997 against 1996.

SWINGS = """swings as (select a.o_custkey unit_id, a.v votes_current, b.v votes_historical, (a.v - b.v) / b.v * 100 swing from
      (select o_custkey, round(sum(o_totalprice), 2) v from orders where year(o_orderdate) = 1997 group by 1) a join (select o_custkey, round(sum(o_totalprice), 2) v from orders where year(o_orderdate) = 1996 group by 1) b using (o_custkey)),
    quarts as (select quantile_cont(swing, 0.25) q1, quantile_cont(swing, 0.5) q2, quantile_cont(swing, 0.75) q3 from swings), fence as (select *, q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from quarts)"""


def _swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    year = lambda y: orders.where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("unit_id")).agg(stats.round_half_up(F.sum("o_totalprice"), 2).alias("votes"))
    return statistics.swings(year(1997), year(1996), "unit_id")


@query(f"with {SWINGS} select unit_id, votes_current, votes_historical, round(swing, 4) swing_pct from swings, fence where swing < lo or swing > hi")
def swing_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.swing_outliers(_swings(spark, sf_dir)).withColumn("swing_pct", stats.round_half_up("swing_pct", 4))


@query(f"with {SWINGS} select count(*) count, round(avg(swing), 4) mean, round(any_value(q2), 4) median, round(any_value(lo), 4) lower_fence, round(any_value(hi), 4) upper_fence, count(*) filter (swing < lo or swing > hi) outliers from swings, fence")
def swing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = statistics.swing_summary(_swings(spark, sf_dir))
    return one.select("count", *[stats.round_half_up(c, 4).alias(c) for c in ("mean", "median", "lower_fence", "upper_fence")], "outliers")


@query("""select count(*) "rows", round(corr(l_quantity, date_diff('day', o_orderdate::date, l_shipdate::date)), 6) correlation, corr(l_quantity, date_diff('day', o_orderdate::date, l_shipdate::date)) < 0 warning
    from lineitem join orders on l_orderkey = o_orderkey""")
def timing_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = verify.timing_correlation(rows, F.col("l_quantity"), F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    return one.withColumn("correlation", stats.round_half_up("correlation", 6))


@query("select count(l_quantity) total, count(*) filter (l_quantity % 50 = 0) round_count, round(count(*) filter (l_quantity % 50 = 0) / count(l_quantity) * 100, 6) round_pct, count(*) filter (l_quantity % 50 = 0) / count(l_quantity) * 100 > 20 round_suspicious from lineitem")
def round_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.round_numbers(table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("round_pct", stats.round_half_up("round_pct", 6))


@query("select round(avg(o_totalprice), 4) mean, round(var_pop(o_totalprice), 1) variance, round(stddev_pop(o_totalprice), 4) stdev, round(stddev_pop(o_totalprice) / avg(o_totalprice) * 100, 6) cv, stddev_pop(o_totalprice) / avg(o_totalprice) * 100 < 10 cv_suspicious from orders")
def variance_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = statistics.variation(table(spark, sf_dir, "orders"), "o_totalprice")
    return one.select(stats.round_half_up("mean", 4).alias("mean"), stats.round_half_up("variance", 1).alias("variance"), stats.round_half_up("stdev", 4).alias("stdev"), stats.round_half_up("cv", 6).alias("cv"), "cv_suspicious")


LINEAR = "(select o_totalprice x, row_number() over (order by o_orderkey, o_totalprice) - 1 i from orders)"


@query(f"""select count(*) "rows", round(corr(i, x), 6) correlation, abs(corr(i, x)) > 0.95 linear_suspicious from {LINEAR}""")
def linear_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.linear_pattern(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey").withColumn("correlation", stats.round_half_up("correlation", 6))


@query(f"""with {DIGITS.replace("o_totalprice >= 10", "o_totalprice >= 1")}, p as (select x, exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6) p from x),
    s as (select count(*) filter (o_totalprice % 50 = 0) / count(*) * 100 > 20 r, stddev_pop(o_totalprice) / avg(o_totalprice) * 100 < 10 c from orders), l as (select abs(corr(i, x)) > 0.95 lin from {LINEAR}),
    f as (select round(x, 2) chi_square, p > 0.05 conforms, r round_suspicious, c cv_suspicious, lin linear_suspicious, ((p <= 0.05)::int + r::int + c::int)::int risk_flags from p, s, l)
    select *, case risk_flags when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end risk_level from f""")
def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = statistics.risk_report(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")
    return one.select(stats.round_half_up("chi_square", 2).alias("chi_square"), "conforms", "round_suspicious", "cv_suspicious", "linear_suspicious", "risk_flags", "risk_level")


# --- Checks --------------------------------------------------------------------------------------------------------


@query("""select count(*) total, count(distinct c_nationkey) "groups" from customer""")
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.structure(table(spark, sf_dir, "customer"), "c_nationkey")


@query("select n_name province, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1 order by 2 desc, 1 limit 10")
def structure_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return verify.largest_groups(rows.select(F.col("n_name").alias("province")), "province")


@query("""with v as (select o_custkey unit_id, round(sum(o_totalprice), 2) votes_cast from orders group by 1), q as (select quantile_cont(votes_cast, 0.25) q1, quantile_cont(votes_cast, 0.75) q3 from v)
    select unit_id, votes_cast, case when votes_cast < q1 - 1.5 * (q3 - q1) then 'low' else 'high' end side from v, q where votes_cast < q1 - 1.5 * (q3 - q1) or votes_cast > q3 + 1.5 * (q3 - q1)""")
def votes_cast_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(stats.round_half_up(F.sum("o_totalprice"), 2).alias("votes_cast"))
    return verify.value_outliers(votes, "votes_cast")


@query("""with u as (select l_orderkey unit_id, count(*) n, count(distinct l_linenumber) d, max(l_linenumber)::bigint m, count(distinct l_suppkey) s, count(distinct l_partkey) p from lineitem group by 1),
    f as (select unit_id, 'lines' field, n a, d b from u union all select unit_id, 'last', n, m from u union all select unit_id, 'suppliers', s, p from u)
    select unit_id, field, a::varchar value_1, b::varchar value_2, abs(a - b)::double difference from f where a <> b""")
def consistency_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of an order's record: number of lines, last line, distinct suppliers against parts."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id"))
    units = lines.agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("d"), F.max("l_linenumber").alias("m"), F.count_distinct("l_suppkey").alias("s"), F.count_distinct("l_partkey").alias("p"))
    first = units.select("unit_id", F.col("n").alias("lines"), F.col("n").alias("last"), F.col("s").alias("suppliers"))
    second = units.select("unit_id", F.col("d").alias("lines"), F.col("m").alias("last"), F.col("p").alias("suppliers"))
    return verify.consistency_diff(first, second, ["unit_id"], ["lines", "last", "suppliers"])


# --- Denormalising and totals -----------------------------------------------------------------------------------------


@query("""select o_orderkey unit_id, coalesce(n_name, c_nationkey::varchar) || ' เขต ' || o_orderkey constituency, coalesce(n_name, c_nationkey::varchar) province, coalesce(r_name, 'unknown') region, coalesce(c_name, '') candidate, coalesce(nullif(c_mktsegment, ''), c_name) abbr, o_totalprice votes
    from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey where not (coalesce(o_totalprice, 0) = 0)""")
def denormalise_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, nation and region, defaults for what is missing."""
    orders, customers = table(spark, sf_dir, "orders").where("not (coalesce(o_totalprice, 0) = 0)"), table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    named = denormalise.with_lookup(orders.withColumn("c_custkey", F.col("o_custkey")), customers.withColumnRenamed("c_name", "candidate"), "c_custkey", "candidate", F.lit(""))
    placed = denormalise.with_lookup(named.withColumnRenamed("c_nationkey", "n_nationkey"), nations, "n_nationkey", "n_name", F.col("n_nationkey").cast("string"))
    return placed.select(
        F.col("o_orderkey").alias("unit_id"),
        F.concat("n_name", F.lit(" เขต "), F.col("o_orderkey").cast("string")).alias("constituency"),
        F.col("n_name").alias("province"),
        F.coalesce("r_name", F.lit("unknown")).alias("region"),
        "candidate",
        F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("")), F.nullif(F.col("candidate"), F.lit(""))).alias("abbr"),
        F.col("o_totalprice").alias("votes"),
    )


@query("select p_brand party, sum(l_quantity)::bigint cons_votes, round(sum(l_extendedprice), 2) list_votes, count(*) seats from lineitem join part on l_partkey = p_partkey group by 1 order by 2 desc, 1 limit 10")
def party_totals_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_brand").alias("party"), F.col("l_quantity").cast("bigint").alias("quantity"), "l_extendedprice", F.lit(1).alias("one"))
    sums = denormalise.party_totals(rows, "party", {"cons_votes": "quantity", "list_votes": "l_extendedprice", "seats": "one"})
    return denormalise.most_votes(sums, "party").withColumn("list_votes", stats.round_half_up("list_votes", 2))


@query("""with v as (select n_name province, p_brand party, sum(l_quantity)::bigint votes from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2)
    select province, party, votes, place::int place from (select *, row_number() over (partition by province order by votes desc, party) place from v) where place <= 5""")
def province_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(places(spark, sf_dir), F.col("l_suppkey") == F.col("unit_id"))
    votes = rows.groupBy("province", F.col("p_brand").alias("party")).agg(F.sum("l_quantity").cast("bigint").alias("votes"))
    return denormalise.top_by_group(votes, "province", [F.desc("votes"), F.col("party")], 5)


@query("""select n_name province, coalesce(sum(n), 0)::bigint turn_out, count(s_suppkey) units from nation left join supplier on s_nationkey = n_nationkey left join (select l_suppkey, count(*) n from lineitem group by 1) on l_suppkey = s_suppkey group by 1""")
def province_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with its suppliers and their order lines, also those without."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(lines, "s_suppkey", "left")
    return rows.groupBy(F.col("n_name").alias("province")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("turn_out"), F.count("s_suppkey").alias("units"))


# --- Text, JSON and listings -----------------------------------------------------------------------------------------------


@query("""select url, count(*) found from (select unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) url from pages) where length(url) < 150 group by 1""")
def url_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.addresses(table(spark, sf_dir, "pages"), "html").orderBy("url")


@query("""select event_type, cast(json_extract_string(props, '$.k') as bigint) k, count(*) n from events group by 1, 2""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.field_counts(table(spark, sf_dir, "events"), "props", "k", "bigint", "event_type")


@query("""select field, count(*) "rows" from (select unnest(json_keys(props)) field from events) group by 1""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.json_fields(table(spark, sf_dir, "events"), "props")


@query("""select props, len(json_keys(props)) entries, count(*) n from events group by 1, 2""")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("props", scans.entries("props").cast("bigint").alias("entries"))
    return rows.groupBy("props", "entries").agg(F.count("*").alias("n"))


@query("""select url, count(*) found from (select unnest(regexp_extract_all(html, '["'']([^"'']*(?:/th|/de)[^"'']*)["'']', 1)) url from pages) where length(url) < 150 group by 1""")
def quoted_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted strings that hold one of some words, as addresses of stations and data files are found."""
    return scans.addresses(table(spark, sf_dir, "pages"), "html", scans.quoted(("/th", "/de")))


@query("""select url, 200 status from pages where page_id % 3 = 0""")
def live_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 3 == 0, 200).otherwise(404).alias("status"))
    return scans.live_endpoints(probes)


@query("""select case page_id % 4 when 0 then 'found' when 1 then 'absent' when 2 then 'reported' else 'error' end outcome, case page_id % 4 when 0 then 200 when 1 then 404 when 2 then 503 end status, count(*) n from pages group by all""")
def endpoint_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probed addresses by what came of them."""
    k = F.col("page_id") % 4
    probes = table(spark, sf_dir, "pages").select("url", F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 503).alias("status"))
    return scans.endpoint_outcomes(probes).groupBy("outcome", "status").agg(F.count("*").alias("n"))


# Thai names: a consonant for each nation in the alphabet's order, every second one behind a vowel that is
# written first and sorted after it (and stands after all consonants by its number).

THAI = ", ".join(f"'{'เ' if k % 2 else ''}{chr(0x0E01 + k)}น'" for k in range(35))


@query(f"""select list_value({THAI})[n_nationkey % 35 + 1] "name", row_number() over (order by n_nationkey) - 1 place from nation where n_nationkey < 35""")
def province_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of the language, with their place."""
    names = table(spark, sf_dir, "nation").where("n_nationkey < 35").select(F.expr(f"array({THAI})[n_nationkey % 35]").alias("name"))
    placed = stats.with_ordinal(dashboard.collated(names.unionByName(names), "name"), F.expr("name collate th"), name="place")
    return placed.select("name", "place")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 200")
def unit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the orders by price."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return dashboard.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


@query("""select user_id unit_id, max(ts) ts, arg_max("value", struct_pack(t := ts, e := event_id)) total from events group by 1""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reading of each unit, as the snapshot comparison takes it."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), "ts", "event_id", F.col("value").alias("total"))
    return snapshots.latest(rows, "event_id")
