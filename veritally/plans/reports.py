"""The nested anomaly report over the driver's tables, written as JSON and read again, and what documents hold.

Unit: an order with its lines; province: a customer.  Turnout: the lines' prices of
the order's price; invalid, blank and wasted: lines by flag and status; candidates:
lines, votes: quantity; counted: lines with a discount over 0.05.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.functions.shared import workspace
from veritally.operators import anomalies, report
from veritally.plans import catalog
from veritally.plans.catalog import PROVINCES, query, table
from veritally.sources import discovery, scans, sinks

TOP = 10
E = stats.EDGES
#: (name, SQL value over u, what is a finding, order of the findings, edges)
SECTIONS = (
    ("turnout", "case when price > 0 and came > 0 then round_even(came / price * 100, 2) end", "both", "-abs(v - median)", E["turnout"]),
    ("invalid_ballots", "round_even(invalid / n * 100, 2)", "high", "-v", E["invalid"]),
    ("blank_votes", "round_even(blank / n * 100, 2)", "high", "-v", E["blank"]),
    ("wasted_votes", "round_even(wasted / n * 100, 2)", "high", "-v", E["wasted"]),
    ("winner_dominance", "case when votes > 0 and fst > 0 then round_even(fst / votes * 100, 2) end", "v > 60", "-v", E["dominance"]),
    ("close_races", "case when n > 1 and votes > 0 then round_even((fst - snd) / votes * 100, 2) end", "v < 3", "v", ()),
    ("counting_progress", "round_even(counted / n * 100, 2)", "v < 100", "v", ()),
    ("math_consistency", "case when price > 0 and abs(came - price) > 0.005 then round_even(abs(came - price) / price * 100, 2) end", "v > 10", "-v", ()),
)


def _sql() -> str:
    measures = " union all ".join(f"select {k} s, '{name}' name, unit, {value} v from u" for k, (name, value, *_) in enumerate(SECTIONS))
    found = {"both": "case when v > hi then 'high' when v < lo then 'low' end", "high": "case when v > hi then 'high' end"}
    flag = " ".join(f"when {k} then {found.get(rule) or f'''case when {rule} then '{'over' if '>' in rule else 'under'}' end'''}" for k, (_, _, rule, *_) in enumerate(SECTIONS))
    order = " ".join(f"when {k} then {key}" for k, (_, _, _, key, _) in enumerate(SECTIONS))
    edges = ", ".join(f"({k}, {i}, {e[i]}, {e[i + 1]}, {i == len(e) - 2}, '{e[i]}-{e[i + 1]}%')" for k, (*_, e) in enumerate(SECTIONS) for i in range(len(e) - 1))
    p = PROVINCES.replace("with l as", "l as", 1)
    return f"""with {p},
    raw as (select l_orderkey unit, count(*) n, sum(l_extendedprice) came, count(*) filter (l_returnflag = 'R') invalid, count(*) filter (l_returnflag = 'A') blank, count(*) filter (l_linestatus = 'F') wasted,
      count(*) filter (l_discount > 0.05) counted, max(l_quantity) fst, (list_sort(list(l_quantity), 'desc'))[2] snd, sum(l_quantity) votes from lineitem group by 1),
    uu as (select raw.*, o_totalprice price from raw join orders on o_orderkey = unit), m0 as ({measures.replace(" from u", " from uu")}), m as (select * from m0 where v is not null),
    stat as (select s, avg(v) mean, median(v) median, coalesce(stddev_samp(v), 0) sd, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3, count(*) total from m group by 1), fence as (select *, q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from stat),
    checked as (select m.s, unit::varchar unit_id, v, case m.s {flag} end flag, case m.s {order} end k from m join fence using (s)),
    ranked as (select *, row_number() over (partition by s order by k, unit_id, v) place from checked where flag is not null),
    tops as (select s, string_agg(unit_id || ':' || round(v * 100)::bigint || ':' || flag, ',' order by place) findings from ranked where place <= {TOP} group by 1),
    e(s, bin, a, b, last, "label") as (values {edges}), bins as (select e.s, bin, any_value("label") "label", count(v) n from e left join m on m.s = e.s and v >= a and (v < b or last and v <= b) group by 1, 2),
    hist as (select s, string_agg("label" || '=' || n, ',' order by bin) histogram from bins group by 1),
    names as (select s, any_value(name) name from m0 group by 1), flagged as (select s, count(*) flagged from checked where flag is not null group by 1),
    units8 as (select name, coalesce(total, 0) total, coalesce(flagged, 0) flagged, round(mean, 2) mean, round(median, 2) median, round(sd, 2) stdev, round(q1, 2) q1, round(q3, 2) q3, round(lo, 2) lower_fence, round(hi, 2) upper_fence, coalesce(histogram, '') histogram, coalesce(findings, '') findings
      from names left join fence using (s) left join flagged using (s) left join hist using (s) left join tops using (s)),
    bd as (select digit, count(o_totalprice) n from (select unnest(range(1, 10))::int digit) left join orders on o_totalprice >= 10 and substr(cast(floor(o_totalprice) as bigint)::varchar, 1, 1)::int = digit group by 1),
    bt as (select sum(n)::bigint total from bd), bx as (select sum((n - total * log10(1 + 1.0 / digit)) ** 2 / (total * log10(1 + 1.0 / digit))) x from bd, bt),
    benford as (select 'benford' name, total, (x >= 15.507)::int flagged, (select string_agg(digit || '=' || n, ',' order by digit) from bd) histogram from bt, bx),
    pat as (select *, row_number() over (order by pattern = 'monopoly' desc, total_cons desc, province::varchar) place from r where pattern is not null),
    provinces as (select 'province_patterns' name, count(*) total, count(*) filter (pattern = 'monopoly') flagged, 'monopoly=' || count(*) filter (pattern = 'monopoly') || ',high_variation=' || count(*) filter (pattern = 'high_variation') histogram,
      coalesce(string_agg(province || ':' || total_cons * 100 || ':' || pattern, ',' order by place) filter (place <= {TOP}), '') findings from pat),
    sections as (select * from units8 union all select name, total, flagged, null, null, null, null, null, null, null, histogram, '' from benford union all select name, total, flagged, null, null, null, null, null, null, null, histogram, findings from provinces)
    select (select count(*) from uu) total_units, (select count(distinct unit_id) from checked where flag is not null) flagged_units, 10 analysis_categories, * from sections"""


def report_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    by_vote = [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    led = anomalies.first_two(lines.withColumnRenamed("l_orderkey", "unit"), "unit", by_vote, "l_quantity", "l_linenumber").select("unit", F.col("winner_votes").alias("first"), F.col("second_votes").alias("second"))
    count = lambda test, name: F.count_if(test).alias(name)
    own = lines.groupBy(F.col("l_orderkey").alias("unit")).agg(
        F.count("*").alias("n"), F.sum("l_extendedprice").alias("came"), F.sum("l_quantity").alias("votes"), count(F.col("l_returnflag") == "R", "invalid"), count(F.col("l_returnflag") == "A", "blank"),
        count(F.col("l_linestatus") == "F", "wasted"), count(F.col("l_discount") > 0.05, "counted"),
    )
    return own.join(led, "unit").join(orders.select(F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("price")), "unit")


def report_sections() -> list[report.Section]:
    n, price, came, votes, first = (F.col(c) for c in ("n", "price", "came", "votes", "first"))
    share = lambda part: stats.rate(F.col(part), n)
    apart = F.abs(came - price)
    return [
        report.Section("turnout", F.when((price > 0) & (came > 0), stats.rate(came, price)), fence="both", edges=E["turnout"]),
        report.Section("invalid_ballots", share("invalid"), fence="high", edges=E["invalid"]),
        report.Section("blank_votes", share("blank"), fence="high", edges=E["blank"]),
        report.Section("wasted_votes", share("wasted"), fence="high", edges=E["wasted"]),
        report.Section("winner_dominance", F.when((votes > 0) & (first > 0), stats.rate(first, votes)), over=anomalies.EXTREME_SHARE, edges=E["dominance"]),
        report.Section("close_races", F.when((n > 1) & (votes > 0), stats.rate(first - F.col("second"), votes)), under=anomalies.CLOSE_MARGIN),
        report.Section("counting_progress", share("counted"), under=100),
        report.Section("math_consistency", F.when((price > 0) & (apart > 0.005), stats.rate(apart, price)), over=10),
    ]


@query(_sql())
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's sections, a row each, read from the document as it was written."""
    patterns = anomalies.province_patterns(catalog.province_units(spark, sf_dir), "province", "winner", "t", "r", "n", "k", ordered=False)
    more = [report.digits_section(table(spark, sf_dir, "orders"), "o_totalprice"), report.patterns_section(patterns, "province", top=TOP)]
    folder = workspace(spark, "report")
    sinks.write_json(report.document(report_units(spark, sf_dir), "unit", report_sections(), more, TOP), folder, files=1)
    rows = scans.read_report(spark, folder).select("total_units", "flagged_units", "analysis_categories", F.explode("sections").alias("s")).select("*", "s.*").drop("s")
    histogram = F.array_join(F.transform("histogram", lambda b: F.concat(b["label"], F.lit("="), b["count"].cast("string"))), ",")
    findings = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["unit_id"], F.floor(f["value"] * 100 + 0.5).cast("string"), f["flag"])), ",")
    return rows.withColumn("histogram", histogram).withColumn("findings", findings)


def _paths_sql(documents: str) -> str:
    """``documents``: SQL of rows with a JSON column ``j``."""
    return f"""with docs as ({documents}), tree as (select regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') path, case t.type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null'
      when 'DOUBLE' then 'number' else 'integer' end "type", case when t.type = 'ARRAY' then json_array_length(t.value) end size from docs, json_tree(docs.j) t),
    found as (select path, "type", count(*) n, min(size)::bigint least_size, max(size)::bigint greatest_size, sum(size)::bigint members from tree group by 1, 2),
    around as (select *, case when path = '$' then null when path like '%[]' then left(path, len(path) - 2) else regexp_replace(path, '\\.[^.]*$', '') end up, case when path like '%[]' then 'array' else 'object' end holds from found)
    select a.path, a."type", a.n count, round(a.n / case when a.path = '$' then (select count(*) from docs) when holds = 'array' then b.members else b.n end, 4) share, a.least_size, a.greatest_size
    from around a left join found b on b.path = a.up and b."type" = holds"""


@query(_paths_sql("select props::json j from events"))
def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, types and shares in the events' documents."""
    return discovery.discover(table(spark, sf_dir, "events"), "props")


@query(
    _paths_sql("""select json_object('unit_id', l_orderkey::varchar, 'note', case when l_orderkey % 4 = 0 then 'checked' end, 'total', case when l_orderkey % 3 = 0 then to_json(sum(l_linenumber)::bigint) else to_json('none') end,
    'place', json_object('open', l_orderkey % 2 = 0), 'lines', to_json(list({'number': l_linenumber, 'price': case when l_linenumber <> 2 then l_linenumber + 0.25 end}))) j from lineitem group by l_orderkey""")
)
def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents as they were landed, with nulls, lists and a field of two types."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    line = F.struct(n.alias("number"), F.when(n != 2, n + 0.25).alias("price"))
    rows = table(spark, sf_dir, "lineitem").groupBy(k).agg(F.sum(n).alias("sum"), F.collect_list(line).alias("lines"))
    rows = rows.select(k.cast("string").alias("unit_id"), F.when(k % 4 == 0, "checked").alias("note"), F.when(k % 3 == 0, F.to_variant_object(F.array("sum"))).alias("sum"), F.struct((k % 2 == 0).alias("open")).alias("place"), "lines")
    total = F.coalesce(F.variant_get("sum", "$[0]", "variant"), F.parse_json(F.lit('"none"')))
    folder = workspace(spark, "documents")
    sinks.write_json(rows.select("unit_id", "note", total.alias("total"), "place", "lines"), folder)
    return discovery.discover(scans.read_documents(spark, folder), "json")
