"""Equivalent DuckDB SQL for every SQL-expressible query key.

The driver registers the input tables as views and runs these strings next to the Spark
queries. ``LAYERS`` rebuilds raw -> bronze -> silver -> gold in SQL; each query continues
from it. Rounding uses ``round_even(x * 10^n, 0) / 10^n``, the SQL spelling of numpy rounding.
"""

from __future__ import annotations

import math

from quillspark.config import MODEL_FEATURES, VALID_STATUSES
from quillspark.operators.iforest import EULER_GAMMA, experiments


def rnd(expr: str, n: int) -> str:
    s = float(10 ** n)
    return f"(round_even(cast({expr} as double) * {s}, 0) / {s})"


def rate(part: str, whole: str) -> str:
    return rnd(f"(cast({part} as double) / nullif(cast({whole} as double), 0)) * 100.0", 2)


def title(expr: str) -> str:
    return (f"trim(array_to_string(list_transform(regexp_extract_all(lower({expr}), '([a-z]+|[^a-z]+)', 1), "
            f"lambda x: concat(upper(x[1]), x[2:])), ''))")


AS_OF = "date '2001-01-01'"

LAYERS = f"""
base as (
 select o_orderkey k, cast(o_orderdate as date) d, o_totalprice p, c_custkey, c_mktsegment, n_name
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
one as (
 select k,
  concat('INV-', lpad(cast(k as varchar), greatest(9, length(cast(k as varchar)))::int, '0')) invoice_id,
  concat('VND-', lpad(cast(c_custkey as varchar), greatest(7, length(cast(c_custkey as varchar)))::int, '0')) vendor_id,
  case when k % 2 = 0 then concat(' VENDOR-GROUP ', cast(c_custkey as varchar), ' O''NEIL AND SONS ')
       else concat('vendor-group ', cast(c_custkey as varchar), ' o''neil and sons') end vendor_name,
  case when k % 211 = 0 then 'not-a-date' when k % 3 = 0 then strftime(d, '%Y-%m-%d')
       when k % 3 = 1 then strftime(d, '%m/%d/%Y') else strftime(d, '%d-%m-%Y') end invoice_date,
  strftime(d + interval 30 day, '%Y-%m-%d') due_date,
  cast(case when k % 33 = 0 then null when k % 97 = 0 then floor(p / 1000) * 1000 when k % 100 = 7 then -p else p end as double) amount,
  case when k % 20 < 11 then 'paid' when k % 20 < 16 then 'Pending ' when k % 20 < 18 then ' OVERDUE'
       when k % 20 = 18 then 'Disputed' else 'cancelled' end status,
  case when k % 2 = 0 then lower(c_mktsegment) else concat(' ', c_mktsegment) end category,
  lower(n_name) state,
  case when k % 10 < 7 then concat('note ', cast(k as varchar)) end notes,
  strftime(cast(d as timestamp) + to_seconds(k % 86400), '%Y-%m-%dT%H:%M:%S') created_at
 from base),
raw as (select * exclude (k) from one union all select * exclude (k) from one where k % 50 = 0),
bronze as (select *, 'invoice_csv_feed' _source,
  md5(concat(invoice_id, coalesce(cast(amount as varchar), 'nan'), invoice_date)) _row_hash from raw),
dd as (select * exclude (rn) from (select *, row_number() over (partition by _row_hash order by created_at, invoice_id) rn from bronze) t where rn = 1),
dt as (select * replace (
   cast(coalesce(try_strptime(invoice_date, '%Y-%m-%d'), try_strptime(invoice_date, '%m/%d/%Y'), try_strptime(invoice_date, '%d-%m-%Y')) as date) as invoice_date,
   cast(coalesce(try_strptime(due_date, '%Y-%m-%d'), try_strptime(due_date, '%m/%d/%Y'), try_strptime(due_date, '%d-%m-%Y')) as date) as due_date)
 from dd),
silver as (
 select invoice_id, vendor_id, {title('vendor_name')} vendor_name, invoice_date, due_date,
  cast(round_even(abs(coalesce(amount, 0.0)) * 100.0, 0) / 100.0 as decimal(28,2)) amount,
  trim(upper(status)) status, {title('category')} category, trim(upper(state)) state, notes, created_at,
  _source, _row_hash, amount is null _amount_was_null,
  cast(due_date - invoice_date as int) days_to_due,
  case when trim(upper(status)) = 'PAID' then 0 when due_date is null then null
       else greatest(cast({AS_OF} - due_date as int), 0) end days_overdue,
  coalesce(trim(upper(status)) = 'OVERDUE' or (due_date < {AS_OF} and trim(upper(status)) = 'PENDING'), false) is_overdue,
  concat('Q', cast(quarter(invoice_date) as varchar)) payment_quarter, cast(year(invoice_date) as int) invoice_year
 from dt where invoice_date is not null),
vendor_g as (
 select vendor_id, vendor_name, state, count(invoice_id) total_invoices, sum(amount) sm, count(amount) cn, max(amount) mx,
  count_if(status = 'PAID') paid_count, count_if(status = 'OVERDUE') overdue_count,
  count_if(status = 'DISPUTED') disputed_count, count_if(status = 'PENDING') pending_count,
  avg(cast(days_overdue as double)) avg_days_overdue
 from silver group by vendor_id, vendor_name, state),
vendor_r as (
 select vendor_id, vendor_name, state, cast(total_invoices as bigint) total_invoices,
  {rnd('cast(sm as double)', 2)} total_amount, {rnd('cast(sm as double) / cn', 2)} avg_amount, cast(mx as double) max_amount,
  cast(paid_count as bigint) paid_count, cast(overdue_count as bigint) overdue_count,
  cast(disputed_count as bigint) disputed_count, cast(pending_count as bigint) pending_count, avg_days_overdue,
  {rate('paid_count', 'total_invoices')} payment_rate, {rate('overdue_count', 'total_invoices')} overdue_rate,
  {rate('disputed_count', 'total_invoices')} dispute_rate
 from vendor_g),
vendor_summary as (select *, {rnd('overdue_rate * 0.6 + dispute_rate * 0.4', 2)} risk_score from vendor_r),
month_g as (
 select strftime(invoice_date, '%Y-%m') year_month, count(invoice_id) total_invoices, sum(amount) sm, count(amount) cn,
  count_if(status = 'PAID') paid_count, count_if(status = 'OVERDUE') overdue_count, count_if(status = 'DISPUTED') disputed_count
 from silver group by 1),
month_r as (
 select year_month, cast(total_invoices as bigint) total_invoices, {rnd('cast(sm as double)', 2)} total_amount,
  {rnd('cast(sm as double) / cn', 2)} avg_amount, cast(paid_count as bigint) paid_count,
  cast(overdue_count as bigint) overdue_count, cast(disputed_count as bigint) disputed_count,
  {rate('overdue_count', 'total_invoices')} overdue_rate
 from month_g),
monthly_trends as (
 select *, {rnd('total_amount / nullif(lag(total_amount) over (order by year_month), 0) - 1.0', 4)} * 100.0 amount_mom_change
 from month_r),
category_analysis as (
 select category, cast(count(invoice_id) as bigint) total_invoices, {rnd('cast(sum(amount) as double)', 2)} total_amount,
  {rnd('cast(sum(amount) as double) / count(amount)', 2)} avg_amount,
  cast(count_if(status = 'OVERDUE') as bigint) overdue_count, cast(count_if(status = 'DISPUTED') as bigint) disputed_count,
  cast(count(distinct vendor_id) as bigint) unique_vendors,
  {rate("count_if(status = 'OVERDUE')", 'count(invoice_id)')} overdue_rate,
  {rate("count_if(status = 'DISPUTED')", 'count(invoice_id)')} dispute_rate
 from silver group by category)
"""


def with_layers(select: str, extra_ctes: str = "") -> str:
    ctes = LAYERS.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"with\n{ctes}\n{select.strip()}"


SILVER_COLS = ("invoice_id, vendor_id, vendor_name, strftime(invoice_date, '%Y-%m-%d') invoice_date, "
               "strftime(due_date, '%Y-%m-%d') due_date, cast(amount as double) amount, status, category, "
               "state, notes, created_at, _source, _row_hash, _amount_was_null, days_to_due, days_overdue, is_overdue, "
               "payment_quarter, invoice_year")

ORACLES: dict[str, str] = {}


def oracle(key: str, sql: str) -> None:
    ORACLES[key] = sql


# --- bronze / silver -----------------------------------------------------------------------
oracle("raw_invoices", with_layers("select * from raw"))
oracle("bronze_invoices", with_layers("select * from bronze"))
oracle("silver_invoices", with_layers(f"select {SILVER_COLS} from silver"))
oracle("silver_audit", with_layers("""
select cast((select count(*) from bronze) as bigint) before_dedup, cast((select count(*) from dd) as bigint) after_dedup,
 cast((select count(*) from bronze) - (select count(*) from dd) as bigint) duplicates_removed,
 cast((select count_if(invoice_date is null) from dt) as bigint) dropped_unparseable,
 cast((select count_if(invoice_date is not null and amount is null) from dt) as bigint) filled_null_amounts,
 cast((select count_if(invoice_date is not null and amount < 0) from dt) as bigint) fixed_negative_amounts
"""))
oracle("ingest_stats", with_layers("""
select column_name, cast(null_count as bigint) null_count, cast((select count(*) from bronze) as bigint) total_records
from (unpivot (select count_if(invoice_id is null) invoice_id, count_if(vendor_id is null) vendor_id,
  count_if(vendor_name is null) vendor_name, count_if(invoice_date is null) invoice_date, count_if(due_date is null) due_date,
  count_if(amount is null) amount, count_if(status is null) status, count_if(category is null) category,
  count_if(state is null) state, count_if(notes is null) notes, count_if(created_at is null) created_at,
  0::bigint _ingested_at, 0::bigint _source, 0::bigint _row_hash from bronze) on columns(*) into name column_name value null_count)
"""))

# --- gold ----------------------------------------------------------------------------------
oracle("vendor_summary", with_layers("select * from vendor_summary"))
oracle("monthly_trends", with_layers("select * from monthly_trends"))
oracle("category_analysis", with_layers("select * from category_analysis"))
oracle("top_vendor", with_layers("""
select vendor_id, vendor_name, state, total_amount from vendor_summary
order by total_amount desc, vendor_id, vendor_name, state limit 1"""))
oracle("status_breakdown", with_layers("select status, cast(count(*) as bigint) n from silver group by status"))
oracle("silver_profile", with_layers("""
select cast(count(*) as bigint) clean_records, cast(min(amount) as double) min_amount, cast(max(amount) as double) max_amount,
 cast(count_if(is_overdue) as bigint) overdue_invoices from silver"""))
oracle("gold_totals", with_layers(f"""
select cast(count(distinct (vendor_id, vendor_name, state)) as bigint) vendors_tracked,
 cast(count(distinct strftime(invoice_date, '%Y-%m')) as bigint) months_of_data,
 cast(count(distinct category) as bigint) categories_analyzed, cast(sum(amount) as double) total_invoice_value,
 {rnd("avg(case when status = 'OVERDUE' then 1.0 else 0.0 end) * 100.0", 1)} overall_overdue_pct from silver"""))
oracle("duplicate_ids", with_layers(
    "select cast(count(*) - count(distinct invoice_id) as bigint) duplicate_invoice_ids from silver"))


# --- quality -------------------------------------------------------------------------------
def _all(cond: str) -> str:
    return f"coalesce(bool_and(coalesce({cond}, false)), true)"


def _checks(layer: str, table: str, checks: list[tuple[str, str, str]]) -> str:
    """checks: (name, passed-expression over `table` or literal, detail-expression)."""
    parts = []
    for name, passed, detail in checks:
        esc = name.replace("'", "''")
        src = "(select 1) one" if passed in ("true", "false") else table   # schema checks: one row, no scan
        parts.append(f"select '{layer}' layer, '{esc}' \"check\", ({passed}) passed, ({detail}) detail from {src}")
    return "\nunion all\n".join(parts)


BRONZE_CHECKS = ([(f"Column {c} exists", "true", "''") for c in
                  ("invoice_id", "vendor_id", "vendor_name", "invoice_date", "amount", "status")]
                 + [("invoice_id no nulls", "count_if(invoice_id is null) = 0", "''"),
                    ("vendor_id no nulls", "count_if(vendor_id is null) = 0", "''"),
                    ("Row count ok", "count(*) between 1000 and 100000", "''")]
                 + [(f"Metadata {c}", "true", "''") for c in ("_ingested_at", "_source", "_row_hash")])
SILVER_CHECKS = [
    ("No null amounts", "count_if(amount is null) = 0", "''"),
    ("Amounts >= 0", _all("cast(amount as double) >= 0"), "''"),
    ("Amounts <= 1M", _all("cast(amount as double) <= 1000000.0"), "''"),
    ("Valid statuses", _all("status in ('PAID','PENDING','OVERDUE','DISPUTED','CANCELLED')"), "''"),
    ("No null invoice_id", "count_if(invoice_id is null) = 0", "''"),
    ("No null vendor_id", "count_if(vendor_id is null) = 0", "''"),
    ("invoice_id unique", "count(*) - count(distinct invoice_id) = 0", "''"),
    ("days_overdue >= 0", _all("coalesce(days_overdue, 0) >= 0"), "''"),
    ("Row count ok", "count(*) between 1000 and 15000", "concat('(', cast(count(*) as varchar), ')')"),
]
GOLD_VENDOR_CHECKS = [
    ("Vendor count=50", "count(*) = 50", "''"),
    ("No null vendor names", "count_if(vendor_name is null) = 0", "''"),
    ("total_amounts >= 0", _all("total_amount >= 0"), "''"),
    ("overdue_rate 0-100", _all("overdue_rate between 0 and 100"), "''"),
    ("No null risk scores", "count_if(risk_score is null) = 0", "''"),
]
GOLD_MONTH_CHECKS = [
    ("Month count 12-36", "count(*) between 12 and 36", "''"),
    ("Monthly totals >= 0", _all("total_amount >= 0"), "''"),
    ("No null year_month", "count_if(year_month is null) = 0", "''"),
]
GOLD_CATEGORY_CHECKS = [
    ("Category count=7", "count(*) = 7", "''"),
    ("Category totals >= 0", _all("total_amount >= 0"), "''"),
]

Q_BRONZE = _checks("bronze", "bronze", BRONZE_CHECKS)
Q_SILVER = _checks("silver", "silver", SILVER_CHECKS)
Q_GOLD = "\nunion all\n".join([_checks("gold", "vendor_summary", GOLD_VENDOR_CHECKS),
                                _checks("gold", "monthly_trends", GOLD_MONTH_CHECKS),
                                _checks("gold", "category_analysis", GOLD_CATEGORY_CHECKS)])
oracle("quality_bronze", with_layers(Q_BRONZE))
oracle("quality_silver", with_layers(Q_SILVER))
oracle("quality_gold", with_layers(Q_GOLD))
oracle("quality_summary", with_layers(f"""
select layer, cast(count_if(passed) as bigint) passed, cast(count_if(not passed) as bigint) failed from report group by layer
union all
select 'total', cast(count_if(passed) as bigint), cast(count_if(not passed) as bigint) from report""",
    f"report as ({Q_BRONZE}\nunion all\n{Q_SILVER}\nunion all\n{Q_GOLD})"))


# --- features ------------------------------------------------------------------------------
CATEGORIES = ("Automobile", "Building", "Furniture", "Household", "Machinery")
STATUSES = VALID_STATUSES
FEATURE_CTES = f"""
fstats as (select avg(cast(amount as double)) mu, stddev_samp(cast(amount as double)) sd from silver),
inv_feat as (
 select invoice_id, vendor_id, cast(amount as double) amount,
  coalesce((cast(amount as double) - mu) / (sd + 1e-9), 0.0) amount_zscore,
  ln(1 + cast(amount as double)) amount_log,
  cast(coalesce(amount % 1000 = 0, false) as int) is_round_amount,
  cast(coalesce(days_overdue, 0) as int) days_overdue,
  coalesce(cast(month(invoice_date) as int), 0) invoice_month,
  coalesce(cast(isodow(invoice_date) - 1 as int), 0) invoice_dow,
  cast(coalesce(cast(isodow(invoice_date) - 1 as int), 0) >= 5 as int) is_weekend,
  coalesce(cast(quarter(invoice_date) as int), 0) invoice_quarter,
  {", ".join(f"cast(coalesce(status = '{s}', false) as int) status_{s}" for s in STATUSES)},
  {", ".join(f"cast(coalesce(category = '{c}', false) as int) cat_{c}" for c in CATEGORIES)}
 from silver, fstats),
features as (
 select inv_feat.*, cast(v.total_invoices as double) vendor_total_invoices, v.avg_amount vendor_avg_amount,
  v.overdue_rate vendor_overdue_rate, v.dispute_rate vendor_dispute_rate, v.risk_score vendor_risk_score,
  v.total_amount vendor_total_amount,
  coalesce(inv_feat.amount / (v.avg_amount + 1e-9), 1.0) amount_vs_vendor_avg
 from inv_feat left join vendor_summary v using (vendor_id))
"""
oracle("invoice_features", with_layers("select * from features", FEATURE_CTES))
oracle("feature_profile", with_layers(f"""
select cast(count(*) as bigint) records, cast({2 + 9 + 5 + len(CATEGORIES) + 7} as bigint) features,
 {rnd('avg(amount_zscore)', 4)} + 0.0 avg_amount_zscore, cast(sum(is_round_amount) as bigint) round_amounts from features""",
    FEATURE_CTES))
_scaled = ", ".join(
    rnd(f"(cast({c} as double) - avg(cast({c} as double)) over ()) / coalesce(nullif(stddev_pop(cast({c} as double)) over (), 0), 1.0)", 4) + f" + 0.0 {c}"
    for c in MODEL_FEATURES)
oracle("standard_scaler", with_layers(f"select invoice_id, vendor_id, {_scaled} from features", FEATURE_CTES))


oracle("column_moments", "select " + ", ".join(
    f"{rnd(f'avg(cast({c} as double))', 6)} mean_{c}, {rnd(f'stddev_pop(cast({c} as double))', 6)} std_{c}"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " from lineitem")
_CODES = """codes as (select vendor_name, cast(row_number() over (order by vendor_name) - 1 as bigint) code
 from (select distinct vendor_name from silver where vendor_name is not null))"""
oracle("category_codes", with_layers("select vendor_name, code from codes", _CODES))
oracle("category_sparse", with_layers("""
select s.invoice_id, s.vendor_name, (select cast(count(*) as bigint) from codes) width, c.code,
 cast(c.code is not null as int)::double ones from silver s left join codes c using (vendor_name)""", _CODES))


# --- scores, tiers, percentiles --------------------------------------------------------------
def np_percentile(table: str, col: str, p: float) -> str:
    """Scalar subquery: numpy 'linear' percentile: virtual index (n-1)*q and numpy's two-sided lerp."""
    return f"""(select case when t >= 0.5 then b - (b - a) * (1.0 - t) else a + (b - a) * t end from (
  select max(case when i = j0 then x end) a, max(case when i = j1 then x end) b, max(vi - j0) t from (
   select x, row_number() over (order by x) - 1 i, vi, floor(vi) j0, least(floor(vi) + 1, n - 1) j1 from (
    select cast({col} as double) x, count(*) over () n,
     cast(count(*) over () - 1 as double) * cast('{repr(p)}' as double) vi
    from {table} where {col} is not null and not isnan(cast({col} as double))))))"""


FIXED_SCORE_CTES = """
fixed as (select invoice_id, vendor_id, cast(amount as double) amount, days_overdue,
  ((cast(substring(invoice_id, 5) as bigint) * 7919) % 1000003 - 50000) / cast(1000003 as double) anomaly_score
 from silver),
fixed_flag as (select *, anomaly_score < 0 is_anomaly from fixed)
"""


def tiers_sql(table: str, col: str = "anomaly_score") -> str:
    p5, p10, p25 = (np_percentile(table, col, p) for p in (0.05, 0.10, 0.25))
    return f"""select *, case when {col} <= {p5} then 'CRITICAL' when {col} <= {p10} then 'HIGH'
  when {col} <= {p25} then 'MEDIUM' else 'LOW' end risk_level from {table}"""


TIERED_CTES = FIXED_SCORE_CTES + f",\ntiered as ({tiers_sql('fixed_flag')})"

oracle("score_percentiles", f"""select {np_percentile('events', 'value', 0.05)} p5,
 {np_percentile('events', 'value', 0.10)} p10, {np_percentile('events', 'value', 0.25)} p25""")
oracle("risk_tiers", with_layers("select * from tiered", TIERED_CTES))
oracle("event_value_tiers", "with ev as (select event_id, value anomaly_score from events)\n" + tiers_sql("ev"))
oracle("contamination_cut", with_layers(f"""
select *, anomaly_score - {np_percentile('fixed', 'anomaly_score', 0.05)} decision,
 anomaly_score - {np_percentile('fixed', 'anomaly_score', 0.05)} < 0 is_anomaly from fixed""", FIXED_SCORE_CTES))
oracle("scoring_report", with_layers(f"""
select cast(count(*) as bigint) total_scored, cast(count_if(is_anomaly) as bigint) anomalies,
 {rnd('cast(count_if(is_anomaly) as double) / count(*) * 100.0', 1)} anomaly_pct,
 cast(count_if(risk_level = 'CRITICAL') as bigint) critical, cast(count_if(risk_level = 'HIGH') as bigint) high
from tiered""", TIERED_CTES))
oracle("top_anomalies", with_layers("""
select invoice_id, vendor_id, amount, anomaly_score, case when is_anomaly then 'ANOMALY' else 'NORMAL' end anomaly_label
from tiered where is_anomaly order by anomaly_score, invoice_id limit 20""", TIERED_CTES))
oracle("top_anomalies_report", with_layers("""
select invoice_id, vendor_id, amount, anomaly_score, risk_level
from tiered where is_anomaly order by anomaly_score, invoice_id limit 10""", TIERED_CTES))

# --- isolation forest ------------------------------------------------------------------------
def _c(n: str) -> str:
    """Average path length of an unsuccessful search among n rows."""
    return (f"case when {n} <= 1 then 0.0 when {n} = 2 then 1.0 else 2.0 * (ln({n} - 1.0) + cast('{EULER_GAMMA!r}' as double))"
            f" - 2.0 * ({n} - 1.0) / {n} end")


def _digits(text: str, place: int) -> str:
    return f"cast(cast('0x' || substring({text}, {place}, 13) as bigint) as double) / 4503599627370496.0"


def forest_ctes(runs) -> str:
    """The same trees level by level, and every row's walk through them."""
    k = len(MODEL_FEATURES)
    x = ", ".join(f"(cast({c} as double) - avg(cast({c} as double)) over ()) / coalesce(nullif(stddev_pop(cast({c} as double)) over (), 0), 1.0)"
                  for c in MODEL_FEATURES)
    par = ", ".join(f"({p.run_id}, {p.n_estimators}, {p.max_samples or 256}, {p.seed})" for p in runs)
    height = max(math.ceil(math.log2(p.max_samples or 256)) for p in runs)
    out = [f"scaled as materialized (select row_number() over () rid, invoice_id, vendor_id, amount raw_amount, [{x}] x from features)",
           f"""par as (select *, n // psi slices0, least(t, n // psi) slices from (
 select run, t, seed, n, least(m, n) psi from (values {par}) v(run, t, m, seed), (select count(*) n from scaled)))""",
           """sample_rows as (select *, row_number() over (partition by run, o order by h, invoice_id, x) - 1 rn from (
 select run, t, psi, slices, o, md5(concat_ws(':', seed, run, o, invoice_id)) h, invoice_id, x
 from scaled, (select *, unnest(range(0, (t - 1) // slices + 1)) o from par)))""",
           """l0 as materialized (select run, o * slices + rn // psi tree, psi, 1::bigint node, x from sample_rows
 where rn < slices * psi and o * slices + rn // psi < t)"""]
    for d in range(height):
        out.append(f"""t{d} as materialized (select run, tree, node, f, lo[f + 1] + {_digits('m', 14)} * (hi[f + 1] - lo[f + 1]) t from (
 select *, case when len(varied) > 0 and {1 << d} < psi then varied[1 + cast(floor({_digits('m', 1)} * len(varied)) as int)] end f from (
  select *, list_filter(range(0, {k}), lambda i: hi[i + 1] > lo[i + 1]) varied, md5(concat_ws(':', seed, run, tree, node)) m from (
   select run, tree, node, [{", ".join(f"min(x[{i + 1}])" for i in range(k))}] lo, [{", ".join(f"max(x[{i + 1}])" for i in range(k))}] hi
   from l{d} group by all) join par using (run))) where f is not null)""")
        out.append(f"""l{d + 1} as materialized (select run, tree, psi, case when f is null then node else 2 * node + cast(x[f + 1] > t as int) end node, x
 from l{d} left join t{d} using (run, tree, node))""")
    out.append("leaves as materialized (select run, tree, node, count(*) size from l%d group by all)" % height)
    out.append("w0 as (select rid, run, tree, 1::bigint node from scaled, (select distinct run, tree from l0))")
    for d in range(height):
        out.append(f"""w{d + 1} as materialized (select rid, run, tree, case when f is null then node else 2 * node + cast(x[f + 1] > t as int) end node
 from w{d} join scaled using (rid) left join t{d} using (run, tree, node))""")
    out.append(f"""forest_raw as (select rid, run, -pow(2.0, -cast(s as double) / (1000000000.0 * t * ({_c('psi')}))) score from (
 select rid, run, cast(sum(cast(floor(log2(node)) as bigint) * 1000000000 + cast(round(({_c('size')}) * 1000000000.0) as bigint)) as bigint) s
 from w{height} join leaves using (run, tree, node) group by all) join par using (run))""")
    for p in runs:
        out.append(f"raw{p.run_id} as (select * from forest_raw where run = {p.run_id})")
        out.append(f"""dec{p.run_id} as (select invoice_id, vendor_id, raw_amount, score - {np_percentile(f'raw{p.run_id}', 'score', p.contamination)} anomaly_score
 from raw{p.run_id} join scaled using (rid))""")
    return ",\n".join(out)


_RUNS = experiments()
oracle("forest_scores", with_layers(f"select * replace (anomaly_score < 0 as is_anomaly) from ({tiers_sql('flagged')})", f"""{FEATURE_CTES},
{forest_ctes(_RUNS[:1])},
flagged as (select invoice_id, vendor_id, raw_amount amount, anomaly_score, anomaly_score < 0 is_anomaly from dec1)"""))
oracle("forest_runs", with_layers("\nunion all\n".join(f"""select cast({p.run_id} as int) run_id, cast({p.n_estimators} as int) n_estimators,
 cast({p.contamination!r} as double) contamination, cast({p.max_samples or 'null'} as int) max_samples, cast({p.seed} as int) seed,
 count(*) n_records, count_if(anomaly_score < 0)::bigint n_anomalies, {rnd('cast(count_if(anomaly_score < 0) as double) / count(*)', 4)} anomaly_rate,
 {rnd('avg(anomaly_score)', 4)} mean_score, {rnd('min(anomaly_score)', 4)} min_score, cast({len(MODEL_FEATURES)} as int) n_features, cast({p.run_id} as int) as version
from dec{p.run_id}""" for p in _RUNS), f"{FEATURE_CTES},\n{forest_ctes(_RUNS)}"))

# --- the demo questions -------------------------------------------------------------------
oracle("q_highest_overdue_vendors", with_layers("""
select vendor_id, vendor_name, state, overdue_rate, overdue_count, total_invoices from vendor_summary
order by overdue_rate desc, vendor_id, vendor_name, state limit 5"""))
oracle("q_critical_invoices", with_layers("select * from tiered where risk_level = 'CRITICAL'", TIERED_CTES))
oracle("q_trends_year", with_layers("select * from monthly_trends where starts_with(year_month, '1998-')"))
oracle("q_dispute_vendors", with_layers("""
select vendor_id, vendor_name, state, disputed_count, dispute_rate, total_invoices from vendor_summary
where disputed_count > 0"""))
oracle("q_zero_amount_invoices", with_layers("""
select invoice_id, vendor_id, cast(amount as double) amount, status, _amount_was_null from silver where amount = 0"""))


# --- documents, chunks, vectors, retrieval ------------------------------------------------------
def money(expr: str) -> str:
    txt = f"regexp_replace(cast(cast({expr} as decimal(38,2)) as varchar), '0+$', '')"
    return f"(case when {expr} is null then null else regexp_replace({txt}, '\\.$', '.0') end)"


def sql_text(*parts) -> str:
    """concat() of literal text (str, newlines as chr(10)) and SQL expressions (tuple ('x', sql))."""
    out = []
    for p in parts:
        if isinstance(p, tuple):
            out.append(p[1])
            continue
        pieces = p.split("\n")
        for i, piece in enumerate(pieces):
            if piece:
                out.append("'" + piece.replace("'", "''") + "'")
            if i < len(pieces) - 1:
                out.append("chr(10)")
    return "concat(" + ", ".join(out) + ")"


def x(sql: str):
    return ("x", sql)


def vc(col: str):
    return x(f"cast({col} as varchar)")


VENDOR_DOC_TEXT = sql_text(
    "Vendor Report: ", vc("vendor_name"), "\nVendor ID: ", vc("vendor_id"), "\nState: ", vc("state"),
    "\n\nInvoice Summary:\n- Total invoices: ", vc("total_invoices"),
    "\n- Total invoice value: $", x(money("total_amount")), "\n- Average invoice amount: $", x(money("avg_amount")),
    "\n- Paid invoices: ", vc("paid_count"), "\n- Overdue invoices: ", vc("overdue_count"),
    "\n- Disputed invoices: ", vc("disputed_count"),
    "\n\nRisk Analysis:\n- Overdue rate: ", x(money("overdue_rate")), "%\n- Dispute rate: ", x(money("dispute_rate")),
    "%\n- Risk score: ", x(money("risk_score")), "\n\nAssessment: ",
    x("case when risk_score > 10.0 then 'High risk vendor requiring attention.' else 'Low to medium risk vendor.' end"))
ANOMALY_DOC_TEXT = sql_text(
    "Anomaly Alert: Invoice ", vc("invoice_id"), "\nRisk Level: ", vc("risk_level"), "\nVendor ID: ", vc("vendor_id"),
    "\nInvoice Amount: $", x(money("amount")), "\nAnomaly Score: ", vc("anomaly_score"),
    "\nDays Overdue: ", vc("days_overdue"),
    "\n\nReason for flagging: This invoice was identified as anomalous by the \nIsolation Forest model. ",
    x("case when amount = 0 then 'Zero dollar amount detected - possible data entry error or fraudulent submission.' "
      "else 'Unusual pattern detected compared to vendor historical behavior.' end"),
    "\n\nRecommended action: ",
    x("case when risk_level = 'CRITICAL' then 'Immediate review required.' else 'Review within 48 hours.' end"))
TREND_DOC_TEXT = sql_text(
    "Monthly Invoice Report: ", vc("year_month"), "\n\nVolume:\n- Total invoices processed: ", vc("total_invoices"),
    "\n- Total invoice value: $", x(money("total_amount")), "\n- Average invoice amount: $", x(money("avg_amount")),
    "\n\nPayment Health:\n- Overdue invoices: ", vc("overdue_count"), " (", x(money("overdue_rate")),
    "% overdue rate)\n- Disputed invoices: ", vc("disputed_count"), "\n\nTrend note: ",
    x("case when overdue_rate > 15.0 then 'Elevated overdue rate this month - collections team should be alerted.' "
      "else 'Overdue rate within normal range.' end"))

DOC_CTES = TIERED_CTES + f""",
vendor_docs as (select concat('vendor_', vendor_id) doc_id, 'vendor_summary' doc_type, vendor_id, {VENDOR_DOC_TEXT} text
 from vendor_summary),
anomaly_docs as (select concat('anomaly_', invoice_id) doc_id, 'anomaly_alert' doc_type, invoice_id, risk_level,
 {ANOMALY_DOC_TEXT} text from (select * from tiered where risk_level in ('CRITICAL', 'HIGH')
)),
trend_docs as (select concat('trend_', year_month) doc_id, 'monthly_trend' doc_type, year_month, {TREND_DOC_TEXT} text
 from monthly_trends),
docs as (
 select doc_id, doc_type, vendor_id, null::varchar invoice_id, null::varchar risk_level, null::varchar year_month, text from vendor_docs
 union all select doc_id, doc_type, null, invoice_id, risk_level, null, text from anomaly_docs
 union all select doc_id, doc_type, null, null, null, year_month, text from trend_docs)"""


def chunks_sql(src: str, keep: str) -> str:
    n = ("case when length(text) <= 0 then 0 when length(text) <= 2000 then 1 "
         "else cast(ceil((length(text) - 2000) / 1800.0) as int) + 1 end")
    return f"""select {keep}, concat(cast(doc_id as varchar), '_chunk_', cast(chunk_idx as varchar)) chunk_id,
 substring(text, chunk_idx * 1800 + 1, 2000) chunk_text, cast(chunk_idx as int) chunk_idx
 from (select *, unnest(generate_series(0, {n} - 1)) chunk_idx from {src})"""


def bow_sql(src: str, id_col: str, text_col: str, dims: int = 64) -> str:
    """Hashed bag-of-words unit vectors, same definition as the Spark embedder."""
    return f"""(select {id_col}, list_transform(v, lambda x: case when nrm > 0 then x / nrm else 0.0 end) embedding from (
  select {id_col}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) nrm from (
   select {id_col}, list(coalesce(c, 0)::double order by b) v from (
    select s.{id_col}, r.b, cnt.c from (select distinct {id_col} from {src}) s cross join range({dims}) r(b)
    left join (select {id_col}, (('0x' || substr(md5(t), 1, 8))::bigint) % {dims} b, count(*) c from (
      select {id_col}, unnest(regexp_extract_all(lower({text_col}), '[a-z0-9]+')) t from {src}) group by all) cnt
    on cnt.{id_col} = s.{id_col} and cnt.b = r.b)
   group by {id_col})))"""


oracle("vendor_documents", with_layers("select doc_id, doc_type, vendor_id, text from vendor_docs", DOC_CTES))
oracle("anomaly_documents", with_layers("select doc_id, doc_type, invoice_id, risk_level, text from anomaly_docs", DOC_CTES))
oracle("trend_documents", with_layers("select doc_id, doc_type, year_month, text from trend_docs", DOC_CTES))
oracle("document_union", with_layers("select * from docs", DOC_CTES))
oracle("document_chunks", with_layers(chunks_sql("docs", "doc_id, doc_type, vendor_id, invoice_id, risk_level, year_month"),
                                      DOC_CTES))
TEXT_CHUNKS = chunks_sql("(select doc_id, text, lang, source from documents)", "doc_id, lang, source")
oracle("chunk_documents", TEXT_CHUNKS)
oracle("embed_chunks", f"with chunks as ({TEXT_CHUNKS})\nselect * from {bow_sql('chunks', 'chunk_id', 'chunk_text')}")

CENTROIDS = """cent as (select label query_id, list(v order by pos) query_vec from (
  select label, pos, avg(x) v from (select label, unnest(embedding) x, unnest(generate_series(1, len(embedding))) pos
  from embeddings) group by label, pos) group by label)"""


def knn_sql(filtered: bool) -> str:
    cond = "where e.label = c.query_id" if filtered else ""
    return f"""with {CENTROIDS},
pairs as (select c.query_id, e.vec_id, round(1.0 - (1.0 - list_dot_product(cast(e.embedding as double[]), c.query_vec)
  / (sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[])))
     * sqrt(list_dot_product(c.query_vec, c.query_vec)))), 4) similarity from embeddings e cross join cent c {cond})
select query_id, vec_id, similarity, cast(rank as int) rank from (
 select *, row_number() over (partition by query_id order by similarity desc, vec_id) rank from pairs) where rank <= 5"""


oracle("knn_topk", knn_sql(False))
oracle("knn_filtered", knn_sql(True))
# the approximate search is held against the exact answer
oracle("ann_topk", knn_sql(False))

oracle("knn_cells", """with v as (select vec_id, label, cast(embedding as double[]) e from embeddings),
q as (select * from v where vec_id % 10 = 0),
pairs as (select q.vec_id query_id, v.vec_id, round(1.0 - (1.0 - list_dot_product(v.e, q.e)
  / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)))), 4) similarity
 from v join q on q.vec_id % 20 <> 0 or v.label = q.label)
select query_id, vec_id, similarity, cast(rank as int) rank from (
 select *, row_number() over (partition by query_id order by similarity desc, vec_id) rank from pairs) where rank <= 5""")
oracle("ann_recall", """select count(*) queries, 5 * count(*) answers, true recall_ok from embeddings where vec_id % 10 = 0""")

QUESTIONS = """questions(query_id, question, doc_type) as (values
 (1, 'Which vendors have the highest overdue rates?', 'vendor_summary'),
 (2, 'What invoices are flagged as critical risk?', 'anomaly_alert'),
 (3, 'What were the invoice trends in 2024?', 'monthly_trend'),
 (4, 'Show me vendors with dispute problems', null),
 (5, 'Which invoices have zero dollar amounts?', 'anomaly_alert'))"""
RAG_CTES = DOC_CTES + f""",
chunks as ({chunks_sql('docs', 'doc_id, doc_type')}),
index as (select c.chunk_id, c.doc_type, c.chunk_text, v.embedding from chunks c join {bow_sql('chunks', 'chunk_id', 'chunk_text')} v using (chunk_id)),
{QUESTIONS},
qvec as (select q.query_id, q.doc_type, v.embedding query_vec from questions q join {bow_sql('questions', 'query_id', 'question')} v using (query_id)),
pairs as (select q.query_id, i.chunk_id, i.doc_type, i.chunk_text, round(1.0 - (1.0 - case when
   sqrt(list_dot_product(i.embedding, i.embedding)) * sqrt(list_dot_product(q.query_vec, q.query_vec)) > 0 then
   list_dot_product(i.embedding, q.query_vec) / (sqrt(list_dot_product(i.embedding, i.embedding)) * sqrt(list_dot_product(q.query_vec, q.query_vec)))
   else 0.0 end), 4) similarity
 from index i join qvec q on q.doc_type is null or i.doc_type = q.doc_type),
hits as (select * from (select *, cast(row_number() over (partition by query_id order by similarity desc, chunk_id) as int) rank
 from pairs) where rank <= 5)"""
oracle("rag_retrieval", with_layers("select query_id, chunk_id, doc_type, similarity, rank from hits", RAG_CTES))
oracle("prompt_context", with_layers("""
select q.query_id, coalesce(ctx, 'No relevant information found in the knowledge base.') context, q.question
from questions q left join (
 select query_id, string_agg(concat('[Source ', cast(rank as varchar), ' | Type: ', coalesce(doc_type, 'unknown'),
  ' | Relevance: ', cast(similarity as varchar), ']', chr(10), chunk_text), chr(10) || chr(10) || '---' || chr(10) || chr(10)
  order by rank) ctx from hits group by query_id) h using (query_id)""", RAG_CTES))


# --- streaming -----------------------------------------------------------------------------
oracle("event_envelope", with_layers("""
select vendor_id key, 'INVOICE_RECEIVED' event_type, '2001-01-01T00:00:00' event_timestamp,
 'invoice_feed_v1' source_system, invoice_id, amount from raw"""))
oracle("event_unwrap", with_layers("select * from raw"))
oracle("stream_bronze", with_layers("select * replace ('kafka_stream' as _source) from bronze"))
oracle("silver_partition_prune", with_layers("""
select status, cast(count(*) as bigint) n from silver where invoice_year = 1998 and payment_quarter = 'Q2' group by status"""))
oracle("run_all_summary", ORACLES["quality_summary"])
oracle("stream_restart", with_layers("""
select * from (values (1, 100::bigint), (3, 0::bigint)) v(run, messages_read)
union all select 2, cast(count(*) as bigint) from raw union all select 0, cast(count(*) + 100 as bigint) from raw"""))
oracle("vector_refresh", f"""with old as ({chunks_sql('documents', 'doc_id')}),
changed as (select doc_id, case when doc_id % 100 = 0 then concat(doc_id, ' changed ', text) else text end as text from documents where doc_id % 97 <> 0),
new as ({chunks_sql('changed', 'doc_id')})
select (select count(distinct chunk_text) from old) first_embedded,
 (select count(distinct chunk_text) from new where chunk_text not in (select chunk_text from old)) second_embedded,
 count(*) second_rows, count(*) same_as_rebuilt from new""")
oracle("restore_types", with_layers(f"select {SILVER_COLS} from silver"))
oracle("bronze_union", with_layers("select * from bronze union all select * replace ('kafka_stream' as _source) from bronze"))
oracle("vendors_by_total", with_layers("select * from vendor_summary order by total_amount desc, vendor_id, vendor_name, state"))

# --- inputs that reach rare branches ----------------------------------------------------------
oracle("amount_repair", """
select l_orderkey, l_linenumber, a is null _amount_was_null, round_even(abs(coalesce(a, 0.0)) * 100.0, 0) / 100.0 amount
from (select l_orderkey, l_linenumber, cast(case when l_orderkey % 13 = 0 then null
  when l_orderkey % 7 = 0 then -l_extendedprice * l_discount when l_orderkey % 11 = 0 then l_extendedprice * 1e12::double
  else l_extendedprice * l_discount end as double) a from lineitem)""")
oracle("csv_scan", with_layers("""
select * replace (case when notes is null then null else concat('He said "', notes, '",', chr(10), state) end as notes) from raw"""))
oracle("parquet_tree", with_layers("select * from raw"))
oracle("chunks_json", f"""select cast(doc_id as varchar) doc_id, chunk_id, chunk_text, chunk_idx from
 ({chunks_sql('documents', 'doc_id')}) where true""")
oracle("scoring_rows", with_layers("""
select count(*) rows_out, count(*) distinct_out, cast(sum(cast(cast(amount as double) * 100 as bigint)) as bigint) cents_out, count(*) scored from (
 select amount from silver union all select amount + 1 from silver where payment_quarter = 'Q1')"""))
oracle("stream_progress", with_layers("select 8::bigint batches_written, cast(count(*) as bigint) messages_read from raw"))
