"""Sources, columns and cleaning (S, P and C rows of the survey)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import HOLES_SQL, Tables, query, rounded, with_holes
from tabstat.operators import cleaning as cl
from tabstat.operators import columns as co
from tabstat.plans.stats import local_table
from tabstat.sources.tables import overview, preview

H = f"WITH h AS ({HOLES_SQL}) "


@query("scan_project", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def scan_project(spark, sf):
    from tabstat.sources.tables import scan
    df = scan(spark, f"{sf}/orders.parquet")
    return co.select_columns(df.where(F.col("o_totalprice") > 400000), ["o_orderkey", "o_totalprice"])


@query("overview", H + """SELECT 'value' AS "column", 'double' AS dtype, count(*) AS n_rows, count(value) AS n_non_null FROM h
UNION ALL SELECT 'event_type', 'string', count(*), count(event_type) FROM h
UNION ALL SELECT 'event_id', 'bigint', count(*), count(event_id) FROM h""")
def overview_q(spark, sf):
    return overview(with_holes(Tables(spark, sf).events).select("value", "event_type", "event_id"))


@query("preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_q(spark, sf):
    return preview(Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus"), 20, "o_orderkey")


@query("drop_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_columns_q(spark, sf):
    return co.drop_columns(Tables(spark, sf).customer, ["c_name", "c_nationkey", "c_acctbal", "score_absent"])


@query("column_kinds", """SELECT * FROM (VALUES ('numeric', 'o_orderkey'), ('numeric', 'o_custkey'), ('numeric', 'o_totalprice'), ('categorical', 'o_orderstatus'),
 ('categorical', 'o_orderpriority'), ('date', 'o_orderdate')) k(kind, "column"), (SELECT count(*) AS n_rows FROM orders)""")
def column_kinds_q(spark, sf):
    df = Tables(spark, sf).orders
    n = df.count()
    return local_table(spark, [(k, c, n) for k in ("numeric", "categorical", "date") for c in co.columns_of(df, (k,))],
                       "kind string, column string, n_rows bigint")


RAW = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '3.7' WHEN 2 THEN 'x'
 WHEN 3 THEN 'TRUE' WHEN 4 THEN 'no' END AS raw FROM events"""


def raw_text(events):
    k = F.col("event_id") % 6
    return events.select("event_id", F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, "3.7")
                         .when(k == 2, "x").when(k == 3, "TRUE").when(k == 4, "no").alias("raw"))


@query("cast_float", f"SELECT event_id, TRY_CAST(raw AS DOUBLE) AS raw FROM ({RAW})")
def cast_float_q(spark, sf):
    return co.cast_column(raw_text(Tables(spark, sf).events), "raw", "float")


@query("cast_int", f"SELECT event_id, CAST(TRY_CAST(raw AS DOUBLE) AS BIGINT) AS raw FROM ({RAW}) WHERE event_id % 6 <> 1")
def cast_int_q(spark, sf):
    return co.cast_column(raw_text(Tables(spark, sf).events).where(F.col("event_id") % 6 != 1), "raw", "int")


@query("cast_datetime", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS day FROM events""")
def cast_datetime_q(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "31/31/2024").otherwise(F.date_format("ts", "dd/MM/yyyy"))
    df = co.cast_column(Tables(spark, sf).events.select("event_id", text.alias("day")), "day", "datetime", "%d/%m/%Y")
    return df.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("cast_text", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def cast_text_q(spark, sf):
    return co.cast_column(Tables(spark, sf).orders.select("o_orderkey", "o_custkey"), "o_custkey", "category")


@query("cast_boolean", f"SELECT event_id, CASE WHEN lower(raw) IN ('true','1','yes') THEN true WHEN lower(raw) IN ('false','0','no') THEN false END AS raw FROM ({RAW})")
def cast_boolean_q(spark, sf):
    return co.cast_boolean(raw_text(Tables(spark, sf).events), "raw")


@query("duplicate_column", "SELECT s_suppkey, s_acctbal, s_acctbal AS balance FROM supplier")
def duplicate_column_q(spark, sf):
    return co.duplicate_column(Tables(spark, sf).supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "balance")


@query("recode", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def recode_q(spark, sf):
    return co.recode(Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "filled"})


@query("flag_ne_null", H + """SELECT event_id, CASE WHEN event_type IS NULL OR event_type <> 'click' THEN 1 ELSE 0 END AS not_click,
 CASE WHEN value >= 50 THEN 1 ELSE 0 END AS large FROM h""")
def flag_q(spark, sf):
    df = co.flag(with_holes(Tables(spark, sf).events), "event_type", "!=", "click", "not_click")
    return co.flag(df, "value", ">=", "50", "large").select("event_id", "not_click", "large")


@query("keep_if", H + "SELECT event_id, CASE WHEN value > 100 THEN user_id END AS kept FROM h")
def keep_if_q(spark, sf):
    return co.keep_if(with_holes(Tables(spark, sf).events), "user_id", [("value", ">", "100")], "kept").select("event_id", "kept")


@query("keep_if_multi", H + """SELECT event_id, CASE WHEN value > 20 AND (event_type IS NULL OR event_type <> 'error') AND user_id <= 75 THEN value END AS kept FROM h""")
def keep_if_multi_q(spark, sf):
    conditions = [("value", ">", "20"), ("event_type", "!=", "error"), ("user_id", "<=", "75")]
    return co.keep_if(with_holes(Tables(spark, sf).events), "value", conditions, "kept").select("event_id", "kept")


@query("drop_missing", H + "SELECT event_id FROM h WHERE value IS NOT NULL")
def drop_missing_q(spark, sf):
    return co.drop_missing(with_holes(Tables(spark, sf).events), ["value", "absent"]).select("event_id")


@query("drop_any_missing", H + "SELECT event_id FROM h WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_any_q(spark, sf):
    return co.drop_missing(with_holes(Tables(spark, sf).events)).select("event_id")


@query("low_cardinality", """SELECT * FROM (SELECT 'l_linenumber' AS "column", count(DISTINCT l_linenumber) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem
UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem) WHERE n_distinct <= 10""")
def low_cardinality_q(spark, sf):
    df = Tables(spark, sf).lineitem.select("l_linenumber", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    return co.distinct_counts(df, co.low_cardinality(df, 10))


@query("binary_columns", """SELECT 'quality' AS variable, count(*) AS n, avg(quality) AS share FROM labels
UNION ALL SELECT 'toxic', count(*), avg(toxic) FROM labels""")
def binary_columns_q(spark, sf):
    df = Tables(spark, sf).labels
    cols = co.binary_columns(df)
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("share")) for c in cols])
    return df.agg(cells.alias("x")).select(F.inline("x"))


@query("distinct_values", "SELECT DISTINCT p_brand FROM part")
def distinct_values_q(spark, sf):
    return co.distinct_values(Tables(spark, sf).part, "p_brand")


@query("present_groups", """SELECT 'size' AS dimension, round(avg(l_quantity), 9) AS v FROM lineitem UNION ALL SELECT 'rates', round(avg(l_tax), 9) FROM lineitem""")
def present_groups_q(spark, sf):
    df = Tables(spark, sf).lineitem
    groups = co.present_groups(df, {"size": ["l_quantity", "gone"], "rates": ["l_tax"], "empty": ["nothing"]})
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.avg(v[0]).alias("v")) for d, v in groups.items() if v])
    return rounded(df.agg(cells.alias("x")).select(F.inline("x")), 9)


# --- cleaning ---------------------------------------------------------------

@query("impute_mean", H + "SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM h")
def impute_mean_q(spark, sf):
    return rounded(cl.impute(with_holes(Tables(spark, sf).events), ["value"], "mean").select("event_id", "value"))


@query("impute_median", H + "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM h)), 6) AS value FROM h")
def impute_median_q(spark, sf):
    return rounded(cl.impute(with_holes(Tables(spark, sf).events), ["value"], "median").select("event_id", "value"))


@query("impute_mode", H + """, m AS (SELECT event_type AS t FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 v AS (SELECT value AS x FROM h WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, coalesce(event_type, (SELECT t FROM m)) AS event_type, coalesce(value, (SELECT x FROM v)) AS value FROM h""")
def impute_mode_q(spark, sf):
    return cl.impute(with_holes(Tables(spark, sf).events), ["event_type", "value"], "mode").select("event_id", "event_type", "value")


@query("impute_const", H + "SELECT event_id, coalesce(value, -1.0::DOUBLE) AS value, coalesce(event_type, 'none') AS event_type FROM h")
def impute_const_q(spark, sf):
    df = cl.impute(with_holes(Tables(spark, sf).events), ["value"], "constant", -1.0)
    return cl.impute(df, ["event_type"], "constant", "none").select("event_id", "value", "event_type")


@query("impute_all", H + """, m AS (SELECT event_type AS t FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value, coalesce(event_type, (SELECT t FROM m)) AS event_type FROM h""")
def impute_all_q(spark, sf):
    return rounded(cl.impute_all(with_holes(Tables(spark, sf).events).select("event_id", "value", "event_type"))) \
        .withColumn("event_id", F.col("event_id").cast("bigint"))


@query("interpolate", """WITH h AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM h),
 b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS p, last_value(value IGNORE NULLS) OVER w AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS q, first_value(value IGNORE NULLS) OVER a AS qv FROM r
  WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(value, pv + (qv - pv) * (rn - p) / (q - p), pv, qv), 6) AS value FROM b""")
def interpolate_q(spark, sf):
    ev = Tables(spark, sf).events
    df = ev.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return rounded(cl.interpolate(df, ["value"], "ts", ["user_id"]).select("event_id", "value"))


B = """b AS (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi, q2 FROM (
 SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {t}))"""


@query("iqr_bounds", f"""WITH {B.format(c='value', t='events')}, c AS (SELECT * FROM events)
SELECT 'value' AS variable, round(lo, 6) AS lower, round(hi, 6) AS upper FROM b""")
def iqr_bounds_q(spark, sf):
    return rounded(cl.iqr_bounds(Tables(spark, sf).events, ["value"]))


@query("iqr_detect", f"WITH {B.format(c='value', t='events')} SELECT event_id, value FROM events, b WHERE value < lo OR value > hi")
def iqr_detect_q(spark, sf):
    return cl.detect_outliers(Tables(spark, sf).events.select("event_id", "value"), "value")


@query("iqr_remove", f"""WITH h AS ({HOLES_SQL}), {B.format(c='value', t='h')}, u AS (SELECT q1 - 1.5::DOUBLE*(q3-q1) AS lo, q3 + 1.5::DOUBLE*(q3-q1) AS hi FROM (
 SELECT quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM h))
SELECT event_id FROM h, b, u WHERE NOT coalesce(value < b.lo OR value > b.hi, false) AND NOT coalesce(user_id < u.lo OR user_id > u.hi, false)""")
def iqr_remove_q(spark, sf):
    return cl.handle_outliers(with_holes(Tables(spark, sf).events), ["value", "user_id"], "remove").select("event_id")


@query("iqr_winsor", f"""WITH h AS ({HOLES_SQL}), {B.format(c='value', t='h')}
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM h, b""")
def iqr_winsor_q(spark, sf):
    return rounded(cl.handle_outliers(with_holes(Tables(spark, sf).events), ["value"], "winsorize").select("event_id", "value"))


@query("iqr_median", f"""WITH h AS ({HOLES_SQL}), {B.format(c='value', t='h')}
SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN q2 ELSE value END, 6) AS value FROM h, b""")
def iqr_median_q(spark, sf):
    return rounded(cl.handle_outliers(with_holes(Tables(spark, sf).events), ["value"], "median").select("event_id", "value"))


@query("zscore", H + """SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) + 0.0 AS value_z, CASE WHEN true THEN 0.0::DOUBLE END AS one_z FROM h""")
def zscore_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).withColumn("one", F.lit(7.0))
    return rounded(cl.zscore(df, ["value", "one"]).select("event_id", "value_z", "one_z"))


@query("minmax", H + "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) + 0.0 AS value_minmax FROM h")
def minmax_q(spark, sf):
    return rounded(cl.minmax(with_holes(Tables(spark, sf).events), ["value"]).select("event_id", "value_minmax"))


@query("log1p", "SELECT c_custkey, round(ln(1 + CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END), 6) + 0.0 AS c_acctbal_log FROM customer")
def log1p_q(spark, sf):
    return rounded(cl.log1p_clip(Tables(spark, sf).customer, ["c_acctbal"]).select("c_custkey", "c_acctbal_log"))


@query("clean_recipe", f"""WITH h AS ({HOLES_SQL}), f AS (SELECT event_id, coalesce(value, avg(value) OVER ()) AS value FROM h),
 {B.format(c='value', t='f')}, w AS (SELECT event_id, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value FROM f, b)
SELECT event_id, round(value, 6) AS value, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) + 0.0 AS value_minmax FROM w""")
def clean_recipe_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).select("event_id", "value")
    return rounded(cl.clean(df, [("impute", ["value"], {"strategy": "mean"}),
                                 ("outliers", ["value"], {"method": "winsorize"}), ("minmax", ["value"])]))


@query("clean_report", f"""WITH h AS ({HOLES_SQL}), f AS (SELECT event_id, event_type, coalesce(value, avg(value) OVER ()) AS value FROM h), {B.format(c='value', t='f')},
 r AS (SELECT f.* FROM f, b WHERE NOT (value < lo OR value > hi))
SELECT 'value' AS "column", (SELECT count(*) FROM h) AS rows_before, (SELECT count(*) FROM r) AS rows_after, (SELECT count(*) - count(value) FROM h) AS nulls_before, (SELECT count(*) - count(value) FROM r) AS nulls_after
UNION ALL SELECT 'event_type', (SELECT count(*) FROM h), (SELECT count(*) FROM r), (SELECT count(*) - count(event_type) FROM h), (SELECT count(*) - count(event_type) FROM r)""")
def clean_report_q(spark, sf):
    df = with_holes(Tables(spark, sf).events)
    after = cl.clean(df, [("impute", ["value"], {"strategy": "mean"}), ("outliers", ["value"], {"method": "remove"})])
    return cl.change_report(df, after, ["value", "event_type"])
