"""Sinks and the operation log (S3 to S6): written to the shared folder, then read back."""

import uuid

from pyspark.sql import functions as F

from tabstat.catalog.registry import HOLES_SQL, Tables, query, rounded, with_holes
from tabstat.operators import linear as ln
from tabstat.sources import audit, sinks
from tabstat.sources.tables import scan


def folder(spark, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_roundtrip", HOLES_SQL.replace("ts, ", ""))
def csv_roundtrip_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).drop("ts")
    path = sinks.write_table(df, folder(spark, "events"), "csv")
    return scan(spark, path, "csv", "event_id bigint, user_id bigint, value double, event_type string")


@query("csv_inferred", "SELECT s_suppkey::INT AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_inferred_q(spark, sf):
    return scan(spark, sinks.write_table(Tables(spark, sf).supplier, folder(spark, "supplier"), "csv"), "csv")


@query("export_exploratory", f"""WITH h AS ({HOLES_SQL}) SELECT 'numeric_summary' AS part, 'value' AS name, count(value) AS n FROM h UNION ALL
SELECT 'frequencies_event_type', coalesce(event_type, 'missing'), count(*) FROM h GROUP BY 2""")
def export_exploratory_q(spark, sf):
    df = with_holes(Tables(spark, sf).events)
    paths = sinks.export_exploratory(df, ["value"], ["event_type"], folder(spark, "exploratory"), "parquet")
    a = spark.read.parquet(paths["numeric_summary"]).select(F.lit("numeric_summary").alias("part"), F.col("variable").alias("name"), F.col("count").alias("n"))
    b = spark.read.parquet(paths["frequencies_event_type"]).select(
        F.lit("frequencies_event_type").alias("part"), F.coalesce("level", F.lit("missing")).alias("name"), "n")
    return a.unionByName(b)


@query("result_bundle", """SELECT 'l_quantity' AS variable, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem""")
def result_bundle_q(spark, sf):
    fit = ln.ols(Tables(spark, sf).lineitem, "l_extendedprice", ["l_quantity"])
    paths = sinks.write_tables({"coefficients": fit.table, "fit": fit.fit}, folder(spark, "bundle"))
    table, one = spark.read.parquet(paths["coefficients"]), spark.read.parquet(paths["fit"])
    out = table.where("variable <> 'const'").select("variable", "coef").withColumn("r2", one.select("r2").scalar())
    return rounded(out, 4, r2=8)


@query("audit_log", """SELECT 'clean' AS stage, 'impute mean' AS op, (count(*) - count(value))::VARCHAR AS nulls FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events)
 UNION ALL SELECT 'derive', 'date parts', '0' FROM (SELECT 1)""")
def audit_log_q(spark, sf):
    df = with_holes(Tables(spark, sf).events)
    nulls = df.agg(F.count(F.lit(1)) - F.count("value")).first()[0]
    path = folder(spark, "log")
    audit.append_step(spark, path, "clean", "impute mean", {"nulls": nulls})
    audit.append_step(spark, path, "derive", "date parts", {"nulls": 0})
    audit.append_step(spark, path, "view", "reset filter", {"nulls": 0})
    out = audit.read_log(spark.read.parquet(path), newest_first=True, without="reset")
    return out.select("stage", "op", F.col("params")["nulls"].alias("nulls"))
