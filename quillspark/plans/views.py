"""Views of the driver's tables that stand for study records, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

RESULTS = """SELECT l_orderkey AS attempt, l_linenumber AS q_no, l_partkey AS question, l_suppkey, p_brand AS tag, p_type AS tag2, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS chosen,
 l_returnflag <> 'R' AS answered, l_returnflag <> 'R' AND l_linestatus = 'F' AS correct, CAST(l_quantity AS INT) AS seconds FROM lineitem JOIN part ON l_partkey = p_partkey"""
ATTEMPTS = "SELECT o_orderkey AS attempt, o_custkey AS test, o_orderdate AS date, c_nationkey AS folder, o_totalprice AS price, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey"
FLAGS = "SELECT DISTINCT o_custkey AS test, l_partkey AS question FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount >= 0.09"
JOB_EVENTS = "SELECT event_id, user_id % 20 AS job, user_id AS chunk, CASE event_type WHEN 'view' THEN 'PLAN' WHEN 'signup' THEN 'START' WHEN 'click' THEN 'HEARTBEAT' WHEN 'purchase' THEN 'SUCCESS' ELSE 'DROP' END AS event, ts, value FROM events"
FIGURES = "SELECT l_orderkey AS page, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS fig, l_partkey % 500 AS x0, l_suppkey % 500 AS y0, l_partkey % 500 + l_quantity * 4 AS x1, l_suppkey % 500 + l_linenumber * 40 AS y1, l_discount * 10 AS score FROM lineitem"
TURNS = "SELECT conv_id AS set_id, turn + 1 AS n, text AS stem, CAST((conv_id + turn) % 4 AS INT) AS k FROM conversations WHERE role = 'user'"


def results(t):
    answered = F.col("l_returnflag") != "R"
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("q_no"), F.col("l_partkey").alias("question"), "l_suppkey", F.col("p_brand").alias("tag"), F.col("p_type").alias("tag2"),
        F.when(answered, F.col("l_returnflag")).alias("chosen"), answered.alias("answered"), (answered & (F.col("l_linestatus") == "F")).alias("correct"), F.col("l_quantity").cast("int").alias("seconds"),
    )


def attempts(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("attempt"), F.col("o_custkey").alias("test"), F.col("o_orderdate").alias("date"), F.col("c_nationkey").alias("folder"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def flags(t):
    return t("lineitem").where("l_discount >= 0.09").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("test"), F.col("l_partkey").alias("question")).distinct()


def job_events(t):
    event = F.when(F.col("event_type") == "view", "PLAN").when(F.col("event_type") == "signup", "START").when(F.col("event_type") == "click", "HEARTBEAT").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("DROP")
    return t("events").select("event_id", (F.col("user_id") % 20).alias("job"), F.col("user_id").alias("chunk"), event.alias("event"), "ts", "value")


def figures(t):
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 500
    fig = F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return t("lineitem").select(F.col("l_orderkey").alias("page"), fig.alias("fig"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 4).alias("x1"), (y0 + F.col("l_linenumber") * 40).alias("y1"), (F.col("l_discount") * 10).alias("score"))


def turns(t):
    return t("conversations").where("role = 'user'").select(F.col("conv_id").alias("set_id"), (F.col("turn") + 1).alias("n"), F.col("text").alias("stem"), ((F.col("conv_id") + F.col("turn")) % 4).cast("int").alias("k"))
