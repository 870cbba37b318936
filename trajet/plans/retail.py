"""Queries over the retail environment whose answers depend on what came before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retail_calls as RC
from ..sources.derive import table
from .content import USERS, status_of, users
from .registry import query

ROUNDS = ("cancel_pending_order", "return_delivered_order_items", "modify_pending_order_address", "return_delivered_order_items", "get_order_details")

CALLS = f"""{USERS},
    li AS (SELECT l_orderkey AS order_id, min(l_partkey) AS first_item FROM lineitem GROUP BY 1),
    pr AS (SELECT l_orderkey AS order_id, l_partkey AS item_id, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
    od AS (SELECT o_orderkey AS order_id, o_custkey AS session_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'delivered' ELSE 'processed' END AS status, o_totalprice AS paid, first_item, p.price
        FROM orders LEFT JOIN li ON li.order_id = o_orderkey LEFT JOIN pr p ON p.order_id = o_orderkey AND p.item_id = first_item),
    ca AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round, order_id) AS step,
            CASE WHEN round < 5 THEN [{', '.join(f"'{t}'" for t in ROUNDS)}][(round + order_id) % 5 + 1] WHEN order_id % 3 = 0 THEN 'modify_user_address' ELSE 'find_user_id_by_name_zip' END AS tool,
            (order_id + round) % 6 = 0 OR first_item IS NULL AS absent, (order_id + round) % 11 = 0 AND round < 5 AS unknown
        FROM od, generate_series(0, 5) AS g(round))"""


@query(f"""WITH RECURSIVE {CALLS},
    f AS (SELECT user_id AS session_id, 0::BIGINT AS step, MAP([]::BIGINT[], []::VARCHAR[]) AS st, zip, zip AS old_zip, ''::VARCHAR AS tool, NULL::VARCHAR AS error, NULL::VARCHAR AS status, NULL::DOUBLE AS refund, NULL::VARCHAR AS answer FROM u
        UNION ALL
        SELECT session_id, step, CASE WHEN fresh IS NOT NULL THEN map_concat(st, MAP([order_id], [fresh])) ELSE st END,
            CASE WHEN tool = 'modify_user_address' THEN lpad((order_id % 100000)::VARCHAR, 5, '0') ELSE zip END, old_zip, tool, error,
            CASE WHEN round < 5 AND NOT unknown THEN coalesce(fresh, cur) END,
            CASE WHEN fresh = 'cancelled' THEN paid WHEN fresh = 'returned' THEN price END,
            CASE WHEN tool = 'find_user_id_by_name_zip' THEN CASE WHEN zip = old_zip THEN session_id::VARCHAR ELSE 'user_id_not_found' END END
        FROM (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN tool = 'cancel_pending_order' THEN 'cancelled' WHEN tool = 'return_delivered_order_items' THEN 'returned' END AS fresh
            FROM (SELECT c.*, f.st, f.zip, f.old_zip, coalesce(f.st[c.order_id], c.status) AS cur,
                CASE WHEN c.round = 5 THEN NULL WHEN c.unknown THEN 'order not found: ' || (-1 - c.order_id)
                    WHEN c.tool IN ('cancel_pending_order', 'modify_pending_order_address') AND coalesce(f.st[c.order_id], c.status) <> 'pending' THEN 'order ' || c.order_id || ' not pending (status=' || coalesce(f.st[c.order_id], c.status) || ')'
                    WHEN c.tool = 'return_delivered_order_items' AND coalesce(f.st[c.order_id], c.status) <> 'delivered' THEN 'order ' || c.order_id || ' not delivered (status=' || coalesce(f.st[c.order_id], c.status) || ')'
                    WHEN c.tool = 'return_delivered_order_items' AND c.absent THEN 'item_id -1 not in order' END AS error
                FROM f JOIN ca c ON c.session_id = f.session_id AND c.step = f.step + 1)))
    SELECT session_id, step, tool, error, status, round(refund, 2) AS refund, answer AS found FROM f WHERE step > 0""")
def q_tool_calls(spark, d):
    """Every customer's session calls the tools on each of its orders, in an order that differs by order, and on itself."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min("l_partkey").alias("first_item"), F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("item_id"), F.col("l_extendedprice").alias("price"))).alias("items"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("session_id"), status_of().alias("status"), F.col("o_totalprice").alias("paid")).join(lines, "order_id", "left")
    text = lambda c: F.col(c).cast("string")
    paid = F.array(F.struct(F.lit("payment").alias("transaction_type"), F.col("paid").alias("amount"), F.lit("card").alias("payment_method_id")))
    none = F.lit(None).cast(RC.ADDRESS)
    # a session's environment has its own customer and orders
    orders = o.select("session_id", F.struct(text("order_id").alias("order_id"), text("session_id").alias("user_id"), "status", "items", paid.alias("payments"), none.alias("address")).alias("order"))
    address = lambda zip_code: F.struct(F.lit("1 Main St").alias("address1"), F.lit(None).cast("string").alias("address2"), F.lit("X").alias("city"), F.lit("US").alias("country"), F.lit(None).cast("string").alias("state"), zip_code.alias("zip"))
    u = users(spark, d)
    people = u.select(F.col("user_id").alias("session_id"), F.struct(text("user_id").alias("user_id"), "first_name", "last_name", "email", address(F.col("zip")).alias("address")).alias("user"))
    # each round calls on every order once, so steps are counted before rows are made for the rounds
    session = Window.partitionBy("session_id")
    c = o.select("order_id", "session_id", "first_item", F.row_number().over(session.orderBy("order_id")).alias("rank"), F.count(F.lit(1)).over(session).alias("n"))
    c = c.join(u.select(F.col("user_id").alias("session_id"), "first_name", "last_name", "zip"), "session_id")
    c = c.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("step", F.col("round") * F.col("n") + F.col("rank"))
    at = (F.col("order_id") + F.col("round")).cast("long")
    tool = F.when(F.col("round") < 5, F.element_at(F.array(*map(F.lit, ROUNDS)), (at % 5 + 1).cast("int"))).when(F.col("order_id") % 3 == 0, "modify_user_address").otherwise("find_user_id_by_name_zip")
    named = F.when((F.col("round") < 5) & (at % 11 == 0), -1 - F.col("order_id")).otherwise(F.col("order_id")).cast("string")
    item = F.when((at % 6 == 0) | F.col("first_item").isNull(), F.lit("-1")).otherwise(text("first_item"))
    call = F.struct(
        tool.alias("tool"), F.lit(None).cast("string").alias("email"), "first_name", "last_name", "zip", text("session_id").alias("user_id"), named.alias("order_id"), F.lit(None).cast("string").alias("product_id"),
        F.array(item).alias("item_ids"), F.lit("card").alias("payment_method_id"), address(F.lpad((F.col("order_id") % 100000).cast("string"), 5, "0")).alias("address"), F.lit(None).cast("string").alias("thought"),
    )
    done = RC.retail_calls(c.select("session_id", "step", call.alias("call")), people, orders)
    found = F.when(F.col("tool") == "find_user_id_by_name_zip", F.col("answer"))
    return done.select("session_id", "step", "tool", "error", "status", F.round("refund", 2).alias("refund"), found.alias("found"))
