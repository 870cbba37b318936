"""The retail environment: sparse rewards, state differences, refunds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_reward(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(order_id, status, items) against expectations whose null fields are not checked: 1 if all that is expected holds.

    Item ids compare as sets. Other columns of the expectations stay.
    """
    have = actual.select("order_id", F.col("status").alias("_status"), F.array_sort(F.array_distinct("items")).alias("_items"), F.lit(True).alias("_there"))
    fits = F.coalesce("_there", F.lit(False)) & (F.col("status").isNull() | (F.col("status") == F.col("_status"))) & (
        F.col("items").isNull() | (F.array_sort(F.array_distinct("items")) == F.col("_items"))
    )
    others = [c for c in expected.columns if c not in ("status", "items")]
    return expected.join(have, "order_id", "left").select(*others, F.coalesce(fits, F.lit(False)).cast("int").alias("reward"))


def task_reward(per_order: DataFrame, by: str) -> DataFrame:
    """A task is rewarded when all its expectations hold."""
    return per_order.groupBy(by).agg(F.min("reward").alias("reward"))


def env_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose columns differ between two states, by a full outer join: added, removed or changed."""
    cols = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*cols).alias("_a"))
    b = after.select(key, F.struct(*cols).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, kind.alias("change"))


def cancel(orders: DataFrame) -> DataFrame:
    """Pending orders are cancelled and refunded; others answer with an error. The input is not changed."""
    pending = F.col("status") == "pending"
    return orders.select(
        "order_id",
        F.when(pending, "cancelled").otherwise(F.col("status")).alias("new_status"),
        F.when(pending, F.col("paid")).otherwise(0.0).alias("refund"),
        F.when(~pending, F.format_string("order %d not pending (status=%s)", "order_id", "status")).alias("error"),
    )


def return_items(orders: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(order_id, item_id) requests -> refund, or an error: unknown order, not delivered, an item that is not in it.

    An item that stands in several lines of an order is refunded with all of them.
    """
    asked = wanted.distinct()
    lines = items.groupBy("order_id", "item_id").agg(F.sum("price").alias("price"), F.count(F.lit(1)).alias("lines"))
    found = asked.join(lines, ["order_id", "item_id"], "left").groupBy("order_id").agg(
        F.sum("price").alias("refund"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("n_items"), F.min(F.when(F.col("lines").isNull(), F.col("item_id"))).alias("_absent")
    )
    state = F.col("status")
    error = (
        F.when(state.isNull(), F.format_string("order not found: %d", "order_id"))
        .when(state != "delivered", F.format_string("order %d not delivered (status=%s)", "order_id", "status"))
        .when(F.col("_absent").isNotNull(), F.format_string("item_id %d not in order", "_absent"))
    )
    answered = found.join(orders.select("order_id", "status"), "order_id", "left").withColumn("error", error)
    ok = F.col("error").isNull()
    return answered.select("order_id", F.when(ok, F.col("refund")).alias("refund"), F.when(ok, F.col("n_items")).alias("n_items"), "error")


def change_address(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """(order_id, address1, city, zip) requests: pending orders take the new address, others answer with an error."""
    have = orders.select("order_id", "status")
    error = F.when(F.col("status").isNull(), F.format_string("order not found: %d", "order_id")).when(
        F.col("status") != "pending", F.format_string("order %d not pending (status=%s)", "order_id", "status")
    )
    joined = requests.join(have, "order_id", "left").withColumn("error", error)
    fresh = F.struct("address1", "city", "zip")
    return joined.select("order_id", F.when(F.col("error").isNull(), fresh).alias("new_address"), "error")


def find(have: DataFrame, asked: DataFrame, keys: list[str], answer: str, missing) -> DataFrame:
    """Requests (keys) against a table that has them: + answer, or the `missing` column where nothing has these keys. Of
    several rows with the same keys the one with the least answer counts; a null key finds nothing."""
    known = have.groupBy(*keys).agg(F.min(answer).alias("_answer"))
    return asked.join(known, keys, "left").select(*asked.columns, F.coalesce(F.col("_answer").cast("string"), missing).alias("answer"))


def find_user_by_email(users: DataFrame, asked: DataFrame) -> DataFrame:
    return find(users, asked, ["email"], "user_id", F.lit("user_id_not_found"))


def find_user_by_name_zip(users: DataFrame, asked: DataFrame) -> DataFrame:
    return find(users, asked, ["first_name", "last_name", "zip"], "user_id", F.lit("user_id_not_found"))


def details(have: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """(<kind>_id) requests -> the row as a struct, or an error that names the id."""
    key = f"{kind}_id"
    rows = have.select(key, F.struct(*[c for c in have.columns if c != key]).alias("details"), F.lit(True).alias("_there"))
    error = F.when(F.col("_there").isNull(), F.concat(F.lit(f"{kind} not found: "), F.col(key).cast("string")))
    return asked.join(rows, key, "left").select(key, "details", error.alias("error"))
