"""The retail tools: calls of a session in their order, on an environment that each call may change.

A call sees what the calls before it left behind. It touches one order, or the session's users, so a session is dealt by
(session, order) and (session, users): a long session is many small parts, and each holds only the rows its calls name.
An order leaves its first status once at most, so what its calls find follows from windows over those before them; only
calls on users, products and nothing are folded in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADDRESS = "struct<address1:string,address2:string,city:string,country:string,state:string,zip:string>"
USER = f"struct<user_id:string,first_name:string,last_name:string,email:string,address:{ADDRESS}>"
ORDER = f"struct<order_id:string,user_id:string,status:string,items:array<struct<item_id:string,price:double>>,payments:array<struct<transaction_type:string,amount:double,payment_method_id:string>>,address:{ADDRESS}>"
PRODUCT = "struct<product_id:string,name:string>"
#: What the tools take; each reads its own fields.
CALL = (
    "struct<tool:string,email:string,first_name:string,last_name:string,zip:string,user_id:string,order_id:string,product_id:string,item_ids:array<string>,payment_method_id:string,"
    f"address:{ADDRESS},thought:string>"
)
ANSWER = "session_id long, step long, tool string, answer string, error string, status string, refund double, refunded double"
_ANSWER_NAMES = [field.split()[0] for field in ANSWER.split(", ")]
_ANSWER = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[field.split()[1]] for field in ANSWER.split(", ")]
_CALL_FIELDS = ("tool", "email", "first_name", "last_name", "zip", "user_id", "order_id", "product_id", "item_ids", "payment_method_id", "address", "thought")
#: What a fold reads of a row: a call's arguments or a user's fields, an address as JSON, and what is told of it, as JSON.
_FOLDED = ("tool", "user_id", "first_name", "last_name", "email", "zip", "product_id", "address", "told")
_ORDER_TOOLS = ("get_order_details", "cancel_pending_order", "modify_pending_order_address", "return_delivered_order_items")
_USER_TOOLS = ("find_user_id_by_email", "find_user_id_by_name_zip", "get_user_details", "modify_user_address")
_WHOLE = {"ignoreNullFields": "false"}
#: Fixed value: characters of a thought that are noted.
THOUGHT_CHARS = 200


class Refused(Exception):
    """A tool's error answer."""


class Environment:
    """Users and products by id, as rows of their fields, and the tools on them. Each tool returns its answer."""

    def __init__(self):
        self.users, self.products = {}, {}

    def call(self, call: dict) -> str:
        tool = getattr(self, f"tool_{call['tool']}", None)
        if tool is None:
            raise Refused(f"unknown tool: {call['tool']}")
        return tool(call)

    @staticmethod
    def _found(have: dict, kind: str, key) -> dict:
        if key not in have:
            raise Refused(f"{kind} not found: {key}")
        return have[key]

    def _first_user(self, fits) -> str:
        return min((u["user_id"] for u in self.users.values() if fits(u)), default="user_id_not_found")

    def tool_find_user_id_by_email(self, call):
        return self._first_user(lambda u: u["email"] is not None and u["email"] == call["email"])

    def tool_find_user_id_by_name_zip(self, call):
        asked = call["first_name"], call["last_name"], call["zip"]
        return self._first_user(lambda u: None not in asked and (u["first_name"], u["last_name"], u["zip"]) == asked)

    def tool_get_user_details(self, call):
        user = self._found(self.users, "user", call["user_id"])
        return f'{user["told"][:-1]},"address":{user["address"] or "null"}}}'

    def tool_get_product_details(self, call):
        return self._found(self.products, "product", call["product_id"])["told"]

    def tool_modify_user_address(self, call):
        self._found(self.users, "user", call["user_id"]).update(address=call["address"], zip=call["zip"])
        return call["told"]

    def tool_think(self, call):
        return call["told"]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (session, place), the environment's first, then the calls in order; each place has a state of its own."""
    at = state = None
    for batch in batches:
        out = []
        # texts come much faster by numpy
        text = {c: batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("place", "phase", *_FOLDED)}
        rows = zip(batch.column("session_id").to_pylist(), text["place"], text["phase"], batch.column("step").to_pylist(), zip(*(text[c] for c in _FOLDED)))
        for session, place, phase, step, fields in rows:
            if at != (session, place):
                at, state = (session, place), Environment()
            row = dict(zip(_FOLDED, fields))
            if not phase:
                if row["user_id"] is not None:
                    state.users.setdefault(row["user_id"], row)
                elif row["product_id"] is not None:
                    state.products.setdefault(row["product_id"], row)
                continue
            answer = error = None
            try:
                answer = state.call(row)
            except Refused as e:
                error = str(e)
            out.append((session, step, row["tool"], answer, error, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(_ANSWER), _ANSWER)], _ANSWER_NAMES)


def _quoted(text):
    """As a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _moved(key: str, address):
    """The answer to a new address, without the fields that are not given."""
    return F.concat(F.lit(f'{{"ok":true,"{key}":'), _quoted(F.col(key)), F.lit(',"new_address":'), F.coalesce(F.to_json(address), F.lit("null")), F.lit("}"))


def _order_calls(calls: DataFrame, orders: DataFrame) -> DataFrame:
    """Calls of the order tools (session_id, step and a call's fields) on (session_id, order) -> ANSWER.

    A pending order can be cancelled and a delivered one returned, once and for all, so the status that a call finds depends
    on the first status and on whether such a call stands before it."""
    tool = F.col("tool")
    cancels, moves, returns, reads = (tool == t for t in ("cancel_pending_order", "modify_pending_order_address", "return_delivered_order_items", "get_order_details"))
    fields = [f.split(":", 1) for f in ("user_id:string", "status:string", f"items:{ORDER.split('items:')[1].split(',payments')[0]}", f"payments:{ORDER.split('payments:')[1].split(',address')[0]}", f"address:{ADDRESS}")]
    given = {"step": "long", "tool": "string", "asked": "array<string>", "method": "string", "to": ADDRESS}
    # of a call only what its tool reads
    asked = {"asked": F.when(returns, F.col("item_ids")), "method": F.when(returns, F.col("payment_method_id")), "to": F.when(moves, F.col("address"))}
    none = lambda types: [F.lit(None).cast(t).alias(k) for k, t in types]
    payments = F.col("order.payments")
    total = lambda xs, field: F.coalesce(F.aggregate(xs, F.lit(0.0), lambda t, x: t + F.coalesce(x[field], F.lit(0.0))), F.lit(0.0))
    of_type = lambda payments, kind: F.filter(payments, lambda p: p["transaction_type"].eqNullSafe(kind))
    sums = {"paid": total(of_type(payments, "payment"), "amount"), "repaid": total(of_type(payments, "refund"), "amount")}
    rows = calls.select("session_id", "order_id", F.lit(1).alias("phase"), "step", "tool", *(v.alias(k) for k, v in asked.items()), *none((f"own_{k}", t) for k, t in fields), *none((f"own_{k}", "double") for k in sums)).unionAll(
        orders.select("session_id", F.col("order.order_id").alias("order_id"), F.lit(0).alias("phase"), *none(given.items()), *(F.col(f"order.{k}").alias(f"own_{k}") for k, _ in fields), *(v.alias(f"own_{k}") for k, v in sums.items()))
    )
    part = Window.partitionBy("session_id", "order_id")
    so_far = part.orderBy("phase", *given, *(f"own_{k}" for k, _ in fields)).rowsBetween(Window.unboundedPreceding, 0)
    # the environment's row stands first
    own = {k: F.first(f"own_{k}").over(so_far) for k in (*(k for k, _ in fields), *sums)}
    rows = rows.withColumns({**own, "there": F.first("phase").over(so_far) == 0}).filter("phase = 1").drop(*(f"own_{k}" for k in own))

    # an order of rows that the windows above leave
    before, so_far = (part.orderBy("phase", *given).rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    status, items, payments = F.col("status"), F.col("items"), F.col("payments")
    pending, delivered = status.eqNullSafe("pending"), status.eqNullSafe("delivered")
    missing = F.filter("asked", lambda i: ~F.exists(F.coalesce(items, F.array().cast(fields[2][1])), lambda x: x["item_id"].eqNullSafe(i)))
    # null asks for nothing
    rows = rows.withColumn("missing", F.when(returns & delivered, F.coalesce(missing, F.array().cast("array<string>"))))
    returned = total(F.filter(items, lambda x: F.exists("asked", lambda i: i.eqNullSafe(x["item_id"]))), "price")
    rows = rows.withColumn("returned", F.when(F.size("missing") == 0, F.struct(returned.alias("amount"), "method")))
    stood = lambda what: F.coalesce(F.max(what).over(before), F.lit(False))
    found = F.when(pending & stood(cancels), "cancelled").when(delivered & stood(F.col("returned").isNotNull()), "returned").otherwise(status)
    rows = rows.withColumn("found", found).withColumn("first_return", F.first("returned", ignorenulls=True).over(so_far))

    refused = lambda what: F.concat(F.lit("order "), F.col("order_id"), F.lit(f" not {what} (status="), F.coalesce("found", F.lit("None")), F.lit(")"))
    error = (
        F.when(~F.col("there"), F.concat(F.lit("order not found: "), F.coalesce("order_id", F.lit("None"))))
        .when((cancels | moves) & ~F.col("found").eqNullSafe("pending"), refused("pending"))
        .when(returns & ~F.col("found").eqNullSafe("delivered"), refused("delivered"))
        .when(returns & (F.size("missing") > 0), F.concat(F.lit("item_id "), F.coalesce(F.get("missing", F.lit(0)), F.lit("null")), F.lit(" not in order")))
    )
    rows = rows.withColumn("error", error)
    done = F.col("error").isNull()
    rows = rows.withColumn("left", F.when(done & cancels, "cancelled").when(done & returns, "returned").otherwise(F.col("found")))
    now_cancelled, now_returned = pending & (F.col("left") == "cancelled"), delivered & (F.col("left") == "returned")
    refunded = F.col("repaid") + F.when(now_cancelled, F.col("paid")).otherwise(0.0) + F.when(now_returned, F.col("first_return.amount")).otherwise(0.0)

    moved = F.last(F.when(done & moves, F.struct(F.col("to").alias("address"))), ignorenulls=True).over(before)
    refund = lambda amount, method: F.struct(F.lit("refund").alias("transaction_type"), amount.alias("amount"), method.alias("payment_method_id"))
    had = F.coalesce(payments, F.array().cast(fields[3][1]))
    booked = F.when(now_cancelled, F.concat(had, F.transform(F.coalesce(of_type(payments, "payment"), F.array().cast(fields[3][1])), lambda p: refund(p["amount"], p["payment_method_id"]))))
    booked = booked.when(now_returned, F.concat(had, F.array(refund(F.col("first_return.amount"), F.col("first_return.method"))))).otherwise(payments)
    address = F.when(F.col("moved").isNull(), F.col("address")).otherwise(F.col("moved.address"))
    order = F.struct("order_id", "user_id", F.col("left").alias("status"), "items", booked.alias("payments"), address.alias("address"))
    ok = F.lit(True).alias("ok")
    answer = (
        F.when(reads, F.to_json(order, _WHOLE))
        .when(cancels, F.to_json(F.struct(ok, "order_id", F.lit("cancelled").alias("new_status"))))
        .when(returns, F.to_json(F.struct(ok, "order_id", F.col("returned.amount").alias("refund"))))
        .otherwise(_moved("order_id", F.col("to")))
    )
    return rows.withColumn("moved", moved).select(
        "session_id", "step", "tool", F.when(done, answer).alias("answer"), "error", F.when(F.col("there"), F.col("left")).alias("status"),
        F.when(done, F.when(cancels, F.col("paid")).when(returns, F.col("returned.amount"))).alias("refund"), F.when(F.col("there"), refunded).alias("refunded"),
    )


def retail_calls(calls: DataFrame, users: DataFrame, orders: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(session_id, step, call) with calls as CALL -> one answer a call: session_id, step, tool, answer, error, status,
    refund, refunded.

    users, orders, products: one column each (`user`, `order`, `product`) of the structs above; every session begins with
    them as they are, or with those of its own where a `session_id` stands beside. A call that a tool refuses has an error
    and changes nothing. Calls of equal steps follow in the order of their tools and arguments; of users with equal data the
    least id is found; several rows of an id count as the first by their other fields; null ids find nothing.
    """
    # field by field, so that what no answer needs is neither built nor moved
    types = dict(zip(_CALL_FIELDS, ["string"] * len(_CALL_FIELDS))) | {"item_ids": "array<string>", "address": ADDRESS}
    call = [F.col("call").getField(have).cast(t).alias(f) for have, (f, t) in zip(calls.schema["call"].dataType.names, types.items())]
    every = calls.select(F.col("session_id").cast("long").alias("session_id"), F.col("step").cast("long").alias("step"), *call)
    on_order = F.coalesce(F.col("tool").isin(*_ORDER_TOOLS), F.lit(False))
    order_calls = every.filter(on_order).select("session_id", "step", "tool", "order_id", "item_ids", "payment_method_id", "address")
    others = every.filter(~on_order)
    tool = F.col("tool")
    place = (
        F.when(tool.isin(*_USER_TOOLS), "users")
        .when(tool == "get_product_details", F.concat(F.lit("product "), F.coalesce("product_id", F.lit(""))))
        .otherwise(F.concat(F.lit("step "), F.col("step").cast("string")))
    )
    moves = tool == "modify_user_address"
    told = F.when(moves, _moved("user_id", F.col("address"))).when(tool == "think", F.to_json(F.struct(F.substring(F.coalesce("thought", F.lit("")), 1, THOUGHT_CHARS).alias("noted"))))
    asked = {"zip": F.when(moves, F.col("address.zip")).otherwise(F.col("zip")), "address": F.when(moves, F.to_json("address", _WHOLE)), "told": told}
    rows = others.select("session_id", place.alias("place"), F.lit(1).alias("phase"), "step", *(asked.get(f, F.col(f)).alias(f) for f in _FOLDED))

    def own(have: DataFrame, kind: str, as_struct: str) -> DataFrame:
        return have.select(*(F.col(k).cast("long").alias(k) for k in have.columns if k == "session_id"), F.col(kind).cast(as_struct).alias(kind)).filter(f"{kind}.{kind}_id is not null")

    def named(tools: tuple, place, known: DataFrame, kind: str, **keys) -> DataFrame:
        """The rows of the environment that a session's calls name by these fields. No step is read, so none is computed."""
        asked = others.filter(tool.isin(*tools)).select("session_id", place.alias("place"), *keys).dropna(subset=list(keys)).distinct()
        known = known.select(kind, *(v.alias(f"_{k}") for k, v in keys.items()))
        return asked.join(known, [asked[k] == known[f"_{k}"] for k in keys]).select("session_id", "place", kind)

    def stand(found: DataFrame, kind: str, **fields) -> DataFrame:
        """Rows of the environment beside the calls that look for them; what no call names is left aside."""
        columns = (fields.get(f, F.lit(None).cast("string")).alias(f) for f in _FOLDED)
        return found.select("session_id", "place", F.lit(0).alias("phase"), F.lit(None).cast("long").alias("step"), *columns)

    u = lambda f: F.col(f"user.{f}")
    in_users, people = F.lit("users"), own(users, "user", USER)
    found = [people.select("session_id", in_users.alias("place"), "user")] if "session_id" in users.columns else [
        named(("get_user_details", "modify_user_address"), in_users, people, "user", user_id=u("user_id")),
        named(("find_user_id_by_email",), in_users, people, "user", email=u("email")),
        named(("find_user_id_by_name_zip",), in_users, people, "user", first_name=u("first_name"), last_name=u("last_name"), zip=u("address.zip")),
    ]
    plain = ("user_id", "first_name", "last_name", "email")
    shown = {"zip": u("address.zip"), "address": F.to_json(u("address"), _WHOLE), "told": F.to_json(F.struct(*(u(f).alias(f) for f in plain)), _WHOLE)}
    for df in found:
        rows = rows.unionAll(stand(df, "user", **{f: u(f) for f in plain}, **shown))
    if products is not None:
        p = own(products, "product", PRODUCT)
        by_id = F.concat(F.lit("product "), F.col("product.product_id"))
        df = p.select("session_id", by_id.alias("place"), "product") if "session_id" in products.columns else named(("get_product_details",), F.concat(F.lit("product "), F.col("product_id")), p, "product", product_id=F.col("product.product_id"))
        rows = rows.unionAll(stand(df, "product", product_id=F.col("product.product_id"), told=F.to_json("product", _WHOLE)))
    # a row is little to send and much to fold, so parts are not put together by their size
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = rows.repartition(parts, "session_id", "place").sortWithinPartitions("session_id", "place", "phase", "step", *_FOLDED).mapInArrow(_folded, ANSWER)

    known = own(orders, "order", ORDER)
    if "session_id" not in orders.columns:
        wanted = order_calls.select("session_id", "order_id").dropna(subset=["order_id"]).distinct()
        known = wanted.join(known, wanted["order_id"] == known["order.order_id"]).select("session_id", "order")
    return _order_calls(order_calls, known).unionAll(folded)
