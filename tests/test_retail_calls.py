"""Sequential tool calls: what one call leaves behind is what the next one sees."""

import json

import pytest

from trajet.operators import retail_calls as RC

HOME = ("1 Main St", None, "Boston", "US", "MA", "02101")


def call(tool, **given):
    names = ("tool", "email", "first_name", "last_name", "zip", "user_id", "order_id", "product_id", "item_ids", "payment_method_id", "address", "thought")
    return tuple({"tool": tool, **given}.get(n) for n in names)


@pytest.fixture(scope="module")
def world(spark):
    users = [(("u1", "Ada", "Low", "ada@x.org", HOME),), (("u2", "Ada", "Low", "low@x.org", HOME),), (("u3", "Bob", "Ray", None, None),)]
    paid = [("payment", 30.5, "card"), ("payment", 9.5, "gift")]
    orders = [(("o1", "u1", "pending", [("i1", 30.0), ("i2", 10.0)], paid, HOME),), (("o2", "u1", "delivered", [("i1", 5.0), ("i1", 6.0), ("i3", 7.0)], [], None),), (("o3", "u3", "pending", None, None, None),)]
    return (
        spark.createDataFrame(users, f"user {RC.USER}"),
        spark.createDataFrame(orders, f"order {RC.ORDER}"),
        spark.createDataFrame([(("p1", "Lamp"),)], f"product {RC.PRODUCT}"),
    )


def run(spark, world, *sessions):
    rows = [(s, i, c) for s, calls in enumerate(sessions) for i, c in enumerate(calls)]
    df = spark.createDataFrame(rows, f"session_id int, step int, call {RC.CALL}")
    return {(r["session_id"], r["step"]): r for r in RC.retail_calls(df, *world).collect()}


def test_calls_follow_each_other(spark, world):
    moved = ("9 Elm", None, "Reno", "US", None, "89501")
    got = run(
        spark, world,
        [call("cancel_pending_order", order_id="o1"), call("cancel_pending_order", order_id="o1"), call("modify_pending_order_address", order_id="o1", address=moved), call("get_order_details", order_id="o1"), call("return_delivered_order_items", order_id="o1", item_ids=["i1"])],
        [call("return_delivered_order_items", order_id="o2", item_ids=["i1", "i9"]), call("return_delivered_order_items", order_id="o2", item_ids=["i1"], payment_method_id="card"), call("return_delivered_order_items", order_id="o2", item_ids=["i3"])],
        [call("modify_pending_order_address", order_id="o1", address=moved), call("get_order_details", order_id="o1"), call("cancel_pending_order", order_id="o3")],
    )
    error = lambda s, i: got[s, i]["error"]
    assert json.loads(got[0, 0]["answer"]) == {"ok": True, "order_id": "o1", "new_status": "cancelled"} and got[0, 0]["refund"] == got[0, 0]["refunded"] == 40.0
    assert error(0, 1) == error(0, 2) == "order o1 not pending (status=cancelled)" and error(0, 4) == "order o1 not delivered (status=cancelled)"
    assert [p["transaction_type"] for p in json.loads(got[0, 3]["answer"])["payments"]] == ["payment", "payment", "refund", "refund"]
    assert error(1, 0) == "item_id i9 not in order" and got[1, 1]["refund"] == 11.0 and got[1, 1]["status"] == "returned" and error(1, 2) == "order o2 not delivered (status=returned)"
    # another session begins with the environment as it was; fields that are not given are not told
    assert json.loads(got[2, 0]["answer"])["new_address"] == {"address1": "9 Elm", "city": "Reno", "country": "US", "zip": "89501"}
    assert json.loads(got[2, 1]["answer"])["address"]["zip"] == "89501" and got[2, 2]["status"] == "cancelled" and got[2, 2]["refund"] == 0.0


def test_lookups_see_changed_users(spark, world):
    by_name = call("find_user_id_by_name_zip", first_name="Ada", last_name="Low", zip="02101")
    moved = ("x", None, "y", "US", None, "99999")
    got = run(
        spark, world,
        [by_name, call("modify_user_address", user_id="u1", address=moved), by_name, call("modify_user_address", user_id="u2", address=moved), by_name, call("get_user_details", user_id="u1"), call("find_user_id_by_email", email="ada@x.org")],
        [by_name, call("find_user_id_by_email", email="no@x.org"), call("find_user_id_by_email"), call("get_user_details", user_id="u9"), call("modify_user_address", user_id="u9", address=moved)],
    )
    assert [got[0, i]["answer"] for i in (0, 2, 4, 6)] == ["u1", "u2", "user_id_not_found", "u1"]
    assert json.loads(got[0, 5]["answer"])["address"]["zip"] == "99999"
    assert [got[1, i]["answer"] for i in (0, 1, 2)] == ["u1", "user_id_not_found", "user_id_not_found"]
    assert [got[1, i]["error"] for i in (3, 4)] == ["user not found: u9"] * 2


def test_other_tools_nulls_and_empty(spark, world):
    got = run(spark, world, [call("get_product_details", product_id="p1"), call("get_product_details", product_id="p2"), call("think", thought="x" * 300), call("think"), call("fly"), call(None), call("get_order_details"), call("return_delivered_order_items", order_id="o2", item_ids=[None])])
    assert json.loads(got[0, 0]["answer"])["name"] == "Lamp" and got[0, 1]["error"] == "product not found: p2"
    assert json.loads(got[0, 2]["answer"]) == {"noted": "x" * 200} and json.loads(got[0, 3]["answer"]) == {"noted": ""}
    assert got[0, 4]["error"] == "unknown tool: fly" and got[0, 5]["error"] and got[0, 6]["error"].startswith("order not found") and got[0, 7]["error"] == "item_id null not in order"
    assert run(spark, world, []) == {}


def test_sessions_with_an_environment_of_their_own(spark):
    people = [(s, (u, "Ada", "Low", None, HOME)) for s, u in ((0, "u2"), (1, "u1"), (2, None))]
    orders = [(s, (o, None, "pending", None, [("payment", paid, "card")], None)) for s, o, paid in ((0, "o1", 1.0), (1, "o1", 2.0), (1, None, 3.0), (5, "o9", 4.0))]
    world = spark.createDataFrame(people, f"session_id int, user {RC.USER}"), spark.createDataFrame(orders, f"session_id int, order {RC.ORDER}")
    calls = [call("find_user_id_by_name_zip", first_name="Ada", last_name="Low", zip="02101"), call("cancel_pending_order", order_id="o1"), call("get_order_details"), call("get_user_details")]
    got = run(spark, world, calls, calls, calls)
    assert [got[s, 0]["answer"] for s in range(3)] == ["u2", "u1", "user_id_not_found"]
    assert [got[s, 1]["refund"] for s in range(3)] == [1.0, 2.0, None] and len(got) == 12
    assert all(got[s, i]["error"].endswith("not found: None") for s in range(3) for i in (2, 3)) and got[2, 1]["error"] == "order not found: o1"


def test_customers_of_one_name_are_found_in_their_own_sessions(spark, tmp_path):
    """Copies of the tables under shifted keys, as SQL answers them, without work that grows with copies of a name."""
    import oracle
    from trajet.plans import ORACLES, QUERIES

    for name, keys in (("customer", ["c_custkey"]), ("orders", ["o_orderkey", "o_custkey"]), ("lineitem", ["l_orderkey"])):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows.unionAll(rows.withColumns({k: rows[k] + 1_000_000 for k in keys})).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = oracle.duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    oracle.compare(spark, QUERIES["q_tool_calls"], ORACLES["q_tool_calls"], str(tmp_path), con)


def test_calls_on_orders_do_not_pass_through_python(spark, world, monkeypatch):
    """Most calls are on orders; as rows of Python they made the query's time. A price that is not given adds nothing."""
    fold = RC._folded

    def watched(batches):
        def seen():
            for batch in batches:
                assert not set(batch.column("tool").to_pylist()) & {"get_order_details", "cancel_pending_order", "modify_pending_order_address", "return_delivered_order_items"}
                yield batch

        yield from fold(seen())

    monkeypatch.setattr(RC, "_folded", watched)
    people, _, products = world
    orders = spark.createDataFrame([(("o4", "u1", "delivered", [("i1", None), ("i1", 2.5), ("i2", 4.0)], [("refund", 1.0, "gift")], HOME),)], f"order {RC.ORDER}")
    back = lambda *items: call("return_delivered_order_items", order_id="o4", item_ids=list(items), payment_method_id="card")
    got = run(spark, (people, orders, products), [back("i3"), back("i1"), back("i2"), call("get_order_details", order_id="o4"), call("get_user_details", user_id="u1")])
    assert [got[0, i]["error"] for i in range(5)] == ["item_id i3 not in order", None, "order o4 not delivered (status=returned)", None, None]
    assert [got[0, i]["refund"] for i in range(3)] == [None, 2.5, None] and [got[0, i]["refunded"] for i in range(4)] == [1.0, 3.5, 3.5, 3.5]
    details = json.loads(got[0, 3]["answer"])
    assert details["status"] == "returned" and details["payments"][-1] == {"transaction_type": "refund", "amount": 2.5, "payment_method_id": "card"} and details["items"][0]["price"] is None
    assert json.loads(got[0, 4]["answer"])["address"]["zip"] == "02101"
