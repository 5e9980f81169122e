"""Findings of quotations, claims on keys, rejected events and qualifiers, on hand-made rows."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from partmill.functions.parts import head_and_qualifier
from partmill.operators import findings
from partmill.streaming import events

LINE = "order_id long, line_id long, requested long, quantity long, unit_price decimal(12,2), quantity_source string, price_source string, stored string, available long, identity_ok boolean, identity string, suggested decimal(12,2), floor decimal(12,2), fingerprint string, status string, codes array<string>, stock_policy string, request_policy string"
GOOD = {"order_id": 1, "line_id": 1, "requested": 5, "quantity": 5, "unit_price": Decimal(10), "quantity_source": "typed", "price_source": "engine", "stored": "f" * 20, "available": 9, "identity_ok": True, "identity": "abc", "suggested": Decimal(10), "floor": Decimal(8), "fingerprint": "f" * 20, "status": "priced", "codes": [], "stock_policy": "confirm", "request_policy": "block"}


def found(spark, **line):
    return [tuple(r)[2:] for r in findings.line_findings(spark.createDataFrame([tuple((GOOD | line).values())], LINE)).collect()]


def test_findings_of_a_line(spark):
    assert found(spark) == []
    assert found(spark, quantity=None) == [("quantity_missing", "block", "")]
    assert found(spark, unit_price=None) == [("price_missing", "block", "")] and found(spark, unit_price=None, quantity=0) == [("zero_offered", "info", "")]
    assert found(spark, identity_ok=False, quantity=5, available=1) == [("identity_changed", "confirm", "abc")]
    assert found(spark, available=4) == [("offered_gt_available", "confirm", "5>4")] and found(spark, quantity=6) == [("offered_gt_requested", "block", "6>5")]
    assert found(spark, unit_price=Decimal(0), suggested=Decimal(0)) == [("zero_price", "confirm", "5@0.00"), ("below_floor", "confirm", "0.00<8.00")]
    assert found(spark, fingerprint="g" * 20, suggested=Decimal(11)) == [("stale_price", "confirm", "f" * 12 + ">" + "g" * 12)]
    assert found(spark, fingerprint="g" * 20) == [] and found(spark, fingerprint="g" * 20, suggested=None, price_source="manual") == []
    assert found(spark, quantity=3, quantity_source="available") == [("reduced_to_stock", "info", "")]
    assert found(spark, suggested=Decimal(9), price_source="manual") == [("manual_price", "info", "")] and found(spark, suggested=Decimal(9), price_source="previous") == [("differs_from_list", "info", "")]
    assert found(spark, status="missing", suggested=None, codes=["fallback_list", "rule_conflict"]) == [("no_list_price", "info", ""), ("fallback_list", "info", ""), ("rule_conflict", "info", "")]
    assert found(spark, status="missing", suggested=None, codes=["rule_conflict"], quantity=0) == [("zero_offered", "info", "")]
    assert found(spark, fingerprint=None, suggested=None, floor=None, status=None, codes=None) == []


def test_orders_and_confirmations(spark):
    rows = [GOOD | {"line_id": 1, "quantity": 0}, GOOD | {"line_id": 2, "quantity": 0}, GOOD | {"order_id": 2, "available": 4, "codes": ["currency_parity"]}, GOOD | {"order_id": 2, "line_id": 2, "status": "currency_mismatch", "identity_ok": False}]
    lines = spark.createDataFrame([tuple(r.values()) for r in rows], LINE)
    orders = spark.createDataFrame([(1, False, True, True), (2, True, True, False), (3, False, False, True)], "order_id long, outdated boolean, no_profile boolean, listed boolean")
    every = findings.line_findings(lines).unionByName(findings.order_findings(orders, lines))
    of_orders = {(r["order_id"], r["code"]) for r in every.where("line_id is null").collect()}
    assert of_orders == {(1, "all_zero"), (1, "no_profile"), (2, "draft_outdated"), (2, "currency_parity"), (2, "currency_mismatch")}
    given = spark.createDataFrame([(2, 1, "offered_gt_available", "5>4"), (2, 1, "offered_gt_available", "5>4"), (2, 2, "identity_changed", "old"), (1, None, "all_zero", "")], "order_id long, line_id long, code string, context string")
    marked = findings.acknowledged(every, given)
    assert {(r["order_id"], r["line_id"], r["code"]) for r in marked.where("acknowledged").collect()} == {(2, 1, "offered_gt_available")}
    assert {tuple(r) for r in findings.finding_totals(marked).collect()} == {(1, 1, 0, 3), (2, 1, 1, 2)}


def test_claims_by_rank(spark):
    graded = spark.createDataFrame([(1, "A", "BASE_CLAIM"), (2, "A", "CURRENT_IS_OEM"), (3, "B", "BASE_CLAIM"), (4, "C", "BASE_CLAIM"), (5, "A", "NONE"), (6, "D", "CURRENT_IS_OEM"), (7, "E", "LOCAL_XREF")], "part_id long, key string, tier string")
    claims = spark.createDataFrame([("A", 1), ("A", 2), ("A", 5), ("A", 5), ("B", 3), ("C", 4), *[("E", k) for k in range(100, 130)]], "key string, part_id long")
    uses = spark.createDataFrame([(3, "partcode"), (3, "retired_sku"), (2, "retired_sku_merged_into_this"), (6, "retired_sku_merged_into_this"), (6, "active_sku"), (4, "retired_sku_merged_into_this"), (5, "active_sku")], "part_id long, kind string")
    got = {r["part_id"]: (r["conflict"], r["n_shared"], r["shared_with"]) for r in findings.claim_conflicts(graded, claims, uses).collect()}
    assert got == {
        1: ("shared_base_family", 2, [2, 5]), 3: ("base_is_retired_part_sku", 0, []), 4: ("base_is_retired_sku_already_merged_into_this_part", 0, []), 6: ("base_is_existing_active_part", 0, []),
        7: ("shared_base_family", 30, list(range(100, 110))),
    }


def test_claims_on_a_common_key_are_counted(spark):
    graded = spark.range(1000).selectExpr("id AS part_id", "'K' AS key", "'BASE_CLAIM' AS tier")
    found = findings.claim_conflicts(graded, graded.select("key", "part_id").where("part_id <> 3"), spark.createDataFrame([], "part_id long, kind string"))
    got = {r["part_id"]: (r["n_shared"], r["shared_with"]) for r in found.collect()}
    assert len(got) == 1000 and got[0] == (998, [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]) and got[3] == (999, [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]) and got[999] == (998, [0, 1, 2, 4, 5, 6, 7, 8, 9, 10])
    assert all("NOT (part_id" not in x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_repeats_with_other_contents_are_rejected(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    folder, state = str(tmp_path / "in"), f"file:{tmp_path}/state"
    batches = [[(1, at(0), 1, "a", 1.0, "{}"), (1, at(0), 1, "a", 1.0, "{}"), (2, at(1), 1, "a", 1.0, "{}"), (2, at(2), 1, "b", 1.0, "{}")], [(1, at(0), 1, "a", 1.0, "{}"), (2, at(2), 1, "b", 1.0, "{}"), (3, at(3), 1, "c", 1.0, "{}")], [(3, at(900), 1, "c", 2.0, "{}"), (1, at(0), 1, "a", 1.0, None)]]
    for rows in batches:
        spark.createDataFrame(rows, events.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        taken, rejected = events.take_events(events.read_events(spark, folder), state)
    assert sorted((r["event_id"], r["event_type"]) for r in taken.collect()) == [(1, "a"), (2, "a"), (3, "c")]
    assert sorted((r["event_id"], r["event_type"], r["value"], r["props"]) for r in rejected.collect()) == [(1, "a", 1.0, None), (2, "b", 1.0, "{}"), (2, "b", 1.0, "{}"), (3, "c", 2.0, "{}")]


def test_events_of_one_moment_come_by_their_own_number(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    folder, state = str(tmp_path / "in"), f"file:{tmp_path}/state"
    rows = [(k // 2, at, k // 4, "ab"[k % 2] if k < 20 else "c", 1.0, "{}") for k in range(40)]
    spark.createDataFrame(rows, events.SCHEMA).withColumn("n", F.monotonically_increasing_id()).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(f"{events.SCHEMA}, n long").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    number = F.col("event_id") * 2 + F.when(F.col("event_type") == "b", 1).otherwise(0)
    taken, rejected = events.take_events(stream.withColumn("n", F.when(F.col("event_type") == "c", F.col("n")).otherwise(number)), state, own="n")
    # Of two that differ the one of the smaller number is first; of two that are the same but for the number the other is rejected, too.
    assert sorted((r["event_id"], r["event_type"]) for r in taken.collect()) == [(k, "a" if k < 10 else "c") for k in range(20)]
    assert sorted((r["event_id"], r["event_type"]) for r in rejected.collect()) == [(k, "b" if k < 10 else "c") for k in range(20)]


def test_qualifiers_by_synonym_and_group(spark):
    texts = ["Filtro de gasolina Kia", "FILTRO COMBUSTIBLE", "Correa P/S 4pk", "CORREA TIEMPO", "Filtro raro", "Correa motor"]
    column = head_and_qualifier(F.col("t"), {}, {"FILTRO": ("GAS", "AIRE"), "CORREA": ("TIEMPO", "MOTOR", "P/S")}, synonyms={"GASOLINA": "GAS", "COMBUSTIBLE": "GAS"}, groups={("CORREA", "MOTOR"): "ACCESORIO", ("CORREA", "P/S"): "ACCESORIO"})
    got = [tuple(r["x"]) for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, t string").select("k", column.alias("x")).orderBy("k").collect()]
    assert got == [("FILTRO", "GAS"), ("FILTRO", "GAS"), ("CORREA", "ACCESORIO"), ("CORREA", "TIEMPO"), ("FILTRO", ""), ("CORREA", "ACCESORIO")]
