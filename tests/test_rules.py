"""Pricing precedence, matching tiers, candidates, components and checks on hand-made tables."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from partmill.operators import checks, graph, matching, pricing

DAY = datetime.date(2024, 5, 1)
RULE = "rule_id string, scope string, profile_id string, target string, target_value string, kind string, value decimal(12,2), currency string, min_quantity long, valid_from date, valid_until date, active boolean, created_at timestamp_ntz"
LINE = "line_id long, profile_id string, item_id string, brand string, discount_group string, day date, quantity long, currency string, base_price decimal(12,2), base_currency string, floor_price decimal(12,2)"


def rule(rid, value, scope="all", target="all", aimed="", kind="discount", least=1, currency="USD", profile=None, since=None, until=None, active=True, made=1):
    return (rid, scope, profile, target, aimed, kind, Decimal(value), currency, least, since, until, active, datetime.datetime(2024, 1, made))


def priced(spark, rules, parity=False, **line):
    given = {"line_id": 1, "profile_id": "P", "item_id": "7", "brand": "KIA", "discount_group": "G", "day": DAY, "quantity": 10, "currency": "USD", "base_price": Decimal(100), "base_currency": "USD", "floor_price": None} | line
    row = pricing.price_lines(spark.createDataFrame([tuple(given.values())], LINE), spark.createDataFrame(rules, RULE), parity).first()
    return row["rule_id"], row["unit_price"] and str(row["unit_price"]), row["status"], row["codes"]


def test_the_most_specific_rule_wins(spark):
    scope = [rule("a", "50", target="item", aimed="7"), rule("b", "5", scope="client", profile="P")]
    assert priced(spark, scope)[:2] == ("b", "95.00")
    target = [rule("brand", "5", target="brand", aimed="KIA"), rule("line", "6", target="line", aimed="G"), rule("all", "90"), rule("other", "99", target="item", aimed="8")]
    assert priced(spark, target)[:2] == ("line", "94.00")
    least = [rule("a", "5"), rule("b", "3", least=10), rule("c", "50", least=11)]
    assert priced(spark, least)[:2] == ("b", "97.00")
    out = [rule("a", "5", active=False), rule("b", "6", since=datetime.date(2024, 5, 2)), rule("c", "7", until=datetime.date(2024, 4, 30)), rule("d", "8", scope="client", profile="Q"), rule("e", "1", since=DAY, until=DAY)]
    assert priced(spark, out)[:2] == ("e", "99.00")


def test_ties_and_prices_that_cannot_be_used(spark):
    assert priced(spark, [rule("a", "20"), rule("b", "10")]) == ("b", "90.00", "priced", ["rule_conflict"])
    assert priced(spark, [rule("b", "10", made=2), rule("c", "10", made=1)]) == ("c", "90.00", "priced", [])
    assert priced(spark, [rule("b", "10"), rule("a", "10")])[0] == "a"
    euro = [rule("net", "40", kind="net_price", currency="EUR", target="item", aimed="7"), rule("x", "10")]
    assert priced(spark, euro)[:2] == ("x", "90.00")
    assert priced(spark, euro, parity=True) == ("net", "40.00", "priced", ["currency_parity"])
    assert priced(spark, [rule("x", "10")], base_currency="EUR") == (None, None, "currency_mismatch", ["currency_mismatch"])
    assert priced(spark, [rule("x", "10")], base_price=None) == (None, None, "missing", ["no_list_price"])
    assert priced(spark, [rule("n", "12", kind="net_price")], base_price=None)[:3] == ("n", "12.00", "priced")
    assert priced(spark, [], floor_price=Decimal("100.01")) == (None, "100.00", "priced", ["below_floor"])
    assert priced(spark, [rule("h", "33.335")], base_price=Decimal("1.50"))[1] == "1.00"
    general = pricing.general_discounts(spark.createDataFrame([("P", Decimal(5)), ("Q", Decimal(0))], "profile_id string, discount_percent decimal(12,2)"))
    assert [tuple(r)[:3] for r in general.collect()] == [("client-discount", "client", "P")]


ITEM = "item_id long, supplier_id long, clave string, brand string, root string"
REF = "ref_id long, line_id long, clave string, brand string, root string, supplier_id long, state string"


def resolved(spark, refs, brand="KAIYI", root="CHERY", supplier=1):
    rows = matching.resolve_items(spark.createDataFrame([(1, supplier, "K", brand, root), (2, supplier, "", "", ""), (3, 1, None, "", "")], ITEM), spark.createDataFrame(refs, REF)).collect()
    assert len(rows) <= 1
    return tuple(rows[0])[1:6] if rows else None


def test_matching_tiers(spark):
    public = lambda rid, line, brand, state="verificado", root=None: (rid, line, "K", brand, root or brand, None, state)
    own = lambda rid, line, brand, supplier=1, state="verificado": (rid, line, "K", brand, brand, supplier, state)
    assert resolved(spark, [public(1, 10, "KAIYI"), own(2, 20, "KAIYI")]) == ("interna", "attach", 20, 2, None)
    assert resolved(spark, [own(2, 20, ""), own(3, 30, "OTHER")]) == ("interna", "attach", 20, 2, None)
    assert resolved(spark, [own(3, 30, "OTHER"), own(4, 40, "KAIYI", state="disputa"), own(5, 50, "KAIYI", supplier=2)]) is None
    assert resolved(spark, [own(3, 30, "OTHER")], brand="", root="") == ("interna", "attach", 30, 3, None)
    assert resolved(spark, [public(1, 10, "KAIYI"), public(2, 20, "")]) == ("exacta", "attach", 10, 1, None)
    assert resolved(spark, [public(2, 20, ""), public(3, 30, "CHERY")]) == ("sin_marca", "attach", 20, 2, None)
    assert resolved(spark, [public(3, 30, "CHERY"), public(4, 40, "KIA")]) == ("familia", "attach", 30, 3, None)
    assert resolved(spark, [public(4, 40, "KIA")]) is None
    assert resolved(spark, [public(1, 10, "KAIYI"), public(2, 20, "KAIYI")]) == ("exacta", "case", None, None, "lineas")
    assert resolved(spark, [public(1, 10, "KAIYI"), public(2, 20, "KAIYI", "disputa")]) == ("exacta", "case", None, None, "disputa")
    assert resolved(spark, [public(1, 10, "KAIYI"), public(2, 10, "KAIYI", "disputa")]) == ("exacta", "attach", 10, 1, None)
    assert resolved(spark, [public(2, 10, "KAIYI", "otro")]) == ("exacta", "case", None, None, "lineas")
    assert resolved(spark, [public(1, 10, "KIA"), public(2, 10, "")], brand="", root="") == ("sin_marca", "attach", 10, 2, None)
    assert resolved(spark, [public(1, 10, "KIA")], brand="", root="") == ("marca_de_la_linea", "attach", 10, 1, None)


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k, [f"{rng.choice('AB')}{rng.randrange(6)}000000{rng.randrange(3)}", "HOT12345"][: rng.randrange(3)]) for k in range(60)]
    got = {}
    for r in matching.candidate_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), most=4).collect():
        got.setdefault(r["id"], []).append(r["candidate"])
    keys = {k: {*ts, *("^" + t[:8] for t in ts if len(t) >= 8)} for k, ts in rows}
    want = {k: sorted(j for j in keys if j != k and keys[j] & keys[k])[:4] for k in keys}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(5, 5), (None, 3), (4, None), (200, 201), (200, 201), (201, 200), (999, 999)] + [(300, 301 + k) for k in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_checks(spark):
    holds = spark.createDataFrame([(1, 5, "open"), (2, 5, "released"), (3, 5, "used"), (4, 5, "open"), (5, 5, "open"), (6, 5, "released"), (7, 5, "open")], "hold_id long, units long, status string")
    entries = spark.createDataFrame([(1, "reserve", 5), (2, "reserve", 5), (2, "release", 5), (3, "reserve", 5), (3, "use", 4), (5, "reserve", 5), (5, "reserve", 5), (6, "reserve", 5), (7, "reserve", 5), (7, "gift", 0)], "hold_id long, kind string, units long")
    assert sorted((r["hold_id"], r["fault"]) for r in checks.reservation_faults(holds, entries).collect()) == [(3, "left"), (4, "left"), (4, "no_reserve"), (5, "left"), (5, "many_reserves"), (6, "closing"), (6, "left"), (7, "foreign_kind")]
    counted = spark.createDataFrame([(1, 5), (2, 3), (4, 0)], "id long, n long")
    rows = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 4)], "id long, units long")
    assert sorted(tuple(r) for r in checks.differing_sums(counted, rows, "id", "n", "units").collect()) == [(2, 3, 1), (3, 0, 4)]
    load = spark.createDataFrame([("a", "X"), ("b", "X"), ("a", "Y"), ("a", "Z"), ("a", "Z")], "owner string, code string")
    catalog = spark.createDataFrame([("c", "Y"), ("a", "Z"), ("c", "W")], "owner string, code string")
    assert sorted(tuple(r) for r in checks.foreign_codes(load, catalog).collect()) == [("X", "a", 1), ("X", "b", 1), ("Y", "a", 1)]
    items = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 9)), (2, datetime.datetime(2024, 1, 1, 9)), (3, datetime.datetime(2024, 1, 1, 9, 50))], "id long, at timestamp_ntz")
    cases = spark.createDataFrame([(1, True), (2, False)], "id long, open boolean")
    assert [r["id"] for r in checks.unattended(items, cases, "id", "at", F.lit(datetime.datetime(2024, 1, 1, 10)).cast("timestamp_ntz")).collect()] == [2]
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, p string"), spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id long, q string")
    assert [r["id"] for r in checks.differing(a, b, "id", F.col("p"), F.col("q")).collect()] == [3]


def test_rank_inside_a_tier(spark):
    refs = lambda *rows: spark.createDataFrame([(r, line, "K", "KAIYI", "CHERY", own, state, main) for r, line, own, state, main in rows], REF + ", is_main boolean")
    items = spark.createDataFrame([(1, 1, "K", "KAIYI", "CHERY")], ITEM)
    pick = lambda *rows: matching.resolve_items(items, refs(*rows)).first()["ref_id"]
    assert pick((1, 10, None, "declarado", False), (2, 10, None, "verificado", False)) == 2
    assert pick((1, 10, None, "verificado", False), (2, 10, None, "declarado", True)) == 2
    assert pick((1, 10, None, "verificado", False), (2, 10, None, "verificado", None)) == 1
    assert pick((1, 10, 1, "declarado", False), (2, 20, 1, "verificado", False), (3, 30, None, "verificado", True)) == 2


def test_orphans(spark):
    rows, known = spark.createDataFrame([(1,), (2,), (None,)], "key long"), spark.createDataFrame([(1,), (3,), (None,)], "key long")
    assert sorted(str(r["key"]) for r in checks.orphans(rows, known, "key").collect()) == ["2", "None"]


def test_volume_breaks_are_the_prices_at_each_threshold(spark):
    rules = [rule("a", "5"), rule("b", "10", least=5), rule("c", "10", least=8, made=2), rule("d", "20", least=10, target="brand", aimed="KIA"), rule("e", "30", least=20), rule("n", "70", least=12, kind="net_price", currency="EUR", target="item", aimed="7"), rule("x", "99", least=6, active=False)]
    given = {"line_id": 1, "profile_id": "P", "item_id": "7", "brand": "KIA", "discount_group": "G", "day": DAY, "quantity": 1, "currency": "USD", "base_price": Decimal(100), "base_currency": "USD", "floor_price": None}

    def breaks(rules, parity=False, most=9, **line):
        return [tuple(r)[2:] for r in pricing.volume_breaks(spark.createDataFrame([tuple((given | line).values())], LINE), spark.createDataFrame(rules, RULE), parity, most).orderBy("step").collect()]

    for parity in (False, True):
        for quantity in (1, 5, 9, 12):
            last, want = priced(spark, rules, parity, quantity=quantity)[1], []
            for q in sorted({r[8] for r in rules if r[8] > quantity and r[11]}):
                rid, price, *_ = priced(spark, rules, parity, quantity=q)
                if rid and price and price != last:
                    want.append((q, Decimal(price), rid))
                    last = price
            assert breaks(rules, parity, quantity=quantity) == want
    assert breaks(rules, most=2) == [(5, Decimal("90.00"), "b"), (10, Decimal("80.00"), "d")]
    assert breaks(rules, base_price=None) == [] and breaks([rule("n", "9", least=3, kind="net_price")], base_price=None) == [(3, Decimal("9.00"), "n")]
    assert breaks([rule("a", "5")]) == []


def test_profiles(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), (None, False)], "state string, active boolean")
    keys = [F.col("state"), F.col("active")]
    assert sorted(map(tuple, checks.profile(rows, "p", keys, groups=2).collect())) == [("p", "-|false", 1, True), ("p", "a|true", 2, True)]
    assert {r["as_expected"] for r in checks.profile(rows, "p", keys, groups=3).collect()} == {False} and {r["as_expected"] for r in checks.profile(rows, "p", keys).collect()} == {None}
    assert checks.profile(rows.limit(0), "p", keys, groups=0).collect() == []


def product_free(df, most):
    """Whether no join of ``df``'s plan gave more than ``most`` rows when it was run."""
    df.collect()
    rows, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        nodes += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in name:
            rows.append(node.metrics().apply("numOutputRows").value())
    assert rows
    return max(rows) <= most


def test_items_meet_counts_of_a_tier_not_lines(spark):
    items = spark.range(300).selectExpr("id AS item", "'n' AS name", "CASE WHEN id < 3 THEN concat('b', id) WHEN id = 3 THEN NULL ELSE 'z' END AS brand", "id % 150 AS size")
    lines = spark.range(1000, 1300).selectExpr("id AS line", "'n' AS name", "concat('b', id % 3) AS brand", "id % 100 AS size")
    got = matching.first_tier(items, lines, "item", "line", (("name", "brand"), ("name", "size"), ("name",)))
    want = {}
    for i in items.collect():
        for tier, fits in enumerate([lambda r, i=i: r["brand"] == i["brand"], lambda r, i=i: r["size"] == i["size"], lambda r: True], 1):
            met = [r["line"] for r in lines.collect() if fits(r)] if i["item"] < 8 or i["item"] > 290 else None
            if met:
                want[i["item"]] = (tier, len(met), min(met))
                break
    assert {r["item"]: (r["tier"], r["lines"], r["line"]) for r in got.where("item < 8 or item > 290").collect()} == want
    assert product_free(got, 300)


def test_items_of_a_common_key_do_not_meet_its_references(spark):
    items = spark.range(400).selectExpr("id AS item_id", "id % 5 AS supplier_id", "'K' AS clave", "CASE WHEN id % 3 = 0 THEN '' ELSE concat('B', id % 7) END AS brand", "CASE WHEN id % 3 = 0 THEN '' ELSE 'F' END AS root")
    refs = spark.range(400).selectExpr("id AS ref_id", "id % 9 AS line_id", "'K' AS clave", "concat('B', id % 11) AS brand", "'F' AS root", "CASE WHEN id % 2 = 0 THEN id % 10 END AS supplier_id", "'verificado' AS state")
    got = matching.resolve_items(items, refs)
    assert got.count() == 400 and product_free(got, 400 * 6)


def test_priced_lines_stay_where_they_are(spark):
    """No line is dealt out or sent to the driver for its rules: only rules are, once."""
    lines = spark.createDataFrame([(k, "P", "7", "KIA", "G", "2024-05-01", k, "USD", "100", "USD", "1") for k in range(50)], "line_id long, profile_id string, item_id string, brand string, discount_group string, day string, quantity long, currency string, base_price string, base_currency string, floor_price string")
    lines = lines.withColumns({"day": F.col("day").cast("date"), "base_price": F.col("base_price").cast("decimal(12,2)"), "floor_price": F.col("floor_price").cast("decimal(12,2)")})
    rules = spark.createDataFrame([rule("x", "10"), rule("y", "20", least=9)], RULE)
    for found in (pricing.price_lines(lines, rules), pricing.volume_breaks(lines, rules)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(line_id" not in plan and "SortMergeJoin" not in plan and "BuildLeft" not in plan
    assert {r["rule_id"]: r["n"] for r in pricing.price_lines(lines, rules).groupBy("rule_id").agg(F.count("*").alias("n")).collect()} == {None: 1, "x": 8, "y": 41}


def test_pairs_in_group_are_made_on_every_core(spark):
    from partmill.plans.matching import pairs_in_group

    assert pairs_in_group(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
