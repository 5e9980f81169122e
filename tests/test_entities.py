"""Pointers, shared keys, families, rules on field values, suffix chains, nested JSON and recovered dates, on hand-made tables."""

from __future__ import annotations

import datetime
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from partmill.functions import suffixes
from partmill.operators import entities, snapshots
from partmill.sources import recovery


def test_pointers_are_followed_ten_steps(spark):
    rows = [(k, k - 1 if k else None) for k in range(12)] + [(100, 101), (101, 102), (102, 100), (200, 999), (300, None), (400, 400)]
    got = {r["id"]: r["end"] for r in entities.follow_pointers(spark.createDataFrame(rows, "id long, into long"), "id", "into").collect()}
    parent = dict(rows)

    def chase(x):
        for _ in range(10):
            if parent.get(x) is None:
                break
            x = parent[x]
        return x

    assert got == {k: chase(k) for k, _ in rows}
    assert got[10] == 0 and got[11] == 1 and got[200] == 999 and got[100] == 101
    assert entities.follow_pointers(spark.createDataFrame([], "id long, into long"), "id", "into").collect() == []
    long = spark.createDataFrame([(k, k - 1 if k else None) for k in range(70)], "id long, into long")
    assert {r["end"] for r in entities.follow_pointers(long, "id", "into", steps=100).collect()} == {0}


def test_key_overlap_equals_brute_force(spark):
    rng = random.Random(6)
    sets = lambda n: {k: {"HOT", *(f"k{rng.randrange(40)}" for _ in range(rng.randrange(6)))} for k in range(n)}
    left, right = sets(60), sets(70)
    rows = lambda d, name: spark.createDataFrame([(k, x) for k, xs in d.items() for x in xs], f"{name} long, key string")
    for least in (1, 2, 3):
        got = {(r["left_id"], r["right_id"]): r["overlap"] for r in entities.key_overlap(rows(left, "left_id"), rows(right, "right_id"), least).collect()}
        assert got == {(a, b): len(x & y) for a, x in left.items() for b, y in right.items() if len(x & y) >= least}


def plain_links(items, item_keys, parts, part_keys):
    key = lambda c: "".join(x for x in c.upper() if x.isalnum() and x.isascii())
    oem = {i: {key(c) for j, k, c in item_keys if j == i and k == "oem" and len(key(c)) >= 5} for i in items}
    brand = {i: {key(c) for j, k, c in item_keys if j == i and k == "brand" and len(key(c)) >= 5 and any(x.isdigit() for x in c)} for i in items}
    filed = {p: {k: {key(c) for q, kk, c in part_keys if q == p and kk == k} for k in ("oem", "raw")} for p in parts}
    printed = Counter(k for ks in oem.values() for k in ks)
    links = {}
    for i, (kind, makes) in items.items():
        for p, (retired, named, own) in parts.items():
            by_oem, by_brand = oem[i] & (filed[p]["oem"] | filed[p]["raw"]), brand[i] & filed[p]["raw"]
            if retired or not by_oem | by_brand or named not in (None, kind):
                continue
            if makes and own and not set(makes) & set(own) or not (makes and own) and not by_oem:
                continue
            links[p, i] = (by_oem, by_brand)
    for p in parts:
        mine = [i for q, i in links if q == p]
        if len(mine) > 1 and (len({items[i][0] for i in mine}) > 1 or not set.intersection(*(links[p, i][0] for i in mine))):
            for i in mine:
                del links[p, i]
    counts = Counter(i for _, i in links)
    return {(p, i, "oem" if o else "brand", len(o | b), bool(b or any(printed[k] == 1 for k in o)), counts[i] > 1) for (p, i), (o, b) in links.items()}


def test_links_by_keys_equal_brute_force(spark):
    rng = random.Random(9)
    code = lambda: rng.choice(["AB-1234", "ab 1235", "12345-67890", "98765", "ZZZZZ", "1-2", "HOT-00000", "Q-77777", "Q77778"])
    makes = lambda: rng.sample(["TOY", "NIS", "KIA"], rng.randrange(3))
    for _ in range(3):
        items = {k: (rng.choice(["filter", "pump"]), makes()) for k in range(25)}
        parts = {k: (rng.random() < 0.1, rng.choice(["filter", "pump", None]), makes()) for k in range(30)}
        item_keys = [(rng.randrange(25), rng.choice(["oem", "brand"]), code()) for _ in range(50)]
        part_keys = [(rng.randrange(30), rng.choice(["oem", "raw"]), code()) for _ in range(60)]
        got = entities.link_by_keys(
            spark.createDataFrame([(k, *v) for k, v in items.items()], "item_id long, product_type string, makes array<string>"), spark.createDataFrame(item_keys, "item_id long, kind string, code string"),
            spark.createDataFrame([(k, *v) for k, v in parts.items()], "part_id long, retired boolean, product_type string, makes array<string>"), spark.createDataFrame(part_keys, "part_id long, kind string, code string"),
        )
        assert {tuple(r) for r in got.collect()} == plain_links(items, item_keys, parts, part_keys)


def family(spark, rows, blocked=()):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "sku string, description string, is_oem boolean, position long")
    found = entities.families(df, spark.createDataFrame([(b,) for b in blocked], "base string") if blocked else None).collect()
    return sorted(tuple(r) for r in found)


def test_families(spark):
    pair = [("12345678-ABC", "Filtro Kia 98-05", False), ("12345678-XYZ", "FILTRO  KIA 03-08", False)]
    assert family(spark, pair) == [("12345678", "12345678-ABC", True, "FILTRO KIA 98-05", True), ("12345678", "12345678-XYZ", True, "FILTRO KIA 98-05", True)]
    assert family(spark, pair, blocked=["12345678"]) == []
    apart = [*pair, ("12345678-QQQ", "FILTRO KIA 06-09", False)]
    assert family(spark, apart) == []
    assert family(spark, [*apart, ("12345678", "Filtro Kia 07-07", False)]) == [("12345678", "12345678-QQQ", False, "FILTRO KIA 07-07", True), ("12345678", "12345678-XYZ", False, "FILTRO KIA 07-07", True)]
    assert family(spark, pair[:1]) == [] and family(spark, [(s, "", False) for s, _, _ in pair]) == []
    assert [r[3:] for r in family(spark, [("12345678-A", "BUJE", False), ("12345678-B", "BUJE", False)])] == [("BUJE", False)] * 2
    assert family(spark, [("12345678-A", "BUJE", True), ("12345678-B", "BUJE", False), ("12345678-LH", "BUJE", False)]) == []
    # The mode, and of a tie the first.
    three = [("12345678-A", "X 98-05", False), ("12345678-B", "X 99-05", False), ("12345678-C", "X 99-05", False)]
    assert {r[3] for r in family(spark, three)} == {"X 99-05"} and {r[3] for r in family(spark, three[:2])} == {"X 98-05"}


def test_rules_on_field_values(spark):
    fields = spark.createDataFrame([("len", "number", None), ("teeth", "integer", None), ("note", "text", None), ("abs", "boolean", None), ("side", "choice", ["LEFT", "RIGHT"])], "key string, kind string, options array<string>")
    parts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "part_id long, part_type string")
    values = spark.createDataFrame([(1, "len", 10.5, None, None), (1, "note", None, "Con Cable", None), (1, "abs", None, None, True), (1, "side", None, "left", None), (2, "len", 12.0, None, None), (2, "abs", None, None, False), (3, "len", 10.5, None, None), (2, "teeth", 20.0, None, None)], "part_id long, key string, number double, text string, flag boolean")

    def met(*rules):
        got = entities.parts_meeting(spark.createDataFrame([(1, "a")], "filter_id long, part_type string"), spark.createDataFrame([(1, *r, *[None] * (4 - len(r))) for r in rules], "filter_id long, key string, operator string, value string, value_to string"), fields, parts, values)
        return sorted(r["part_id"] for r in got.collect())

    assert met() == [1, 2, 4]
    assert met(("len", "eq", "10.500000")) == [1] and met(("len", "gt", "10.5")) == [2] and met(("len", "gte", "10.5")) == [1, 2] and met(("len", "lt", "12")) == [1] and met(("len", "lte", "12")) == [1, 2]
    assert met(("len", "between", "12", "12")) == [2] and met(("len", "between", "13", "14")) == [] and met(("teeth", "between", "1", "20")) == [2]
    assert met(("note", "contains", "cable ")) == [1] and met(("note", "eq", "con cable")) == [1] and met(("note", "eq", "cable")) == []
    assert met(("abs", "eq", "true")) == [1] and met(("abs", "eq", "false")) == [2] and met(("side", "eq", "Left")) == [1]
    assert met(("len", "gte", "1"), ("abs", "eq", "false"), ("teeth", "eq", "20")) == [2] and met(("len", "gte", "1"), ("note", "eq", "nothing")) == []
    bad = [("len", "contains", "1", None), ("teeth", "eq", "x", None), ("note", "gt", "a", None), ("abs", "eq", "yes", None), ("side", "eq", "UP", None), ("gone", "eq", "1", None)]
    errors = entities.rule_errors(spark.createDataFrame([(k, *r) for k, r in enumerate([*bad, ("len", "between", "2", "1"), ("len", "between", "2", None)])], "filter_id long, key string, operator string, value string, value_to string"), fields)
    assert [r["error"] for r in errors.orderBy("filter_id").collect()] == ["operator", "number", "operator", "boolean", "option", "unknown_field", "order", "number"]
    twice = entities.rule_errors(spark.createDataFrame([(1, "len", "gt", "1", None), (1, "len", "lt", "9", None)], "filter_id long, key string, operator string, value string, value_to string"), fields)
    assert [tuple(r) for r in twice.collect()] == [(1, "len", "repeated")]
    assert met(*bad[:1]) == []


TABLE = suffixes.Suffixes(
    {"G": ("TAG", "genuine"), "TAIH": ("TAG", "brand"), "KSM": ("TAG", "brand"), "NP": ("TAG", "commercial"), "KYB": ("TAG", "brand"), "NAK": ("TAG", "brand"), "STD": ("VARIANT", "size"), "KIT": ("VARIANT", "kit"), "NEW ERA": ("TAG", "brand"), "SPK/WAP": ("TAG", "brand"), "MANDO": ("TAG", "brand"), "CODE:-AA99": ("UNKNOWN", "code"), "HD": ("VARIANT", "spec")},
    {"HD": ((("TACO",), "TAG", "brand"),), "DAI": ((("CASQ", "BUJE BIELA"), "TAG", "brand"),)},
)


def test_suffix_chains(spark):
    def run(column, *texts):
        df = spark.createDataFrame([(k, *(t if isinstance(t, tuple) else (t,))) for k, t in enumerate(texts)], "k long, a string" + (", b string, c string" if isinstance(texts[0], tuple) else ""))
        return [r["x"] for r in df.select("k", column.alias("x")).orderBy("k").collect()]

    pairs = lambda x: [(r["sep"], r["tok"]) for r in x]
    got = run(suffixes.tokens(F.col("a"), TABLE), "-NEW_ERA", "-.25", "-SPK/WAP-NP", "-STD-TAIH", "-KSM-NP (1)", "", "-NEW_ERA_KYB", "-A/STD", "/170-G", "-1.5X")
    assert list(map(pairs, got)) == [
        [("-", "NEW ERA")], [("-", "0.25")], [("-", "SPK/WAP"), ("-", "NP")], [("-", "STD"), ("-", "TAIH")], [("-", "KSM"), ("-", "NP"), (" (", "1")], [], [("-", "NEW ERA"), ("_", "KYB")], [("-", "A"), ("/", "STD")],
        [("/", "170"), ("-", "G")], [("-", "1.5X")],
    ]
    none = run(suffixes.tokens(F.col("a"), suffixes.Suffixes({"G": ("TAG", "genuine")})), "-NEW_ERA")
    assert list(map(pairs, none)) == [[("-", "NEW"), ("_", "ERA")]]
    of = lambda x: [(r["tok"], r["cls"], r["kind"], r["alt_code"]) for r in x]
    chain = suffixes.chain_of(F.col("a"), TABLE, base=F.col("b"), head=F.struct(F.col("c").alias("head"), F.lit("BIELA").alias("qualifier")))
    got = run(chain, ("/170-G", "27060-16160", ""), ("-KYB/NAK", "X1", ""), ("-KYB/STD", "X1", ""), ("-KYB/QQ", "X1", ""), ("-PA16", "X1", ""), ("-12AB", "X1", ""), ("-HD", "X1", "TACO"), ("-HD", "X1", "AMORT"), ("-DAI", "X1", "BUJE"), ("-DAI", "X1", "BASE"), ("/1234567", "1-2", ""))
    assert [of(x) for x in got] == [
        [("170", "VARIANT", "alt_oem_tail", "27060-16170"), ("G", "TAG", "genuine", None)], [("KYB/NAK", "TAG", "brand", None)], [("KYB", "TAG", "brand", None), ("STD", "VARIANT", "size", None)], [("KYB/QQ", "UNKNOWN", "compound", None)],
        [("PA16", "UNKNOWN", "code", None)], [("12AB", "UNKNOWN", "code_tail", None)], [("HD", "TAG", "brand", None)], [("HD", "VARIANT", "spec", None)], [("DAI", "TAG", "brand", None)], [("DAI", "UNKNOWN", "unseen", None)],
        [("1234567", "UNKNOWN", "code_tail", None)],
    ]
    codes = ["54650-D4000-MANDO", "58411-1R000-ANULADO", "58411-1R000 ANULADA1", "58411-1R000_1234_DELETED", "58411-1R000-AULADO-", "ABC-KSM-NP", "12-3.4-KIT", "", "5–6-zzz", "1-KIT-ANULADO"]
    got = run(suffixes.stripped(F.col("a"), TABLE), *codes)
    assert [(r["base"], r["chain_class"]) for r in got] == [("54650-D4000", "tag"), *[("58411-1R000", "lifecycle")] * 4, ("ABC", "tag"), ("12-3.4", "variant"), ("", "bare"), ("5-6", "unknown"), ("1", "lifecycle")]


def test_stripped_folds_a_code_once(spark):
    """A Column named twice is written out twice: a code was folded 517 times in one row."""
    found = spark.createDataFrame([("1-A2_NEW_ERA",)], "code string").select(suffixes.stripped(F.col("code"), TABLE).alias("s")).select("s.base", "s.chain", "s.lifecycle", "s.chain_class")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def flatten(value, path="", out=None):
    out = {} if out is None else out
    if isinstance(value, dict) and value:
        for k, v in value.items():
            flatten(v, f"{path}/{k}" if path else k, out)
    elif isinstance(value, list) and value:
        ids = [str(x["id"]) for x in value if isinstance(x, dict) and "id" in x]
        if len(ids) == len(value) == len(set(ids)):
            out[f"{path}[order]"] = ids
            for i, x in zip(ids, value, strict=True):
                flatten({k: v for k, v in x.items() if k != "id"}, f"{path}[id={i}]", out)
        else:
            for k, x in enumerate(value):
                flatten(x, f"{path}[{k}]", out)
    else:
        out[path] = value
    return out


def test_nested_json_is_compared_by_path(spark):
    old = {"a": 1, "b": {"c": [1, 2, {"d": None}], "e": {}, "id": 9}, "rows": [{"id": 7, "n": "x"}, {"id": 8, "n": [1]}, {"id": 3}], "same": [{"id": 1}, {"id": 1}], "t": "ü \" /", "f": True, "z": []}
    new = {"a": 2, "b": {"c": [1, {"d": 5}], "e": [], "id": 9}, "rows": [{"id": 8, "n": [1]}, {"id": 7, "n": "y", "m": {"k": 1}}, {"id": 3}], "same": [{"id": 1}, {"id": 1}], "t": "ü \" /", "f": None, "z": []}
    texts = [(1, json.dumps(old)), (2, "[1, [2]]"), (3, None), (4, "{no json"), (5, "5")]
    got = snapshots.leaves(spark.createDataFrame(texts, "k long, body string"), "k", "body").collect()
    assert {r["path"]: json.loads(r["leaf"]) for r in got if r["k"] == 1} == flatten(old)
    assert {(r["k"], r["path"], r["leaf"]) for r in got if r["k"] > 1} == {(2, "[0]", "1"), (2, "[1][0]", "2"), (5, "", "5")}
    sides = [snapshots.leaves(spark.createDataFrame([(1, json.dumps(x))], "k long, body string"), "k", "body") for x in (old, new)]
    a, b = flatten(old), flatten(new)
    missing = object()
    want = {p for p in a.keys() | b.keys() if a.get(p, missing) != b.get(p, missing) or type(a.get(p)) is not type(b.get(p))}
    found = snapshots.compare(*sides, "k", allow=["b/*", "rows[[]id=7]/?"], ignore=[r"rows\[order"]).collect()
    assert {r["path"] for r in found} == want
    kinds = {r["path"]: r["kind"] for r in found}
    assert kinds["rows[order]"] == "ignored" and kinds["a"] == "unexpected" and kinds["b/e"] == "expected" and kinds["rows[id=7]/n"] == "expected" and kinds["rows[id=7]/m/k"] == "unexpected"
    assert {(r["old"], r["new"]) for r in found if r["path"] in ("f", "rows[id=7]/m/k")} == {("true", "null"), (None, "1")}


def test_codes_that_became_dates(spark):
    day = datetime.date
    cells = [
        (1, "code", day(2021, 10, 1), "mmm-yy", "Filtro aceite"), (2, "code", day(2021, 10, 1), "mmm-yy", "Bomba agua"), (3, "code", day(2024, 3, 5), "d-mmm", "X"), (4, "code", day(2150, 10, 1), "m/yyyy", "Pieza 10-2150 nueva"),
        (5, "code", day(2021, 10, 1), "[$-C0A]MMM-YY", "Tapa REF: 10-21 y más"), (6, "sku", day(2021, 10, 1), "mmm-yy", "Filtro x"), (7, "code", day(2003, 2, 1), "dd/mm/yyyy", "SKU 1-2-03 o REF 2-1-03"), (8, "code", None, "mmm-yy", "Y"), (9, "code", day(2021, 10, 1), "mmm-yy", None),
    ]
    intact = [("code", "10-22", "Filtro aire"), ("code", "10-23", "filtro cabina"), ("code", "10-23", "Filtro otra vez"), ("code", "10-1999", "Bomba"), ("code", "11-2022", "Bomba"), ("sku", "10-24", "Filtro"), ("code", "ABC", "Filtro")]
    got = {r["row"]: r for r in recovery.recover_dates(spark.createDataFrame(cells, "row long, field string, day date, mask string, description string"), spark.createDataFrame(intact, "field string, code string, description string")).collect()}
    assert {k: (r["suggested"], r["automatic"], r["reason"]) for k, r in got.items()} == {
        1: ("10-21", True, "pattern"), 2: ("10-21", False, "none"), 3: ("3-5", False, "none"), 4: ("10-2150", True, "description"), 5: ("10-21", True, "description"), 6: ("10-21", False, "none"),
        7: ("2-1-03", False, "none"), 9: ("10-21", False, "none"),
    }
    assert got[1]["candidates"] == ["10-21", "10-2021", "2021-10"] and got[3]["candidates"] == ["3-5", "5-3", "03-05", "05-03"]
    assert got[4]["candidates"] == ["10-2150", "10-50", "2150-10"]
    assert got[7]["candidates"] == ["2-1-03", "2-1-3", "02-01-03", "2-1-2003", "1-2-03", "1-2-3", "01-02-03", "1-2-2003", "2003-02-01"]
