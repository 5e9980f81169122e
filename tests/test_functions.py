"""Text functions on hand-made cases."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from partmill.functions import parts, text


def each(spark, function, values, schema="x string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k long, {schema}")
    names = df.columns[1:]
    return [r["out"] for r in df.select("k", function(*[F.col(c) for c in names]).alias("out")).orderBy("k").collect()]


def test_folding(spark):
    assert each(spark, text.fold, ["Bujía", "piñón", "À Â Ê Ö ü", "Bujía", "ñ", "ç", None]) == ["BUJIA", "PINON", "A A E O U", "BUJIA", "N", "Ç", None]
    assert each(spark, text.wide_fold, ["  Bujía  ǆ\tñandú", "ça và Ǻ ṩ", "é", None]) == ["BUJIA Ǆ NANDU", "CA VA A S", "E", None]
    assert each(spark, text.header, [" Código  del artículo ", None]) == ["CODIGO_DEL_ARTICULO", ""]
    assert each(spark, text.citation_title, ["Catálogo 5 · pág. 12", "X", None]) == ["Catálogo 5", "X", ""]
    assert each(spark, text.snippet, ["a" * 140, "a" * 141]) == ["a" * 140, "a" * 139 + "…"]


def test_search(spark):
    assert each(spark, text.search_words, ["filtro de aceite - para Toyota", "de la", "a b c d e f g h i j", "  ", None]) == [["FILTRO", "ACEITE", "TOYOTA"], ["DE", "LA"], list("ABCDEFGH"), [], None]
    assert each(spark, text.search_key, ["51750-J9000", "MR 968365", "abc", "a1", "filtro", ""]) == ["51750J9000", "MR968365", "", "", "", ""]
    assert each(spark, text.padded, [(["A", "B", "", "A", None],), ([],)], "x array<string>") == [" A B ", ""]
    assert each(spark, text.has_token, [(" A1 B2 ", "A1"), (" A1 B2 ", "B"), ("", "A")], "p string, v string") == [True, False, False]
    assert each(spark, text.brand_key, [" century  / hkt ", "", None]) == ["CENTURY / HKT", "", ""]


@pytest.mark.parametrize(
    ("given", "value", "error"),
    [
        ("1234", "1234.00", None), ("12.50", "12.50", None), ("12,5", "12.50", None), ("1,234.50", "1234.50", None), ("1.234,50", "1234.50", None), ("1,234,567", "1234567.00", None), ("12,500", None, "ambiguous"),
        ("1.2345", None, "decimals"), ("-5", None, "negative"), ("(5)", None, "negative"), ("5-", None, "negative"), ("1,234.505", None, "decimals"), ("12a", None, "invalid"), ("", None, "invalid"), ("1,23,456", None, "invalid"),
        ("99999999999", None, "too_large"), ("9" * 60, None, "too_large"), (None, None, None),
    ],
)
def test_amounts(spark, given, value, error):
    (got,) = each(spark, parts.amount, [given])
    assert got["error"] == error and got["value"] == (Decimal(value) if value else None)


def test_reference_cells(spark):
    cells = ["HYUNDAI:51712-1R000; kia:51712-0U000; RN11002V", "oem:Kia:1; OEM:2|empresa:FEBEST:x\nKIA:9", "A:1; OEM:A:1", "COMPANY:5", "KIA:", "A:1;a:1", "", None, "x" * 121]
    got = each(spark, parts.references_in_cell, cells)
    plain = [[tuple(r) for r in g["refs"]] if g["refs"] is not None else g["error"] for g in got]
    assert plain == [
        [("", "RN11002V", None), ("HYUNDAI", "51712-1R000", None), ("KIA", "51712-0U000", None)], [("", "2", "oem"), ("FEBEST", "X", "company"), ("KIA", "1", "oem"), ("KIA", "9", None)],
        "contradiction", "brand", "code", [("A", "1", None)], [], [], "length",
    ]
    assert each(spark, parts.labelled_references, ["bujia OEM: 90919-01253, ref 123-4567 REEMPLAZA 12-3", ""]) == [["9091901253"], []]
    assert each(spark, parts.code_tokens, ["filtro 51750-J9000 abc 12345 a1b2c3"]) == [["51750J9000", "A1B2C3"]]


def test_codes(spark):
    assert each(spark, parts.supplier_base, [" 54650-d4000-mando ", "54650-D4000-LH", "54650-D4000", "12-MANDO", "ABC-DEF"]) == ["54650-D4000", "", "", "", ""]
    numbers = [("Suzuki", "16100-87795-000"), ("Kia", "16100-87795-000"), ("Opel", "636160"), ("gm", "02898355"), ("GM", "636160"), ("Opel", "63616A")]
    assert each(spark, parts.canonical_number, numbers, "m string, n string") == ["1610087795", "1610087795000", "0636160", "2898355", "636160", "63616A"]
    assert each(spark, parts.one_part, [(["GWT-116A", "GWT-116AH"],), (["GWT116", "GWT117"],), (["AB1", "AB1 XYZW"],), (["ab1"],)], "x array<string>") == [True, False, False, True]
    assert each(spark, parts.twin_scope, ["opel", " Saab", "Kia"]) == ["GM", "GM", "KIA"]
    classes = {"MANDO": "tag", "STD": "variant", "SPK/WAP": "tag", "TAIH": "tag"}
    codes = ["54650-D4000-MANDO", "54650-D4000", "ABC-MANDO", "12345-STD-TAIH", "12345-XX", "12345-MANDO_ANULADO", "9-SPK/WAP", "54650_99_DELETED"]
    got = each(spark, lambda c: parts.code_with_tags(c, classes), codes)
    assert [(g["base"], g["tags"], g["chain_class"]) for g in got] == [
        ("54650-D4000", ["MANDO"], "tag"), ("54650-D4000", [], "bare"), ("ABC", ["MANDO"], "tag"), ("12345", ["STD", "TAIH"], "variant"), ("12345", ["XX"], "unknown"), ("12345", ["MANDO"], "lifecycle"),
        ("9", ["SPK/WAP"], "tag"), ("54650", [], "lifecycle"),
    ]
    group = lambda m: parts.make_group(m, {"AUDI": "VOLKSWAGEN", "BENZ": "MERCEDES", "PEUGEOT": "PEUGEOT"}, {"VOLKSWAGEN": "VAG", "MERCEDES": "MB", "PEUGEOT": "OTHER"})
    assert each(spark, group, ["Audi", "Mercedes-Benz", "peugeot", "TATA", None]) == ["VAG", "MB", "", "TATA", ""]


def test_descriptions(spark):
    got = each(spark, parts.application, ["Buje  Kia 98-05", "BUJE 2005/1998", "BUJE 70-69", "BUJE 2001 – 2004", "98-05"])
    assert [tuple(g) for g in got] == [("BUJE KIA", 1998, 2005), ("BUJE 2005/1998", None, None), ("BUJE", 1970, 2069), ("BUJE", 2001, 2004), ("98-05", None, None)]
    pairs = [("Buje 98-05", "BUJE 04-10"), ("BUJE 98-02", "BUJE 04-10"), ("a b", "A  B"), ("", ""), ("BUJE", "BUJE 98-05")]
    assert each(spark, parts.descriptions_compatible, pairs, "a string, b string") == [True, False, True, False, False]
    assert each(spark, parts.sides, ["amort del izq", "LH/RH", "del lh rh", "R/H tras", "buje"]) == [["front", "left"], [], ["front"], ["rear", "right"], []]
    conflicts = [
        ("disco del", "disco tras"), ("kit disco", "disco"), ("pastilla set", "pastillas"), ("disco 20 mm", "disco 22 mm"), ("disco 20mm", "disco"), ("disco", "tambor"), ("amortiguador", "amort"), ("x 98-02", "x 04-10"), ("disco LH/RH", "disco rh"),
    ]
    assert each(spark, parts.spec_conflict, conflicts, "a string, b string") == [True, True, False, True, False, True, False, True, False]
    head = lambda t: parts.head_and_qualifier(t, {"SOPORTE": "BASE"}, {"BUJE": ["BIELA"], "BASE": ["MOTOR"]})
    assert [tuple(g) for g in each(spark, head, ["Buje biela HYU", "soporte de motor", "buje de goma", "12"])] == [("BUJE", "BIELA"), ("BASE", "MOTOR"), ("BUJE", ""), ("", "")]
    rules = [("bujias", r"BUJIA\b"), ("cables", "CABLE BUJIA"), ("other", "B")]
    assert each(spark, lambda t: parts.first_rule(t, rules), ["bujía x", "cable bujia", "bujias", "zz"]) == ["bujias", "cables", "other", None]
    assert each(spark, lambda t, g: parts.first_rule(t, rules, g), [("bujía", None), ("bujía", "Bujías"), ("bujía", "cables")], "t string, g string") == ["bujias", "bujias", None]
    assert each(spark, parts.masked, ["a@b.co pide $ 12.50 y 5 % en 04465-33450", "te cuesta 45 USD"]) == ["[email] pide [amount] y [amount] en 04465-33450", "te cuesta [amount]"]
    assert each(spark, lambda t: parts.masked(t, numbers=True), ["tengo 3 de BKR6E-11"]) == ["tengo [number] de BKR6E-11"]


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_typo_fixes_equal_all_pairs(spark):
    import random

    from partmill.operators import text_joins

    rng = random.Random(12)

    def typo(w):
        w = list(w)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w)) if w else 0
            what = rng.randrange(4)
            if what == 0 and len(w) > k + 1:
                w[k], w[k + 1] = w[k + 1], w[k]
            elif what == 1 and len(w) > 1:
                del w[k]
            elif what == 2:
                w.insert(k, rng.choice("ABC"))
            elif w:
                w[k] = rng.choice("ABC")
        return "".join(w)

    common = {"".join(rng.choice("ABCDE") for _ in range(rng.choice([2, 4, 5, 9, 15, 16, 17, 18, 30, 60]))) for _ in range(60)}
    rare = {typo(rng.choice(sorted(common))) for _ in range(300)} - common - {""}
    rows = [(w, 9) for w in common] + [(w, 1) for w in rare]
    got = {(r["word"], r["fix"], r["edits"]) for r in text_joins.typo_fixes(spark.createDataFrame(rows, "word string, n long"), 5).collect()}
    assert got == {(w, f, osa(w, f)) for w in rare for f in common if osa(w, f) <= (2 if len(w) >= 5 else 1)}


def test_wide_fold_decomposes_everything(spark):
    import unicodedata

    from partmill.functions.text import wide_fold

    plain = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t.upper()) if not unicodedata.combining(c)).split())
    texts = ["Nº 5", "1ª", "½ x ²", "ＦＵＬＬ　ｗｉｄｔｈ１", "ﬁltro", "Ⅳ №", "é É ñ ß", "áb", "…"]
    got = [r["x"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", wide_fold(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == list(map(plain, texts))


def test_edits_with_a_letter_between_swapped_ones(spark):
    from partmill.operators import text_joins

    pairs = [("ANENR", "ANRE"), ("EINCH", "ENLICH"), ("CA", "ABC"), ("XCAY", "XABCY"), ("ABCD", "ABDC"), ("ABCD", "ACBDE"), ("AB", "BXYA"), ("AA", "AXA"), ("", "AB")]
    got = lambda between: each(spark, lambda a, b: text_joins.edits(a, b, between), pairs, "a string, b string")
    assert got(True) == [2, 2, 2, 2, 1, 2, 4, 1, 2]
    assert got(False)[:4] == [3, 3, 3, 3]
    rows = spark.createDataFrame([("ANENR", 1), ("ANRE", 9), ("HUNDERTMEILENSTEINCH", 1), ("HUNDERTMEILENSTENLICH", 9)], "word string, n long")
    assert {(r["word"], r["edits"]) for r in text_joins.typo_fixes(rows, 5, between=True).collect()} == {("ANENR", 2), ("HUNDERTMEILENSTEINCH", 2)}
