"""Parsing of codes, amounts, references and descriptions of parts, as Column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partmill.functions.text import compact, wide_fold

#: Suffixes that say where a part sits, so they belong to its code.
POSITION_SUFFIXES = (
    "LEFT", "RIGHT", "LH", "RH", "L", "R", "IZQ", "IZQUIERDO", "IZQUIERDA", "DER", "DERECHO", "DERECHA", "FRONT", "REAR", "DEL", "DELANTERO", "DELANTERA", "TRAS", "TRASERO", "TRASERA",
    "UPPER", "LOWER", "SUPERIOR", "INFERIOR", "INT", "EXT", "INTERIOR", "EXTERIOR", "ABS", "STD", "TURBO", "KIT", "SET", "PAIR", "MM", "CM",
)
#: Words for a side or an axle.
SIDES = {
    "left": ("IZQ", "IZQUIERDO", "IZQUIERDA", "LH", "LEFT"), "right": ("DER", "DERECHO", "DERECHA", "RH", "RIGHT"),
    "front": ("DEL", "DELANTERO", "DELANTERA", "FRONT"), "rear": ("TRAS", "TRASERO", "TRASERA", "REAR"),
}
#: Words for a kit (the first two not between two parts that are always sold as a set), parts sold so, part nouns with
#: their plurals and abbreviations.
SET_WORDS, KIT_WORDS, SOLD_AS_SET = ("JUEGO", "SET"), ("KIT", "PAR"), ("PASTILLA", "ZAPATA")
NOUNS = {
    "TAMBOR": "TAMBOR", "TAMBORES": "TAMBOR", "DISCO": "DISCO", "DISCOS": "DISCO", "PASTILLA": "PASTILLA", "PASTILLAS": "PASTILLA", "ZAPATA": "ZAPATA", "ZAPATAS": "ZAPATA", "FILTRO": "FILTRO",
    "FILTROS": "FILTRO", "BUJIA": "BUJIA", "BUJIAS": "BUJIA", "AMORTIGUADOR": "AMORT", "AMORTIGUADORES": "AMORT", "AMORTS": "AMORT", "AMORT": "AMORT", "ROTULA": "ROTULA", "ROTULAS": "ROTULA",
}
#: Makes whose numbers drop a trailing 000, the family that shares one catalogue, and its makes with seven digits.
TRAILING_000_MAKES = ("DAIHATSU", "SUZUKI", "TOYOTA")
GM_FAMILY, OPEL_CATALOG_MAKES = ("OPEL", "VAUXHALL", "GM", "CHEVROLET", "DAEWOO", "HOLDEN", "SAAB"), ("OPEL", "VAUXHALL")
#: The kinds that can stand before a reference.
KINDS = {"OEM": "oem", "COMPANY": "company", "EMPRESA": "company"}
_MONEY = "decimal(12,2)"


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


# ---- amounts -------------------------------------------------------------------------------------------------------


def amount(text: Column) -> Column:
    """``struct<value: decimal(12,2), error: string>`` of an amount as people write it.

    1234, 12.50, 12,50, 1,234.50, 1.234,50 and 1,234,567 are read; a lone separator before three digits is ambiguous.  Errors:
    negative, ambiguous, decimals, too_large, invalid; null text has neither value nor error."""
    text = F.trim(text)
    plain, one = text.rlike(r"^\d+$"), text.rlike(r"^\d+[.,]\d+$")
    part = F.regexp_extract(text, r"^\d+[.,](\d+)$", 1)
    comma, point = text.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), text.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    cents = F.when(comma, F.regexp_extract(text, r"\.(\d+)$", 1)).otherwise(F.regexp_extract(text, r",(\d+)$", 1))
    grouped = F.when(comma, F.regexp_replace(text, ",", "")).otherwise(F.replace(F.regexp_replace(text, r"\.", ""), F.lit(","), F.lit(".")))
    number = F.when(plain, text).when(one, F.replace(text, F.lit(","), F.lit("."))).when(comma | point, grouped)
    value = number.try_cast("decimal(38,2)")
    error = (
        F.when(text.isNull(), None)
        .when(text.rlike(r"^[-(]|-$"), "negative")
        .when(one & (F.length(part) == 3), "ambiguous")
        .when(one & (F.length(part) > 2), "decimals")
        .when(~plain & ~one & (comma | point) & (F.length(cents) > 2), "decimals")
        .when(number.isNull(), "invalid")
        .when(value.isNull() | (value >= F.lit(10_000_000_000)), "too_large")
    )
    return F.struct(F.when(error.isNull(), value).cast(_MONEY).alias("value"), error.alias("error"))


# ---- references ----------------------------------------------------------------------------------------------------


def references_in_cell(cell: Column) -> Column:
    """``struct<refs: array<struct<brand, code, ref_type>>, error>`` of ``BRAND:CODE; OEM:BRAND:CODE; CODE``: upper case, each
    once, sorted.  Errors: code (none), brand (a company's reference without), length (over 120), contradiction (one
    reference of two types), many (over 100)."""
    tokens = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[;\n|]+"), lambda x: F.trim(x)), lambda x: x != "")

    def parsed(token: Column) -> Column:
        first = F.upper(F.regexp_extract(token, r"^([^:]*):", 1))
        kind = F.try_element_at(_map(KINDS), first)
        rest = F.when(kind.isNotNull(), F.regexp_extract(token, r"(?s)^[^:]*:(.*)$", 1)).otherwise(token)
        brand = F.regexp_extract(rest, r"^([^:]*):", 1)
        code = F.when(F.contains(rest, F.lit(":")), F.regexp_extract(rest, r"(?s)^[^:]*:(.*)$", 1)).otherwise(rest)
        return F.struct(F.upper(F.trim(brand)).alias("brand"), F.upper(F.trim(code)).alias("code"), kind.alias("ref_type"))

    rows = F.array_sort(F.array_distinct(F.transform(tokens, parsed)))
    names = F.array_distinct(F.transform(rows, lambda r: F.struct(r["brand"], r["code"])))
    typed = F.array_distinct(F.transform(rows, lambda r: F.struct(r["brand"], r["code"], F.coalesce(r["ref_type"], F.lit("unknown")))))
    error = (
        F.when(F.size(tokens) > 100, "many")
        .when(F.exists(rows, lambda r: r["code"] == ""), "code")
        .when(F.exists(rows, lambda r: (F.length(r["code"]) > 120) | (F.length(r["brand"]) > 120)), "length")
        .when(F.exists(rows, lambda r: F.coalesce(r["ref_type"] == "company", F.lit(False)) & (r["brand"] == "")), "brand")
        .when(F.size(names) < F.size(typed), "contradiction")
    )
    return F.struct(F.when(error.isNull(), rows).alias("refs"), error.alias("error"))


def labelled_references(text: Column) -> Column:
    """Compact codes that a text names as OEM or replacement references; each once, sorted."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"(?:OEM|OE|REF(?:ERENCIA)?|REEMPLAZA)\s*[:#=]?\s*([A-Z0-9]+(?:[-./][A-Z0-9]+)+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, compact), lambda c: F.length(c) >= 8)))


def code_tokens(text: Column) -> Column:
    """Compact codes in a text: tokens of 6 characters and 3 digits at least; each once, sorted."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"([A-Z0-9]+(?:[-./][A-Z0-9]+)*)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, compact), lambda c: (F.length(c) >= 6) & (_digits(c) >= 3))))


# ---- codes ---------------------------------------------------------------------------------------------------------


def supplier_base(sku: Column) -> Column:
    """A supplier's code without its trailing alphabetic parts; empty where there are none, where one says a position, or
    where less than 8 characters and 3 digits are left."""
    sku = F.upper(F.trim(sku))
    suffix = F.regexp_extract(sku, "((?:-[A-Z]{1,12})+)$", 1)
    base = F.substr(sku, F.lit(1), F.length(sku) - F.length(suffix))
    positions = F.arrays_overlap(F.split(suffix, "-"), F.array(*map(F.lit, POSITION_SUFFIXES)))
    return F.when((suffix != "") & ~positions & (F.length(compact(base)) >= 8) & (_digits(base) >= 3), base).otherwise("")


def canonical_number(make: Column, number: Column) -> Column:
    """The spelling that two printings of one number settle on."""
    make, number = F.regexp_replace(F.upper(F.trim(make)), r"\s+", " "), compact(number)
    digits = number.rlike("^[0-9]+$")
    return (
        F.when(make.isin(*TRAILING_000_MAKES) & (F.length(number) > 10) & number.endswith("000"), F.substr(number, F.lit(1), F.length(number) - 3))
        .when(make.isin(*GM_FAMILY) & digits & (F.length(number) == 8) & number.startswith("0"), F.substr(number, F.lit(2)))
        .when(make.isin(*OPEL_CATALOG_MAKES) & digits & (F.length(number) == 6), F.concat(F.lit("0"), number))
        .otherwise(number)
    )


def one_part(codes: Column) -> Column:
    """Whether codes name one part: the shortest begins all others, which go on with three letters at most."""
    keys = F.array_sort(F.transform(codes, lambda c: F.struct(F.length(compact(c)).alias("n"), compact(c).alias("k"))))
    first = keys[0]["k"]
    rest = lambda k: F.substr(k["k"], F.length(first) + 1)
    return F.forall(keys, lambda k: k["k"].startswith(first) & rest(k).rlike("^[A-Z]{0,3}$"))


def twin_scope(make: Column) -> Column:
    """The makes whose numbers can be twins of one another."""
    make = F.regexp_replace(F.upper(F.trim(make)), r"\s+", " ")
    return F.when(make.isin(*GM_FAMILY), "GM").otherwise(make)


_SEPARATORS = r"(?:[-_+() ]|(?<![A-Z])/|/(?![A-Z])|\.)+"
_LIFECYCLE = r"(?:[-_ /]+(?:ANULAD[OA]S?[0-9]*|AULADO[0-9]*))+[-_ ]*$|_[0-9]+_DELETED$"


def code_with_tags(code: Column, classes: Mapping[str, str]) -> Column:
    """``struct<base, tags, lifecycle, chain_class>``: a code without the run of parts that have no digit at its end.

    A part with a digit ends the run, so a number is never cut, and the first part always stays.  ``classes`` says of each
    known part whether it is a ``tag`` or a ``variant``.  The class of the run is unknown where a part is, else lifecycle
    where the code is marked as withdrawn, else variant, tag or bare."""
    whole = F.trim(F.regexp_replace(F.regexp_replace(wide_fold(code), "[–—]", "-"), r"\s+", " "))
    marker = F.regexp_extract(whole, f"({_LIFECYCLE})", 1)
    body = F.regexp_replace(F.substr(whole, F.lit(1), F.length(whole) - F.length(marker)), "[-_ /]+$", "")
    body = F.when(marker != "", body).otherwise(whole)
    numbered = F.regexp_extract(body, "^(.*[0-9][^-/_+() .]*)", 1)
    base = F.when(numbered != "", numbered).otherwise(F.regexp_extract(body, "^([-/_+() .]*[^-/_+() .]*)", 1))
    tags = F.filter(F.split(F.substr(body, F.length(base) + 1), _SEPARATORS), lambda x: x != "")
    known = F.transform(tags, lambda x: F.coalesce(F.try_element_at(_map(classes), x), F.lit("unknown")))
    kind = (
        F.when(F.array_contains(known, "unknown"), "unknown")
        .when(marker != "", "lifecycle")
        .when(F.array_contains(known, "variant"), "variant")
        .when(F.size(tags) > 0, "tag")
        .otherwise("bare")
    )
    return F.struct(base.alias("base"), tags.alias("tags"), F.regexp_replace(marker, "^[-_ /]+|[-_ /]+$", "").alias("lifecycle"), kind.alias("chain_class"))


def make_group(make: Column, tokens: Mapping[str, str], groups: Mapping[str, str]) -> Column:
    """The group of a make's name: by the whole name, else by its first known token; empty without one."""
    name = F.upper(F.trim(F.coalesce(make, F.lit(""))))
    tried = F.concat(F.array(name), F.split(name, "[^0-9A-Z]+"))
    known = F.filter(F.transform(tried, lambda x: F.try_element_at(_map(tokens), x)), lambda x: x.isNotNull())
    canonical = F.coalesce(F.try_element_at(known, F.lit(1)), name)
    group = F.coalesce(F.try_element_at(_map(groups), canonical), canonical)
    return F.when(group == "OTHER", "").otherwise(group)


# ---- descriptions --------------------------------------------------------------------------------------------------


def application(text: Column) -> Column:
    """``struct<text, first, last>``: a description without the years at its end (98-05 is 1998 to 2005); none stay null."""
    text = F.regexp_replace(F.upper(F.trim(text)), r"\s+", " ")
    pattern = r"^(.+?)\s+((?:19|20)?[0-9]{2})\s*[-–/]\s*((?:19|20)?[0-9]{2})$"
    number = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    year = lambda n: F.when(n >= 100, n).otherwise(n + F.when(n >= 70, 1900).otherwise(2000))
    first, last = year(number(2)), year(number(3))
    right = F.coalesce(first <= last, F.lit(False))
    kept = lambda v: F.when(right, v)
    return F.struct(F.when(right, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("text"), kept(first).alias("first"), kept(last).alias("last"))


def descriptions_compatible(a: Column, b: Column) -> Column:
    """Equal, or equal but for years that overlap."""
    plain = lambda t: F.regexp_replace(F.upper(F.trim(t)), r"\s+", " ")
    x, y = application(a), application(b)
    overlap = (F.greatest(x["first"], y["first"]) <= F.least(x["last"], y["last"])) & x["first"].isNotNull() & y["first"].isNotNull()
    return F.coalesce(((plain(a) != "") & (plain(a) == plain(b))) | ((x["text"] == y["text"]) & overlap), F.lit(False))


def sides(text: Column) -> Column:
    """The sides and axles that a description names; one that names both of a pair names neither."""
    text = F.regexp_replace(wide_fold(text), r"\b([LR])/H\b", "$1H")
    words = F.regexp_extract_all(text, F.lit("([A-Z0-9]+)"), 1)
    names = {side: F.arrays_overlap(words, F.array(*map(F.lit, SIDES[side]))) for side in SIDES}
    other = {"left": "right", "right": "left", "front": "rear", "rear": "front"}
    return F.array_compact(F.array(*[F.when(names[s] & ~names[other[s]], s) for s in sorted(SIDES)]))


def part_nouns(text: Column) -> Column:
    """The part nouns that a description names."""
    words = F.regexp_extract_all(wide_fold(text), F.lit(r"(\w+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(_map(NOUNS), w)), lambda w: w.isNotNull())))


def spec_conflict(a: Column, b: Column) -> Column:
    """Whether two descriptions contradict each other: kit against single part, other sides, other measures, years apart, or
    other part nouns.  What only one of them says is no contradiction."""
    words = lambda t: F.regexp_extract_all(wide_fold(t), F.lit(r"(\w+)"), 1)
    either = lambda t, names: F.arrays_overlap(words(t), F.array(*map(F.lit, names)))
    nouns_a, nouns_b = part_nouns(a), part_nouns(b)
    as_set = F.arrays_overlap(F.array_intersect(nouns_a, nouns_b), F.array(*map(F.lit, SOLD_AS_SET)))
    kit = lambda t: either(t, KIT_WORDS) | (either(t, SET_WORDS) & ~as_set)
    both = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0)
    opposite = [F.array_contains(sides(a), x) & F.array_contains(sides(b), y) for x, y in (("left", "right"), ("right", "left"), ("front", "rear"), ("rear", "front"))]

    def measures(pattern: str) -> Column:
        found = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(wide_fold(t), F.lit(pattern), 0)))
        return both(found(a), found(b)) & (found(a) != found(b))

    x, y = application(wide_fold(a)), application(wide_fold(b))
    apart = F.coalesce(F.greatest(x["first"], y["first"]) > F.least(x["last"], y["last"]), F.lit(False)) & x["first"].isNotNull() & y["first"].isNotNull()
    parts = [
        kit(a) != kit(b), *opposite, measures(r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:MM|CM|V|W)\b"), measures(r"\b[0-9]+\s*(?:DIENTES|ESTRIAS|HUECOS)\b"), apart,
        both(nouns_a, nouns_b) & (nouns_a != nouns_b),
    ]
    return reduce(lambda p, q: p | q, parts)


def head_and_qualifier(text: Column, heads: Mapping[str, str], qualifiers: Mapping[str, Sequence[str]], filler: Sequence[str] = ("DE", "PARA", "P", "EL", "LA"), synonyms: Mapping[str, str] | None = None, groups: Mapping[tuple[str, str], str] | None = None) -> Column:
    """``struct<head, qualifier>``: the first noun of a description by its synonym, and the first word after it (of the next
    three, filler left out) where it, or its synonym, is one of that noun's qualifiers; ``groups``: (head, qualifier) -> the name that
    several of a noun's qualifiers share."""
    words = F.regexp_extract_all(wide_fold(text), F.lit("([A-Z][A-Z0-9/]*)"), 1)
    first = F.regexp_extract(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), "^([A-Z]+)", 1)
    head = F.coalesce(F.try_element_at(_map(heads), first), first)
    following = F.filter(F.slice(words, 2, 3), lambda w: ~w.isin(*filler))
    allowed = F.create_map(*[x for h, qs in qualifiers.items() for x in (F.lit(h), F.array(*map(F.lit, qs)))])
    word = F.try_element_at(following, F.lit(1))
    named = F.coalesce(F.try_element_at(_map(synonyms), word), word) if synonyms else word
    own = F.try_element_at(allowed, head)
    fits = F.coalesce(F.array_contains(own, named) | F.array_contains(own, word), F.lit(False))
    if groups:
        named = F.coalesce(F.try_element_at(_map({f"{h} {q}": g for (h, q), g in groups.items()}), F.concat_ws(" ", head, named)), named)
    return F.struct(head.alias("head"), F.when(fits, named).otherwise("").alias("qualifier"))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], given: Column | None = None) -> Column:
    """The label of the first rule ``(label, pattern)`` whose pattern begins the folded text; null where none does, or where a
    label is given and another one is found."""
    folded = wide_fold(text)
    label = F.coalesce(*[F.when(folded.rlike(f"^(?:{pattern})"), name) for name, pattern in rules])
    return label if given is None else F.when(given.isNull() | (given == "") | (wide_fold(given) == wide_fold(label)), label)


# ---- masking -------------------------------------------------------------------------------------------------------

_NUMBER = r"[0-9](?:[0-9.,]*[0-9])?"
#: E-mail addresses, amounts of money, and numbers that stand alone.
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
AMOUNT = (
    rf"(?i)(?:\$|B/\.)\s?{_NUMBER}|\b(?:USD|PAB)\s?{_NUMBER}|\b{_NUMBER}\s?(?:USD|PAB|balboas?|d[oó]lares?)\b|(?:[0-9]+[.,])*[0-9]+[.,][0-9]{{2}}\b"
    r"|[0-9]+(?:[.,][0-9]+)?\s?(?:%|por\s?ciento\b)"
)
LONE_NUMBER = r"(?<![\w./,-])[0-9]+(?:[.,][0-9]+)*(?![\w/-])"


def masked(text: Column, numbers: bool = False) -> Column:
    """A text with e-mail addresses and amounts masked, and with ``numbers`` every number that stands alone, too."""
    out = F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), AMOUNT, "[amount]")
    return F.regexp_replace(out, LONE_NUMBER, "[number]") if numbers else out
