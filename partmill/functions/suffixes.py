"""The run of suffixes behind a code's number, read in order: sizes, compounds, tags of two words, and tails that spell other codes.

A chain is folded token by token: what a token is can depend on the one before it (``NEW_ERA`` is one tag, ``SPK/WAP`` a compound)
and on the separator (``/170`` after ``27060-16160`` is 27060-16170).  What a token means comes from a table that is a parameter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from partmill.functions.text import let, shape, wide_fold

#: Sizes, alphabetic tokens, separators, and marks of withdrawn codes.
SIZE = r"^(STD|0\.[0-9]{2}|[0-9]\.[0-9]{2}|0[0-9]{2}|0?[1-9]0|100|075|125|150)$"
ALPHA = "^[A-Z]{1,16}$"
SEPARATOR = r"(?:[-/_+() ]|(?<![0-9])\.|\.(?![0-9]))"
LIFECYCLE = r"(?:[-_ /]+(?:ANULAD[OA]S?[0-9]*|AULADO[0-9]*))+[-_ ]*$|_[0-9]+_DELETED$"
_TOKEN = r"((?:[^-/_+(). ]|(?<=[0-9])\.(?=[0-9]))+)"


@dataclass(frozen=True)
class Suffixes:
    """``known``: token -> (class, kind), class TAG, VARIANT or UNKNOWN; a key with a space is a tag of two words, ``CODE:-AA99`` the
    shape of a token with digits behind its separator.  ``scopes``: token -> ((heads, class, kind), ...): what it is behind
    descriptions with one of these heads ("BUJE" or "BUJE BIELA")."""

    known: Mapping[str, tuple[str, str]]
    scopes: Mapping[str, Sequence[tuple[Sequence[str], str, str]]] = field(default_factory=dict)


def _entry(cls: str, kind: str) -> Column:
    return F.struct(F.lit(cls).alias("cls"), F.lit(kind).alias("kind"))


def tokens(rest: Column, table: Suffixes) -> Column:
    """``array<struct<sep, tok>>`` of a chain such as ``-STD-TAIH``; ``-.25`` is the size 0.25."""
    rest = F.regexp_replace(rest, r"(^|[-/ ])\.([0-9]{2})(?=$|[-/ ])", "$1" + "0.$2")
    found = F.transform(F.regexp_extract_all(rest, F.lit(f"({SEPARATOR}*){_TOKEN}"), 0), lambda x: F.struct(F.regexp_extract(x, f"^({SEPARATOR}*)", 1).alias("sep"), F.regexp_extract(x, rf"^{SEPARATOR}*(.*)$", 1).alias("tok")))
    pairs = F.array(*[F.lit(t) for t in sorted(table.known) if " " in t]) if any(" " in t for t in table.known) else F.array().cast("array<string>")

    def add(done: Column, new: Column) -> Column:
        last, alpha = F.element_at(done, -1), new["tok"].rlike(ALPHA)
        compound = (new["sep"] == "/") & alpha & ~new["tok"].rlike(SIZE) & F.forall(F.split(last["tok"], "/"), lambda p: p.rlike(ALPHA))
        two_words = F.array_contains(pairs, F.concat(last["tok"], F.lit(" "), new["tok"])) & alpha & last["tok"].rlike(ALPHA)
        joined = F.when(compound, F.concat(last["tok"], F.lit("/"), new["tok"])).when(two_words, F.concat(last["tok"], F.lit(" "), new["tok"]))
        grown = lambda tok: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["sep"].alias("sep"), tok.alias("tok"))))
        return let(joined, lambda tok: F.when((F.size(done) > 0) & tok.isNotNull(), grown(tok)).otherwise(F.concat(done, F.array(new))))

    # An element_at of the empty start must not be looked up.
    folded = lambda f: F.when(F.size(f) > 0, F.aggregate(F.slice(f, 2, F.greatest(F.size(f), F.lit(1))), F.slice(f, 1, 1), add)).otherwise(F.slice(f, 1, 1))
    return let(found, folded)


def classify(sep: Column, tok: Column, table: Suffixes, head: Column | None = None) -> Column:
    """``struct<cls, kind>`` of a token; ``head``: struct<head, qualifier> of the description."""
    known = F.create_map(*[x for t, (c, k) in sorted(table.known.items()) for x in (F.lit(t), _entry(c, k))])
    exact = lambda t: F.try_element_at(known, t)
    scoped = F.lit(None).cast("struct<cls:string,kind:string>")
    if head is not None:
        both = F.concat_ws(" ", head["head"], head["qualifier"])
        for token, entries in sorted(table.scopes.items(), reverse=True):
            for heads, cls, kind in reversed(entries):
                scoped = F.when((tok == token) & (head["head"] != "") & (head["head"].isin(*heads) | both.isin(*heads)), _entry(cls, kind)).otherwise(scoped)
    parts = F.filter(F.split(tok, "/"), lambda p: p != "")
    single = lambda p: F.coalesce(exact(p), F.when(p.rlike(SIZE), _entry("VARIANT", "size")), _entry("UNKNOWN", "unseen"))["cls"]
    compound = (
        F.when(~((F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(ALPHA))), _entry("UNKNOWN", "code_compound"))
        .when(F.forall(parts, lambda p: single(p) == "TAG"), _entry("TAG", "brand"))
        .when(F.exists(parts, lambda p: single(p) == "VARIANT"), _entry("VARIANT", "compound"))
        .otherwise(_entry("UNKNOWN", "compound"))
    )
    of_shape = F.coalesce(exact(F.concat(F.lit("CODE:"), F.when(sep == "", "(NONE)").otherwise(sep), shape(tok))), exact(F.concat(F.lit("CODE:-"), shape(tok))), _entry("UNKNOWN", "code_tail"))
    return F.coalesce(
        scoped, exact(tok), F.when(F.contains(tok, F.lit("/")), compound), F.when(tok.rlike(SIZE), _entry("VARIANT", "size")), F.when(tok.rlike("[0-9]"), of_shape), _entry("UNKNOWN", "unseen")
    )


def chain_of(rest: Column, table: Suffixes, base: Column | None = None, head: Column | None = None) -> Column:
    """``array<struct<sep, tok, cls, kind, alt_code>>`` of a chain.  With the ``base`` as written, a short token with a digit behind a
    slash takes the place of the base's end: another code."""
    last = F.element_at(F.split(base, "[-.]"), -1) if base is not None else None

    def each(x: Column) -> Column:
        whole = lambda found, alt: F.struct(x["sep"].alias("sep"), x["tok"].alias("tok"), found["cls"].alias("cls"), found["kind"].alias("kind"), alt.alias("alt_code"))
        found = classify(x["sep"], x["tok"], table, head)
        if base is None:
            return let(found, lambda f: whole(f, F.lit(None).cast("string")))
        tail = F.contains(x["sep"], F.lit("/")) & x["tok"].rlike("^[0-9A-Z]{1,6}$") & x["tok"].rlike("[0-9]") & (F.length(x["tok"]) <= F.length(last))
        alt = F.when(tail, F.concat(F.substr(base, F.lit(1), F.length(base) - F.length(x["tok"])), x["tok"]))
        return let(alt, lambda a: let(F.when(a.isNotNull(), _entry("VARIANT", "alt_oem_tail")).otherwise(found), lambda f: whole(f, a)))

    return F.transform(tokens(rest, table), each)


def chain_class(chain: Column, lifecycle: Column) -> Column:
    """unknown where a token is, else lifecycle, variant (or another code), tag or bare."""
    has = lambda cls: F.exists(chain, lambda c: c["cls"] == cls)
    marked = (lifecycle != "") | F.exists(chain, lambda c: (c["cls"] == "TAG") & (c["kind"] == "lifecycle"))
    return F.when(has("UNKNOWN"), "unknown").when(marked, "lifecycle").when(has("VARIANT"), "variant").when(has("TAG"), "tag").otherwise("bare")


def split_code(code: Column) -> Column:
    """``struct<base, rest, lifecycle>``: up to the last token with a digit, or the first token; what follows; the mark of withdrawal."""
    whole = F.trim(F.regexp_replace(F.regexp_replace(wide_fold(code), "[–—]", "-"), r"\s+", " "))

    def cut(w: Column) -> Column:
        body = F.when(w["marker"] != "", F.regexp_replace(F.substr(w["whole"], F.lit(1), F.length(w["whole"]) - F.length(w["marker"])), "[-_ /]+$", "")).otherwise(w["whole"])
        return let(body, lambda b: let(based(b), lambda base: F.struct(base.alias("base"), F.substr(b, F.length(base) + 1).alias("rest"), F.regexp_replace(w["marker"], "^[-_ /]+|[-_ /]+$", "").alias("lifecycle"))))

    def based(body: Column) -> Column:
        numbered = F.regexp_extract(body, "^(.*[0-9][^-/_+(). ]*)", 1)
        return F.when(numbered != "", numbered).otherwise(F.regexp_extract(body, rf"^({SEPARATOR}*{_TOKEN})", 1))

    return let(let(whole, lambda w: F.struct(w.alias("whole"), F.regexp_extract(w, f"({LIFECYCLE})", 1).alias("marker"))), cut)


def stripped(code: Column, table: Suffixes, head: Column | None = None) -> Column:
    """``struct<base, chain, lifecycle, chain_class>`` of a code."""
    whole = lambda cut, chain: F.struct(cut["base"].alias("base"), chain.alias("chain"), cut["lifecycle"].alias("lifecycle"), chain_class(chain, cut["lifecycle"]).alias("chain_class"))
    return let(split_code(code), lambda cut: let(chain_of(cut["rest"], table, head=head), lambda chain: whole(cut, chain)))
