"""Text keys as Column functions; each has the same meaning as SQL text in ``SQL``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that the search folds, and what they become.
ACCENTED = "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑáàâäéèêëíìîïóòôöúùûüñ"
PLAIN = "AAAAEEEEIIIIOOOOUUUUNaaaaeeeeiiiioooouuuun"
#: Words that join a search but name nothing; words that a search uses; least length of a code.
FILLER = ("DE", "LA", "LAS", "EL", "LOS", "PARA", "CON", "Y", "EN", "POR", "UN", "UNA")
MAX_WORDS, MIN_SEARCH = 8, 4
#: Letters and the marks that compose with them to a letter of ``ACCENTED``.
_COMPOSED = "([AEIOUaeiou])[̀́̂̈]|([Nn])̃"


def _latin_letters() -> tuple[str, str]:
    """Every Latin letter of U+00C0 to U+1EFF that is an ASCII letter with marks, and that letter."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFKD", c)
        if base.isascii() and base.isalpha() and marks and all(map(unicodedata.combining, marks)):
            found[c] = base
    return "".join(found), "".join(found.values())


MARKED, UNMARKED = _latin_letters()


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition without marks makes of a character: one other, or several (fractions, ligatures, numerals).

    All of the basic plane but syllables, whose parts are no marks; several only where letters, numbers and their forms are."""
    one, many = {}, {}
    for n in [*range(0x80, 0xAC00), *range(0xE000, 0xFFFE)]:
        out = "".join(x for x in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(x))
        if out != chr(n) and len(out) == 1:
            one[chr(n)] = out
        elif len(out) > 1 and (n < 0x2600 or 0xFB00 <= n < 0xFB07):
            many[chr(n)] = out
    return one, many


SINGLE, SEVERAL = _decompositions()


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once however often ``then`` names it: a Column named twice is written out twice, and what
    names that is written out four times."""
    return F.transform(F.array(value), then)[0]


def fold(text: Column) -> Column:
    """Search folding: the accents of ``ACCENTED`` off, composed or not, upper case."""
    return F.upper(F.translate(F.regexp_replace(text, _COMPOSED, "$1$2"), ACCENTED, PLAIN))


def wide_fold(text: Column) -> Column:
    """The wider folding: upper case, then compatibility forms decomposed (½, ², º, full-width letters) and all marks off; single spaces.

    Letters that only come from decomposing stay as they come: ``Nº`` is ``No``."""
    several = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])

    def plain(upper: Column) -> Column:
        spelt = F.array_join(F.transform(F.split(upper, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
        single = F.when(upper.rlike("[" + "".join(SEVERAL) + "]"), spelt).otherwise(upper)
        return F.regexp_replace(F.translate(single, "".join(SINGLE), "".join(SINGLE.values())), r"\p{M}", "")

    # Nothing in ASCII decomposes, and most codes are in it.
    folded = let(F.upper(text), lambda upper: F.when(F.octet_length(upper) == F.length(upper), upper).otherwise(plain(upper)))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def compact(text: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def code_key(code: Column) -> Column:
    """The compact code where it has 8 characters and 3 digits at least, else trimmed, upper case, single spaces."""
    short = compact(code)
    digits = F.regexp_replace(short, "[^0-9]", "")
    return F.when((F.length(short) >= 8) & (F.length(digits) >= 3), short).otherwise(F.regexp_replace(F.upper(F.trim(code)), " +", " "))


def shape(text: Column) -> Column:
    """Digits as 9, letters as A."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "A")


def snippet(text: Column, limit: int = 140) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def search_words(text: Column) -> Column:
    """The words that must each match: folded, without bare punctuation, the first ``MAX_WORDS``; filler goes unless nothing
    else is left."""
    words = F.slice(F.filter(F.split(F.trim(fold(text)), r"\s+"), lambda w: compact(w) != ""), 1, MAX_WORDS)
    named = F.filter(words, lambda w: ~w.isin(*FILLER))
    return F.when(F.size(named) > 0, named).otherwise(words)


def search_key(text: Column) -> Column:
    """The whole search without separators where it reads as a code: a digit and ``MIN_SEARCH`` characters; else empty."""
    key = compact(fold(text))
    return F.when((F.length(key) >= MIN_SEARCH) & key.rlike("[0-9]"), key).otherwise("")


def padded(values: Column) -> Column:
    """`` A B ``: each value once, in order, a space on both sides; empty without values."""
    values = F.array_distinct(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))))
    return F.when(F.size(values) > 0, F.concat(F.lit(" "), F.array_join(values, " "), F.lit(" "))).otherwise("")


def has_token(padded_values: Column, value: Column) -> Column:
    """Whether a padded list has exactly this value."""
    return F.contains(padded_values, F.concat(F.lit(" "), value, F.lit(" ")))


def brand_key(name: Column) -> Column:
    """Trimmed, upper case, single spaces; empty for null."""
    return F.coalesce(F.regexp_replace(F.upper(F.trim(F.regexp_replace(name, r"\s", " "))), " +", " "), F.lit(""))


def header(text: Column) -> Column:
    """A column title: folded, words joined by underscores; empty for null."""
    return F.coalesce(F.replace(wide_fold(text), F.lit(" "), F.lit("_")), F.lit(""))


def citation_title(citation: Column) -> Column:
    """What stands before the page of a citation."""
    return F.trim(F.split(F.coalesce(citation, F.lit("")), " · pág\\.")[0])


def sql_fold(x: str) -> str:
    return f"upper(translate({x}, '{ACCENTED}', '{PLAIN}'))"


def sql_compact(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def sql_code_key(x: str) -> str:
    c = sql_compact(x)
    return f"CASE WHEN length({c}) >= 8 AND length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 3 THEN {c} ELSE regexp_replace(upper(trim({x})), ' +', ' ', 'g') END"
