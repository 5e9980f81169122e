"""Joins of texts with tables of names: brands, aliases, and words with what they may be typed for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions.text import brand_key

_TOKEN = "([A-Z0-9]+)"


def resolve_brands(df: DataFrame, name_col: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``brand`` and ``root``: what ``aliases`` (alias, brand, root of the family) says of a spelling, else the
    spelling itself, normalised.  Of several rows for an alias the first brand counts."""
    known = aliases.groupBy(brand_key(F.col("alias")).alias("_key")).agg(F.min(F.struct("brand", "root")).alias("_named"))
    found = df.withColumn("_key", brand_key(F.col(name_col))).join(known, "_key", "left")
    return found.withColumns({"brand": F.coalesce("_named.brand", "_key"), "root": F.coalesce("_named.root", "_key")}).drop("_key", "_named")


def expand_aliases(docs: DataFrame, key: str, text_col: str, aliases: DataFrame) -> DataFrame:
    """``docs`` with ``added``: the brands that words or phrases of a folded text name and that it does not have yet, sorted.

    Texts meet aliases on the alias's first word, so a text is compared with few of them."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(c, F.lit(_TOKEN), 1), " "), F.lit(" "))
    phrases = aliases.select(spaced(F.upper("alias")).alias("_phrase"), spaced(F.upper("brand")).alias("_named"), F.col("brand").alias("_brand")).where("trim(_phrase) <> ''")
    phrases = phrases.withColumn("_first", F.split(F.trim("_phrase"), " ")[0])
    words = docs.select(key, spaced(F.col(text_col)).alias("_text"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(_TOKEN), 1))).alias("_first"))
    hits = words.join(phrases, "_first").where(F.contains("_text", F.col("_phrase")) & ~F.contains("_text", F.col("_named")))
    names = hits.groupBy(key).agg(F.array_sort(F.collect_set("_brand")).alias("_added"))  # brands that one text names
    return docs.join(names, key, "left").withColumn("added", F.coalesce("_added", F.array().cast("array<string>"))).drop("_added")


def edits(a: Column, b: Column, between: bool = False) -> Column:
    """Optimal string alignment distance up to 2 (a swap of neighbours is one edit); greater ones may come out greater than they are.
    With ``between`` it is Damerau and Levenshtein's: letters can be swapped and one put between them (``ANRE``, ``ANENR``), two edits.

    Levenshtein's distance counts a swap as two: words at 2 of it are one apart if swapping makes them equal, words at 3 or 4 are two
    apart if undoing the first swap (or both) leaves as much.  The swap is where the common prefix ends."""
    plain = F.levenshtein(a, b)

    def alike(x: Column, y: Column) -> Column:
        """Length of the common prefix."""
        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(x), F.length(y)), F.lit(1))), lambda k: F.substr(x, F.lit(1), k) == F.substr(y, F.lit(1), k)))

    def parted(x: Column, y: Column) -> Column:
        """Whether y is x with two neighbours swapped and a letter put between them: what differs begins and ends with these."""
        n = alike(x, y)
        crosswise = (F.substr(x, n + 1, F.lit(1)) == F.substr(y, n + 3, F.lit(1))) & (F.substr(x, n + 2, F.lit(1)) == F.substr(y, n + 1, F.lit(1)))
        return (F.length(y) == F.length(x) + 1) & (F.length(x) >= n + 2) & crosswise & (F.substr(x, n + 3) == F.substr(y, n + 4))

    def swapped(x: Column, y: Column) -> Column:
        """x with its first difference from y swapped back, where two neighbours stand crosswise there; null else."""
        n = alike(x, y)
        crosswise = (F.substr(x, n + 1, F.lit(1)) == F.substr(y, n + 2, F.lit(1))) & (F.substr(x, n + 2, F.lit(1)) == F.substr(y, n + 1, F.lit(1))) & (F.length(x) >= n + 2) & (F.length(y) >= n + 2)
        return F.when(crosswise, F.concat(F.substr(x, F.lit(1), n), F.substr(y, n + 1, F.lit(2)), F.substr(x, n + 3)))

    front, back = swapped(a, b), F.reverse(swapped(F.reverse(a), F.reverse(b)))
    both = swapped(back, b)
    apart = F.when(parted(a, b) | parted(b, a), 2) if between else F.lit(None).cast("int")
    return F.least(plain, F.levenshtein(front, b) + 1, F.levenshtein(back, b) + 1, F.levenshtein(both, b) + 2, apart).cast("int")


def _pieces(word: Column, length: Column, most: int) -> Column:
    """A word's ``most`` + 1 pieces, cut as words of ``length`` are: (number, piece)."""
    size = F.floor(length / (most + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(k.alias("k"), F.when(k < most, F.substr(word, k * size + 1, size)).otherwise(F.substr(word, k * size + 1)).alias("piece")))


def _without(word: Column, most: int) -> Column:
    """A word and all that is left of it when up to ``most`` letters are dropped."""
    kept = F.array(word)
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substr(w, F.lit(1), k - 1), F.substr(w, k + 1)))
    layer = kept
    for _ in range(most):
        layer = F.array_distinct(F.flatten(F.transform(F.filter(layer, lambda w: F.length(w) > 0), drop)))
        kept = F.array_union(kept, layer)
    return kept


def typo_fixes(vocabulary: DataFrame, known: int, most: int = 2, short: int = 5, long: int = 16, between: bool = False) -> DataFrame:
    """(word, fix, edits): words of ``vocabulary`` (word, n) used less than ``known`` times that are at most ``most`` (1 or 2) edits from
    one used as often (one edit for words shorter than ``short``); ``between`` as in ``edits``.

    Two words within k edits share what is left after k letters are dropped from each: words of up to ``long`` letters meet on that.
    Of longer ones, which would have too many such keys, a piece is whole in the other: a swap touches two letters, so of
    ``2 * most`` + 1 pieces one is, moved by ``most`` places at most.  They meet on the length they were cut by, the piece and its
    place.  Never all meet all, and a word's keys do not grow faster than its length."""
    rare, common = vocabulary.where(F.col("n") < known).select("word"), vocabulary.where(F.col("n") >= known).select(F.col("word").alias("fix"))
    left = lambda df, name, reach: df.where(F.length(name) <= reach).select(name, F.explode(_without(F.col(name), most)).alias("rest"))
    by_rest = left(rare, "word", long).join(left(common, "fix", long + most), "rest").select("word", "fix")
    cut = rare.where(F.length("word") > long).select("word", F.length("word").alias("cut"), F.explode(_pieces(F.col("word"), F.length("word"), 2 * most)).alias("p")).select("word", "cut", "p.*")
    by_piece = cut.join(_shifted(common.where(F.length("fix") > long - most), most, 2 * most), ["cut", "k", "piece"]).select("word", "fix")
    pairs = by_rest.unionByName(by_piece).distinct()
    # A swap is two edits for levenshtein, so nothing within reach is lost here.
    near = pairs.where(F.levenshtein("word", "fix") <= 2 * most).withColumn("edits", edits(F.col("word"), F.col("fix"), between))
    return near.where(F.col("edits") <= F.when(F.length("word") >= short, most).otherwise(1))


def _shifted(words: DataFrame, most: int, parts: int) -> DataFrame:
    """(fix, cut, k, piece) of ``words`` (fix): what a word of ``cut`` letters can have as its k-th piece if ``fix`` is within ``most`` edits of it."""
    each = words.select("fix", F.explode(F.sequence(F.greatest(F.length("fix") - most, F.lit(1)), F.length("fix") + most)).alias("cut"))
    each = each.select("fix", "cut", F.floor(F.col("cut") / (parts + 1)).cast("int").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("k"))
    each = each.select("*", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("at", F.col("k") * F.col("size") + 1 + F.col("shift"))
    # The last piece goes to the end of the word, however long that is.
    rest = F.col("cut") - F.col("k") * F.col("size")
    wide = F.when(F.col("k") < parts, F.col("size")).otherwise(rest)
    return each.where((F.col("at") >= 1) & (F.col("at") + wide - 1 <= F.length("fix"))).select("fix", "cut", "k", F.substr("fix", F.col("at"), wide).alias("piece")).distinct()
