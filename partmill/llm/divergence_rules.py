"""Quality rules: base counts, and how far a document's character classes and common words lie from its language's.

Only DataFrame functions are used.  A word is a run of characters other than space and tab to carriage return.

References
----------
For every language (the ``lang`` column; ``*`` pools all rows, for documents without one) over all documents: the shares of
seven character classes, and the shares of its ``COMMON`` most frequent words (without case; ties by name) among all words,
with one more share for all other words.  Words of any length count; they are pre-aggregated before they are shuffled.
References are tables of one row a language, of any number of languages; documents are joined with them.

Texts are read twice: for the words of all languages, then for each document's counts, those of its language's common words
among them.  Only these counts are written, so what is kept between the jobs is small whatever the texts are.

Rules
-----
The distance is the square root of the Jensen-Shannon divergence (base 2, so 0 to 1).  A document fails if its classes are
farther than ``CLASS_LIMIT`` and it has at least ``CLASS_CHARS`` characters, or if its common words are farther than
``WORD_LIMIT`` and it has at least ``WORD_WORDS`` words; below those lengths a distance says little and doesn't count.

Windows of five words are compared by 64-bit hash.  A null text has no words; it fails the base rules.  Repeated rows give
repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.sources.storage import materialize

WINDOW = 5
COMMON = 24
CLASS_LIMIT, CLASS_CHARS = 0.30, 200
WORD_LIMIT, WORD_WORDS = 0.55, 50
POOLED = "*"
_SPACE = "[\\x20\\x09-\\x0D]"
#: Lower-case ASCII letters come first: they are taken out before the other classes are counted.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", "[\\x20\\x09-\\x0D]", "[.,;:!?'\"()-]", "[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{_SPACE}+"), "")


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"{pattern}+", "")


def any_of(words: Column) -> Column:
    """A regular expression of which group 1 is one of these words, between spaces."""
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit(f"{_SPACE}("), F.array_join(quoted, "|"), F.lit(f")(?={_SPACE})"))


def count_each(text: Column, words: Column, pattern: Column) -> Column:
    """How often each of ``words`` stands in ``text``, without case; ``pattern`` is their ``any_of``.

    The pattern takes the common words out first, each between spaces of its own; what is short is then searched for each."""
    common = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), pattern, 1), "  "), F.lit(" "))
    size = lambda c: F.octet_length(c).cast("long")
    alone = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    return F.transform(F.array(common), lambda c: F.transform(words, lambda w: F.floor((size(c) - size(F.replace(c, alone(w), F.lit("")))) / size(alone(w)))))[0]


def text_features(df: DataFrame) -> DataFrame:
    """One row a document of ``df`` (doc_id, lang, text, ref_words, ref_pattern): base counts, class counts and ``hits``, the count
    of each of its language's common words."""
    length = lambda c: F.length(c).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # What needs the text comes first, so that the steps below don't carry it along.
    hits = count_each(F.col("text"), F.col("ref_words"), F.col("ref_pattern"))
    df = df.select("doc_id", "lang", length("text").alias("n_chars"), words_of(F.col("text")).alias("words"), lines.alias("lines"), hits.alias("hits"))
    df = df.withColumns({"n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_words": F.size("words").cast("long"), "dense": F.array_join("words", ""), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    df = df.withColumn("rest", _without(F.col("dense"), CLASSES[0]))
    df = df.withColumn("left", _without(F.col("rest"), CLASSES[1]))
    # Hash of the window that begins at each word.
    many = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    side_by_side = F.arrays_zip(*[F.slice("hashes", k + 1, many) for k in range(WINDOW)])
    df = df.withColumn("windows", F.transform(side_by_side, lambda x: F.xxhash64(x)))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    tagged = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("sorted", F.when(again, F.sort_array(tagged)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: (F.get(F.col("sorted"), j - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), j + 1)["h"] == x["h"])
    df = df.withColumn("repeated", F.sort_array(F.transform(F.filter("sorted", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])))
    # Each repeated window covers the words up to the next one's beginning, five at most.
    gaps = F.zip_with("repeated", F.slice("repeated", F.lit(2), F.greatest(F.size("repeated") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    dense, rest, left = F.col("dense"), F.col("rest"), F.col("left")
    space, upper = F.col("n_chars") - length(dense), length(rest) - length(left)
    marks = length(left) - length(_without(left, CLASSES[4]))
    digits = length(left) - length(_without(left, CLASSES[2]))
    ascii_left = length(left) - length(_without(left, "[\\x21-\\x7E]"))
    classes = F.array(length(dense) - length(rest), upper, digits, space, marks, ascii_left - marks - digits, length(left) - ascii_left)
    return df.select(
        "doc_id", "lang", "n_words",
        length(dense).alias("word_chars"),
        (length(left) - length(_without(left, "[#*$%&|<>]"))).alias("n_symbols"),
        "n_dup_lines",
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g).alias("n_repeat_words"),
        classes.alias("classes"),
        "hits",
    )


def _by_language(rows: DataFrame) -> DataFrame:
    """Every row under its language and under the pooled one."""
    return rows.withColumn("to", F.explode(F.array_distinct(F.array("lang", F.lit(POOLED)))))


def learn_words(texts: DataFrame) -> DataFrame:
    """(lang, ref_words, ref_counts) of the languages of ``texts`` (lang, text): the common words and how often each occurs."""
    words = texts.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = _by_language(words).groupBy("to", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("to").orderBy(F.desc("n"), "word")
    top = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= COMMON)
    top = top.groupBy(F.col("to").alias("lang")).agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))  # COMMON at most
    return top.select("lang", F.col("top.word").alias("ref_words"), F.col("top.n").alias("ref_counts"))


def learn_shares(features: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, ref_class: class shares, ref_shares: those of the common words and of all others), a row a language."""
    n = len(CLASSES) + 1
    sums = _by_language(features.select("lang", "n_words", "classes")).groupBy(F.col("to").alias("lang")).agg(F.sum("n_words").alias("count"), *[F.sum(F.col("classes")[k]).cast("double").alias(f"c{k}") for k in range(n)])
    both = sums.join(words.select("lang", "ref_counts"), "lang", "left").withColumn("ref_counts", F.coalesce("ref_counts", F.array().cast("array<bigint>")))
    chars, count = F.greatest(sum((F.col(f"c{k}") for k in range(n)), F.lit(0.0)), F.lit(1.0)), F.greatest("count", F.lit(1)).cast("double")
    shares = F.transform("ref_counts", lambda x: x / count)
    rest = 1 - F.aggregate("ref_counts", F.lit(0).cast("long"), lambda a, x: a + x) / count
    return both.select("lang", F.array(*[F.col(f"c{k}") / chars for k in range(n)]).alias("ref_class"), F.concat(shares, F.array(rest)).alias("ref_shares"))


def js_distance(counts: Column, shares: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of an array of counts from an array of shares; 0 without counts."""
    added = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    # The sum is made once, before the lambda that divides by it: inside, it would be made again for each element.
    parts = F.transform(F.array(added(counts)), lambda total: F.transform(counts, lambda c: F.when(total > 0, c / total)))[0]
    terms = F.zip_with(parts, shares, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.coalesce(F.sqrt(F.greatest(added(terms) / 2, F.lit(0.0))), F.lit(0.0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit(POOLED)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = materialize(learn_words(texts), "quality-words")
    # The joins are broadcast where the table of languages is small; else skew is left to AQE.
    refs = words.select("lang", "ref_words", any_of(F.col("ref_words")).alias("ref_pattern"))
    known = texts.join(refs, "lang", "left").withColumns({"ref_words": F.coalesce("ref_words", F.array().cast("array<string>")), "ref_pattern": F.coalesce("ref_pattern", F.lit("()"))})
    features = materialize(text_features(known), "quality-features")
    df = features.join(materialize(learn_shares(features, words), "quality-shares"), "lang")
    others = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    found = F.transform(F.concat("hits", F.array(others)), lambda x: x.cast("double"))
    df = df.withColumns({"class_distance": js_distance(F.transform("classes", lambda c: c.cast("double")), F.col("ref_class")), "word_distance": js_distance(found, F.col("ref_shares"))})
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    far = ((chars >= CLASS_CHARS) & (F.col("class_distance") > CLASS_LIMIT)) | ((F.col("n_words") >= WORD_WORDS) & (F.col("word_distance") > WORD_LIMIT))
    return df.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ~far).alias("kept"), F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"),
    )
