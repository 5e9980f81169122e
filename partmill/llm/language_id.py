"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 characters, words padded with ``_``), most frequent
first, ties by code point.  A document's distance to a language is the sum over its own profile of how many places each
n-gram is out of place in the language's profile; an absent one counts as the profile's length.  The nearest language
wins, ties by name.

The score is 1 - distance / (largest possible distance), so 1 means the same order and 0 nothing in common.  A null, empty
or letterless text is ``und`` with score 0, and so is every text where no language could be learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.llm.textcore import pieces

UNKNOWN = "und"
#: N-grams of a language profile and of a document profile.
PROFILE, DOCUMENT_PROFILE = 400, 300
#: Documents of one language that are learned from, about: a hash of id and text chooses them.
TRAIN_DOCS_PER_LANG = 3000
_PAD = 0x5F
#: Characters whose n-grams are counted at once, and of all texts that are ranked together.
_PART, _TOGETHER = 1 << 17, 1 << 18
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code of each character of the basic plane: itself for a letter, else 0."""
    if not _LETTERS:
        _LETTERS.append(np.array([c if chr(c).isalpha() else 0 for c in range(1 << 16)], dtype=np.uint16))
    return _LETTERS[0]


def _codes(units: np.ndarray) -> np.ndarray:
    """The code of each UTF-16 unit; the two units of a letter beyond the basic plane keep theirs, other pairs have none."""
    code = _letters()[units]
    high = np.flatnonzero((units[:-1] & 0xFC00) == 0xD800)
    high = high[(units[high + 1] & 0xFC00) == 0xDC00]
    if len(high):
        points, at = np.unique(0x10000 + ((units[high].astype(np.int64) & 0x3FF) << 10) + (units[high + 1] & 0x3FF), return_inverse=True)
        letter = high[np.array([chr(p).isalpha() for p in points])[at]]
        code[letter], code[letter + 1] = units[letter], units[letter + 1]
    return code


def _ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram code, count) of every distinct n-gram of every text, ordered by text and code."""
    units = [np.frombuffer(f" {t.lower()} ".encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in (x or "" for x in texts)]
    owner = np.repeat(np.arange(len(texts), dtype=np.uint16), [len(u) for u in units])
    code = _codes(np.concatenate(units)) if units else np.zeros(0, dtype=np.uint16)
    code[code == 0] = _PAD
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != _PAD) | (code[:-1] != _PAD) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    s, keys, counts = np.uint64(16), [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(code), _PART):
        # The n-grams that end in this part.
        begin = max(lo - 2, 0)
        c, o = code[begin : lo + _PART].astype(np.uint64), owner[begin : lo + _PART].astype(np.uint64) << (s * np.uint64(3))
        letter, new = c != _PAD, np.arange(len(c)) >= lo - begin
        one = letter & new
        found = [o[one] | (c[one] << (s + s))]
        two = (o[:-1] == o[1:]) & new[1:]
        found.append((o[:-1] | (c[:-1] << (s + s)) | (c[1:] << s))[two])
        three = (o[:-2] == o[2:]) & letter[1:-1] & new[2:]
        found.append((o[:-2] | (c[:-2] << (s + s)) | (c[1:-1] << s) | c[2:])[three])
        distinct, times = np.unique(np.concatenate(found), return_counts=True)
        keys.append(distinct)
        counts.append(times)
    joined = np.concatenate(keys)
    if len(keys) == 2:  # one part
        return (joined >> (s * np.uint64(3))).astype(np.int64), joined & np.uint64((1 << 48) - 1), counts[1]
    order = np.argsort(joined, kind="stable")
    joined = joined[order]
    first = np.flatnonzero(np.diff(joined, prepend=~joined[:1]))
    total = np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    return (joined[first] >> (s * np.uint64(3))).astype(np.int64), joined[first] & np.uint64((1 << 48) - 1), total


def _ranked(texts: list[str | None], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, rank from 0) of each text's most frequent n-grams."""
    owner, gram, count = _ngram_counts(texts)
    order = np.lexsort((gram, -count, owner))
    owner, gram = owner[order], gram[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = rank < limit
    return owner[top], gram[top], rank[top]


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            texts = part["text"].tolist()
            for lo, hi in pieces(texts, _TOGETHER):
                _, gram, count = _ngram_counts(texts[lo:hi])
                grams, at = np.unique(gram, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": np.bincount(at, count, len(grams)).astype(np.int64)})


def learn_profiles(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE, per_lang: int = TRAIN_DOCS_PER_LANG, id_col: str = "doc_id"
) -> dict[str, list[int]]:
    """Language -> its n-gram codes by rank, from about ``per_lang`` documents a language.

    A hash of id and text chooses them, so that copies of a text are drawn like any documents; that with the smallest hash is
    always among them, so every language of which one text has a letter is learned.  Rows with a null language or without a
    letter are skipped.  Rows alike in id and text are drawn together.  Only the profiles come to the driver."""
    own = F.col(id_col) if id_col in labelled.columns else F.lit(None).cast("long")
    drawn = F.pmod(F.xxhash64(own, F.col(text_col)), F.lit(1 << 40)) / float(1 << 40)
    known = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), drawn.alias("drawn")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # One share for all languages would starve the rare ones; a row for each language with more than ``per_lang`` documents.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("drawn").alias("least")).where(F.col("n") > per_lang).collect()
    large = {r["lang"]: max(per_lang / r["n"], r["least"]) for r in sizes}
    share = F.try_element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), F.col("lang")) if large else F.lit(None).cast("double")
    chosen = known.where(F.col("drawn") <= F.coalesce(share, F.lit(1.0))).select("lang", "text")
    counts = chosen.mapInPandas(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def _predictor(profiles: dict[str, list[int]]):
    langs = sorted(profiles)
    tables = []
    for lang in langs:
        grams = np.array(profiles[lang], dtype=np.uint64)
        order = np.argsort(grams)
        tables.append((grams[order], order))

    def best_of(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        owner, gram, rank = _ranked(texts, DOCUMENT_PROFILE)
        size = np.bincount(owner, minlength=n)
        near = np.full((len(langs), n), np.inf)
        for k, (grams, place) in enumerate(tables):
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            away = np.where(grams[at] == gram, np.minimum(np.abs(place[at] - rank), len(grams)), len(grams))
            near[k] = np.bincount(owner, away, n) / np.maximum(size * len(grams), 1)
        best = near.argmin(axis=0) if langs else np.zeros(n, dtype=int)
        known = (size > 0) & bool(langs)
        return [langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, 1 - near.min(axis=0, initial=1.0), 0.0)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = column.tolist()
            found = [best_of(texts[lo:hi]) for lo, hi in pieces(texts, _TOGETHER)]
            yield pd.DataFrame({"lang": [x for names, _ in found for x in names], "score": np.concatenate([np.zeros(0), *[x for _, x in found]])})

    return predict


def language_of(text: Column, profiles: dict[str, list[int]]) -> Column:
    """``struct<lang, score>`` of a text; the whole text counts.  Only the text goes to the worker, and only this comes back."""
    # Not deterministic for the optimizer: a filter on the result must not be pushed below it and work it out again.
    return F.pandas_udf(_predictor(profiles), "lang string, score double").asNondeterministic()(text)


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ``lang_pred`` and ``score`` (0 to 1) of every row; the carried columns stay as they are."""
    found = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], language_of(F.col(text_col), profiles).alias("_found"))
    return found.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
