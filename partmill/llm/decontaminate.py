"""Benchmark decontamination: n-gram seeds join texts to test items, Smith-Waterman alignment scores the passage.

1.  The n-grams of the items are counted in the corpus.  An item's seeds are its rare n-grams; one is frequent if it would make
    more than ``FEW`` hits (occurrences x items with it) and more than ``FREQUENT`` of all n-grams that the corpus has.  A frequent n-gram is a seed
    only where no rare one shares a word with it, so every stretch of an item is covered, also of items that have no rare ones.
    An edit breaks the n-grams around it and no others.  Out of reach are copies without a run of ``n`` unedited words that
    holds a seed, for example those of which every second or third word is replaced.
2.  A text's seed hits are grouped by item and by diagonal.  Each group with hits from at least ``min_seeds`` seeds (fewer for
    items of few windows of ``window`` n-grams) whose region has words enough of the item for the threshold is aligned: local
    alignment of the item's words with that region of the text, match +2, mismatch -1, gap -1.  The score is the best
    alignment's over the perfect score (2 x item words).

Items of fewer than ``n`` words have no such seed: they are found wherever all their words stand in a row, with score 1.

The benchmark is compared in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters at most, each one broadcast: a
benchmark of any size is worked through, and what a worker holds is bounded: ``HITS`` at once, or those of one text and item.
Each block reads the texts twice, to count and to join; only texts go to the workers and only counts are shuffled.

Nulls: rows with a null or wordless text match nothing; items with a null, empty or wordless text are skipped.  Rows are
judged by their text alone, whatever their id is.  Repeated items or texts each give their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.llm.tables import columns_of, free_name
from partmill.llm.textcore import pieces, shingles, word_hashes

#: Test items compared in one pass over the texts, and characters of them: what is broadcast to a worker.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16 << 20
#: Characters of short texts that are compared together.
TOGETHER = 1 << 18
#: Seed hits that a worker holds at once.
HITS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, end) of the best local alignment of ``item`` in ``region``, by anti-diagonals in numpy.

    Of equal scores the one ending first in the region is taken."""
    m, k = len(item), len(region)
    before, last = np.zeros(m + 1, dtype=np.int32), np.zeros(m + 1, dtype=np.int32)  # diagonals d-2 and d-1, by item position
    start_before, start_last = np.zeros(m + 1, dtype=np.int32), np.zeros(m + 1, dtype=np.int32)
    best = (0, 0, 0)
    padded = np.concatenate([region, np.zeros(1, dtype=region.dtype)])
    for d in range(2, m + k + 1):
        lo, hi = max(1, d - k), min(m, d - 1)
        i = np.arange(lo, hi + 1)
        j = d - i
        same = item[i - 1] == padded[j - 1]
        step = before[i - 1] + np.where(same, MATCH, MISMATCH)
        from_start = np.where(before[i - 1] > 0, start_before[i - 1], j - 1)
        up, left = last[i - 1] + GAP, last[i] + GAP
        score = np.maximum(np.maximum(step, 0), np.maximum(up, left))
        start = np.where(score == step, from_start, np.where(score == up, start_last[i - 1], start_last[i]))
        before, start_before = last, start_last
        last, start_last = np.zeros(m + 1, dtype=np.int32), np.zeros(m + 1, dtype=np.int32)
        last[i], start_last[i] = score, start
        top = int(score.argmax())
        if score[top] > best[0] or score[top] == best[0] > 0 and int(j[top]) < best[2]:
            best = (int(score[top]), int(start[top]), int(j[top]))
    return best


def _verbatim(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    """The alignment of the first exact copy of ``item``, which no other beats; None without one."""
    m = len(item)
    for at in np.flatnonzero(region[: max(0, len(region) - m + 1)] == item[0]):
        if np.array_equal(region[at : at + m], item):
            return MATCH * m, int(at), int(at) + m
    return None


def _rare_seeds(grams: np.ndarray, item: np.ndarray, place: np.ndarray, hits: np.ndarray, most: float, n: int) -> np.ndarray:
    """Which n-grams (by item and place) are seeds: rare ones, and frequent ones that share no word with a rare one.

    One that the corpus does not have at all is no seed to rely on."""
    rare = (hits > 0) & (hits <= most)
    near = rare.copy()
    for d in range(1, n):
        # Places of an item follow each other, and an item's places are in order.
        same = (item[d:] == item[:-d]) & (place[d:] - place[:-d] == d)
        near[d:] |= same & rare[:-d]
        near[:-d] |= same & rare[d:]
    return rare | ~near


class _Block(NamedTuple):
    """Test items of one pass: their words and ids; seeds with the item and place of each; whole short items by length."""

    items: list[np.ndarray]
    ids: list[int | None]
    needed: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_pos: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def _count_seeds(seeds: np.ndarray, n: int):
    """Occurrences of each of ``seeds`` (sorted) in the texts; at the place -1, of all n-grams."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = np.zeros(len(seeds) + 1, dtype=np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in pieces(texts, TOGETHER):
                found, _ = shingles(*word_hashes(texts[lo:hi]), n)
                at = np.searchsorted(seeds, found)
                at[at == len(seeds)] = 0
                times[:-1] += np.bincount(at[seeds[at] == found], minlength=len(seeds))
                times[-1] += len(found)
        seen = np.flatnonzero(times)
        yield pd.DataFrame({"seed": np.where(seen == len(seeds), -1, seen), "n": times[seen]})

    return count


def _block_of(texts: list[str], ids: list[int | None], n: int, window: int, min_seeds: int, docs: DataFrame, frequent: float) -> _Block:
    """``docs`` (text): the corpus in which n-grams are counted."""
    words, offsets = word_hashes(texts)
    items = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    length = np.diff(offsets)
    short = {}
    for k in range(1, n):
        which = np.flatnonzero(length == k)
        if len(which):
            grams, _ = shingles(np.concatenate([items[i] for i in which]), np.arange(len(which) + 1) * k, k)
            order = np.argsort(grams, kind="stable")
            short[k] = grams[order], which[order]
    grams, begin = shingles(words, offsets, n)
    seed_item = np.repeat(np.arange(len(items)), np.diff(begin))
    seed_pos = np.arange(len(grams)) - begin[seed_item]
    long = np.flatnonzero(length[seed_item] >= n)
    needed = np.clip(np.diff(begin) // window, 1, min_seeds)
    if len(long):
        own, which, items_with = np.unique(grams[long], return_inverse=True, return_counts=True)
        times = np.zeros(len(own) + 1, dtype=np.int64)
        for row in docs.mapInPandas(_count_seeds(own, n), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
            times[row["seed"]] = row["n"]
        long = long[_rare_seeds(grams[long], seed_item[long], seed_pos[long], (times[:-1] * items_with)[which], max(frequent * times[-1], FEW), n)]
        needed = np.minimum(needed, np.maximum(np.bincount(seed_item[long], minlength=len(items)), 1))
    order = long[np.argsort(grams[long], kind="stable")]
    return _Block(items, ids, needed, grams[order], seed_item[order], seed_pos[order], short)


def _passages(block: _Block, n: int, threshold: float):
    lengths = np.array([len(w) for w in block.items], dtype=np.int64)

    def in_lot(words, offsets, begin, found, hit, seeds, seed_item, seed_pos) -> Iterator[tuple]:
        """(text, item, score, n_seeds, word_start, word_end) of the passages that ``hit`` (places of n-grams) seed."""
        first = np.searchsorted(seeds, found[hit], "left")
        times = np.searchsorted(seeds, found[hit], "right") - first
        which = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        hit = np.repeat(hit, times)
        if not len(hit):
            return
        owner = np.searchsorted(begin, hit, side="right") - 1
        place = hit - begin[owner]
        item, diagonal = seed_item[which], place - seed_pos[which]
        order = np.lexsort((diagonal, item, owner))
        owner, item, diagonal, which = owner[order], item[order], diagonal[order], which[order]
        # A group: one text and item, diagonals that go on within half the item's length.
        slack = np.maximum(lengths[item] // 2, 4)
        new = (np.diff(owner, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0) | (np.diff(diagonal, prepend=0) > slack)
        cuts = np.append(np.flatnonzero(new), len(new))
        group = np.cumsum(new) - 1
        distinct = np.unique(group * np.int64(len(seeds)) + which) // len(seeds)
        n_seeds = np.bincount(distinct, minlength=len(cuts) - 1)
        for g in np.flatnonzero(n_seeds >= block.needed[item[cuts[:-1]]]):
            a, b = cuts[g], cuts[g + 1]
            d, it = owner[a], item[a]
            text_words, own = words[offsets[d] : offsets[d + 1]], block.items[it]
            room = lengths[it] // 2 + 4
            # Diagonals can go on for long in a text that repeats a passage: the region then has as many items' lengths.
            left = max(0, int(diagonal[a]) - room)
            region = text_words[left : max(0, int(diagonal[b - 1])) + lengths[it] + room]
            least = threshold * MATCH * lengths[it]
            # No alignment scores more than a match of every word that the region has.
            if MATCH * np.isin(own, region).sum() < least:
                continue
            score, start, end = _verbatim(own, region) or align(own, region)
            if score >= least:
                yield int(d), int(it), score / (MATCH * int(lengths[it])), int(n_seeds[g]), int(left + start), int(left + end)

    def seeded(words, offsets) -> Iterator[tuple]:
        found, begin = shingles(words, offsets, n)
        times = np.searchsorted(block.seeds, found, "right") - np.searchsorted(block.seeds, found, "left")
        every = np.flatnonzero(times)
        if not len(every):
            return
        owner = np.searchsorted(begin, every, side="right") - 1
        # Whole texts whose hits are held at once; one text's hits beyond that are taken an item class at a time.
        lots = np.cumsum(times[every]) // HITS
        ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
        ends = ends[np.diff(lots[ends - 1], append=-1) != 0]
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            hit = every[a:b]
            classes = 1 + int(times[hit].sum()) // (2 * HITS)
            for k in range(classes):
                own = slice(None) if classes == 1 else block.seed_item % classes == k
                yield from in_lot(words, offsets, begin, found, hit, block.seeds[own], block.seed_item[own], block.seed_pos[own])

    def whole(words, offsets) -> Iterator[tuple]:
        for k, (keys, which) in block.short.items():
            found, begin = shingles(words, offsets, k)
            hit = np.flatnonzero(np.isin(found, keys))
            owner = np.searchsorted(begin, hit, side="right") - 1
            # The first place of each short item in each text.
            _, at = np.unique(np.stack([owner.astype(np.uint64), found[hit]]), axis=1, return_index=True)
            for h, d in zip(hit[at], owner[at], strict=True):
                if offsets[d + 1] - offsets[d] >= k:
                    start = int(h - begin[d])
                    for it in which[np.searchsorted(keys, found[h], "left") : np.searchsorted(keys, found[h], "right")]:
                        yield int(d), int(it), 1.0, 1, start, start + k

    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts = column.tolist()
            out: list[list[dict]] = [[] for _ in texts]
            for lo, hi in pieces(texts, TOGETHER):
                words, offsets = word_hashes(texts[lo:hi])
                best: dict[tuple[int, int], tuple] = {}
                for d, it, *rest in chain(seeded(words, offsets), whole(words, offsets)):
                    # Of a text's passages of one item the best stays, of equal ones the first.
                    if (d, it) not in best or (rest[0], -rest[2], -rest[3]) > (best[d, it][0], -best[d, it][2], -best[d, it][3]):
                        best[d, it] = tuple(rest)
                for (d, it), rest in best.items():
                    out[lo + d].append(dict(zip(_FIELDS, (block.ids[it], *rest), strict=True)))
            yield pd.Series(out, dtype=object)

    return match


_FIELDS = ("item_id", "score", "n_seeds", "word_start", "word_end")
_PASSAGES = "array<struct<item_id:long,score:double,n_seeds:long,word_start:long,word_end:long>>"
#: Hits that are never too many.
FEW = 1000
#: Words of a seed, windows, seeds needed, the least share of a perfect score, and the hits of a rare seed, as a share of all n-grams.
N_WORDS, N_WINDOW, MIN_SEEDS, THRESHOLD, FREQUENT = 3, 4, 2, 0.5, 1e-4


def leak_columns(
    docs: DataFrame, text: Column, benchmark: DataFrame, n: int = N_WORDS, window: int = N_WINDOW, min_seeds: int = MIN_SEEDS, threshold: float = THRESHOLD, frequent: float = FREQUENT
) -> Iterator[Column]:
    """For each block of ``benchmark`` (item_id, text) the array of the passages of ``text``, a column of ``docs``, that align with its
    items: the best of each item."""
    corpus = docs.select(text.alias("text")).where("text is not null")
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    for k in range(n_blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
        block = _block_of([r["text"] for r in rows], [r["item_id"] for r in rows], n, window, min_seeds, corpus, frequent)
        if len(block.seeds) or block.short:
            yield F.pandas_udf(_passages(block, n, threshold), _PASSAGES).asNondeterministic()(text)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, window: int = N_WINDOW, min_seeds: int = MIN_SEEDS, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, word_start, word_end): every text passage that aligns with a test item at
    ``threshold`` or more of the perfect score, the best passage of each (text row, item); words count from 0, end exclusive."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long, word_start long, word_end long")
    for found in leak_columns(given, F.col("text"), benchmark, n, window, min_seeds, threshold):
        out = out.unionByName(given.select("doc_id", found.alias("found")).select("doc_id", F.inline("found")))
    return out


def leaks_per_item(found: DataFrame) -> DataFrame:
    """The best passage of each document id and item id (ties: the first in the text), where rows or items share ids."""
    best = F.max_by(F.struct("score", "n_seeds", "word_start", "word_end"), F.struct("score", -F.col("word_start"), -F.col("word_end")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no passage of the benchmark, with all their columns; ids play no part."""
    name, own, left = free_name(docs, "_passages"), columns_of(docs), docs
    for found in leak_columns(docs, F.col(text_col), benchmark):
        left = left.withColumn(name, found).where(F.size(name) == 0).select(own)
    return left
