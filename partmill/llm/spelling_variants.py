"""Spelling variants: words one edit apart, found by a positional q-gram index, and the more frequent form of each.

Words are maximal runs of Latin letters (A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased) of at least ``MIN_LENGTH``
code points that occur at least ``MIN_COUNT`` times.  Two are *near* if exactly one code point is inserted, deleted or replaced.

Index, count filter, verification
---------------------------------
Words of length l meet those of l and l + 1, in the class l.  A word's *posting grams* are three disjoint positional ones, a third of l
long: at the start, after it, and at the end.  One edit spoils at most one of them, and the middle one of a longer word stands where it
would or one further.  So near words share two posting grams at places that fit, and

1.  each word is posted under each two of its posting grams, in its own class and in that of the words shorter by one;
2.  postings are shuffled by their two grams, sorted, and merged in streams: the words of a list meet, those of length l first;
3.  pairs met are counted on all their padded positional 2-grams.  An edit spoils two of them, so near words, the longer of length m,
    share at least m - 1 at the same place (or the next, where lengths differ).  Rows of grams are packed a byte to a gram, and
    the equal bytes of two rows are counted in whole machine words; chance can only add to a count;
4.  those at or above the bound are verified by common prefix and suffix, and kept at the first list under which they meet, so no
    pair is counted twice and nothing is removed later.

The form of a word is its near word of largest count (ties: smallest by code point) if that is at least ``TIMES`` times the word's
own; the root is where the forms lead.  Counts grow by ``TIMES`` at each step, so chains are short, and doubling ends them soon.

Nulls: a null text has no words; a null id counts as an empty one.  Repeated rows count again.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.textcore import mix
from partmill.sources.storage import materialize

#: Least length and occurrences of a word, how many times more frequent a form is; a document deletes a letter of one word in so many.
MIN_LENGTH, MIN_COUNT, TIMES, DELETES = 7, 2, 10, 31
#: Words that a task counts before it passes them on; words posted and pairs compared at once.
HELD_WORDS, POSTED, PAIRS = 500_000, 20_000, 1 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
def _count_words(min_length: int, deletes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for lo in range(0, len(words), 50_000):
                own = words[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in own], pa.string()), pa.array([held[w] for w in own], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Latin-1 has a byte for each letter; what it lacks ends a run.
                for word, n in Counter(w for w in text.encode("latin-1", "replace").translate(_LOWER).split() if len(w) >= min_length).items():
                    if deletes:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % deletes == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield from flush()
                held.clear()
        yield from flush()

    return count


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, deletes: int = DELETES) -> DataFrame:
    """(word, n) of the words of all texts.  ``deletes``: of how many words of a document one loses a letter, chosen by a hash of
    id and word; 0 for none."""
    given = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    found = given.mapInArrow(_count_words(min_length, deletes), "word string, n long")
    return materialize(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "spelling-words")


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, letters in a row each) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, np.frombuffer(b"".join([words[i] for i in at]), dtype=np.uint8).reshape(len(at), size)


def _hash(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(letters), dtype=np.uint64)
    for column in letters.T:
        out = mix(out + column)
    return out


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every, counts = [w.encode("latin-1") for w in batch.column("word").to_pylist()], batch.column("n").to_numpy()
        for lo in range(0, len(every), POSTED):
            words, n = np.array(every[lo : lo + POSTED], dtype=object), counts[lo : lo + POSTED]
            for size, at, letters in _by_length(words.tolist()):
                own = pa.array(words[at].tolist(), pa.binary())
                for longer in (0, 1):
                    length = size - longer
                    q = length // 3
                    first, last = _hash(letters[:, :q]), _hash(letters[:, size - q :])
                    middle = [_hash(letters[:, q + k : 2 * q + k]) for k in ((0, 1) if longer else (0, 0))]
                    for kind, (a, b) in enumerate(((first, middle[0]), (first, last), (middle[-1], last))):
                        key = mix(mix(a + np.uint64(3 * length + kind)) ^ b)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), length)), pa.array(key.view(np.int64)), pa.array(np.full(len(at), kind)), pa.array(np.full(len(at), bool(longer))), own, pa.array(n[at])],
                            names=["class", "grams", "kind", "longer", "word", "n"],
                        )


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _packed_grams(letters: np.ndarray) -> np.ndarray:
    """The padded 2-grams of words of one length, a row each and a byte to a gram."""
    padded = np.pad(letters, ((0, 0), (1, 1))).astype(np.uint16)
    return ((padded[:, :-1] * 167 + padded[:, 1:] * 59) >> 1).astype(np.uint8)


def _as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of 64-bit words, zeros at the end."""
    width = -(-rows.shape[1] // 8) * 8
    return np.ascontiguousarray(np.ascontiguousarray(np.pad(rows, ((0, 0), (0, width - rows.shape[1])))).view(np.uint64).T)


def _equal_bytes(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """In how many of ``width`` bytes the rows i of ``a`` and j of ``b`` are equal."""
    out = np.zeros(len(i), dtype=np.int64)
    for x, y in zip(a, b, strict=True):
        differ = x[i] ^ y[j]
        differ = (((differ & _LOW) + _LOW) | differ) & _HIGH
        out += np.bitwise_count(differ)
    return width - out


class _Class:
    """Postings of one class, in order; words of the class's length and longer ones by one."""

    def __init__(self, size: int, words: list[bytes], longer: np.ndarray):
        self.size, self.longer = size, longer
        row = np.frombuffer(b"".join(w.ljust(size + 1, b"\0") for w in words), dtype=np.uint8).reshape(len(words), size + 1)
        self.letters = row
        start, end = np.zeros((len(words), size + 1), dtype=np.uint8), np.zeros((len(words), size + 1), dtype=np.uint8)
        start[~longer] = _packed_grams(row[~longer, :size])
        both = _packed_grams(row[longer])
        start[longer], end[longer] = both[:, :-1], both[:, 1:]
        self.start, self.end = _as_words(start), _as_words(end)

    def near(self, i: np.ndarray, j: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which pairs are near and meet here first; i are of the class's length, j of that or longer."""
        size, q = self.size, self.size // 3
        more = self.longer[j]
        shared = _equal_bytes(self.start, self.start, i, j, size + 1)
        cross = np.flatnonzero(more)
        shared[cross] += _equal_bytes(self.start, self.end, i[cross], j[cross], size + 1)
        kept = np.flatnonzero(shared >= size - 1 + more)
        i, j, more, kind = i[kept], j[kept], more[kept], kind[kept]
        a, b = self.letters[i, :size], self.letters[j]
        # Verified: common prefix and suffix cover all but one letter of the longer word.
        same = a == b[:, :size]
        prefix = np.cumprod(same, axis=1, dtype=np.int64).sum(axis=1)
        suffix = np.cumprod(np.where(more[:, None], a == b[:, 1:], same)[:, ::-1], axis=1, dtype=np.int64).sum(axis=1)
        ok = (prefix + suffix >= size - 1 + more) & (more | (prefix < size))
        # The first list: that of the first two grams, then that of the outer ones.
        met = np.where(kind == 1, same[:, q : 2 * q].all(axis=1), np.where(kind == 2, same[:, :q].all(axis=1), False))
        return kept[ok & ~met]


def _near_of(size: int, grams: np.ndarray, kind: np.ndarray, longer: np.ndarray, words: list[bytes], counts: np.ndarray, old: int) -> Iterator[pa.RecordBatch]:
    """Near pairs of sorted postings of a class; the first ``old``, of one list, have already met each other."""
    ends = np.searchsorted(grams, grams, side="right")
    left = np.flatnonzero(~longer)
    lo = np.maximum(left + 1, np.where(grams[left] == grams[0], old, 0)) if old else left + 1
    many = np.maximum(ends[left] - lo, 0)
    if not many.sum():
        return
    held, total, at = _Class(size, words, longer), np.cumsum(many), 0
    step = max(1, PAIRS * 16 // max(16, size))
    while at < len(left):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        n = many[at:until]
        offset = np.repeat(lo[at:until] - (np.cumsum(n) - n), n)
        i, j = np.repeat(left[at:until], n), offset + np.arange(len(offset))
        found = held.near(i, j, kind[i])
        at = until
        if len(found):
            i, j = i[found], j[found]
            a, b = ([words[k].decode("latin-1") for k in x.tolist()] for x in (i, j))
            yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(np.concatenate([counts[i], counts[j]])), pa.array(np.concatenate([counts[j], counts[i]]))], names=["word", "near", "n", "near_n"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        old = held.num_rows if held is not None else 0
        if held is not None:
            table = pa.concat_tables([held, table])
        size, grams, kind, longer, counts = (table.column(c).to_numpy() for c in ("class", "grams", "kind", "longer", "n"))
        words = table.column("word").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield from _near_of(int(size[lo]), grams[lo:hi], kind[lo:hi], longer[lo:hi], words[lo:hi], counts[lo:hi], old if lo == 0 else 0)
        # What the next postings can still meet: the last list.
        last = cuts[-2] + int(np.searchsorted(grams[cuts[-2] :], grams[-1]))
        held = table.slice(last).combine_chunks()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n, near_n): every near pair of ``words`` (word, n), both ways."""
    posts = words.mapInArrow(_post, "class long, grams long, kind long, longer boolean, word binary, n long")
    dealt = posts.repartition("grams", "class").sortWithinPartitions("class", "grams", "longer")
    return dealt.mapInArrow(_merge, "word string, near string, n long, near_n long")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), which has no cycle: where the forms of each word lead."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(ahead, "root", "left")
        now = materialize(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    met = near_words(words).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best)
    has = F.col("best.near_n") >= F.lit(times) * F.col("n")
    met = materialize(met.select("word", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("best.near_n")).alias("form_n")), "spelling-near")
    roots = follow_forms(met.where("form is not null"))
    return words.join(met, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
