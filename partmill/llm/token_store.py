"""Token ids in bit-plane shards: documents are encoded in id order, their ids transposed into planes and compressed.

File format of a shard (all integers little-endian)
---------------------------------------------------
``PMPLANE1``, then blocks, then the footer, its length (8 bytes) and ``PMPLANE1`` again.

A block holds ``BLOCK_IDS`` ids (the last one fewer).  The ids are transposed into planes: plane k holds bit k of every id
(``bit``, packed eight to a byte) or byte k of every id (``byte``).  Planes above the highest one in use are left out; each
other is one zstandard frame.  The footer, itself one zstandard frame, is the chunk index: plane kind, number of
documents, blocks and ids, then for each block its offset, ids, crc32 and the sizes of its planes, then for each document
its id, whether that is null, and the end of its ids in the shard.  So any document is read from the blocks it lies in.

Plan
----
Texts are range-partitioned by document id (ties: by hash of the text, so rows sharing an id are spread) and sorted;
every task encodes and writes its own shards, a few blocks in memory at a time, and returns a row for each shard.  The
global position of a shard is the sum of the ids in those before it: a window over one row a shard.  A shard's name is
new for each attempt, and only shards named in the written manifest are ever read, so lost or doubled tasks do no harm.

Null texts are empty: they have the end id only.  Rows with a null id come first.  Rows sharing an id follow each other in
the order of their text's hash.  An empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partmill.llm.textcore import pieces
from partmill.sources import blobs
from partmill.sources.storage import materialize, shared_path

MAGIC = b"PMPLANE1"
#: Ids of a block, and ids and documents after which a task begins another shard.
BLOCK_IDS, SHARD_IDS, SHARD_DOCS = 1 << 16, 1 << 24, 1 << 20
#: Rows that a reader returns together.
READ_ROWS = 1 << 16
#: Words whose ids a worker remembers, and characters of short texts that are encoded together.
REMEMBERED, TOGETHER = 150_000, 1 << 18

#: Of a byte: letter 1, digit 2, symbol other than an apostrophe 3, anything else 0.
_KIND = np.zeros(256, dtype=np.uint8)
for _a, _b, _k in ((33, 38, 3), (40, 47, 3), (48, 57, 2), (58, 64, 3), (65, 90, 1), (91, 96, 3), (97, 122, 1), (123, 126, 3)):
    _KIND[_a : _b + 1] = _k
#: Of a byte: whether it is no white space.
_SOLID = np.ones(256, dtype=bool)
_SOLID[[*range(9, 14), 32]] = False
_MARK = regex.compile(r"\p{M}")
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: How a tokenizer must split for its words to be encoded one by one.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(path: str) -> bool:
    """Whether the tokenizer lower-cases and encodes runs of letters, digits and runs of symbols each for itself, and looks for
    its added tokens in the raw text only."""
    with open(path) as f:
        model = json.load(f)
    steps = lambda x: x.get("normalizers") or x.get("pretokenizers") or [x]
    normal, split = steps(model["normalizer"] or {}), steps(model["pre_tokenizer"] or {})
    if any(t["normalized"] for t in model["added_tokens"]):
        return False
    return [x.get("type") for x in normal] == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": _WORDS} and split[0].get("behavior") == "Removed"


class WordEncoder:
    """Ids of whole texts, remembering the ids of words.

    A tokenizer that ``splits_words`` never joins across white space nor between ASCII letters, digits and symbols, so a
    text's ids are those of such words end to end.  Words are looked up in lower case, but in texts with combining marks:
    there composing comes before lower-casing and can change its outcome.  A text that holds an added token, and every text
    of any other tokenizer, is encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.remembered, self.by_word = remembered, splits_words(path)
        # For a word of lower-case letters, normalising and splitting change nothing.
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain.model._resize_cache(0)
        # Whether an id ends a word.
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix) and t not in self.added]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.begin, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keeps the words used most."""
        words = list(self.number)
        keep = np.flatnonzero(self.uses >= max(3, np.partition(self.uses, -self.remembered // 3)[-self.remembered // 3]))
        size = np.diff(self.begin)[keep]
        at = np.repeat(self.begin[keep] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.ids, self.uses = self.ids[at], self.uses[keep] // 2
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.number = {words[k]: i for i, k in enumerate(keep)}

    @staticmethod
    def _each(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters as those of one text, parted where an id ends a word; each for itself if that parts
        them otherwise."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids])
        if len(ends) != len(words) or ends[-1] != len(ids) - 1:
            return self._each(self.plain, words)
        return ids, np.diff(ends, prepend=-1)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """The numbers that ``words`` get."""
        texts = [w.decode() for w in words]
        plain = np.array([bool(_PLAIN.fullmatch(t)) for t in texts])
        order = np.argsort(plain, kind="stable")
        words, texts, split = [words[k] for k in order], [texts[k] for k in order], len(plain) - int(plain.sum())
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(len(self.number), len(self.number) + len(words))
        found = [self._each(self.tokenizer, texts[lo : min(lo + 4096, split)]) for lo in range(0, split, 4096)]
        found += [self._together(texts[lo : lo + 4096]) for lo in range(split, len(texts), 4096)]
        flat, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        return numbers

    def _encode_some_whole(self, texts: Sequence[str | None], whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)]
        rest, counts = self.encode([None if k in set(whole) else t for k, t in enumerate(texts)]) if len(whole) < len(texts) else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        parts = np.split(rest, np.cumsum(counts)[:-1])
        for k, ids in zip(whole, found, strict=True):
            parts[k], counts[k] = ids, len(ids)
        return np.concatenate(parts), counts

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has."""
        whole = [k for k, t in enumerate(texts) if t and (not self.by_word or any(x in t for x in self.added))]
        if whole:
            return self._encode_some_whole(texts, whole)
        words, per_text = self._words(texts)
        distinct, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.number) > self.remembered:
            self._shrink()
        # Each distinct word is looked up once; all else is done for whole arrays.
        known = np.array([self.number.get(w, -1) for w in distinct], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self._learn([distinct[k] for k in new])
        self.uses[known] += np.bincount(which, minlength=len(distinct))
        begin = self.begin[known]
        size = (self.begin[known + 1] - begin)[which]
        ends = np.cumsum(size)
        at = np.repeat(begin[which] - (ends - size), size) + np.arange(int(size.sum()))
        return self.ids[at], np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])])

    @staticmethod
    def _words(texts: Sequence[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, end to end, and how many each has."""
        raw = []
        for text in texts:
            own = text.encode() if text else b""
            # Below U+0300 there are no marks.
            marked = text and not text.isascii() and np.frombuffer(own, dtype=np.uint8).max() >= 0xCC and _MARK.search(text)
            raw.append(own if marked else own.lower())
        a = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        kind, solid = _KIND[a], _SOLID[a]
        left, right = kind[:-1], kind[1:]
        first = solid.copy()
        first[1:] &= ~solid[:-1] | ((left != 0) & (right != 0) & ((left != right) | (left == 2)))
        data, offsets = a[solid], np.flatnonzero(first[solid])
        words = pa.Array.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(np.append(offsets, len(data)).astype(np.int32)), pa.py_buffer(data)])
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
        return words.dictionary_encode(), np.diff(np.searchsorted(np.flatnonzero(first), bounds))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker and tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block, lowest first, up to the highest in use."""
    width = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [octets[:, k].tobytes() for k in range(-(-width // 8))]
    narrow = ids.astype("<u2") if width <= 16 else ids.astype("<u4")
    bits = np.unpackbits(narrow.view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little", count=width) if width else np.zeros((len(ids), 0), np.uint8)
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    out = np.zeros((n, 32 if kind == "bit" else 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        a = np.frombuffer(plane, dtype=np.uint8)
        out[:, k] = np.unpackbits(a, count=n, bitorder="little") if kind == "bit" else a
    octets = np.packbits(out, axis=1, bitorder="little") if kind == "bit" else out
    return octets.view("<u4").reshape(n).astype(np.uint32)


class ShardWriter:
    """Writes one shard; ids may come in any portions."""

    def __init__(self, uri: str, kind: str = "bit", block_ids: int = BLOCK_IDS, level: int = 3):
        self.uri, self.kind, self.block_ids = uri, kind, block_ids
        self.file, self.zstd = blobs.create(uri), zstandard.ZstdCompressor(level=level)
        self.file.write(MAGIC)
        self.at, self.held, self.n_held, self.n_ids = len(MAGIC), [], 0, 0
        self.blocks: list[tuple] = []
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.ends: list[np.ndarray] = []

    def add(self, doc_ids: Sequence[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.nulls += [d is None for d in doc_ids]
        self.doc_ids += [0 if d is None else d for d in doc_ids]
        self.ends.append(self.n_ids + np.cumsum(counts))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            joined = np.concatenate(self.held)
            whole = len(joined) // self.block_ids * self.block_ids
            for lo in range(0, whole, self.block_ids):
                self._block(joined[lo : lo + self.block_ids])
            self.held, self.n_held = [joined[whole:].copy()], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append((self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [len(f) for f in frames]))
        for frame in frames:
            self.file.write(frame)
            self.at += len(frame)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        parts = [struct.pack("<BQQQ", self.kind == "bit", len(self.doc_ids), len(self.blocks), self.n_ids)]
        parts += [struct.pack(f"<QIIB{len(sizes)}I", at, n, crc, len(sizes), *sizes) for at, n, crc, sizes in self.blocks]
        parts += [np.array(self.doc_ids, "<i8").tobytes(), np.array(self.nulls, np.uint8).tobytes(), (np.concatenate(self.ends) if self.ends else np.zeros(0)).astype("<i8").tobytes()]
        footer = self.zstd.compress(b"".join(parts))
        self.file.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.file.close()


class ShardReader:
    """Random access to the documents of a shard, a block in memory at a time."""

    def __init__(self, uri: str):
        self.file = blobs.open_random(uri)
        end = self.file.size()
        self.file.seek(end - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a whole shard")
        (size,) = struct.unpack("<Q", tail[:8])
        self.file.seek(end - 16 - size)
        footer = zstandard.ZstdDecompressor().decompress(self.file.read(size))
        bit, n_docs, n_blocks, self.n_ids = struct.unpack_from("<BQQQ", footer)
        self.kind, at, self.blocks = "bit" if bit else "byte", struct.calcsize("<BQQQ"), []
        for _ in range(n_blocks):
            place, n, crc, width = struct.unpack_from("<QIIB", footer, at)
            at += struct.calcsize("<QIIB")
            self.blocks.append((place, n, crc, struct.unpack_from(f"<{width}I", footer, at)))
            at += 4 * width
        self.doc_ids = np.frombuffer(footer, "<i8", n_docs, at)
        self.nulls = np.frombuffer(footer, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.ends = np.frombuffer(footer, "<i8", n_docs, at + 9 * n_docs)
        self.block_starts = np.concatenate([[0], np.cumsum([n for _, n, _, _ in self.blocks])]).astype(np.int64)
        self._last: tuple[int, np.ndarray] | None = None

    def block(self, k: int) -> np.ndarray:
        if self._last is None or self._last[0] != k:
            at, n, crc, sizes = self.blocks[k]
            self.file.seek(at)
            unzip, planes = zstandard.ZstdDecompressor(), []
            for size in sizes:
                planes.append(unzip.decompress(self.file.read(size)))
            ids = from_planes(planes, n, self.kind)
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {k} is damaged")
            self._last = (k, ids)
        return self._last[1]

    def runs(self, i: int) -> Iterator[np.ndarray]:
        """The ids of document ``i`` in runs, one for each block it lies in."""
        lo, hi = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        while lo < hi:
            k = int(np.searchsorted(self.block_starts, lo, side="right")) - 1
            until = min(hi, int(self.block_starts[k + 1]))
            start = int(self.block_starts[k])
            yield self.block(k)[lo - start : until - start]
            lo = until

    def ids(self, i: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.runs(i)])


def _writer(folder: str, tokenizer: str, end_id: int, kind: str, block_ids: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, seq = TaskContext.get().partitionId(), None, 0
        encode = encoder(tokenizer).encode
        done = lambda s: pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": s.uri, "n_docs": len(s.doc_ids), "n_ids": s.n_ids}])
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi in pieces(texts, TOGETHER):
                ids, counts = encode(texts[lo:hi])
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                shard = shard or ShardWriter(f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids", kind, block_ids)
                shard.add(doc_ids[lo:hi], ids, counts)
                if shard.n_ids >= shard_ids or len(shard.doc_ids) >= SHARD_DOCS:
                    shard.close()
                    yield done(shard)
                    shard, seq = None, seq + 1
        if shard:
            shard.close()
            yield done(shard)

    return write


def write_token_shards(
    docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte",
    block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encodes and writes ``docs``; the manifest: (path, n_docs, n_ids, first: ids in the shards before it)."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("row"))
    # The row number spreads rows that are alike in all else; which of them comes first makes no difference.
    ordered = given.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    folder = shared_path(spark, "token-shards")
    written = ordered.mapInArrow(_writer(folder, tokenizer, end_id, kind, block_ids, shard_ids), "part long, seq long, path string, n_docs long, n_ids long")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = materialize(written, "token-manifest")
    return materialize(manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("part", "seq"), "token-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """One shard a task, about: the manifest's own partitions are few."""
    return manifest.repartition(max(1, min(manifest.count(), 20_000)))


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document; the ids of a document must fit in a worker."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, first in zip(pdf["path"], pdf["first"], strict=True):
                shard = ShardReader(path)
                for i in range(len(shard.ends)):
                    start = int(first) + (int(shard.ends[i - 1]) if i else 0)
                    yield pd.DataFrame({"doc_id": pd.array([None if shard.nulls[i] else int(shard.doc_ids[i])], "Int64"), "start": [start], "ids": [shard.ids(i).astype(np.int64)]})

    return _spread(manifest).mapInPandas(read, "doc_id long, start long, ids array<long>")


def read_token_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, first in zip(pdf["path"], pdf["first"], strict=True):
                shard = ShardReader(path)
                crcs = np.zeros(len(shard.ends), dtype=np.int64)
                for i in range(len(shard.ends)):
                    crc = 0
                    for run in shard.runs(i):
                        crc = zlib.crc32(run.astype("<u4").tobytes(), crc)
                    crcs[i] = crc
                counts = np.diff(shard.ends, prepend=0)
                doc_ids = pd.array(shard.doc_ids, dtype="Int64")
                doc_ids[shard.nulls] = pd.NA
                rows = pd.DataFrame({"doc_id": doc_ids, "start": int(first) + shard.ends - counts, "n_tokens": counts, "ids_crc32": crcs})
                yield from (rows.iloc[lo : lo + READ_ROWS] for lo in range(0, len(rows), READ_ROWS))

    return _spread(manifest).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
