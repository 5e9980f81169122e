"""Byte-level BPE by dynamic programming over prefixes: encoding to exact ids, and decoding.

Every prefix of a word has one BPE encoding, so one last token.  It is the only token that ends there and is *compatible* with
the last token of the prefix that it leaves: no merge of the vocabulary would have joined the two across their border.  So

1.  an automaton with suffix links, built over the vocabulary, gives at each byte the tokens that end there, longest first;
2.  the first of them that is compatible with the last token of the prefix before it is stored as that prefix's last token;
3.  the ids are read off backwards, each token pointing to the prefix before it.

Compatible: let a run down the right edge of the left token's merge tree and b down the left edge of the right one's.  Merges
happen by rank, of equal rank the leftmost first.  The pair is joined across its border if some (a, b) has a merge of a rank
below the rank that takes a away and not above the rank that takes b away; the walk goes down whichever of a and b was made last.

Words are those of the byte-level splitter; many short ones are worked on at once, a byte position at a time, in numpy; a
long one alone, in time linear in its length.  Workers remember the ids of words, a bounded number of them, and the outcome of
pair tests in a table of fixed size.

Nulls: a null text is empty and has no ids.  An added token in a text is that token, as the library takes it.  Whole texts are
encoded, whatever their length; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.llm.textcore import pieces

#: Words whose ids a worker remembers, slots of its table of pair tests, bytes of a word that is not worked on alone, and
#: cells (words x bytes) worked on at once.
REMEMBERED, SLOTS, SHORT, CELLS = 300_000, 1 << 20, 64, 1 << 21
#: Characters of short texts that are encoded together.
TOGETHER = 1 << 18
_NEVER = np.int64(1) << 40

#: The splitter's pattern (a fixed value), and the same where no character lies beyond U+00FF.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
_WIDE = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_NARROW = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\xff]")


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is visible in Latin-1, else one from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(hidden)) for b in range(256)]


class PrefixEncoder:
    """Encodes and decodes with the vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str, remembered: int = REMEMBERED, short: int = SHORT):
        with open(path) as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and file["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.remembered, self.short = remembered, short
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        text_of = {i: t for t, i in model["vocab"].items()}
        size = max([*text_of, *self.added.values()]) + 1
        in_bytes = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.bytes_of = [in_bytes(text_of[i]) if i in text_of else b"" for i in range(size)]
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.length = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._merges(model["vocab"], model["merges"], size)
        single = [model["vocab"][c] for c in byte_letters()]
        made = np.flatnonzero(self.made >= 0)
        # A token stands if its own bytes are encoded as that token: no other merge joins across its parts before its own.
        stand = self._apart(self.parts[made, 0], self.parts[made, 1], self.made[made])
        self._automaton([*single, *made[stand].tolist()])
        joined = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.flat, self.flat_at = joined, np.concatenate([[0], np.cumsum(self.length)])
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.slots, self.outcome = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=bool)
        self._forget()

    def _merges(self, vocab: dict[str, int], merges: list, size: int) -> None:
        """``made``: the rank at which a token is made, -1 for bytes; ``parts``: what it is made of; merges by sorted pair."""
        self.made, self.parts = np.full(size, -1, dtype=np.int64), np.zeros((size, 2), dtype=np.int64)
        pair, rank = np.zeros(len(merges), dtype=np.int64), np.arange(len(merges))
        for k, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            i = vocab[a + b]
            if self.made[i] < 0:
                self.made[i], self.parts[i] = k, (vocab[a], vocab[b])
            pair[k] = vocab[a] << 32 | vocab[b]
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], rank[order]

    def _apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge, or none but one of rank ``until`` or above, joins the tokens ``a`` and ``b`` across their border."""
        a, b, out = a.copy(), b.copy(), np.ones(len(a), dtype=bool)
        a_goes, b_goes = (np.full(len(a), _NEVER, dtype=np.int64) if until is None else until.copy() for _ in range(2))
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == key, self.ranks[at], _NEVER + 1)
            joined = (rank < a_goes[live]) & (rank <= b_goes[live])
            out[live[joined]] = False
            made_x, made_y = self.made[x], self.made[y]
            on = ~joined & ((made_x >= 0) | (made_y >= 0))
            live, x, y, made_x, made_y = live[on], x[on], y[on], made_x[on], made_y[on]
            left = made_x > made_y  # of one rank, the left one was made first
            a[live], a_goes[live] = np.where(left, self.parts[x, 1], x), np.where(left, made_x, a_goes[live])
            b[live], b_goes[live] = np.where(left, y, self.parts[y, 0]), np.where(left, b_goes[live], made_y)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        missing = np.flatnonzero(self.slots[slot] != key)
        out = self.outcome[slot]
        if len(missing):
            new, at = np.unique(key[missing], return_inverse=True)
            found = self._apart(new >> 32, new & 0xFFFFFFFF)
            out[missing] = found[at]
            self.slots[slot[missing]] = key[missing]
            # Two pairs can fall into one slot; what is read back is what was written last.
            self.outcome[slot[missing]] = out[missing]
            stored = self.slots[slot[missing]] == key[missing]
            self.outcome[slot[missing][stored]] = out[missing][stored]
        return out

    def _automaton(self, tokens: list[int]) -> None:
        """States are the prefixes of tokens.  ``go``: state after a byte; ``longest``: longest token that ends a state's
        string; ``shorter``: the next shorter token that ends a token's string, -1 for none."""
        children: list[dict[int, int]] = [{}]
        token_at: dict[int, int] = {}
        for i in tokens:
            node = 0
            for c in self.bytes_of[i]:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            token_at[node] = int(i)
        self.go = np.zeros((len(children), 256), dtype=np.int32)
        self.longest = np.full(len(children), -1, dtype=np.int64)
        self.shorter = np.full(len(self.bytes_of), -1, dtype=np.int64)
        suffix = np.zeros(len(children), dtype=np.int64)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            link = suffix[node]
            if node:
                self.go[node] = self.go[link]
            ends = self.longest[link] if node else -1
            self.longest[node] = token_at.get(node, ends)
            if node in token_at:
                self.shorter[token_at[node]] = ends
            for c, child in children[node].items():
                suffix[child] = self.go[link, c] if node else 0
                self.go[node, c] = child
                queue.append(child)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._know(["\ud800" + c for c in self.added], np.array(list(self.added.values()), np.uint32), np.ones(len(self.added), np.int64))

    def _know(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words``, end to end, and how many each has; words come longest first."""
        n, sizes = len(words), np.array([len(w) for w in words], dtype=np.int64)
        width = int(sizes[0])
        cells = np.zeros((n, width), dtype=np.uint8)
        cells[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.full((n, width + 1), -1, dtype=np.int64)
        state = np.zeros(n, dtype=np.int64)
        for i in range(1, width + 1):
            m = int(np.searchsorted(-sizes, -i, side="right"))  # words that reach so far
            state[:m] = self.go[state[:m], cells[:m, i - 1]]
            token, open_ = self.longest[state[:m]], np.arange(m)
            while len(open_):
                before = i - self.length[token]
                whole = before == 0
                fits = whole.copy()
                rest = np.flatnonzero(~whole)
                fits[rest] = self.compatible(last[open_[rest], before[rest]], token[rest])
                last[open_[fits], i] = token[fits]
                open_, token = open_[~fits], self.shorter[token[~fits]]
        back, at, open_ = np.full((n, width), -1, dtype=np.int64), sizes.copy(), np.arange(n)
        k = 0
        while len(open_):
            token = last[open_, at[open_]]
            back[open_, k] = token
            at[open_] -= self.length[token]
            open_, k = open_[at[open_] > 0], k + 1
        back = back[:, :k][:, ::-1]
        has = back >= 0
        return back[has].astype(np.uint32), has.sum(axis=1)

    def _alone(self, word: bytes) -> list[int]:
        """Ids of one long word."""
        go, longest, shorter, length = self.go, self.longest, self.shorter, self.length
        last, state, known = [-1] * (len(word) + 1), 0, {}
        for i, c in enumerate(word, 1):
            state = go.item(state, c)
            token = longest.item(state)
            while True:
                before = i - length.item(token)
                if before == 0:
                    break
                pair = last[before], token
                if pair not in known:
                    known[pair] = bool(self.compatible(np.array([pair[0]]), np.array([token]))[0])
                if known[pair]:
                    break
                token = shorter.item(token)
            last[i] = token
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= length.item(last[i])
        return out[::-1]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(words)), key=lambda k: -len(raw[k]))
        lo = 0
        while lo < len(order):
            width = len(raw[order[lo]])
            if width > self.short:
                ids = self._alone(raw[order[lo]])
                self._know([words[order[lo]]], np.array(ids, np.uint32), np.array([len(ids)]))
                lo += 1
                continue
            part = order[lo : lo + max(1, CELLS // width)]
            self._know([words[k] for k in part], *self._together([raw[k] for k in part]))
            lo += len(part)

    def words_of(self, text: str) -> list[str]:
        """The splitter's words; an added token stands behind a mark that no text holds."""
        found = _WIDE if _BEYOND.search(text) else _NARROW
        if self.split_added is None or not self.split_added.search(text):
            return found.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.split_added.split(text)):
            out += ["\ud800" + part] if k % 2 else found.findall(part)
        return out

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has."""
        if len(self.number) > self.remembered:
            self._forget()
        each = [self.words_of(t) if t else [] for t in texts]
        words = [w for own in each for w in own]
        missing = [w for w in set(words) if w not in self.number]
        if missing:
            self._learn(missing)
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        size = np.diff(self.begin)[which]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(own) for own in each], dtype=np.int64)])]
        return self.ids[_spread(self.begin[which], size)], np.diff(ends)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, end to end, and how many each has; ids beyond the vocabulary have none."""
        known = ids[ids < len(self.length)].astype(np.int64)
        size = self.length[known]
        return self.flat[_spread(self.flat_at[known], size)], size

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, dtype=np.int64))[0].tobytes().decode("utf-8", "replace")


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``begin`` and have ``size`` entries."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_column(text: Column, path: str) -> Column:
    """The ids of a text, as an array; the file must be at ``path`` on every worker."""

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts, out = column.tolist(), []
            for lo, hi in pieces(texts, TOGETHER):
                found, counts = encoder(path).encode(texts[lo:hi])
                out += np.split(found.astype(np.int32), np.cumsum(counts)[:-1])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(ids, "array<int>").asNondeterministic()(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an array of ids."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([None if x is None else encoder(path).decode(x) for x in column], dtype=object)

    return F.pandas_udf(texts, "string").asNondeterministic()(ids)


def _digests(path: str):
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts, rows = column.tolist(), []
            for lo, hi in pieces(texts, TOGETHER):
                ids, counts = encoder(path).encode(texts[lo:hi])
                raw, sizes = encoder(path).decode_bytes(ids)
                ends = np.cumsum(counts)
                raw_ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
                ids, raw, a, b = memoryview(ids.astype("<u4")), memoryview(raw), 0, 0
                for n, end, raw_end in zip(counts.tolist(), ends.tolist(), raw_ends.tolist(), strict=True):
                    back = bytes(raw[b:raw_end]).decode("utf-8", "replace").encode()
                    rows.append((n, hashlib.sha256(ids[a:end]).hexdigest(), hashlib.sha256(back).hexdigest()))
                    a, b = end, raw_end
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of its ids as little-endian unsigned 32-bit integers and of
    the text decoded from them."""
    found = F.pandas_udf(_digests(path), "n_tokens long, ids_sha256 string, decoded_sha256 string").asNondeterministic()(F.col(text_col))
    return docs.select(F.col(id_col).alias("_id"), found.alias("_found")).select(F.col("_id").alias(id_col), "_found.*")
