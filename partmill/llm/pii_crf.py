"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

Base spans are the leftmost non-overlapping matches of four patterns (see ``base_spans``); they always stay.  The field adds
spans of the same kinds in other spellings, such as ``+``-less telephone numbers or ``name at host dot com``.

The field
---------
A text is cut into tokens: runs of ASCII letters, of digits, of other letters, and single other characters; white space
only sets a flag.  Every token has one of a small set of word shapes (case pattern, digit count, the character itself, or a
class of cue words).  A label's score at a token is the sum of weights for the shapes at offsets -3 to 3, for the pairs of
neighbouring shapes and for the flag, plus a transition weight from the label before.  Labels are O and B/I of each kind.
Weights are fitted on the driver to a small labelled table (``labelled_texts``) by full-batch Adam on the regularised
conditional likelihood, with the forward-backward recursions in numpy.

Decoding gives the field's best labels of every whole text.  Every token is scored; ``_may_be_labelled`` then leaves out
tokens that no best labelling can label (see there for the proof), and exact Viterbi runs in numpy over batches of the
stretches that remain, each with an unlabelled token on both sides.  So the result is that of decoding the whole text, in
texts and stretches of any length: scores are made for ``CELLS`` tokens at a time, and only back pointers (a byte a label)
are kept for all of a stretch.

An added span is dropped where it overlaps a base span or a stretch that a base pattern found and rejected.

Null, empty and wordless texts have no spans.  Repeated rows give repeated results; the whole text counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.llm.textcore import pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{bi}-{k}" for k in KINDS for bi in "BI"))
#: Tokens, over all rows, that are scored at once.
CELLS = 1 << 15
#: Characters of short texts that are cut into tokens together.
TOGETHER = 1 << 18

# ---- fixed patterns ------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(start, end, kind) by start, then kind as in ``KINDS``; and the stretches that failed a pattern's test."""
    found, failed = [], []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, done := m.end(), "email"))
        at = text.find("@", m.end() if m else at + 1)
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                parts, start = m.group().split("."), m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        found.append((start, end, "ip"))
                    else:
                        failed.append((start, end))
                    start = end + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
                else:
                    failed.append((m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
            else:
                failed.append((m.start(), m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[2]])), failed


# ---- word shapes ---------------------------------------------------------------------------------------------------

#: Every character lies in one of these: letters, digits, other letters, white space, or one other character.
_PIECES = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_A-Za-z]+|\s+|.", re.DOTALL)
#: Cue words; each class is one shape.
CUE_WORDS = {
    "w_phone": ("phone", "tel", "telephone", "telefon", "telefono", "mobile", "cell", "fax", "whatsapp"),
    "w_mail": ("mail", "email", "correo", "courriel"),
    "w_at": ("at", "arroba"),
    "w_dot": ("dot", "punkt", "punto", "point"),
    "w_tld": ("com", "org", "net", "edu", "info", "io"),
    "w_card": ("card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte", "iban"),
    "w_ip": ("ip", "host", "server", "address"),
    "w_number": ("version", "page", "chapter", "part", "order", "invoice", "year", "no", "id", "isbn"),
}
_CLASS = {w: c for c, ws in CUE_WORDS.items() for w in ws}
_PUNCTUATION = "@.-+()[]:/,_%"
SHAPES = ("none", "x", "X", "Xx", "letters", "d1", "d2", "d3", "d4", "d5", "d6", "d7+", "d12+", "other", *CUE_WORDS, *_PUNCTUATION)
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
S, L = len(SHAPES), len(LABELS)


def shape_of(token: str) -> int:
    if token.isascii() and token.isalpha():
        if found := _CLASS.get(token.lower()):
            return _SHAPE[found]
        return _SHAPE["x" if token.islower() else "X" if token.isupper() else "Xx"]
    if token[0] in "0123456789":
        n = len(token)
        return _SHAPE[f"d{n}" if n < 7 else "d7+" if n < 12 else "d12+"]
    if token in _SHAPE:
        return _SHAPE[token]
    return _SHAPE["letters" if token[0].isalpha() else "other"]


class _Shapes(dict):
    """The shape of each token seen, -1 for white space; begins anew when it has grown."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        found = self[token] = -1 if token.isspace() else shape_of(token)
        return found


_SHAPES_SEEN = _Shapes()


def tokens_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape, 1 if white space precedes) of the tokens of ``text``."""
    found = _PIECES.findall(text)
    shape = np.fromiter(map(_SHAPES_SEEN.__getitem__, found), np.int8, len(found))
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    gap = np.zeros(len(found), dtype=np.int8)
    gap[1:] = shape[:-1] < 0
    start = np.concatenate([np.zeros(1, np.int64), end[:-1]]) if len(end) else end
    token = shape >= 0
    return start[token], end[token], shape[token], gap[token]


class Field(NamedTuple):
    """Weights: [offset -3..3, shape, label], [pair of neighbouring shapes ending at -1..1 around the token, label], [flag, label], [label before, label]."""

    single: np.ndarray
    pair: np.ndarray
    gap: np.ndarray
    step: np.ndarray

    def emissions(self, shape: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """[row, token, label] for padded rows of shapes ([row, token], 0 outside)."""
        padded = np.pad(shape.astype(np.int64), ((0, 0), (3, 3)))
        out = self.gap[gap]
        n = shape.shape[1]
        for k in range(7):
            out += self.single[k][padded[:, k : k + n]]
        for k in range(2):
            out += self.pair[k][padded[:, 2 + k : 2 + k + n] * S + padded[:, 3 + k : 3 + k + n]]
        return out


#: From a label, which may follow: I only after B or I of its kind.
_ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])
_START = np.array([not b.startswith("I") for b in LABELS])
_NEVER = -1e9


def viterbi(field: Field, padded: np.ndarray, gap: np.ndarray, length: np.ndarray, none: np.ndarray | None = None) -> np.ndarray:
    """Best label of every token of every row; ``padded`` has the shapes of three neighbours more on both sides, and tokens
    in ``none`` are O."""
    rows, n = gap.shape
    some = max(1, CELLS // rows)
    step = np.where(_ALLOWED, field.step, _NEVER)
    back = np.zeros((n, rows, L), dtype=np.int8)
    for t in range(n):
        if t % some == 0:
            # Three neighbours on both sides belong to the scores of a part.
            emit = field.emissions(padded[:, t : t + some + 6], np.pad(gap[:, t : t + some], ((0, 0), (3, 3))))[:, 3:-3]
            if none is not None:
                emit[:, :, 1:] += np.where(none[:, t : t + some, None], _NEVER, 0)
        if t == 0:
            score = emit[:, 0] + np.where(_START, 0, _NEVER)
            continue
        through = score[:, :, None] + step[None]
        back[t] = through.argmax(axis=1)
        new = through.max(axis=1) + emit[:, t % some]
        score = np.where((t < length)[:, None], new, score)
    out = np.zeros((rows, n), dtype=np.int8)
    best = score.argmax(axis=1)
    for t in range(n - 1, -1, -1):
        inside = t < length
        out[inside, t] = best[inside]
        best = np.where(inside, back[t][np.arange(rows), best], best)
    return out


# ---- training ------------------------------------------------------------------------------------------------------


def labelled_texts(n: int = 700, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: ``n`` invented sentences and the (start, end, kind) of their personal data, made from
    templates with a fixed seed.  Many have none, but plain words or what looks alike (dates, versions, prices, keys)."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuv"), int(rng.integers(2, 9))))
    accented = lambda: "".join(rng.choice(list("abceilmnorstuéèêçäöüßñóí"), int(rng.integers(1, 9))))
    code = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    tld = lambda: pick("com", "org", "net", "edu")
    personal = {
        "email": lambda: pick(
            f"{word()} at {word()} dot {tld()}", f"{word()} at {word()} dot {tld()}", f"{word()}.{word()} at {word()} dot {tld()}", f"{word()} [at] {word()} [dot] {tld()}", f"{word()}(at){word()}.{tld()}", f"{word()} (at) {word()} (dot) {tld()}",
            f"{word()} @ {word()}.{tld()}", f"{word()}.{word()}@{word()}.{tld()}", f"{word()}{digits(2)} at {word()} dot {tld()}",
        ),
        "ip": lambda: pick(f"{digits(2)}.{digits(3)}.{digits(1)}.{digits(2)}", f"{digits(3)} . {digits(2)} . {digits(2)} . {digits(1)}", f"{digits(2)}[.]{digits(3)}[.]{digits(1)}[.]{digits(2)}"),
        "card": lambda: pick(f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}"),
        "phone": lambda: pick(
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
            f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"({digits(3)}){digits(3)}-{digits(4)}",
        ),
    }
    cue = {"email": ("email", "mail to", "correo :", ""), "ip": ("ip", "host", "from", ""), "card": ("card", "visa", "paid with", ""), "phone": ("call", "tel", "phone :", "fax", "")}
    plain = lambda: pick(
        f"version {digits(1)}.{digits(1)}.", f"in {digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"page {digits(3)}", f"{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", digits(16), digits(9),
        f"order {digits(7)}", f"{digits(2)} at {word()}", f"look at {word()} com", f"the dot {word()}", f"token = {word()}{digits(3)}{word()}{digits(2)}", f"isbn {digits(3)}-{digits(1)}-{digits(4)}", f"{digits(2)}-{digits(2)}",
        f"at {word()} point {word()}", f"part ({digits(1)}) {word()}", f"{word()} @ {word()}", f"{digits(3)} {digits(3)}", f"CC BY {digits(1)}.{digits(1)}.", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{word()}***", f"{word()}&&& {digits(16)}$$$",
        f'token = "{code(40)}"', f'key = "{code(32)}"', f"password={code(18)}", f"AKIA{code(16).upper()}", f"commit {code(40)}", f"{word()}!! {word().upper()}!!", f"{accented()} {accented()}%%% {accented()}",
    )
    fill = lambda: " ".join(pick(word().capitalize(), word(), word(), word() + pick(".", ","), accented(), accented() + pick(".", ",", "***"), word().upper(), "at", "the", "net", word() + ".\n" + word()) for _ in range(int(rng.integers(1, 7))))
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    for k in range(n):
        text, spans = fill(), []
        if k % 4 == 0:
            out.append((" ".join(fill() for _ in range(4)), []))
            continue
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.5:
                text += " " + plain()
            else:
                kind = pick(*KINDS)
                start = len(text := f"{text} {pick(*cue[kind])} ".replace("  ", " "))
                written = personal[kind]()
                text += written.upper() if rng.random() < 0.1 else written
                spans.append((start, len(text), kind))
            text += pick("", ".", "\n") if rng.random() < 0.2 else pick(" ", ". ", ", ") + fill()
        out.append((text, spans))
    return out


def _gold(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, str]]) -> np.ndarray:
    gold = np.zeros(len(start), dtype=np.int64)
    for lo, hi, kind in spans:
        at = np.flatnonzero((start >= lo) & (end <= hi))
        gold[at] = LABELS.index(f"I-{kind}")
        gold[at[0]] = LABELS.index(f"B-{kind}")
    return gold


def train_field(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """The field fitted to labelled texts; they are a parameter of bounded size and held whole."""
    cut = [tokens_of(text) for text, _ in rows]
    n, width = len(rows), max(len(c[0]) for c in cut)
    shape, gap, gold = (np.zeros((n, width), dtype=np.int64) for _ in range(3))
    length = np.array([len(c[0]) for c in cut])
    for k, ((start, end, shapes, flags), (_, spans)) in enumerate(zip(cut, rows, strict=True)):
        shape[k, : len(start)], gap[k, : len(start)], gold[k, : len(start)] = shapes, flags, _gold(start, end, spans)
    inside = np.arange(width)[None, :] < length[:, None]
    field = Field(np.zeros((7, S, L)), np.zeros((2, S * S, L)), np.zeros((2, L)), np.zeros((L, L)))
    first, second = [np.zeros_like(w) for w in field], [np.zeros_like(w) for w in field]
    padded = np.pad(shape, ((0, 0), (3, 3)))
    at = [padded[:, k : k + width] for k in range(7)]
    pairs = [at[2 + k] * S + at[3 + k] for k in range(2)]
    rows_of = np.arange(n)

    def summing(index: np.ndarray):
        """Adds rows of the same index into ``to``."""
        order = np.argsort(index, axis=None, kind="stable")
        held = index.reshape(-1)[order]
        first_of = np.flatnonzero(np.diff(held, prepend=-1))

        def total(to: np.ndarray, rows: np.ndarray) -> None:
            to[held[first_of]] = np.add.reduceat(rows[order], first_of, axis=0)

        return total

    add_single, add_pair, add_gap = [summing(x) for x in at], [summing(x) for x in pairs], summing(gap)
    for turn in range(1, rounds + 1):
        emit = field.emissions(shape, gap).transpose(1, 0, 2)
        local = np.exp(emit - emit.max(axis=2, keepdims=True))
        step = np.where(_ALLOWED, np.exp(field.step), 0)
        # Each step is scaled to sum to 1; beyond a row's end nothing changes.
        forward, scale, backward = np.zeros((width, n, L)), np.ones((width, n, 1)), np.ones((width, n, L))
        for t in range(width):
            new = local[t] * (_START if t == 0 else forward[t - 1] @ step)
            total = new.sum(axis=1, keepdims=True)
            on = inside[:, t, None]
            scale[t] = np.where(on, total, 1)
            forward[t] = np.where(on, new / np.maximum(total, 1e-300), forward[t - 1])
        pulls = [np.zeros_like(w) for w in field]
        for t in range(width - 1, 0, -1):
            ahead = local[t] * backward[t] / scale[t] * inside[:, t, None]
            backward[t - 1] = np.where(inside[:, t, None], ahead @ step.T, 1)
            pulls[3] += step * (forward[t - 1].T @ ahead)
            np.add.at(pulls[3], (gold[inside[:, t], t - 1], gold[inside[:, t], t]), -1)
        wrong = (forward * backward).transpose(1, 0, 2)
        wrong[rows_of[:, None], np.arange(width)[None, :], gold] -= 1
        flat = (wrong * inside[:, :, None]).reshape(-1, L)
        for k in range(7):
            add_single[k](pulls[0][k], flat)
        for k in range(2):
            add_pair[k](pulls[1][k], flat)
        add_gap(pulls[2], flat)
        for w, pull, m, v in zip(field, pulls, first, second, strict=True):
            pull = pull / n + decay * w
            m += 0.1 * (pull - m)
            v += 0.01 * (pull * pull - v)
            w -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train_field(labelled_texts())


# ---- finding -------------------------------------------------------------------------------------------------------


def _highest_into(step: np.ndarray) -> np.ndarray:
    """For each label but O: the most that coming into it can add over staying in O, with what leaving it for O can add."""
    into = np.where(_ALLOWED, step, _NEVER).max(axis=0)[1:] - step[0, 0]
    return into + np.maximum(step[1:, 0] - step[0, 0], 0)


def _may_be_labelled(gain: np.ndarray) -> np.ndarray:
    """Which tokens can have a label in a best labelling, given the most that labelling each can gain.

    Take a best labelling and a longest run of labelled tokens in it, and label these O instead: the score changes by the
    labels' own scores and the transitions into them and out of the last one, all of which ``gain`` bounds from above token by
    token.  As the labelling was best, the gains of the run must sum to 0 or more.  So only tokens that lie in some stretch
    whose gains sum to 0 or more remain: where the best sum of a stretch that ends at a token and the best of one that begins
    at it, less its own gain, make 0 or more."""
    total = np.cumsum(gain)
    before = np.concatenate([np.zeros(1), total[:-1]])
    ending = total - np.minimum.accumulate(before)
    beginning = np.maximum.accumulate(total[::-1])[::-1] - before
    return ending + beginning - gain >= -1e-6


def _stretches(field: Field, shape: np.ndarray, gap: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of tokens that may be labelled; ``breaks``: tokens that begin a text."""
    into, n = _highest_into(field.step), len(shape)
    gain, padded, begins = np.empty(n), np.pad(shape, (3, 3)), np.zeros(n, dtype=bool)
    begins[breaks[breaks < n]] = True
    for lo in range(0, n, CELLS):
        hi = min(n, lo + CELLS)
        emit = field.emissions(padded[None, lo : hi + 6], np.pad(gap[lo:hi], (3, 3))[None])[0, 3:-3]
        # Nothing comes into a text's first token, from no label.
        gain[lo:hi] = (emit[:, 1:] + np.where(begins[lo:hi, None], np.maximum(into, 0), into)).max(axis=1) - emit[:, 0]
    hot = _may_be_labelled(gain).view(np.int8)
    edge = np.diff(hot, prepend=np.int8(0), append=np.int8(0))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A stretch over the end of a text is cut there; so texts are decoded apart.
    cut = breaks[(np.searchsorted(first, breaks, "left") - np.searchsorted(end, breaks, "right")) == 1]
    return np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([end, cut]))


def added_spans(field: Field, texts: list[str], lots: int = 512) -> list[list[tuple[int, int, str]]]:
    """What the field labels in each text; stretches of like length are decoded together."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for lo, hi in pieces(texts, TOGETHER):
        cut = [tokens_of(t) for t in texts[lo:hi]]
        sizes = np.array([len(c[0]) for c in cut])
        # Between texts lie three tokens of the shape "none", as outside of any text.
        begin = np.cumsum(sizes + 3) - sizes
        shape, gap = np.zeros(int(begin[-1] + sizes[-1]) + 3, dtype=np.int8), np.zeros(int(begin[-1] + sizes[-1]) + 3, dtype=np.int8)
        for b, n, c in zip(begin, sizes, cut, strict=True):
            shape[b : b + n], gap[b : b + n] = c[2], c[3]
        first, end = _stretches(field, shape, gap, np.concatenate([begin, begin + sizes]))
        owner = np.searchsorted(begin, first, side="right") - 1
        inside = (owner >= 0) & (first < begin[owner] + sizes[owner])
        first, end, owner = first[inside], end[inside], owner[inside]
        # An unlabelled token more on both sides, but at a text's ends.
        left, right = first > begin[owner], end < begin[owner] + sizes[owner]
        first, end = first - left, end + right
        order = np.argsort(end - first, kind="stable")
        first, end, owner, left, right = first[order], end[order], owner[order], left[order], right[order]
        at = 0
        while at < len(first):
            until = at + 1
            while until < min(len(first), at + lots) and (until + 1 - at) * (end[until] - first[until]) <= CELLS:
                until += 1
            length = (end - first)[at:until]
            # Three neighbours on both sides belong to the scores.
            where = np.minimum(first[at:until, None] + np.arange(-3, length.max() + 3), len(shape) - 1)
            none = np.zeros((until - at, length.max()), dtype=bool)
            none[left[at:until], 0] = True
            none[np.flatnonzero(right[at:until]), length[right[at:until]] - 1] = True
            labels = viterbi(field, shape[where], gap[where[:, 3:-3]], length, none)
            for r in np.flatnonzero(labels.any(axis=1)):
                k, from_token = owner[at + r], first[at + r] - begin[owner[at + r]]
                row = labels[r, : length[r]]
                for b in np.flatnonzero(row % 2 == 1):
                    e = b + 1
                    while e < len(row) and row[e] == row[b] + 1:
                        e += 1
                    out[lo + k].append((int(cut[k][0][from_token + b]), int(cut[k][1][from_token + e - 1]), KINDS[(row[b] - 1) // 2]))
            at = until
    return out


def find_spans(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, whether base) of every text, by start, then kind."""
    order = {k: i for i, k in enumerate(KINDS)}
    whole = [t or "" for t in texts]
    added = added_spans(field, whole)
    out = []
    for text, more in zip(whole, added, strict=True):
        base, failed = base_spans(text)
        taken = sorted([(s, e) for s, e, _ in base] + failed)
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max, initial=0))
        found = [(s, e, k, True) for s, e, k in base]
        # The farthest end of all that begin before the span's end.
        found += [(s, e, k, False) for s, e, k in more if reach[bisect_left(starts, e)] <= s]
        out.append(sorted(found, key=lambda s: (s[0], order[s[2]])))
    return out


#: What is found in a text.
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def personal_data_of(text: Column, field: Field | None = None) -> Column:
    """The spans (kind, start, end, base) of a text, in code points, end exclusive."""
    field = field or default_field()

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in row] for row in find_spans(field, column.tolist())], dtype=object)

    return F.pandas_udf(find, SPANS).asNondeterministic()(text)


def find_personal_data(docs: DataFrame, field: Field | None = None, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``pii``: the spans of every row (see ``personal_data_of``); the carried columns stay as they are."""
    return docs.select(*[F.col(c) for c in carry], personal_data_of(F.col(text_col), field).alias("pii"))


def mask(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets (ids must be unique)."""
    pieces = F.aggregate(
        "_pii",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substr(F.col(text_col), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.when(s["start"] >= a["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    spans = found.select(F.col(id_col).alias("_id"), F.col("pii").alias("_pii"))
    joined = docs.join(spans, docs[id_col] == spans["_id"], "left").withColumn("_cut", pieces)
    rest = F.concat(F.col("_cut.out"), F.substr(F.col(text_col), (F.col("_cut.at") + 1).cast("int")))
    return joined.withColumn(text_col, F.coalesce(rest, F.col(text_col))).select(docs.columns)


def labelled_table(spark: SparkSession) -> DataFrame:
    """``labelled_texts`` as a table, for those who add to it: (text, spans)."""
    return spark.createDataFrame([(t, [(k, s, e) for s, e, k in spans]) for t, spans in labelled_texts()], "text string, spans array<struct<kind:string,start:int,end:int>>")
