"""Secret scanning: patterns propose, a random forest removes false positives.

Candidates are provider key formats, values assigned to names like ``password`` or ``token``, and runs of at least
``MIN_RUN`` characters of ``[A-Za-z0-9+/_=-]`` with a digit or with letters of both cases.  Of overlapping candidates a provider
format comes before an assigned value and that before a bare run, so the run ``password=abc...`` gives way to the value in it;
of the same sort the earlier one stays.

Features of a candidate: its length; mean log probability of its character transitions under a word model; changes of
character class; share of digits, upper case and hexadecimal characters; entropy; the share of its letters that dictionary
words cover; whether a provider format or an assignment proposed it; marks of the path it was found in; and cue words for
secrets and for harmless values among the neighbouring words.

The forest is Spark's, fitted to labelled findings (``labelled_findings``: a bounded table of invented ones, or one's own with
the columns ``candidate, before, after, path, label``).  Texts are read once and never shuffled.

Nulls: a null or empty text has no candidates; a null path has no marks.  Whole texts are read, of any length; repeated rows
give repeated findings.  Tables may have any other columns.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_RUN = 16
TREES, DEPTH, THRESHOLD = 60, 8, 0.5
#: Characters of context kept on each side, and labelled findings made.
CONTEXT, LABELLED = 60, 3000

_FORMATS = re.compile(r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?[ \t]*(?:=>|:=|[=:])[ \t]*[\"']?([^\s\"',;]{6,})")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: A run with a digit, or with letters of both cases (two upper-case ones); each pattern reads a run once.
_DIGIT, _LOW, _TWO_UP = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z][^A-Z]*[A-Z]")
_WORD = re.compile(r"[^\W_]+")

#: Words that stand near secrets, and near values that only look like them.
SECRET_CUES = frozenset("password passwd pwd secret token key apikey auth bearer credential credentials login aws private".split())
HARMLESS_CUES = frozenset("commit sha md5 hash checksum digest uuid guid etag revision build serial isbn order invoice example sample placeholder version test".split())
#: A small dictionary for coverage and for the transition model.
DICTIONARY = tuple(
    "the and for with from this that have not are was you your all can will one time year people way day man thing woman life child world school state family "
    "student group country problem hand part place case week company system program question work government number night point home water room mother area money "
    "story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city "
    "name president team minute idea body information back parent face others level office door health person art war history party result change morning reason "
    "research girl guy moment air teacher force education my your example test value string config user admin public static index main default change".split()
)
FEATURES = (
    "length", "transition", "class_changes", "digits", "upper", "hex", "entropy", "coverage", "format", "assigned", "path_code", "path_test", "path_docs", "secret_before", "harmless_before", "cues_after", "repeats", "dashes",
)


def _letter(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26


@lru_cache(maxsize=1)
def _transitions() -> np.ndarray:
    counts = np.full((27, 27), 0.1)
    for w in DICTIONARY:
        for a, b in zip(f" {w}", f"{w} ", strict=True):
            counts[_letter(a), _letter(b)] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def features_of(candidate: str, before: str, after: str, path: str | None) -> list[float]:
    """In the order of ``FEATURES``."""
    n, low = max(1, len(candidate)), candidate.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in candidate]
    table = _transitions()
    moves = [table[_letter(a), _letter(b)] for a, b in zip(low, low[1:], strict=False)]
    counts = Counter(candidate).values()
    covered = set()
    for w in DICTIONARY:
        at = low.find(w)
        while at >= 0 and len(w) > 2:
            covered.update(range(at, at + len(w)))
            at = low.find(w, at + 1)
    letters = sum(c.isalpha() for c in candidate)
    near = [w.lower() for w in _WORD.findall(before)][-4:]
    next_words = [w.lower() for w in _WORD.findall(after)][:3]
    where = (path or "").lower()
    has = lambda *xs: float(any(x in where for x in xs))
    return [
        float(n), float(np.mean(moves)) if moves else 0.0, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, kinds.count("d") / n, kinds.count("u") / n,
        sum(c in "0123456789abcdef" for c in low) / n, -sum(k / n * math.log2(k / n) for k in counts), sum(candidate[i].isalpha() for i in covered) / max(1, letters),
        float(bool(_FORMATS.fullmatch(candidate))), float(bool(re.search(r"(?:=>|[=:])[ \t]*[\"']?\Z", before))), has(".py", ".js", ".env", ".yml", ".yaml", ".json", ".cfg", ".java", ".sh"), has("test", "example", "sample", "mock"),
        has("doc", "readme", ".md"), float(sum(w in SECRET_CUES for w in near)), float(sum(w in HARMLESS_CUES for w in near)), float(sum(w in SECRET_CUES for w in next_words) - sum(w in HARMLESS_CUES for w in next_words)),
        max(counts, default=1) / n, float(candidate.count("-")),
    ]


def candidates_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates in ``text``, by start."""
    sorts = [[m.span() for m in _FORMATS.finditer(text)], [], []]
    if "=" in text or ":" in text:
        sorts[1] = [m.span(1) for m in _ASSIGNED.finditer(text)]
    for m in _RUN.finditer(text):
        run = m.group()
        if _DIGIT.search(run) or _LOW.search(run) and _TWO_UP.search(run):
            sorts[2].append(m.span())
    out: list[tuple[int, int]] = []
    for found in sorts:
        # Those of a sort never overlap each other; those taken before are in order, too.
        starts = [s for s, _ in out]
        free = [(s, e) for s, e in found if (k := bisect_left(starts, e)) == 0 or out[k - 1][1] <= s]
        out = sorted(out + free)
    return out


def labelled_findings(n: int = LABELLED, seed: int = 5) -> list[tuple[str, str, str, str, float]]:
    """(candidate, before, after, path, label) of ``n`` invented findings, half of them secrets (label 1)."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    lower, upper, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: chars(lower, int(rng.integers(2, 10)))
    prose = lambda: " ".join(pick(word(), word(), *DICTIONARY[:30]) for _ in range(4))
    near = lambda: pick(" ", ": ", " = ", "=", ' = "')
    name = lambda: pick("password", "token", "secret", "api_key", "auth", "access_key", "pwd")
    path = lambda: pick("src1", "src7", "", "app/config.py", "deploy/.env", "web/main.js", "docs/readme.md", "tests/test_x.py", "crawl")
    out = []
    for k in range(n):
        before, after = prose(), " " + prose()
        if k % 2:
            kind = pick("format", "assigned", "assigned", "bare")
            value = {"format": lambda: pick("AKIA" + chars(upper + digits, 16), "ghp_" + chars(lower + upper + digits, 36), "sk_live_" + chars(lower + upper + digits, 24)),
                     "assigned": lambda: pick(chars(hexes, 40), chars(hexes, 18), chars(hexes, 32), chars(lower + upper + digits, int(rng.integers(10, 40))), chars(lower + upper + digits + "+/", 40)),
                     "bare": lambda: chars(lower + upper + digits + "+/", int(rng.integers(30, 60)))}[kind]()
            before += {"format": pick(" ", f" {name()}{near()}"), "assigned": f" {name()}{pick('=', ': ', ' = ', ' = ' + chr(34))}", "bare": f" {pick('bearer', 'key', 'secret', 'token')} "}[kind]
            out.append((value, before, after, path(), 1.0))
        else:
            kind = int(rng.integers(8))
            value = (
                chars(hexes, 40), "-".join(chars(hexes, m) for m in (8, 4, 4, 4, 12)), chars(digits, int(rng.integers(16, 20))), "_".join(pick(*DICTIONARY) for _ in range(4)) + chars(digits, 1),
                pick("your_api_key_here", "xxxxxxxxxxxxxxxx1", "changeme123", "example-password-1", "${TOKEN_1_FROM_ENV}", "0000000000000000", "placeholder_token_0"), "/".join(word() for _ in range(5)) + "/" + chars(digits, 3),
                word() + word() + word() + chars(digits, 2), "".join(w.capitalize() for w in (pick(*DICTIONARY), pick(*DICTIONARY), pick(*DICTIONARY), pick(*DICTIONARY))) + chars(digits, 1),
            )[kind]
            before += (f" {pick('commit', 'sha', 'checksum:', 'revision', 'etag')} ", f" {pick('uuid', 'id', 'request')} ", f" {pick('order', 'serial', 'the', 'of')} ", " ", f" {name()}{pick('=', ': ')}", pick(" /", " http://"), " ", " ")[kind]
            out.append((value, before[-CONTEXT:], after, path(), 0.0))
    return out


def train_forest(spark: SparkSession, findings: list[tuple[str, str, str, str, float]] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 17) -> RandomForestClassificationModel:
    """The forest fitted to labelled findings, by default the invented ones; the table is a parameter of bounded size."""
    rows = [(features_of(c, b, a, p), label) for c, b, a, p, label in (findings or labelled_findings())]
    table = spark.createDataFrame(rows, "f array<double>, label double").coalesce(1).select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(table)


_FOUND = "array<struct<start:long,end:long,candidate:string,f:array<double>>>"


def _find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, paths in batches:
        out = []
        for text, path in zip(texts, paths, strict=True):
            rows = []
            for start, end in candidates_of(text or ""):
                value, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
                rows.append({"start": start, "end": end, "candidate": value, "f": features_of(value, before, after, path)})
            out.append(rows)
        yield pd.Series(out, dtype=object)


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str = "source", carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``carry`` columns, ``start``, ``end`` (code points, end exclusive), ``candidate``, ``score`` and ``is_secret`` of every candidate."""
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    found = F.pandas_udf(_find, _FOUND).asNondeterministic()(F.col(text_col), path)
    given = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], found.alias("_found"))
    each = given.select(*[f"_c{k}" for k in range(len(carry))], F.inline("_found"))
    scored = model.transform(each.withColumn("features", array_to_vector("f")))
    score = F.round(vector_to_array("probability")[1], 9)
    return scored.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], "start", "end", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))
