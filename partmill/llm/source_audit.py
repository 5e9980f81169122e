"""How far the sources of a language differ in their words: exact divergences of all pairs, and each source's own terms.

Terms are runs of letters (anything but ASCII's other characters; only A-Z is lower-cased).  A language keeps the terms that at
least ``MIN_DOCS`` of its documents hold.  A group, that is a source within a language, gives each kept term the smoothed share
``p = 1 + floor(SCALE * (count + 2) / (N + 2V))``; two shares differ by ``f = floor((p - q)**2 / (p + q))``.  All is integer
arithmetic, so partial sums can be added in any order.

Heavy-light split
-----------------
A pair's sum runs over all V kept terms, most of which either group may lack.  With p0 the share of a term that a group lacks:

* **heavy** terms, which more than ``HEAVY`` of the language's groups have, are filled up with p0 to dense rows; tasks hold them
  as numpy tiles of terms x groups and sum f over the terms, a pair of groups at a time;
* **light** terms count as if no group had them, V_light * f(p0, p0'); each posting (group, term) then corrects its group against
  every other one, by how often the group has which count; and each *pair of postings* of a term corrects what the single
  corrections got wrong.

The partial sums are added.  Rows of a term hold its postings, at most one for each group of the language; groups are numbered
within their language and worked on in blocks of ``BLOCK`` x ``BLOCK``, so a task holds the sums of a few blocks, whatever the number
of groups.  Tasks count terms over many texts before anything is shuffled; a frequent term comes once from each of these counts.

Nulls: null text, language and source are ''.  A group without any kept term still has its rows; where a language keeps no term
every pair has 0.  Rows are documents of their own, whatever their id.  Repeated rows count twice.  Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partmill.sources.storage import materialize

#: Documents of a language that a kept term is in, the unit of shares, and ranks of the own terms.
MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: A term is heavy if more than this share of the language's groups have it; groups of a block.
HEAVY, BLOCK = 0.5, 256
#: Terms that a task counts before it passes them on, and cells of a tile or pairs of postings worked on at once.
HELD_TERMS, CELLS = 400_000, 1 << 20

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each (lang, source)."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for lo in range(0, len(terms), 50_000):
                own = terms[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array([t.decode("utf-8", "replace") for t in own]), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        for text, lang, source in zip(*(batch.column(k).to_pylist() for k in ("text", "lang", "source")), strict=True):
            found = Counter(text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()) if text else ()
            if not found:
                continue
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(found)
            docs.update(found.keys())
            held += len(n) - before
            if held > HELD_TERMS:
                yield from flush()
                counts, held = {}, 0
    yield from flush()


def _share(n: str, total: str) -> str:
    """The SQL of a smoothed share; decimals, as counts times SCALE can leave 64 bits."""
    return f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(19,0))) DIV CAST({total} + 2 * v AS DECIMAL(19,0))"


def _difference(p: str, q: str) -> str:
    """The SQL of f; shares are at most SCALE + 1, so the square fits in 64 bits."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) DIV (({p}) + ({q}))"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _postings(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's postings begin (one entry more than rows), and their group, share and share of a term not there."""
    begin = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]).astype(np.int64)
    return begin, [np.asarray(x) for x in column.flatten().flatten()]


def _sum_dense(sums: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], rows: int, same: bool) -> None:
    """Adds f over the terms of full rows; a row has a share for each group of the block."""
    a, b = (x[1].reshape(rows, -1)[np.arange(rows)[:, None], np.argsort(x[0].reshape(rows, -1), axis=1)] for x in (left, right))
    step = max(1, CELLS // b.shape[1])
    for lo in range(0, rows, step):
        x, y = np.ascontiguousarray(a[lo : lo + step].T), np.ascontiguousarray(b[lo : lo + step].T)
        for i in range(len(x)):
            first = i + 1 if same else 0
            sums[i, first : len(y)] += _f(x[i], y[first:]).sum(axis=1)


def _sum_pairs(sums: np.ndarray, begins: tuple, left: list[np.ndarray], right: list[np.ndarray], same: bool, block: tuple[int, int]) -> None:
    """Adds what every two postings of a term correct: f of both, less what each alone corrected, and what none did."""
    n_left, n_right = (np.diff(b) for b in begins)
    ends, lo = np.cumsum(n_left * n_right), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
        owner = np.repeat(np.arange(lo, hi), n_left[lo:hi])  # the term of each left posting
        i = np.repeat(np.arange(begins[0][lo], begins[0][hi]), n_right[owner])
        size = n_right[owner]
        j = np.repeat(begins[1][owner] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if same:
            up = left[0][i] < right[0][j]
            i, j = i[up], j[up]
        p, q, p0, q0 = left[1][i], right[1][j], left[2][i], right[2][j]
        np.add.at(sums, (left[0][i] - block[0] * BLOCK, right[0][j] - block[1] * BLOCK), _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0))
        lo = hi


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (lang, g, h, value), g < h, of rows sorted by language and pair of blocks."""
    key, sums = None, np.zeros((0, 0), dtype=np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        g, h = np.nonzero(sums)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(g)), pa.array(g + key[1] * BLOCK), pa.array(h + key[2] * BLOCK), pa.array(sums[g, h])], names=["lang", "g", "h", "value"])

    for batch in batches:
        lang, bi, bj, heavy = (batch.column(k).to_pylist() for k in ("lang", "bi", "bj", "heavy"))
        sorts = list(zip(lang, bi, bj, heavy, strict=True))
        lo = 0
        while lo < len(sorts):
            hi = lo + 1
            while hi < len(sorts) and sorts[hi] == sorts[lo]:
                hi += 1
            if sorts[lo][:3] != key:
                yield from done()
                key, sums = sorts[lo][:3], np.zeros((BLOCK, BLOCK), dtype=np.int64)
            (from_left, left), (from_right, right) = (_postings(batch.column(k).slice(lo, hi - lo)) for k in ("left", "right"))
            same = key[1] == key[2]
            if sorts[lo][3]:
                _sum_dense(sums, left, right, hi - lo, same)
            else:
                _sum_pairs(sums, (from_left, from_right), left, right, same, key[1:])
            lo = hi
    yield from done()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, n_lang, k) of every kept term and group that has it, k groups of the language have it; and the groups:
    (lang, source, g: number in the language, groups, total, v, total_lang)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    found = given.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    of_group = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = of_group.withColumns({"in_docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "k": F.count("*").over(of_term)}).where(F.col("in_docs") >= min_docs)
    counts = materialize(kept.select("lang", "source", "term", "n", "n_lang", "k"), "audit-counts")
    terms = counts.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = given.select("lang", "source").distinct().withColumns({"g": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "groups": F.count("*").over(Window.partitionBy("lang"))})
    groups = numbered.join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    return counts, materialize(groups.fillna(0, ["total", "v", "total_lang"]), "audit-groups")


def _pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value) of every ordered pair of groups of a language."""
    heavy = F.col("k") > HEAVY * F.col("groups")
    own = groups.select("lang", "g", F.when(F.col("v") > 0, F.expr(_share("0", "total"))).alias("p0"))
    other = own.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    pairs = own.join(other, "lang").where("g <> h")

    # Light terms as if no group had them, and what a group's postings correct against every other group.
    light_terms = shares.where(~heavy).groupBy("lang").agg(F.count_distinct("term").alias("times"))
    none = pairs.join(light_terms, "lang").select("lang", "g", "h", F.expr(f"times * ({_difference('p0', 'q0')})").alias("value"))
    often = shares.where(~heavy).groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("times"))
    single = often.join(other, "lang").where("g <> h").select("lang", "g", "h", F.expr(f"times * (({_difference('p', 'q0')}) - ({_difference('p0', 'q0')}))").alias("value"))
    single = single.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    # Every term's postings by pair of blocks; those of heavy terms are filled up.
    posting = lambda g, p, p0: F.struct(g.cast("int").alias("g"), p.alias("p"), p0.alias("p0"))
    lists = shares.groupBy("lang", "term").agg(F.collect_list(posting(F.col("g"), F.col("p"), F.col("p0"))).alias("posts"), F.first(heavy).alias("heavy"), F.first("groups").alias("groups"))
    none_of = own.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "p0"))), lambda x: x["p0"]).alias("none"))
    absent = F.array_except(F.sequence(F.lit(0), F.col("groups").cast("int") - 1), F.col("posts.g"))
    filled = lists.where("heavy").join(none_of, "lang").select("lang", "heavy", "groups", F.concat("posts", F.transform(absent, lambda g: posting(g, F.get("none", g), F.get("none", g)))).alias("posts"))
    rows = lists.where("not heavy").select("lang", "heavy", "groups", "posts").unionByName(filled)
    last = (F.floor((F.col("groups") - 1) / BLOCK)).cast("int")
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda a: F.transform(F.sequence(a, last), lambda b: F.struct(a.alias("bi"), b.alias("bj")))))
    of_block = lambda b: F.filter("posts", lambda x: F.floor(x["g"] / BLOCK).cast("int") == F.col(b))
    tiles = rows.select("*", F.inline(blocks)).select("lang", "bi", "bj", "heavy", of_block("bi").alias("left"), of_block("bj").alias("right"))
    tiles = tiles.where("size(left) > 0 and size(right) > 0").sortWithinPartitions("lang", "bi", "bj", "heavy")
    both = tiles.mapInArrow(_sum_blocks, "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    both = both.select("lang", F.inline(F.array(F.struct("g", "h", "value"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), "value"))))

    single = single.select("lang", F.inline(F.array(F.struct("g", "h", "value"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), "value"))))
    at_least = pairs.select("lang", "g", "h", F.lit(0).cast("long").alias("value"))
    return at_least.unionByName(none).unionByName(single).unionByName(both).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the divergence of a group from each other source of its language,
    part ``term`` the ``top`` terms that it uses more than its language does.  Ranks go by value, then by item."""
    counts, groups = count_terms(docs, text_col, lang_col, source_col, min_docs)
    shares = counts.join(groups.where("v > 0"), ["lang", "source"])
    shares = shares.select("*", F.expr(_share("n", "total")).alias("p"), F.expr(_share("0", "total")).alias("p0"), F.expr(_share("n_lang", "total_lang")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_difference("p", "q")).alias("value"))
    named = _pair_values(shares, groups).join(groups.select("lang", "g", "source"), ["lang", "g"]).join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    return ranked(named, "pair").unionByName(ranked(own, "term").where(F.col("rank") <= top))
