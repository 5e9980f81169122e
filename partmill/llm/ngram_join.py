"""N-gram Jaccard self-join of texts: MinHash banding proposes, full n-gram sets decide.

Plan
----
1.  Every text is read once: hash of its word sequence, size of its n-gram set, one hash per band.  Texts with the same word sequence
    are one *node* with a number of its own, so that copies cost nothing later.
2.  Bands are shuffled on their hash.  Each bucket is a star around its smallest node (a ``min`` aggregate and a join, so
    a bucket of any size is spread), and connected components of the stars are the candidate groups.
3.  Inside a candidate group all pairs are verified on their n-gram sets.  Small groups share tasks; a large group is cut
    into blocks by size class of the n-gram sets and hash, and block meets block in a task of bounded size.  No pair leaves a task: it
    returns link counts and a spanning star of each connected part.
4.  Connected components of those stars are the classes.

With ``bands`` x ``rows`` a pair of similarity s is proposed with probability 1 - (1 - s**rows)**bands; the default misses
6 in 100,000 pairs at s = 0.8 and fewer above.

Nulls and ties: a null, empty or wordless text has no links and is a class of its own.  Rows are told apart by their text, not
by their id: rows with a null id are linked like any other and only never name a class (a class without any id has a null
one), and rows sharing an id but not their text are documents of their own.  A text of fewer words than ``n`` has one
shingle: all its words.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.llm.tables import columns_of, free_name
from partmill.llm.textcore import mix, pieces, shingles, word_hashes
from partmill.operators.graph import connected_components
from partmill.sources.storage import materialize

#: Words of an n-gram, least similarity, bands and rows of a band.
N_WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
#: N-grams of the sets that one verification task holds for one side, and texts (the similarity matrix is square).
BLOCK_WORDS, BLOCK_TEXTS = 400_000, 1024
#: Characters of short texts that are read together.
TOGETHER = 1 << 18


def _text_keys(words: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A digest of each text's word sequence; None without words."""
    return [hashlib.md5(words[lo:hi].tobytes()).digest() if hi > lo else None for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]


def _signer(n: int, bands: int, rows: int):
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).astype(np.uint32)
    flip, odd = seeds[::2], seeds[1::2] | np.uint32(1)
    band_salt = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))

    def signed(texts: list[str | None]) -> pd.DataFrame:
        words, offsets = word_hashes(texts)
        grams, begin = shingles(words, offsets, n)
        has = np.diff(begin) > 0
        low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
        at = begin[:-1][has]
        keys = np.zeros((bands, len(at)), dtype=np.uint64)
        for b in range(bands):
            for r in range(b * rows, (b + 1) * rows):
                least = np.minimum.reduceat((low ^ flip[r]) * odd[r], at) if len(at) else at
                keys[b] = mix(keys[b] ^ least.astype(np.uint64))
            keys[b] = mix(keys[b] ^ band_salt[b])
        each = iter(keys.T.astype(np.int64))
        count = [len(np.unique(grams[a:b])) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        return pd.DataFrame({"text_key": _text_keys(words, offsets), "n_grams": count, "bands": [next(each) if h else None for h in has]})

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = column.tolist()
            yield pd.concat([signed(texts[lo:hi]) for lo, hi in pieces(texts, TOGETHER)] or [signed([])], ignore_index=True)

    return sign


def _link_block(copies, sides, sets, threshold: float, crossing: bool):
    """Links among texts held in one task: ``(linked documents, linked texts, star to the first of each part)``."""
    m = len(copies)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    _, first, count = np.unique(grams, return_index=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    common = np.zeros((m, m), dtype=np.float32)
    for lo in range(0, len(shared), 4096):
        part = shared[lo : lo + 4096]
        seen = np.zeros((m, len(part)), dtype=np.float32)
        for_gram = np.repeat(np.arange(len(part)), count[part])
        at = np.repeat(first[part] - (np.cumsum(count[part]) - count[part]), count[part]) + np.arange(int(count[part].sum()))
        seen[owner[at], for_gram] = 1
        common += seen @ seen.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if crossing:
        linked &= sides[:, None] != sides[None, :]
    label = np.arange(m)
    while True:
        best = np.where(linked, label[None, :], m).min(axis=1, initial=m)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return linked @ copies, linked.sum(axis=1), label


def _verifier(threshold: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["component", "node"], kind="stable")
        component, side = pdf["component"].to_numpy(), pdf["side"].to_numpy()
        crossing = bool(pdf["crossing"].iloc[0])
        cuts = np.flatnonzero(np.diff(component, prepend=component[0] - 1, append=component[-1] + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            ids, copies = pdf["node"].to_numpy()[lo:hi], pdf["copies"].to_numpy()[lo:hi]
            sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["grams"].iloc[lo:hi]]
            docs, texts, label = _link_block(copies, side[lo:hi], sets, threshold, crossing)
            has = texts > 0
            out.append(pd.DataFrame({"node": ids[has], "star": ids[label][has], "links": docs[has], "texts": texts[has]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "star": [], "links": [], "texts": []}).astype("int64")

    return verify


def _gram_sets(n: int):
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts, keys, found = column.tolist(), [], []
            for lo, hi in pieces(texts, TOGETHER):
                words, offsets = word_hashes(texts[lo:hi])
                grams, begin = shingles(words, offsets, n)
                keys += _text_keys(words, offsets)
                found += [np.unique(grams[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "grams": pd.Series(found, dtype=object)})

    return sets


def _sets_of_nodes(base: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``members`` (node, text_key, first_id, first_hash, ...) with the n-gram set of each node's text, without the columns that find it.

    A node's text is found by the id and the JVM's hash of its first row (the hash alone where that has a null id), so rows that
    share an id meet only the texts they are."""
    of_text = F.pandas_udf(_gram_sets(n), "key binary, grams binary").asNondeterministic()
    texts = base.where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    named = members.where("first_id is not null").join(texts.where("doc_id is not null"), (F.col("first_id") == F.col("doc_id")) & (F.col("first_hash") == F.col("text_hash")))
    nameless = members.where("first_id is null").join(texts.where("doc_id is null"), F.col("first_hash") == F.col("text_hash"))
    # Repeated rows hold a node's text, too; they lie together already, by the keys of the join.
    found = [df.select(*members.columns, of_text("text").alias("set")).where("set.key = text_key").dropDuplicates([*keys, "node"]) for df, keys in ((named, ["first_id", "first_hash"]), (nameless, ["first_hash"]))]
    return found[0].unionByName(found[1]).select("*", F.col("set.grams").alias("grams")).drop("set", "text_key", "first_id", "first_hash")


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (smallest id of its class), ``n_links`` (other documents with an
    n-gram Jaccard similarity of at least ``threshold``, copies included), ``n_text_links`` (those with another word
    sequence) and ``n_copies`` (documents with this very word sequence, itself included)."""
    base, signed, nodes = _sign(docs, id_col, text_col, n, bands, rows)
    found = _links(base, nodes, n, threshold)
    classes = connected_components(found, "node", "star", "ngram-classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    by_text = _named_classes(nodes, classes).join(links, "node", "left")
    by_text = by_text.select("text_key", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    out = signed.select("doc_id", "text_key").join(by_text, "text_key", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def _sign(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text) of every row, its signature, and the nodes: one for each word sequence."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    of_text = F.pandas_udf(_signer(n, bands, rows), "text_key binary, n_grams long, bands array<long>").asNondeterministic()
    signed = materialize(base.select("doc_id", F.xxhash64("text").alias("text_hash"), of_text("text").alias("s")).select("doc_id", "text_hash", "s.*"), "ngram-signatures")
    # The first row: the smallest id, then the smallest hash; rows with a null id come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first")
    nodes = signed.where("text_key is not null").groupBy("text_key").agg(first, F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    nodes = nodes.select("text_key", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "copies", "n_grams", "bands")
    # The number is any one; it is fixed as the table is written.
    return base, signed, materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, hub) of every bucket's star, and the (node, component) that the stars make."""
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    stars = banded.join(buckets, "bucket").where("node <> hub").select("node", "hub")
    return stars, connected_components(stars, "node", "hub", "ngram-candidates")


def _named_classes(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text_key, copies, first_id, first_hash, component, class_id) of every node: the class's smallest id."""
    own = nodes.select("node", "text_key", "copies", "first_id", "first_hash").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = own.join(classes.select("node"), "node", "left_semi").groupBy("component").agg(F.min("first_id").alias("named"), F.lit(True).alias("shared"))
    return own.join(names, "component", "left").withColumn("class_id", F.when(F.col("shared"), F.col("named")).otherwise(F.col("first_id"))).drop("named", "shared")


def _links(base: DataFrame, nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, star, links, texts): link counts and spanning stars from verifying all pairs of each candidate group."""
    _, groups = _candidates(nodes)
    members = materialize(nodes.drop("bands").join(groups, "node"), "ngram-members")
    return _verified(base, members, n, threshold)


def _similar(threshold: float):
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common >= threshold * (len(x) + len(y) - common) - 1e-6)
        return pd.Series(out, dtype=bool)

    return similar


def _stars_for_classes(base: DataFrame, nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, star): enough of the links for the classes.

    In a large candidate group every node is first compared with one hub only, that with which it shares most buckets.  A group
    that these links join is done; all pairs are verified only in small groups and in those that stay apart."""
    stars, groups = _candidates(nodes)
    members = materialize(nodes.drop("bands").join(groups, "node"), "ngram-members")
    large = members.join(_sized(members).where("parts > 1").select("component"), "component", "left_semi")
    if large.isEmpty():
        return _verified(base, members, n, threshold).select("node", "star")
    sets = materialize(_sets_of_nodes(base, large.select("node", "text_key", "first_id", "first_hash"), n), "ngram-large-sets")
    shared = stars.join(large.select("node"), "node", "left_semi").groupBy("node", "hub").count()
    nearest = shared.groupBy("node").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    pairs = nearest.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("grams").alias("hub_grams")), "hub")
    linked = pairs.where(F.pandas_udf(_similar(threshold), "boolean")("grams", "hub_grams"))
    linked = materialize(linked.select("node", F.col("hub").alias("star")), "ngram-stars")
    part_of = connected_components(linked, "node", "star", "ngram-parts").withColumnRenamed("component", "part")
    apart = large.join(part_of, "node", "left").groupBy("component").agg((F.min(F.coalesce("part", "node")) < F.max(F.coalesce("part", "node"))).alias("apart"))
    rest = members.join(apart.where("not apart").select("component"), "component", "left_anti")
    return linked.unionByName(_verified(base, rest, n, threshold).select("node", "star"))


def _parts() -> Column:
    return F.greatest(F.ceil(F.col("grams") / BLOCK_WORDS), F.ceil(F.col("texts") / BLOCK_TEXTS))


def _sized(members: DataFrame) -> DataFrame:
    """(component, grams, texts, parts) of the candidate groups; ``parts`` is 1 for those that fit in one task."""
    sized = members.groupBy("component").agg(F.sum("n_grams").alias("grams"), F.count("*").alias("texts"))
    return sized.withColumn("parts", _parts())


def _verified(base: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """``_links`` of ``members``: nodes with the ``component`` that is their candidate group."""
    sized = materialize(_sized(members), "ngram-groups")
    grams = sized.where("parts = 1").agg(F.sum("grams")).first()[0] or 0
    shared = max(1, math.ceil(2 * grams / BLOCK_WORDS))

    small = members.join(sized.where("parts = 1").select("component"), "component")
    small = small.select("node", "text_key", "first_id", "first_hash", "copies", "component", F.array(F.struct(
        F.lit(-1).cast("long").alias("group"), F.pmod(F.xxhash64("component"), F.lit(shared)).alias("left"), F.lit(-1).cast("long").alias("right"),
        F.lit(0).cast("long").alias("side"), F.lit(False).alias("crossing"))).alias("blocks"))
    # A large group: texts can only be linked to texts of the same or the next class of set size (classes are 1/threshold wide).
    large = members.join(sized.where("parts > 1").select("component"), "component")
    large = large.withColumn("band", F.floor(F.log(F.greatest("n_grams", F.lit(1))) / math.log(1 / threshold) + 1e-9))
    bands_of = large.groupBy("component", "band").agg(F.sum("n_grams").alias("grams"), F.count("*").alias("texts"))
    bands_of = materialize(bands_of.select("component", "band", _parts().cast("int").alias("parts")), "ngram-blocks")
    near = lambda by, name: bands_of.select("component", (F.col("band") + by).alias("band"), F.col("parts").alias(name))
    large = large.join(near(0, "parts"), ["component", "band"]).join(near(1, "below"), ["component", "band"], "left").join(near(-1, "above"), ["component", "band"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    code = lambda band, part: (band * F.lit(1 << 32) + part).cast("long")
    block = lambda left, right, side, crossing: F.struct(
        F.col("component").alias("group"), left.alias("left"), right.alias("right"), side.cast("long").alias("side"), crossing.alias("crossing"))
    self_code = code(F.col("band"), own)
    indexes = lambda count: F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(count, F.lit(0)) - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(indexes(F.col("parts")), lambda k: block(
        code(F.col("band"), F.least(own, k)), code(F.col("band"), F.greatest(own, k)), F.when(own <= k, 0).otherwise(1), own != k))
    up = F.transform(indexes(F.col("above")), lambda k: block(self_code, code(F.col("band") + 1, k), F.lit(0), F.lit(True)))
    down = F.transform(indexes(F.col("below")), lambda k: block(code(F.col("band") - 1, k), self_code, F.lit(1), F.lit(True)))
    large = large.select("node", "text_key", "first_id", "first_hash", "copies", "component", F.concat(within, up, down).alias("blocks"))

    sets = _sets_of_nodes(base, small.unionByName(large), n)
    spread = sets.select("node", "copies", "component", "grams", F.inline("blocks"))
    found = spread.groupBy("group", "left", "right").applyInPandas(_verifier(threshold), "node long, star long, links long, texts long")
    return materialize(found, "ngram-links")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class one row with its smallest id, and every row without words.

    A class whose rows all have a null id keeps one of them; of repeated rows one stays.  All columns stay as they are."""
    base, _, nodes = _sign(docs, id_col, text_col, N_WORDS, BANDS, ROWS)
    classes = connected_components(_stars_for_classes(base, nodes, N_WORDS, THRESHOLD), "node", "star", "ngram-classes")
    # The keeper: the text with the class's smallest id (none: last), of several the first by digest.
    order = F.struct(F.col("first_id").isNull(), "first_id", "text_key")
    keepers = _named_classes(nodes, classes).groupBy("component").agg(F.min_by(F.struct("first_id", "first_hash", "text_key"), order).alias("k"))
    keep_id, keep_hash, keep_key, found = (free_name(docs, x) for x in ("_keep_id", "_keep_hash", "_keep_key", "_keep_found"))
    keepers = materialize(keepers.select(F.col("k.first_id").alias(keep_id), F.col("k.first_hash").alias(keep_hash), F.col("k.text_key").alias(keep_key)), "ngram-keepers")
    text, own = F.col(text_col), columns_of(docs)
    key = F.pandas_udf(_keyed, "binary").asNondeterministic()(text)
    worded = docs.where(text.rlike(r"[A-Za-z0-9_]|[^\x00-\x7F]"))
    this = F.xxhash64(text) == F.col(keep_hash)
    named = worded.join(keepers.where(F.col(keep_id).isNotNull()), (F.col(id_col).cast("long") == F.col(keep_id)) & this)
    named = named.withColumn(found, key).where(F.col(found) == F.col(keep_key)).dropDuplicates([id_col, keep_key])
    nameless = worded.where(F.col(id_col).isNull()).join(keepers.where(F.col(keep_id).isNull()), this)
    nameless = nameless.withColumn(found, key).where(F.col(found) == F.col(keep_key)).dropDuplicates([keep_key])
    wordless = docs.where(~F.coalesce(text.rlike(r"[A-Za-z0-9_]|[^\x00-\x7F]"), F.lit(False)))
    return named.select(own).unionByName(nameless.select(own)).unionByName(wordless)


def _keyed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in batches:
        texts = column.tolist()
        yield pd.Series([key for lo, hi in pieces(texts, TOGETHER) for key in _text_keys(*word_hashes(texts[lo:hi]))], dtype=object)
