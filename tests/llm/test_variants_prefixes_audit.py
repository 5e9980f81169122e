"""Spelling variants, BPE by prefixes and the source audit, and faults mended in the earlier operators."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partmill.llm import bpe_prefixes, decontaminate, language_id, mixing, ngram_join, queries, secret_forest, source_audit, spelling_variants, token_store

SF = "/root/testdata/sf0.001"


def documents(columns="doc_id, text"):
    return duckdb.sql(f"select {columns} from '{SF}/documents.parquet'").fetchall()


# ---- spelling variants ---------------------------------------------------------------------------------------------


def plain_words(rows, deletes=31):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if deletes and h % deletes == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, []) if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_op11_on_the_smallest_table(spark):
    found = {tuple(r) for r in queries.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == plain_variants(plain_words(documents()))


def test_op11_chains_pads_repeats_and_long_words(spark):
    rng = random.Random(3)
    words = {"letters": 5000, "lettersx": 400, "lettersxy": 30, "xlettersxy": 2, "aaaaaaa": 9, "aaaaaaaa": 90, "aaaaaaaaa": 900, "ététété": 7, "etetete": 2, "ÿ" * 7: 3, "ÿ" * 6 + "z": 40}
    for _ in range(400):
        words["".join(rng.choice("ab") for _ in range(rng.randrange(7, 11)))] = rng.randrange(2, 2000)
    long = "".join(rng.choice("abcdef") for _ in range(500))
    words |= {long: 50, long[:250] + long[251:]: 3, long + "a": 2, "z" + long[1:]: 2, "".join(rng.choice("abcdef") for _ in range(500)): 2}
    found = {tuple(r) for r in spelling_variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert found == plain_variants(words)
    assert ("xlettersxy", "lettersxy", "letters", 2, 1, 30) in found


def test_op11_merges_postings_over_many_batches(spark):
    """Few letters make long posting lists; an Arrow batch holds a part of one."""
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(12)): rng.randrange(2, 500) for _ in range(1500)}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = {tuple(r) for r in spelling_variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found == plain_variants(words)


def test_op11_edges(spark):
    rows = [(1, None), (2, ""), (3, "1234567 --- ??"), (None, "ZebraÉtoile zebraÉtoile"), (5, "short wœrdlike 中zzzzzzz zzzzzzz"), (5, "zzzzzzz"), (6, "longword " * 20_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    found = {tuple(r) for r in spelling_variants.group_variants(spelling_variants.count_words(docs)).collect()}
    assert found == plain_variants(plain_words(rows))
    plain = {tuple(r) for r in spelling_variants.count_words(docs, deletes=0).collect()}
    assert plain == set(plain_words(rows, deletes=0).items())
    assert spelling_variants.group_variants(spelling_variants.count_words(docs.limit(0))).collect() == []


# ---- BPE by prefixes -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, bpe_prefixes.PrefixEncoder(path), Tokenizer.from_file(path)


def same_as_library(bpe, texts):
    _, own, library = bpe
    ids, counts = own.encode(texts)
    for text, found, there in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert found.tolist() == there.ids, text
        assert own.decode(found) == library.decode(there.ids, skip_special_tokens=False)


def test_op12_whole_table_against_the_library(spark, bpe):
    path, _, library = bpe
    import hashlib

    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_bpe_prefixes(spark, SF).collect()}
    rows = documents()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert found[doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_op12_every_character(bpe):
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0200)]
    for lo in range(0, len(every), 20_000):
        same_as_library(bpe, [f"a{c}b{c}{c} {c}1{c}" for c in every[lo : lo + 20_000]])


def test_op12_random_long_and_odd_texts(bpe):
    rng = random.Random(11)
    parts = ["a", "b", "A", "1", " ", "\n", "\t", "'s", "'ll", "'", "<|endoftext|>", "<|endoftext", "aaaa", "----", "    ", "é", "中", "\x1c", "\x85", "　", "\U0001f600", ".", "_", "the", " the"]
    same_as_library(bpe, ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(4000)])
    same_as_library(bpe, [None, "", " ", "a" * 100_000, "-" * 50_000 + "x", "é" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), "word " * 50_000])


def test_op12_of_long_and_short_words_agree(bpe):
    path, own, _ = bpe
    alone = bpe_prefixes.PrefixEncoder(path, remembered=100, short=0)
    texts = [t for _, t in documents()][:40]
    for a, b in zip(own.encode(texts), alone.encode(texts), strict=True):
        assert (a == b).all()
    assert (alone.encode(texts)[0] == own.encode(texts)[0]).all()  # all forgotten in between


def test_op12_decodes_any_ids(bpe):
    _, own, library = bpe
    rng = np.random.default_rng(2)
    for _ in range(2000):
        ids = rng.integers(0, 50_257, int(rng.integers(0, 12))).tolist()
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_op12_columns_and_edges(spark, bpe):
    path = bpe[0]
    df = spark.createDataFrame([(1, None, "a"), (1, "x y", "b"), (None, "x y", "c"), (3, "", "d")], "doc_id long, text string, _id string")
    out = df.withColumn("ids", bpe_prefixes.encode_column(F.col("text"), path)).withColumn("back", bpe_prefixes.decode_column(F.col("ids"), path))
    assert sorted((r["_id"], r["ids"], r["back"]) for r in out.collect()) == [("a", [], ""), ("b", [87, 331], "x y"), ("c", [87, 331], "x y"), ("d", [], "")]
    assert sorted(r["n_tokens"] for r in bpe_prefixes.round_trip(df, path).collect()) == [0, 0, 2, 2]
    assert bpe_prefixes.round_trip(df.limit(0), path).collect() == []
    with pytest.raises(ValueError):
        bpe_prefixes.PrefixEncoder(public_tokenizers.path("word_bpe_49k.json"))


# ---- source audit --------------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs=10, top=10):
    counts, docs, groups = {}, Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = Counter("".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        counts.setdefault((lang, source), Counter()).update(own)
        docs.update((lang, t) for t in own)
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        terms = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        n = {s: sum(counts[lang, s][t] for t in terms) for s in sources}
        share = lambda c, total: 1 + 1_000_000_000 * (c + 2) // (total + 2 * len(terms))
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in terms} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in terms}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            own = [(-f(p[s][t], q[t]), t) for t in terms if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(items, 1)}
    return out


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize(("heavy", "block"), [(0.5, 256), (2.0, 256), (-1.0, 256), (0.3, 3)])
def test_op13_on_the_smallest_table(spark, monkeypatch, heavy, block):
    """As registered; all terms light; all heavy; and in many blocks."""
    monkeypatch.setattr(source_audit, "HEAVY", heavy)
    if block != source_audit.BLOCK:  # workers import the module anew, so blocks are tried on the functions themselves
        rng = np.random.default_rng(1)
        p = rng.integers(1, 10**9, (5, 7))
        sums, same = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64)
        flat = lambda a, of: [np.tile(of, 5), a[:, of].ravel(), a[:, of].ravel()]
        source_audit._sum_dense(sums, flat(p, np.arange(3)), flat(p, np.arange(3, 7)), 5, False)
        source_audit._sum_dense(same, flat(p, np.array([2, 0, 1])), flat(p, np.array([2, 0, 1])), 5, True)
        f = lambda i, j: sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p[:, i], p[:, j], strict=True))
        assert all(sums[i, j - 3] == f(i, j) for i in range(3) for j in range(3, 7))
        assert all(same[i, j] == (f(i, j) if i < j else 0) for i in range(3) for j in range(3))
        return
    found = {tuple(r) for r in queries.op13_source_audit(spark, SF).select(*COLUMNS).collect()}
    assert found == plain_audit(documents("text, lang, source"))


def test_op13_more_groups_than_a_block_holds(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps", "été", "zeta"]) for _ in range(6)), "en", f"s{k % 300}") for k in range(700)]
    rows += [(f"rare{k % 9} alpha", "en", f"s{k % 4}") for k in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = {tuple(r) for r in source_audit.audit_sources(df).select(*COLUMNS).collect()}
    assert found == plain_audit(rows)


def test_op13_edges(spark):
    rows = [(None, None, None), ("", "en", "a"), ("one two", "en", "b"), ("zwölf", "de", "only"), ("123 ...", "fr", "a"), ("123", "fr", "b")] + [("Same same THING ÉTÉ", "es", s) for s in ("x", "y", None)] * 10
    df = spark.createDataFrame([(*r, "extra") for r in rows], "text string, lang string, source string, term string")
    found = {tuple(r) for r in source_audit.audit_sources(df).select(*COLUMNS).collect()}
    assert found == plain_audit(rows)
    assert source_audit.audit_sources(df.limit(0)).collect() == []


# ---- faults mended -------------------------------------------------------------------------------------------------


def test_op4_learns_languages_of_copies(spark):
    rows = [(k, "der die das und nicht ist", "de") for k in range(400)] + [(1000 + k, f"the word number {'x' * (k % 7)} and this", "en") for k in range(400)] + [(5000 + k, "1234", "fr") for k in range(400)] + [(6000, "le chat est sur la table", "fr")]
    for shift in (0, 10_000, 20_000):
        docs = spark.createDataFrame([(d + shift, t, x) for d, t, x in rows], "doc_id long, text string, lang string")
        assert set(language_id.learn_profiles(docs, per_lang=100)) == {"de", "en", "fr"}
        assert set(language_id.learn_profiles(docs.drop("doc_id"), per_lang=1)) == {"de", "en", "fr"}


@pytest.mark.parametrize("c", ["a", "A", "-", "=", "aA", "password=", "ghp_"])
def test_op6_long_runs_take_linear_time(c):
    began = time.time()
    secret_forest.candidates_of(c * (1_000_000 // len(c)))
    assert time.time() - began < 1


def test_op6_runs_with_letters_of_both_cases():
    for run, is_one in (("a" * 20, False), ("A" * 20, False), ("A" + "a" * 20, False), ("AA" + "a" * 20, True), ("a" * 20 + "AA", True), ("A" * 20 + "a", True), ("-" * 20, False), ("A" + "a" * 20 + "A", True)):
        assert bool(secret_forest.candidates_of(run)) == is_one, run


def test_op1_many_rows_of_one_id(spark):
    texts = [" ".join(f"w{(k // 2) * 40 + j}" for j in range(40)) + (" tail" if k % 2 else "") for k in range(3000)]
    rows = [(7, t) for t in texts]
    began = time.time()
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shared = time.time() - began
    assert len(found) == 3000 and {(r["class_id"], r["n_links"], r["n_text_links"]) for r in found} == {(7, 1, 1)}
    assert shared < 60  # 1,600 such rows took 81 s when each met all others
    kept = ngram_join.keep_one_per_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == 1500


def test_op10_null_topics_keep_their_rows(spark):
    df = spark.createDataFrame([(k, f"text {k}", "s", "en", None if k % 2 else "t") for k in range(20)], "doc_id long, text string, source string, lang string, subject string")
    found = mixing.mix(df, topic=F.col("subject")).collect()
    assert len(found) == 20 and {r["topic"] for r in found} == {"", "t"}


def test_op5_equal_rows_and_many_empty_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "same text")] * 500 + [(2, None)] * 500, "doc_id long, text string").repartition(4)
    found = token_store.read_token_digests(token_store.write_token_shards(df, queries.tokenizer_path())).collect()
    assert Counter(r["doc_id"] for r in found) == {1: 500, 2: 500}
    assert sorted(r["start"] for r in found) == sorted([3 * k for k in range(500)] + [1500 + k for k in range(500)])


def test_op9_rows_sharing_an_id_and_rare_seeds(spark):
    item = "which of the following best describes the quantum tunnelling of alpha particles through a barrier"
    bench = spark.createDataFrame([(1, item), (2, "which of the following is not a valid colour of the rainbow")], "item_id long, text string")
    leak = f"intro words here {item} and more"
    noise = [(100 + k, f"which of the following things number {k} which of the following") for k in range(200)]
    docs = spark.createDataFrame([(None, leak), (None, leak), (5, leak), (5, leak + " twice " + item), *noise], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in found) == {(None, 1): 2, (5, 1): 2}
    # Frequent n-grams that share a word with rare ones are no seeds; an item without rare ones keeps all.
    grams, item_of, place = np.arange(6), np.array([0, 0, 0, 0, 0, 1]), np.array([0, 1, 2, 3, 4, 0])
    assert decontaminate._rare_seeds(grams, item_of, place, np.array([1, 9, 9, 9, 9, 0]), 5, 3).tolist() == [True, False, False, True, True, True]
