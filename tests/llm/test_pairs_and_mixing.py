"""Operators without a plain expression in SQL, against brute force on small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partmill.llm import decontaminate, mixing, ngram_join, secret_forest

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000


def table(name, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


# ---- near duplicates -----------------------------------------------------------------------------------------------


def gram_set(text, n=5):
    words = re.findall(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+", (text or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_join(rows, threshold=0.8):
    """id -> (class, links, links to other texts' word sequences)."""
    sets = [gram_set(t) for _, t in rows]
    links, parent = defaultdict(int), {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by_gram[g].append(k)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in by_gram[g]:
                common[j] += 1
        for j, c in common.items():
            if j > i and c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[rows[i][0]] += 1
                links[rows[j][0]] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d, _ in rows}


def test_op1_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == plain_join(table("documents", "doc_id, text"))


def family(rng, n, words=60):
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, 3))):
            own[at] = f"x{rng.integers(0, 9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [(400_000, 1024), (600, 16)])
def test_op1_families_in_blocks(spark, monkeypatch, block):
    """With small blocks, large groups are cut and crossed; no link may be lost."""
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", block[0])
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block[1])
    rng = np.random.default_rng(4)
    texts = [t for n in (1, 2, 3, 40, 60) for t in family(rng, n)] + ["", None, "one two", "one two", "One, two!", LONG, LONG + "x"]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    want = plain_join(rows)
    assert {d: n for d, (_, n) in got.items()} == {d: n for d, (_, n) in want.items()}
    assert got == want


def test_op1_repeated_passages_in_blocks(spark, monkeypatch):
    """A passage said once or several times has nearly the same n-gram set, though many more words."""
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", 600)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 16)
    once = family(np.random.default_rng(5), 40, words=100)
    texts = once + [" ".join([t] * (2 + k % 4)) for k, t in enumerate(once)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == plain_join(rows)


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f"), (1, "A b, c d e f"), (2, "q r s"), (4, None), (5, ""), (None, "z z"), (None, "z z"), (1, "A b, c d e f")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, component string")
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 4, 5]
    assert ngram_join.keep_one_per_class(docs.limit(0)).count() == 0


BIG = 9007199254740993


def test_op1_links_rows_by_their_text_whatever_their_ids(spark, monkeypatch):
    """Null ids, ids that repeat with another text, and ids that no float holds."""
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 8)
    long = " ".join(f"t{k}" for k in range(80))
    near = [f"{long} z{k}" for k in range(30)]
    rows = [(7, long), (None, long + " more"), (None, "only here and nowhere else"), (None, "only here and nowhere else"), (BIG, "large id text one two"), (BIG - 1, "large id text one two"), (3, "x y z"), (3, "p q r")]
    rows += [(100 + k, t) for k, t in enumerate(near)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, text_key int").coalesce(1)
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs).collect()]
    want = [(7, 7, 31), (None, 7, 31), (None, None, 1), (None, None, 1), (BIG, BIG - 1, 1), (BIG - 1, BIG - 1, 1), (3, 3, 0), (3, 3, 0)] + [(100 + k, 7, 31) for k in range(30)]
    assert Counter(got) == Counter(want)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one_per_class(docs).collect()]
    assert Counter(kept) == Counter([(7, long), (None, "only here and nowhere else"), (BIG - 1, "large id text one two"), (3, "x y z"), (3, "p q r")])


def test_classes_without_counts_are_the_same(spark, monkeypatch):
    """With small blocks: what the stars join, and what they leave apart."""
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", 600)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 16)
    rng = np.random.default_rng(8)
    rows = list(enumerate(t for n in (2, 30, 70) for t in family(rng, n)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_per_class(docs).collect()) == sorted({c for c, _ in plain_join(rows).values()})


# ---- decontamination -----------------------------------------------------------------------------------------------


def plain_alignment(a, b):
    score = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if x == y else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
    return int(score.max())


def test_alignment_equals_the_plain_recursion():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, int(rng.integers(1, 25))).astype(np.uint64), rng.integers(0, 6, int(rng.integers(1, 40))).astype(np.uint64)
        score, start, end = decontaminate.align(a, b)
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[start:end]) == score


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(20)] + [(90, None), (91, ""), (92, "tiny one")]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for k, (item, text) in enumerate(items[:20]):
        own = text.split()
        for at in rng.integers(0, 40, k % 6):
            own[at] = word()
        if k % 3 == 0:
            del own[20]
        docs.append((k, f"{fill(50)} {' '.join(own)} {fill(30)}"))
        want.add((k, item))
    docs += [(100 + k, fill(100)) for k in range(50)] + [(200, None), (201, ""), (202, LONG), (203, " ".join(items[0][1].split()[:8]) + " " + fill(50))]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks_per_item(decontaminate.find_leaks(frame, bench)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    left = decontaminate.drop_leaks(frame, bench)
    assert left.columns == frame.columns and left.count() == len(docs) - 20
    assert decontaminate.drop_leaks(frame, bench.limit(0)).count() == len(docs)
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def test_short_items_and_rows_without_an_id(spark, monkeypatch):
    """Items of one or two words are found inside texts; a leaked row goes whatever its id is, and only that row."""
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    leak = " ".join(f"q{k}" for k in range(20))
    bench = spark.createDataFrame([(1, "zebra"), (2, "Blue Whale"), (3, leak), (4, leak), (None, "a b c d e f g h")], "item_id long, text string")
    rows = [(None, f"see {leak} end"), (BIG, leak), (BIG - 1, "clean text"), (None, "clean text"), (5, "the zebra zebra"), (6, "my blue, whale"), (7, "whale blue"), (8, "blue"), (BIG, "same id but clean"), (None, "x a b c d e f g h")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _passages int").coalesce(1)
    found = Counter((r["doc_id"], r["item_id"], r["word_start"]) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == Counter([(None, 3, 1), (None, 4, 1), (BIG, 3, 0), (BIG, 4, 0), (5, 1, 1), (6, 2, 1), (None, None, 1)])
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(BIG - 1, "clean text"), (None, "clean text"), (7, "whale blue"), (8, "blue"), (BIG, "same id but clean")])


def test_op9_equals_aligning_every_pair(spark):
    """All pairs of text and item, aligned by the plain recursion; copies with a growing share of words changed."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = [[word() for _ in range(24)] for _ in range(6)]
    docs = []
    for k in range(60):
        own = list(items[k % 6])
        for at in rng.permutation(24)[: k // 6]:
            own[at] = word()
        docs.append([word() for _ in range(8)] + own + [word() for _ in range(8)])
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks_per_item(decontaminate.find_leaks(frame, bench)).collect()}
    scores = {(d, i): plain_alignment(items[i], docs[d]) / 48 for d in range(60) for i in range(6)}
    want = {pair: s for pair, s in scores.items() if s >= 0.5}
    assert all(want.get(pair) == s for pair, s in found.items())
    # A pair above the threshold without two runs of three unedited words has no seeds.
    assert len(found) >= 0.95 * len(want)


@pytest.mark.parametrize("verbatim", [0, 5])
def test_copies_edited_at_every_few_words_are_found(spark, monkeypatch, verbatim):
    """Whatever else is in the corpus, and however few hits are held at once."""
    monkeypatch.setattr(decontaminate, "HITS", 7, raising=False)
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    fill = lambda n: " ".join(word() for _ in range(n))
    items = [(k, fill(40)) for k in range(12)] + [(50 + k, fill(5)) for k in range(3)]
    docs, want = [], set()
    for item, text in items:
        for every in (4, 5, 6) if item < 50 else (5,):
            own = [word() if k % every == every - 2 else w for k, w in enumerate(text.split())]
            docs.append((len(docs), f"{fill(20)} {' '.join(own)} {fill(20)}"))
            want.add((len(docs) - 1, item))
        for _ in range(verbatim):
            docs.append((len(docs), f"{fill(9)} {text} {fill(9)}"))
            want.add((len(docs) - 1, item))
    docs += [(len(docs) + k, fill(60)) for k in range(20)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks_per_item(decontaminate.find_leaks(frame, bench)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


def test_op9_finds_every_verbatim_item(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks_per_item(decontaminate.find_leaks(docs, bench)).collect()}
    words = lambda t: " " + " ".join(re.findall(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+", (t or "").lower())) + " "
    items = [(i, words(t)) for i, t in table("benchmark", "item_id, text")]
    assert {(d, i) for d, t in table("documents", "doc_id, text") for i, w in items if w in words(t)} <= found


# ---- secrets -------------------------------------------------------------------------------------------------------


def test_forest_on_findings_it_has_not_seen(spark):
    """All of them: a secret that is not proposed, or proposed with another span, is a miss."""
    model = secret_forest.train_forest(spark)
    unseen = secret_forest.labelled_findings(800, seed=123)
    docs = spark.createDataFrame([(BIG + k, b + c + a, p, 1.5) for k, (c, b, a, p, _) in enumerate(unseen)] + [(None, None, None, 1.0)], "doc_id long, text string, source string, features double")
    found = {(r["doc_id"] - BIG, r["start"], r["end"]) for r in secret_forest.scan_secrets(docs.coalesce(1), model).where("is_secret").collect()}
    true = {(k, len(b), len(b) + len(c)) for k, (c, b, _, _, label) in enumerate(unseen) if label}
    assert len(found & true) / len(true) > 0.95
    assert len(found & true) / len(found) > 0.9


@pytest.mark.parametrize("before", ["password=", "Password: ", 'token = "', "api_key=", "api-key => ", "secret := '", "my_token=", '"auth": "', "x;pwd="])
def test_an_assigned_value_is_the_candidate(before):
    value = "abc123def456ghi789"
    text = f"see {before}{value}"
    assert [text[s:e] for s, e in secret_forest.candidates_of(text + "; end")] == [value]


def test_secret_edges(spark):
    key = "AKIA" + "Q7" * 8
    docs = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, f"é {key} end", "a/b.py"), (3, f"é {key} end", "a/b.py"), (4, LONG + f'token = "{"0af9" * 10}"', None)], "doc_id long, text string, source string")
    model = secret_forest.train_forest(spark)
    got = sorted((r["doc_id"], r["start"], r["candidate"]) for r in secret_forest.scan_secrets(docs, model).collect())
    assert got == [(3, 2, key), (3, 2, key), (4, len(LONG) + 9, "0af9" * 10)]
    assert secret_forest.scan_secrets(docs.drop("source").limit(0), model).count() == 0


# ---- mixing --------------------------------------------------------------------------------------------------------


def test_raking_equals_numpy(spark):
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 50, (4, 3, 2))
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(tokens[i, j, k])) for i in range(4) for j in range(3) for k in range(2) if tokens[i, j, k]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    shares = [rng.random(n) for n in (4, 3, 2)]
    names = [[f"{c}{k}" for k in range(n)] for c, n in (("s", 4), ("l", 3), ("t", 2))]
    targets = {m: spark.createDataFrame([*zip(n, map(float, s), strict=True), ("absent", 9.0)], "value string, share double") for m, n, s in zip(mixing.MARGINALS, names, shares, strict=True)}
    got = {(r["source"], r["lang"], r["topic"]): r["raked"] for r in mixing.rake(cells, targets)[0].collect()}
    x = tokens.astype(float)
    for _ in range(200):
        for axis, s in enumerate(shares):
            other = tuple(a for a in range(3) if a != axis)
            factor = s / s.sum() * tokens.sum() / x.sum(axis=other)
            x *= factor.reshape([-1 if a == axis else 1 for a in range(3)])
    for (i, j, k), value in np.ndenumerate(x):
        assert abs(got.get((f"s{i}", f"l{j}", f"t{k}"), 0.0) - value) < 1e-2
    fitted = mixing.fit_mix(cells, targets, budget=0.4).join(cells, list(mixing.MARGINALS))
    r = fitted.agg(F.sum(F.col("probability") * F.col("tokens")), F.max("probability"), F.sum("tokens")).first()
    assert r[1] <= 1 and abs(r[0] / r[2] - 0.4) < 0.01


def test_targets_that_contradict_each_other_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    shares = lambda **s: spark.createDataFrame(list(s.items()), "value string, share double")
    with pytest.warns(UserWarning, match="raking stopped"):
        raked, off = mixing.rake(cells, {"source": shares(a=1.0, b=3.0), "lang": shares(x=3.0, y=1.0), "topic": shares(t=1.0)}, rounds=5)
    assert off > 0.1 and raked.count() == 2


def test_mix_edges(spark):
    rows = [(k, "a b c", "s1" if k % 3 else None, "en" if k % 2 else None) for k in range(300)] + [(None, None, None, None), (7, "", "s1", "en"), (8, LONG, "s2", "fr")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, source string, lang string, weight double, topic string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["probability"] <= 1 and r["sampled"] == (r["draw"] < r["probability"]) for r in out)
    kept = mixing.keep_sampled(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["sampled"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.keep_sampled(docs.limit(0)).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, SF)
        assert new.columns == docs.columns, name
        assert 0 < new.count() <= kept.count(), name
        kept = new
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in kept.collect())
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))


def test_pipeline_on_odd_tables(spark):
    """Nulls, repeated rows and ids, large ids, a leak without an id, and columns with the stages' own names; then no rows."""
    leak = duckdb.sql(f"select text from '{SF}/benchmark.parquet' order by item_id limit 1").fetchall()[0][0]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, leak + " and more", "en", "s", 1), (BIG, "the quick brown fox " * 9, None, None, None), (BIG + 1, "the quick brown fox " * 9, None, None, None), (BIG, None, "en", "s", 0), (None, None, None, None, None), (7, "123", "en", "s", 3)]
    both = docs.union(spark.createDataFrame(odd + odd[:2], docs.schema)).withColumns({"_language": F.lit("x"), "_mix_p": F.lit(2.0), "node": F.lit(1), "_passages": F.lit(None).cast("string")})
    for table_in in (both, both.limit(0)):
        kept = table_in
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.materialize(stage(spark, kept, SF), "test-stage")
            assert kept.columns == both.columns
            texts = [r["text"] for r in kept.collect()]
            assert None not in texts and "123" not in texts
        assert leak + " and more" not in texts
        tokens = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
        assert sorted((r["doc_id"] or -1) for r in tokens) == sorted((r["doc_id"] or -1) for r in kept.collect())
        assert texts.count("the quick brown fox " * 9) <= 1
