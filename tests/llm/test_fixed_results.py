"""The queries with fixed results against plain Python over the smallest tables, and hand-made edge rows."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partmill.llm import divergence_rules, language_id, pii_crf, queries, token_store, url_rules, warc

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000


def table(name, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


# ---- personal data -------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii_crf.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], pii_crf.KINDS.index(s[2])))


def test_base_spans_equal_plain_regular_expressions():
    rng = np.random.default_rng(1)
    pieces = ["a", "b@", "@", ".", "1", "25", ".", "-", " ", "+", "4111111111111111", "(", ")", "é", "%", "a.b", "1.2.3.4", "300", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 25))))
        assert pii_crf.base_spans(text)[0] == plain_spans(text), text
    for (text,) in table("documents", "text"):
        assert pii_crf.base_spans(text)[0] == plain_spans(text)


def test_op2(spark):
    got = {r["doc_id"]: r for r in queries.op2_pii_crf(spark, SF).collect()}
    rows = table("documents", "doc_id, text")
    assert len(got) == len(rows)
    for doc_id, text in rows:
        spans = plain_spans(text or "")
        named = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        r = got[doc_id]
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii_crf.KINDS] == [sum(x[2] == k for x in spans) for k in pii_crf.KINDS]
        assert set(filter(None, named.split(","))) <= set(r["spans"].split(","))


def test_field_finds_other_spellings_and_masks(spark):
    field = pii_crf.default_field()
    unseen = pii_crf.labelled_texts(200, seed=77)
    found = pii_crf.added_spans(field, [t for t, _ in unseen])
    right = sum(sorted(a) == sorted(b) for a, (_, b) in zip(found, unseen, strict=True))
    assert right / len(unseen) > 0.9
    text = "please call (555) 010-7788 or write to ann at shop dot com today"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, "", 7), (4, LONG + "a@b.co", 8)], "doc_id long, text string, pii int")
    found = pii_crf.find_personal_data(docs)
    by_id = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["pii"]] for r in found.collect()}
    assert by_id == {1: [("phone", False), ("email", False)], 2: [], 3: [], 4: [("email", True)]}
    masked = {r["doc_id"]: r["text"] for r in pii_crf.mask(docs, found).collect()}
    assert masked[1] == "please call <phone> or write to <email> today"
    assert masked[2] is None and masked[4].endswith("<email>")
    assert pii_crf.find_personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("number", ["(212) 555-1234\n", "212-555-1234, "])
def test_long_lists_are_found_whole(number):
    """2000 numbers are one stretch without gaps; every one lies in a span, as in a short list."""
    for k, spans in zip((20, 2000), pii_crf.find_spans(pii_crf.default_field(), [number * 20, number * 2000]), strict=True):
        places = [(i * len(number), i * len(number) + len(number.rstrip(", \n"))) for i in range(k)]
        assert sum(any(s <= lo and hi <= e and kind == "phone" for s, e, kind, _ in spans) for lo, hi in places) == k


def plain_labels(field, text):
    """The spans of one Viterbi pass over all tokens of a text."""
    start, end, shape, gap = pii_crf.tokens_of(text)
    if not len(start):
        return []
    row = pii_crf.viterbi(field, np.pad(shape, (3, 3))[None], gap[None], np.array([len(start)]))[0]
    out = []
    for b in np.flatnonzero(row % 2 == 1):
        e = b + 1
        while e < len(row) and row[e] == row[b] + 1:
            e += 1
        out.append((int(start[b]), int(end[e - 1]), pii_crf.KINDS[(row[b] - 1) // 2]))
    return out


def test_leaving_tokens_out_changes_nothing(monkeypatch):
    """Every text is decoded whole: what may not be labelled is left out, and the rest gives the same as all."""
    field = pii_crf.default_field()
    texts = [t or "" for (t,) in table("documents", "text")][:80] + [t for t, _ in pii_crf.labelled_texts(300, seed=5)] + ["", " ", "1", "a" * 3000, "@" * 500, "at dot com " * 200]
    want = [plain_labels(field, t) for t in texts]
    for cells, together in ((1 << 15, 1 << 18), (50, 300)):
        monkeypatch.setattr(pii_crf, "CELLS", cells)
        monkeypatch.setattr(pii_crf, "TOGETHER", together)
        assert [sorted(x) for x in pii_crf.added_spans(field, texts)] == want


def test_spellings_without_digits_in_any_case():
    texts = ["please write to marta(at)holden.com today", "write to ann [AT] shop.org now", "write to ann (arroba) shop.net", "or write to ann at shop dOT com today", "write to marta AT holden DOT com"]
    assert [[(t[s:e], k) for s, e, k in found] for t, found in zip(texts, pii_crf.added_spans(pii_crf.default_field(), texts), strict=True)] == [
        [("marta(at)holden.com", "email")], [("ann [AT] shop.org", "email")], [("ann (arroba) shop.net", "email")], [("ann at shop dOT com", "email")], [("marta AT holden DOT com", "email")],
    ]


def test_long_runs_neither_crash_nor_hang():
    field = pii_crf.default_field()
    zeros = "1." + "0" * 5000 + ".2.3"
    assert pii_crf.base_spans(zeros)[0] == [(0, len(zeros), "ip")]
    began = time.time()
    pii_crf.find_spans(field, ["1a" * 500_000, "7" * 1_000_000, "a@" * 200_000, "1.2.3.4," * 50_000])
    assert time.time() - began < 60


def test_viterbi_in_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    field = pii_crf.default_field()
    shape, gap, length = rng.integers(0, pii_crf.S, (5, 103)), rng.integers(0, 2, (5, 103)), np.array([103, 90, 41, 40, 1])
    shape = np.pad(shape, ((0, 0), (3, 3)))
    whole = pii_crf.viterbi(field, shape, gap, length)
    monkeypatch.setattr(pii_crf, "CELLS", 37)
    assert (pii_crf.viterbi(field, shape, gap, length) == whole).all()


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    shape = rng.integers(0, pii_crf.S, (3, 4))
    gap = rng.integers(0, 2, (3, 4))
    n = pii_crf.L
    field = pii_crf.Field(rng.normal(size=(7, pii_crf.S, n)), rng.normal(size=(2, pii_crf.S**2, n)), rng.normal(size=(2, n)), rng.normal(size=(n, n)))
    emit = field.emissions(shape, gap)
    length = np.array([4, 3, 1])
    got = pii_crf.viterbi(field, np.pad(shape, ((0, 0), (3, 3))), gap, length)
    for r in range(3):
        best = {(b,): emit[r, 0, b] for b in range(n) if pii_crf._START[b]}
        for t in range(1, length[r]):
            best = {p + (b,): s + field.step[p[-1], b] + emit[r, t, b] for p, s in best.items() for b in range(n) if pii_crf._ALLOWED[p[-1], b]}
        assert tuple(got[r, : length[r]]) == max(best, key=best.get)


# ---- URLs ----------------------------------------------------------------------------------------------------------


def plain_rule(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after).group()
    path = re.match(r"[^?#]*", after[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(r.name), r.name, r.action)
        for r in queries.HOST_RULES
        if (host == r.name.split("/")[0] or host.endswith("." + r.name.split("/")[0])) and path.startswith(r.name[r.name.index("/") :])
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_op3(spark):
    got = {r["page_id"]: r for r in queries.op3_url_rules(spark, SF).collect()}
    for page_id, url in table("pages", "page_id, url"):
        host, path, rule, action = plain_rule(url)
        r = got[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (action or "allow")


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://A.Net/x?y#z", "http://net/", "http://net?x=/", "http://xnet/", "http://a.example.net/en/1", "http://example.net/enx",
    "http://example.net/en", "https://b.example.com/de/x", "https://b.example.com/DE/x", "https://q.org/fr/", "https://q.org#/fr/", "a://b://c.net/d", "http://a.net:80/", "http://shop.example.com/login?next=1",
    "http://shop.example.com/loginpage", "http://ads.example.com/ads/1", "http://é.net/ü", "http://a.net/" + "x" * 200_000,
]


@pytest.mark.parametrize("per_pass", [50_000, 3])
def test_urls_at_the_edges(spark, per_pass):
    rows = [(k, u, "x") for k, u in enumerate(URLS)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, _text string")
    rules = queries.HOST_RULES + url_rules.PATTERNS
    for r in url_rules.judge_urls(df, rules, rules_per_pass=per_pass).collect():
        url = URLS[r["page_id"]]
        host, path, rule, action = plain_rule(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        # every rule, without the index
        after = url.split("://", 1)[1] if url and "://" in url else ""
        text = host + after[len(re.match(r"[^/?#]*", after).group()) :]
        fitting = [x for x in rules if re.search(x.regex(), text)]
        best = max(fitting, key=lambda x: x.rank, default=None)
        assert r["pattern"] == (best.pattern if best else None)
        assert r["verdict"] == (best.action if best else "allow" if host else "block")
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0


# ---- languages -----------------------------------------------------------------------------------------------------


def test_op4_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op4_language_rank_order(spark, SF).collect()}
    rows = table("documents", "doc_id, lang, length(text)")
    assert len(got) == len(rows)
    held = [(got[d]["lang_pred"], lang) for d, lang, n in rows if zlib.crc32(str(d).encode()) % 4 == 2 and n > 50]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def plain_profile(counts, limit):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:limit]]


def plain_grams(text):
    padded = re.sub("_+", "_", "".join(c if c.isalpha() else "_" for c in f" {(text or '').lower()} "))
    found = Counter(c for c in padded if c != "_") + Counter(padded[i : i + 2] for i in range(len(padded) - 1)) + Counter(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != "_")
    return found


def test_op4_equals_plain_rank_order(spark):
    """Every document's language and score by plain counting; with so few documents all are learned from."""
    rows = table("documents", "doc_id, text, lang")
    counts = defaultdict(Counter)
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2 and text is not None and lang is not None:
            counts[lang].update(plain_grams(text))
    places = {lang: {g: k for k, g in enumerate(plain_profile(c, language_id.PROFILE))} for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in queries.op4_language_rank_order(spark, SF).collect()}
    for d, text, _ in rows:
        own = plain_profile(plain_grams(text), language_id.DOCUMENT_PROFILE)
        if not own:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(min(abs(p[g] - k), len(p)) if g in p else len(p) for k, g in enumerate(own)) / (len(own) * len(p)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get)
        assert got[d]["lang_pred"] == best and abs(got[d]["score"] - (1 - far[best])) < 1e-9, d


def test_texts_without_letters_are_undetermined(spark):
    texts = ["\U0001f600\U0001f600 123", "\u0301\u0308", "12 34", "\U0001d400\U0001d401", "中文", "ª"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    profiles = language_id.learn_profiles(spark.createDataFrame([("the cat", "en")], "text string, lang string"))
    assert [r["lang_pred"] for r in language_id.predict_languages(docs, profiles).orderBy("doc_id").collect()] == ["und", "und", "und", "en", "en", "en"]


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (None, None, None), (4, "123 --", "en"), (5, "", None), (6, "the " * 100_000, None)], "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_languages(docs, profiles).collect()}
    assert got == {1: "en", 2: "fr", None: "und", 4: "und", 5: "und", 6: "en"}
    assert {r["lang_pred"] for r in language_id.predict_languages(docs, {}).collect()} == {"und"}
    assert language_id.learn_profiles(docs.limit(0)) == {}


# ---- tokens --------------------------------------------------------------------------------------------------------


def plain_tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_op5(spark):
    got = {r["doc_id"]: r for r in queries.op5_token_planes(spark, SF).collect()}
    rows = sorted(table("documents", "doc_id, text"))
    at = 0
    for (doc_id, _), ids in zip(rows, plain_tokens([t for _, t in rows]), strict=True):
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


ATOMS = [
    "a", "T", "H", "The", "'s", "'S", "'re", "n't", "it's", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "1", "12", "½", "²", "é", "É", "e\u0301", "T\u0308", "H\u0331", "W\u030a", "Y", "\u030a", "J\u030c", "\u0308",
    "ß", "İ", "Σ", "ς", "!", "!!", "¡", "-", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "\U0001f600", "\u1112\u1161\u11ab", "你好", "\u200d", "ﬁ", "\u212b", "…", "''", "#", "$", "ǅ", "\u0345", "\ufeff",
]


def test_ids_equal_the_library_on_any_text():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(ATOMS, int(rng.integers(1, 14)))) for _ in range(6000)]
    mine = token_store.WordEncoder(queries.tokenizer_path(), remembered=500)
    for lo in range(0, len(texts), 300):
        part = [*texts[lo : lo + 300], None, ""]
        ids, counts = mine.encode(part)
        for t, got, want in zip(part, np.split(ids, np.cumsum(counts)[:-1]), plain_tokens(part), strict=True):
            assert [*got, 1] == want, t


def test_a_word_is_looked_up_once_a_piece():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    mine = token_store.WordEncoder(queries.tokenizer_path())
    mine.number = Counted()
    part = ["The cat's hat " * 500, None, "", "the hat! é e\u0301", " \n"]
    ids, counts = mine.encode(part)
    for got, want in zip(np.split(ids, np.cumsum(counts)[:-1]), plain_tokens(part), strict=True):
        assert [*got, 1] == want
    assert mine.number.asked <= 8 and mine.uses.sum() == 1500 + 5
    assert [len(x) for x in mine.encode([])] == [0, 0] and [len(x) for x in mine.encode([None, " "])] == [0, 2]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_shards_round_trip(spark, kind):
    texts = [(3, "It's a.b, c!! 12x"), (1, None), (2, ""), (None, "İ é É. Σας"), (5, LONG), (5, "same id"), (4, "<|endoftext|> a"), (6, "a\x0bb\x1cc\x85d\xa0e")]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, tie int")
    manifest = token_store.write_token_shards(df, queries.tokenizer_path(), kind=kind, block_ids=64, shard_ids=500)
    got = token_store.read_token_ids(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6]
    want = defaultdict(list)
    for (d, _), ids in zip(texts, plain_tokens([t for _, t in texts]), strict=True):
        want[d].append(ids)
    at = 0
    for r in got:
        assert r["ids"] in want[r["doc_id"]]
        assert r["start"] == at
        at += len(r["ids"])
    assert token_store.read_token_digests(token_store.write_token_shards(df.limit(0), queries.tokenizer_path())).count() == 0


def test_planes():
    rng = np.random.default_rng(0)
    for top in (1, 2, 256, 49408, 1 << 32):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, top, n).astype(np.uint32)
            for kind in ("bit", "byte"):
                assert (token_store.from_planes(token_store.to_planes(ids, kind), n, kind) == ids).all()


# ---- archives ------------------------------------------------------------------------------------------------------


def plain_archive(rows):
    largest = {}
    for page_id, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and page_id is not None:
            largest[p] = max(page_id, largest.get(p, page_id))
    out = Counter()
    for page_id, html in rows:
        p = (html or "").encode()
        to = largest.get(p, page_id)
        out[(page_id, len(p), hashlib.sha1(p).hexdigest(), "response" if to == page_id else "revisit", None if to == page_id else to, None)] += 1
    return out


def test_op7(spark):
    got = Counter(tuple(r) for r in queries.op7_warc_segments(spark, SF).collect())
    assert got == plain_archive(table("pages", "page_id, html"))


def test_archives_at_the_edges(spark):
    big = "<p>é\r\n\r\n0\r\n</p>" * 20_000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "u", ""), (None, "v", "x" * 1000), (7, "w", "x" * 1000), (8, "w", "x" * 999), (9, "w", "x" * 999)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(df, segment_bytes=1000, archive_bytes=20_000)
    records = warc.read_archives(manifest)
    assert Counter(tuple(r) for r in warc.describe_records(records).collect()) == plain_archive([(r[0], r[2]) for r in rows])
    assert {r["payload"].decode() for r in records.where("type = 'response'").collect()} == {big, "", "x" * 1000, "x" * 999}
    assert warc.describe_records(warc.read_archives(warc.write_archives(df.limit(0)))).count() == 0


def test_many_equal_rows_come_back_as_often(spark):
    rows = [(5, "http://a", "<p>x</p>" * 400)] * 300 + [(4, "http://b", "<p>x</p>" * 400)]
    records = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), segment_bytes=500))
    got = Counter((r["page_id"], r["record_type"], r["problem"]) for r in warc.describe_records(records).collect())
    assert got == {(5, "response", None): 300, (4, "revisit", None): 1}


def test_broken_segments():
    assert warc.assemble([(2, 4, b"cd"), (1, None, b"ab")]) == (b"abcd", None)
    assert warc.assemble([(3, 6, b"ef"), (1, None, b"ab")])[1] == "missing segment"
    assert warc.assemble([(1, None, b"ab")])[1] == "no last segment"
    assert warc.assemble([(1, None, b"ab"), (2, 5, b"cd")])[1] == "wrong total length"
    assert warc.unchunked(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\nT: v\r\n\r\n") == b"abc0123456789"
    for bad in (b"", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


# ---- quality -------------------------------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_op8(spark):
    got = {r["doc_id"]: r for r in queries.op8_divergence_rules(spark, SF).collect()}
    for doc_id, text in table("documents", "doc_id, text"):
        assert tuple(got[doc_id][c] for c in COLUMNS) == plain_quality(text), doc_id
        assert not (got[doc_id]["kept"] and got[doc_id]["base_failed"])


def test_op8_verdict_equals_plain_python(spark):
    """Distances and verdict of every document from plain counts of characters and words."""
    rows = table("documents", "doc_id, text, lang")
    classes = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[\x21-\x7E]")
    spaces = re.compile(r"[^\x20\x09-\x0D]+")

    def counted(text):
        out, left = [], text or ""
        for c in classes:
            kept = re.sub(c, "", left)
            out.append(len(left) - len(kept))
            left = kept
        return np.array([*out, len(left)], float)

    per_lang, words = defaultdict(lambda: np.zeros(7)), defaultdict(Counter)
    for _, text, lang in rows:
        for to in {lang or "*", "*"}:
            per_lang[to] += counted(text)
            words[to].update(w.lower() for w in spaces.findall(text or ""))

    def distance(p, q):
        if p.sum() == 0:
            return 0.0
        p, m = p / p.sum(), (p / p.sum() + q) / 2
        part = lambda x: np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0))
        return np.sqrt(max(0.0, (part(p) + part(q)) / 2))

    got = {r["doc_id"]: r for r in queries.op8_divergence_rules(spark, SF).collect()}
    for d, text, lang in rows:
        to, own = lang or "*", [w.lower() for w in spaces.findall(text or "")]
        top = sorted(words[to].items(), key=lambda x: (-x[1], x[0].encode()))[: divergence_rules.COMMON]
        total = sum(words[to].values())
        hits, count = [float(own.count(w)) for w, _ in top], Counter(own)
        near = distance(np.array([*hits, len(own) - sum(hits)]), np.array([n / total for _, n in top] + [1 - sum(n for _, n in top) / total]))
        char = distance(counted(text), per_lang[to] / per_lang[to].sum())
        assert abs(got[d]["class_distance"] - char) < 1e-7 and abs(got[d]["word_distance"] - near) < 1e-7, (d, len(count))
        far = len(text or "") >= divergence_rules.CLASS_CHARS and char > divergence_rules.CLASS_LIMIT or len(own) >= divergence_rules.WORD_WORDS and near > divergence_rules.WORD_LIMIT
        assert got[d]["kept"] == (not plain_quality(text)[5] and not far), d


def test_quality_at_the_edges(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "a b c d e f a b c d e", "é\x0bü\x0cñ 😀 $$", "x\nx\n \n \ny\nx", "\r\n\r\na\r\na\r\n", "a a a a a a a", "w" * 100_000, LONG, "one two three\xa0four\x85five six seven eight nine ten eleven"]
    df = spark.createDataFrame([(k, t, None if k % 2 else "en", k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, words int")
    got = {r["doc_id"]: r for r in divergence_rules.quality_rules(df).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in COLUMNS) == plain_quality(t), repr(t)[:50]
    assert divergence_rules.quality_rules(df.limit(0)).count() == 0


def test_divergence(spark):
    df = spark.createDataFrame([([1.0, 1.0], [0.5, 0.5]), ([2.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 1.0], [0.5, 0.5])], "c array<double>, q array<double>")
    got = [r[0] for r in df.select(divergence_rules.js_distance(F.col("c"), F.col("q"))).collect()]
    p, q = np.array([0.75, 0.25]), np.array([0.5, 0.5])
    m = (p + q) / 2
    want = np.sqrt((np.sum(p * np.log2(p / m)) + np.sum(q * np.log2(q / m))) / 2)
    assert np.allclose(got, [0, 1, 0, want])


def test_a_distance_sums_its_counts_once(spark):
    """A sum inside the lambda over the counts would be made again for each of them."""
    text = spark.createDataFrame([], "c array<double>, q array<double>").select(divergence_rules.js_distance(F.col("c"), F.col("q")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert text.count("aggregate(c#") == 1, text


def test_common_words_are_counted_as_they_stand(spark):
    """Words that mean something in a regular expression, begin alike, or stand beside any white space."""
    words = ["a", "a.", "|", "\\E", "(", "aa", "\\q\\e", "é", "i̇", "$1", "ς"]
    pieces = [*words, "A", "É", "İ", "\\Q\\E", "a|", "aaa", "b", "Σ", "ΑΣ"]
    rng = np.random.default_rng(5)
    gaps = [" ", "\n", "\t ", "\x0b", "\r\n", "\x0c"]
    texts = ["".join(str(rng.choice(pieces)) + str(rng.choice(gaps)) for _ in range(int(rng.integers(0, 60)))) for _ in range(200)] + ["", "a", " a a ", "a\xa0a"]
    df = spark.createDataFrame([(k, t, words) for k, t in enumerate(texts)], "k long, text string, words array<string>")
    got = {r["k"]: r["n"] for r in df.select("k", divergence_rules.count_each(F.col("text"), F.col("words"), divergence_rules.any_of(F.col("words"))).alias("n")).collect()}
    for k, t in enumerate(texts):
        own = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        assert got[k] == [own.count(w) for w in words], repr(t)


# ---- ids beside a null ---------------------------------------------------------------------------------------------


BIG = (1 << 53) + 1


def test_large_ids_beside_a_null_stay_exact(spark):
    """One partition, one batch: an id that no float holds comes back as it was from every operator of rows."""
    texts = ["the cat sat on the mat and looked at the dog " * 3, "mail a@b.co or +1 212 555 0100 x", None, "AKIA" + "Q7" * 8]
    rows = [(BIG + k if k != 2 else None, t, f"http://a{k}.net/", (t or "") * 20, "en", "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, html string, lang string, source string").coalesce(1)
    ids = {r[0] for r in rows}
    profiles = language_id.learn_profiles(df)
    assert {r["doc_id"] for r in language_id.predict_languages(df, profiles).collect()} == ids
    assert {r["doc_id"] for r in pii_crf.find_personal_data(df).collect()} == ids
    assert {r["doc_id"] for r in url_rules.judge_urls(df, queries.HOST_RULES, carry=("doc_id",)).collect()} == ids
    assert {r["doc_id"] for r in token_store.read_token_digests(token_store.write_token_shards(df, queries.tokenizer_path())).collect()} == ids
    assert {r["doc_id"] for r in divergence_rules.quality_rules(df).collect()} == ids
    assert {r["page_id"] for r in warc.describe_records(warc.read_archives(warc.write_archives(df, id_col="doc_id"))).collect()} == ids


def test_rules_from_a_table(spark):
    """Thousands of rules, read from a table, judge as each for itself does."""
    rows = [(f"||h{k}.net/", "block" if k % 3 else "allow") for k in range(3000)] + [(f"/p{k}^", "block") for k in range(500)] + [(None, "block"), ("x", None), ("", "block"), ("||h1.net/", "block")]
    rules = url_rules.read_rules(spark.createDataFrame(rows, "pattern string, action string"))
    assert len(rules) == 3500
    urls = spark.createDataFrame([(1, "http://a.h4.net/p3/x"), (2, "http://h3.net/"), (3, "http://z.org/p7"), (4, "http://z.org/p7x")], "page_id long, url string")
    got = {r["page_id"]: (r["pattern"], r["verdict"]) for r in url_rules.judge_urls(urls, rules).collect()}
    assert got == {1: ("||h4.net/", "block"), 2: ("||h3.net/", "allow"), 3: ("/p7^", "block"), 4: (None, "allow")}
