"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.llm import bpe_prefixes, decontaminate, divergence_rules, language_id, mixing, ngram_join, pii_crf, secret_forest, source_audit, spelling_variants, tables, token_store, url_rules, warc


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and link counts of every document: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.ngram_jaccard_join(tables.documents(spark, sf_dir))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans with those that the field adds."""
    found = pii_crf.find_personal_data(tables.documents(spark, sf_dir))
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = (F.size("pii") - F.size(base)).cast("long")
    return found.select("doc_id", *[count(k) for k in pii_crf.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), added.alias("n_added"))


#: The rules that the contract of op3 fixes.
HOST_RULES = tuple(url_rules.Rule(f"||{name}", action) for name, action in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by the fixed host rules and the production patterns."""
    found = url_rules.judge_urls(tables.pages(spark, sf_dir), HOST_RULES + url_rules.PATTERNS)
    return found.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op4_language_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from documents that are not held out."""
    docs = tables.documents(spark, sf_dir)
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out()))
    found = language_id.predict_languages(docs, profiles)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written to plane shards and read back."""
    return token_store.read_token_digests(token_store.write_token_shards(tables.documents(spark, sf_dir), tokenizer_path()))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's score; the value itself only as a digest."""
    found = secret_forest.scan_secrets(tables.documents(spark, sf_dir), secret_forest.train_forest(spark))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to segmented archives, read back and put together."""
    return warc.describe_records(warc.read_archives(warc.write_archives(tables.pages(spark, sf_dir))))


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document; DataFrame functions only."""
    return divergence_rules.quality_rules(tables.documents(spark, sf_dir))


def op9_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of every document and test item that align."""
    return decontaminate.find_leaks(tables.documents(spark, sf_dir), tables.benchmark(spark, sf_dir))


def op10_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, weight, probability and draw of every document under flattened source, language and topic marginals."""
    return mixing.mix(tables.documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and near words of every long word of all documents, each document with its own planted deletions."""
    return spelling_variants.group_variants(spelling_variants.count_words(tables.documents(spark, sf_dir)))


def op12_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level BPE ids, and the text decoded from them, as digests."""
    return bpe_prefixes.round_trip(tables.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all pairs of sources within each language, and the terms that each source has more than its language."""
    return source_audit.audit_sources(tables.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_pii_crf, op3_url_rules, op4_language_rank_order, op5_token_planes, op6_secret_forest, op7_warc_segments, op8_divergence_rules,
        op9_benchmark_alignment, op10_raked_mix, op11_spelling_variants, op12_bpe_prefixes, op13_source_audit,
    )
}

def _op3_sql() -> str:
    """The rules in order of rank, each as a regular expression on the whole url, without any index."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ranked = sorted(HOST_RULES + url_rules.PATTERNS, key=lambda r: r.rank, reverse=True)
    when = lambda value: " ".join(f"WHEN regexp_matches(host || rest, {quoted(r.regex())}) THEN {quoted(value(r))}" for r in ranked)
    return f"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
      h AS (SELECT *, regexp_extract(after, '^([^/?#]*)', 1, 's') AS raw FROM a),
      u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(after, length(raw) + 1) AS rest FROM h),
      j AS (SELECT *, CASE {when(lambda r: r.pattern)} END AS pattern, CASE {when(lambda r: r.action)} WHEN host = '' THEN 'block' ELSE 'allow' END AS verdict FROM u)
      SELECT page_id, host, regexp_extract(rest, '^([^?#]*)', 1, 's') AS path, CASE WHEN starts_with(pattern, '||') THEN substr(pattern, 3) END AS rule, verdict, pattern FROM j"""


_OP7_SQL = """WITH p AS (SELECT page_id, COALESCE(html, '') AS html, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
  r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN MAX(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM p)
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN top = page_id OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM r"""

#: Words by the letters that each document deletes (crc32 from its table), near pairs by all deletions of a letter.
_OP11_SQL = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
  r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  d AS (SELECT id, run, COUNT(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
  b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bytes FROM d),
  h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 AS INTEGER) + 1])), 4294967295) AS h FROM b, crc),
  v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
  w AS MATERIALIZED (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING SUM(n) >= 2),
  del AS MATERIALIZED (SELECT word, k, substr(word, 1, CAST(k AS INTEGER)) || substr(word, CAST(k AS INTEGER) + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM w)),
  near AS MATERIALIZED (SELECT a.word, b.word AS near FROM del a JOIN del b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, w.word FROM del a JOIN w ON a.rest = w.word UNION SELECT w.word, a.word FROM del a JOIN w ON a.rest = w.word),
  best AS MATERIALIZED (SELECT x.word, x.n, o.word AS other, o.n AS other_n, COUNT(*) OVER (PARTITION BY x.word) AS n_near FROM near JOIN w x ON x.word = near.word JOIN w o ON o.word = near.near
    QUALIFY row_number() OVER (PARTITION BY x.word ORDER BY o.n DESC, o.word) = 1),
  f AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 10 * n),
  walk AS (SELECT word, form AS here FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here),
  roots AS (SELECT word, here AS root FROM walk WHERE here NOT IN (SELECT word FROM f))
  SELECT w.word, f.form, coalesce(roots.root, w.word) AS root, w.n, CAST(coalesce(best.n_near, 0) AS BIGINT) AS n_near, f.form_n FROM w LEFT JOIN best USING (word) LEFT JOIN f USING (word) LEFT JOIN roots USING (word)"""

_OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
  kept AS (SELECT lang, term, COUNT(*) AS n_lang FROM t GROUP BY lang, term HAVING COUNT(DISTINCT r) >= 10),
  c AS (SELECT lang, source, term, COUNT(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d),
  v AS (SELECT lang, COUNT(*) AS v, SUM(n_lang) AS total FROM kept GROUP BY lang),
  nn AS (SELECT g.lang, g.source, coalesce(SUM(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
  p AS (SELECT nn.lang, nn.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (nn.total + 2 * v.v) AS HUGEINT) AS p,
      CAST(1 + (1000000000::HUGEINT * (kept.n_lang + 2)) // (v.total + 2 * v.v) AS HUGEINT) AS q
    FROM nn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = nn.lang AND c.source = nn.source AND c.term = kept.term),
  s AS (SELECT a.lang, a.source, b.source AS item, SUM(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
  QUALIFY part = 'pair' OR rank <= 10"""

#: The others have no SQL form (trained models, MinHash, tokenizer, raking) or one too slow for whole tables; tests hold them
#: against brute force.
ORACLE_SQL: dict[str, str] = {"op3_url_rules": _op3_sql(), "op7_warc_segments": _OP7_SQL, "op11_spelling_variants": _OP11_SQL, "op13_source_audit": _OP13_SQL}
