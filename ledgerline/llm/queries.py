"""The registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_prints, blob_ledger, divergence, lempel_ziv, line_spread, packing, quality, ranked_search, simhash, token_counts, toxicity, url_aliases, winnowing
from .labelled import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_lempel_ziv_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lempel_ziv.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages")
    )


def op5_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = blob_ledger.scan_all(_table(spark, sf_dir, "documents"), key_cols=["doc_id"])
    kinds = F.transform("findings", lambda x: x["kind"])
    count = {k: F.size(kinds).cast("long") - F.size(F.array_remove(kinds, k)) for k in ("assign", "access", "hex")}
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *[n.alias(f"n_{k}") for k, n in count.items()], F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans")
    )


def op6_line_spread_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = line_spread.remove_boilerplate(docs)
    return kept.select(
        "doc_id", F.col("__lines.n").alias("n_lines"), F.col("__lines.removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256")
    )


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has media; each vector of ``embeddings`` is played as a melody."""
    found = audio_prints.aligned_groups(
        _table(spark, sf_dir, "embeddings"), id_col="vec_id", media_col="embedding", decode=audio_prints.played_vector
    )
    return found.select("vec_id", "n_ints", F.sha2("prints", 256).alias("prints_sha256"), "group_id")


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


#: The URL policy of the query: (verdict, host, path).
URL_RULES = (
    "VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), "
    "('allow', 'com', '/fr/'), ('block', 'com', '/de/') AS rules(verdict, host, path)"
)


def op11_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.judge(_table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {URL_RULES}"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build(_table(spark, sf_dir, "documents"))
    found = ranked_search.search(index, _table(spark, sf_dir, "benchmark"), 20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.audit(_table(spark, sf_dir, "documents"), least_docs=10, top=10)
    return found.select("lang", "source", "part", "item", "value", "rank")


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, source, text, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) t
), counted AS (
  SELECT *, trim(line) AS bare, trim(line) <> '' AS counts
  FROM lines
), spread AS (
  SELECT bare FROM counted WHERE counts GROUP BY bare
  HAVING count(DISTINCT source) >= 10 AND count(DISTINCT text) >= 10
), marked AS (
  SELECT c.*, s.bare IS NOT NULL AND c.counts AS gone FROM counted c LEFT JOIN spread s ON c.bare = s.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP11_SQL = r"""
WITH RECURSIVE rules AS (
  SELECT verdict, host, path, host || path AS rule FROM (%(rules)s)
), links AS (
  SELECT url, tag,
         regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS rel,
         regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS href,
         regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS equiv,
         regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS content
  FROM (SELECT url, unnest(regexp_extract_all(
          regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
        FROM pages WHERE strpos(url, '://') > 0) t
), raw AS (
  SELECT url, CASE WHEN tag ILIKE '<link%%' THEN CASE WHEN list_contains(string_split(lower(rel.a || rel.b || rel.c), ' '), 'canonical') THEN href.a || href.b || href.c END
              WHEN lower(trim(equiv.a || equiv.b || equiv.c)) = 'refresh'
              THEN regexp_extract(content.a || content.b || content.c, '(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?(.*?)["'']?\s*$', 1) END AS href
  FROM links
), pointed AS (
  SELECT url, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href
                   WHEN regexp_matches(href, '^(?:$|#)|^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                   WHEN starts_with(href, '//') THEN split_part(url, '://', 1) || ':' || href
                   WHEN starts_with(href, '/') THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || href
                   ELSE regexp_extract(url, '^[^:/?#]*://[^/?#]*') || coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*/|/)', 1), ''), '/') || href END AS target
  FROM (SELECT url, replace(trim(href), '&amp;', '&') AS href FROM raw WHERE href IS NOT NULL) h
), told AS (
  SELECT url AS u, target AS v FROM pointed WHERE target IS NOT NULL
), named AS (
  SELECT u AS url FROM told UNION SELECT v FROM told UNION SELECT url FROM pages WHERE url IS NOT NULL
), cut AS (
  SELECT url, CASE WHEN place > 0 THEN translate(regexp_extract(substr(url, place + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN place > 0 THEN regexp_extract(substr(url, place + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN place > 0 THEN translate(substr(url, 1, place - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS scheme,
         CASE WHEN place > 0 THEN regexp_extract(substr(url, place + 3), '^[^/?#]*([^#]*)', 1) END AS tail
  FROM (SELECT url, strpos(url, '://') AS place FROM named) n
), parts AS (
  SELECT url, host, path, scheme || '://' || host || tail AS resource FROM cut
), judged AS (
  SELECT url, any_value(p.host) AS host, any_value(p.path) AS path, any_value(resource) AS resource,
         arg_max(rule, (length(rule), verdict = 'allow', rule)) AS rule, arg_max(verdict, (length(rule), verdict = 'allow', rule)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) AND p.host <> ''
  GROUP BY url
), edges AS (
  SELECT a.resource AS u, b.resource AS v FROM told JOIN parts a ON a.url = told.u JOIN parts b ON b.url = told.v WHERE a.resource <> b.resource
), ways AS (
  SELECT u, v FROM edges UNION SELECT v, u FROM edges
), bad AS (
  SELECT DISTINCT resource FROM judged WHERE verdict = 'block' AND resource IN (SELECT u FROM ways)
  UNION
  SELECT v FROM bad JOIN ways ON u = resource
)
SELECT page_id, coalesce(judged.host, '') AS host, coalesce(judged.path, '') AS path, judged.rule,
       coalesce(judged.verdict, CASE WHEN judged.resource IN (SELECT resource FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN judged USING (url)
""" % {"rules": f"SELECT * FROM ({URL_RULES[: URL_RULES.index(' AS rules')]}) AS rules(verdict, host, path)"}


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), sizes AS (
  SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM texts WHERE len(words) > 0
), postings AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(words) AS term FROM texts) t GROUP BY k, term
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) b
  GROUP BY item_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sizes GROUP BY term, n_docs
), impacts AS (
  SELECT k, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(words) * n_docs) // n_terms)) AS impact FROM postings JOIN texts USING (k), sizes
), scores AS (
  SELECT item_id, k, sum(times * w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, k
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM scores JOIN texts USING (k) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


OP13_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS words
  FROM documents
), occurring AS (
  SELECT k, lang, source, unnest(words) AS term FROM texts
), kept AS (
  SELECT lang, term, count(*) AS times FROM occurring GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), sizes AS (
  SELECT lang, count(*) AS v, sum(times) AS n FROM kept GROUP BY lang
), sources AS (
  SELECT DISTINCT lang, source FROM texts
), counted AS (
  SELECT o.lang, o.source, o.term, count(*) AS times FROM occurring o JOIN kept USING (lang, term) GROUP BY o.lang, o.source, o.term
), sums AS (
  SELECT lang, source, sum(times) AS n FROM counted GROUP BY lang, source
), dense AS (
  SELECT s.lang, s.source, m.term, coalesce(c.times, 0) AS times,
         (1 + (1000000000::HUGEINT * (coalesce(c.times, 0) + 2)) // (coalesce(u.n, 0) + 2 * z.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (m.times + 2)) // (z.n + 2 * z.v))::BIGINT AS base
  FROM sources s JOIN kept m ON m.lang = s.lang JOIN sizes z ON z.lang = s.lang
  LEFT JOIN sums u ON u.lang = s.lang AND u.source = s.source
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = m.term
), compared AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN compared c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - base) * (p - base)) // (p + base))::BIGINT FROM dense WHERE times > 0 AND p > base
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds as SQL reads them: pattern, group that is measured, its least length.
SECRET_KINDS = (
    ("assign", "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
)

#: A match begins after what the pattern leaves between matches and after the matches before it.
OP5_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  %s
), places AS (
  SELECT k, nr, kind, least, whole, inner_part, i, list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(matches, 1, i - 1), lambda x: length(x))), 0) AS start
  FROM (SELECT k, nr, kind, least, gaps, matches, i, matches[i] AS whole, inners[i] AS inner_part FROM (SELECT *, unnest(generate_series(1, len(matches))) AS i FROM found) u) v
), spans AS (
  SELECT k, kind, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(whole) AS BIGINT), ',' ORDER BY start, nr) OVER (PARTITION BY k ORDER BY start, nr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every
  FROM places WHERE length(inner_part) >= least
), told AS (
  SELECT k, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, any_value(every) AS every FROM spans GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(every, '')) AS base_sha256, coalesce(every, '') AS spans
FROM texts LEFT JOIN told USING (k)
""" % " UNION ALL ".join(
    f"SELECT k, {nr} AS nr, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS matches, regexp_extract_all(t, '{p}', {group}) AS inners, string_split_regex(t, '{p}') AS gaps FROM texts"
    for nr, (kind, p, group, least) in enumerate(SECRET_KINDS)
)


OP3_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, a, md5(array_to_string(words[a:a + 49], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS a FROM texts) t
), firsts AS (
  SELECT k, min(doc_id) AS f FROM windows GROUP BY k
), covered AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(a, a + 49)) AS p FROM windows JOIN firsts USING (k) WHERE f < doc_id) c
), places AS (
  SELECT t.doc_id, t.p, t.words[t.p] AS word, c.p IS NULL AS kept
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS p FROM texts) t LEFT JOIN covered c ON c.doc_id = t.doc_id AND c.p = t.p
), cut AS (
  SELECT doc_id, count(*) FILTER (WHERE NOT kept) AS n, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE kept), '') AS left_words FROM places GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(left_words, '')) AS kept_sha256
FROM texts t LEFT JOIN cut ON cut.doc_id = t.doc_id
"""

OP10_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(words[a:a + size - 1], ' ') AS w
  FROM (SELECT *, least(len(words), 10) AS size, unnest(generate_series(1, len(words) - least(len(words), 10) + 1)) AS a FROM items WHERE len(words) > 0) i
), held AS (
  SELECT doc_id, size, a, array_to_string(words[a:a + size - 1], ' ') AS w
  FROM (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS a FROM texts, (SELECT DISTINCT size FROM wanted) s) t
), hits AS (
  SELECT doc_id, a, size, item_id FROM held JOIN wanted USING (size, w)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(a, a + size - 1)) AS p FROM hits) h GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) h GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN places p ON p.doc_id = t.doc_id LEFT JOIN found f ON f.doc_id = t.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (op1_token_counts, op2_neighbour_quality, op3_lempel_ziv_dedup, op4_segment_toxicity, op5_blob_ledger_secrets, op6_line_spread_dedup, op7_simhash_near_duplicates, op8_bm25_packing, op9_chroma_fingerprints, op10_winnowing_decontamination, op11_url_aliases, op12_ranked_search, op13_source_divergence,)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_lempel_ziv_dedup": OP3_SQL, "op5_blob_ledger_secrets": OP5_SQL, "op6_line_spread_dedup": OP6_SQL, "op10_winnowing_decontamination": OP10_SQL,
        "op11_url_aliases": OP11_SQL, "op12_ranked_search": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
    }
