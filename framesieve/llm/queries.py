"""The driver's queries opN_<name> and pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, near_dup, packing, pii, quality, substring, tiff, token_store, toxicity, url_filter, vector_codes
from .common import fold, shared_dir, table
from .digest import sha256

ALLOW = ["example.com/en/7", "net/de/"]
BLOCK = ["com/en/", "example.net/de/8", "org/es/"]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), ALLOW, BLOCK, ["page_id"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", (F.size("matches") > 0).cast("int").alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
        F.transform("matches", lambda m: m["item_id"]).alias("item_ids"), F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)), 6).alias("coverage"),
    )


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return made.select("conv_id", "speaker", "chunk", "n_turns", "start", F.length("text").cast("long").alias("n_chars"), sha256(F.col("text")).alias("text_sha256"), spans.alias("mask"), "n_masked")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, _ = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return toxicity.classify(docs, weights, ["doc_id"]).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", sha256(F.col("text")).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.classify(docs, weights, ["doc_id"]).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.text_media(table(spark, sf_dir, "documents"), ["doc_id"])
    return tiff.media_features(media, ["doc_id", "n_bytes"])


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    counts = [count(k) for k in range(len(pii.KINDS))]
    return found.select("doc_id", *counts, sha256(pii.written(F.col("base"))).alias("base_sha256"), pii.written(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_extra"), pii.written(F.col("secrets")).alias("secrets"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/framesieve-ids-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return token_store.digests(spark, folder)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    coded = codes.rows.select("row.vec_id", "row.label", "code", "error")
    return vector_codes.label_errors(coded, F.col("label")).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_url_filter, op2_decontaminate, op3_perspective_rotation, op4_toxicity, op5_substring_dedup, op6_quality, op7_bin_slack_packing, op8_tiff, op9_near_dup, op10_contextual_pii, op11_divergence, op12_token_store, op13_vector_codes]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_OP1_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rule, verdict, rule_host, rule_path) AS (
  VALUES ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'allow', 'net', '/de/'),
         ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM split JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN fits f USING (page_id)
"""

_OP3_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) AS pos FROM turns
), people AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), lines AS (
  SELECT n.conv_id, p.speaker, n.pos, n.role = p.speaker AS own,
         CASE WHEN n.role = p.speaker THEN '<|assistant|>' WHEN n.role = 'system' THEN '<|system|>' ELSE '<|user name=' || n.role || '|>' END || chr(10) AS head,
         n.text || '<|end|>' AS body
  FROM numbered n JOIN people p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, CAST(pos // 64 AS BIGINT) AS chunk, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM lines
)
SELECT conv_id, speaker, chunk, CAST(count(*) AS BIGINT) AS n_turns, CAST(min(s0) AS BIGINT) AS start,
       CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars, sha256(string_agg(head || body || chr(10), '' ORDER BY pos)) AS text_sha256,
       coalesce(string_agg(CAST(CAST(s0 + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s0 + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (own), '') AS mask,
       CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, speaker, chunk
"""

_OP5_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT row_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS w FROM (SELECT row_id, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35)
), again AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT row_id, i + d AS p FROM (SELECT row_id, i FROM windows WHERE w IN (SELECT w FROM again)), (SELECT unnest(range(0, 35)) AS d)
), each AS (
  SELECT row_id, words[p] AS word, p FROM (SELECT row_id, words, unnest(range(1, len(words) + 1)) AS p FROM texts)
), kept AS (
  SELECT row_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (row_id, p) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_id)
"""


#: All pairs whose common shingles have enough of both texts' weight; what banding may miss of them is below one in ten
#: thousand at the threshold itself.
_OP9_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS MATERIALIZED (
  SELECT doc_id, s, 1 + ln(count(*)) AS w
  FROM (SELECT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM texts WHERE len(words) > 0)) GROUP BY ALL
), totals AS (
  SELECT doc_id, sum(w) AS total FROM shingles GROUP BY doc_id
), close AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id JOIN totals p ON p.doc_id = x.doc_id JOIN totals q ON q.doc_id = y.doc_id
  GROUP BY ALL HAVING sum(least(x.w / p.total, y.w / q.total)) >= 0.8 - 1e-6
), sides AS (
  SELECT a, b, s, w AS x, 0.0 AS y FROM close JOIN shingles ON doc_id = a UNION ALL SELECT a, b, s, 0.0, w FROM close JOIN shingles ON doc_id = b
), both_ AS (
  SELECT a, b, s, max(x) AS x, max(y) AS y FROM sides GROUP BY ALL
), ratios AS (
  SELECT *, CASE WHEN x = 0 THEN 1e300 ELSE y / x END AS r FROM both_
), sums AS (
  SELECT *, sum(x) OVER upto AS low, sum(y) OVER (PARTITION BY a, b) - sum(y) OVER upto AS high FROM ratios WINDOW upto AS (PARTITION BY a, b ORDER BY r RANGE UNBOUNDED PRECEDING)
), similar_ AS (
  SELECT a, b FROM sums WHERE x > 0 AND y > 0 GROUP BY a, b HAVING sum(1 / (low / x + high / y)) >= 0.8 - 1e-9
), links AS (
  SELECT a, b FROM similar_ UNION ALL SELECT b, a FROM similar_
  UNION ALL SELECT x.doc_id, y.doc_id FROM texts x, (SELECT min(doc_id) AS doc_id FROM texts WHERE len(words) = 0) y WHERE len(x.words) = 0
  UNION ALL SELECT y.doc_id, x.doc_id FROM texts x, (SELECT min(doc_id) AS doc_id FROM texts WHERE len(words) = 0) y WHERE len(x.words) = 0
), reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a
"""


_OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), terms AS (
  SELECT row_id, lang, source, unnest(words) AS term FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10
), langs AS (
  SELECT lang, sum(n) AS n, count(*) AS v FROM kept GROUP BY lang
), counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS MATERIALIZED (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _op13_sql(rounds: int = 4) -> str:
    """Every round scans all entries for every part."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min({{'d': d, 'e': entry}}) AS best
  FROM (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM parts JOIN b{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CAST(coalesce((s - ((s % n + n) % n)) // n, c) AS BIGINT) AS c
  FROM b{k} LEFT JOIN (SELECT part, best.e AS entry, pos, sum(x) AS s, count(*) AS n FROM a{k} JOIN parts USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos)
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, i // (len(v) // 4) AS part, i % (len(v) // 4) AS pos, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(0, len(v))) AS i FROM kept)
), b0 AS MATERIALIZED (
  SELECT part, entry, pos, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 256
), {", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    made = {"op1_url_filter": _OP1_SQL, "op3_perspective_rotation": _OP3_SQL, "op5_substring_dedup": _OP5_SQL, "op9_near_dup": _OP9_SQL, "op11_divergence": _OP11_SQL, "op13_vector_codes": _op13_sql()}
    return made | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
