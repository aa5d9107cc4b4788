"""The queries of this package on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyloom.llm.bpe import encode_documents
from rallyloom.llm.chat_format import REPLY, conversation_messages, format_messages
from rallyloom.llm.exact_dedup import exact_duplicates
from rallyloom.llm.lm_scores import score_documents
from rallyloom.llm.mixing import mix_documents
from rallyloom.llm.near_dedup import near_duplicates
from rallyloom.llm.quality_rules import judge_documents
from rallyloom.llm.substring_dedup import remove_repeats
from rallyloom.llm.token_counts import count_tokens

from rallyloom.llm.url_filter import filter_pages

#: The production block list: names in three domains.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_UNDER = ("example.com", "example.net", "example.org")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.bround("target", 6).alias("target"), "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(f"{name}.{under}") for name in BLOCKED_NAMES for under in BLOCKED_UNDER])
    return filter_pages(_table(spark, sf_dir, "pages"), spark.range(1).select(F.explode(keys).alias("key")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge_documents(docs).select(*columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_documents(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "n_backoff", F.bround("log_prob", 4).alias("log_prob"), F.bround("mean_log_prob", 6).alias("mean_log_prob"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = conversation_messages(_table(spark, sf_dir, "conversations"))
    formatted = format_messages(messages, REPLY)
    return formatted.withColumn("errors", F.concat_ws("; ", "errors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe_encoding": op5_bpe_encoding,
    "op6_url_filters": op6_url_filters,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_dedup": op8_near_dedup,
    "op9_lm_scores": op9_lm_scores,
    "op10_chat_formatting": op10_chat_formatting,
}

OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     x AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS norm FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM x WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM a)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
f AS (SELECT a.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM a LEFT JOIN cover ON a.doc_id = cover.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY 1),
p0 AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS hn FROM h),
p AS (SELECT m, least(greatest(CASE WHEN q - m * m - m * (1 - m) * hn > 1e-12 THEN m * (1 - m) / (q - m * m - m * (1 - m) * hn) - 1 ELSE 1000.0 END, 2.0), 1000.0) AS k FROM p0),
v AS (SELECT source, (f + m * k) / (n + k) <= 0.5 AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(ok, true)) AS kept
FROM b LEFT JOIN v ON b.source = v.source
"""

OP4_SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM a)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
cut AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM twice) GROUP BY 1),
kept AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a) u
         ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM cut) c ON u.doc_id = c.doc_id AND u.i = c.p GROUP BY 1)
SELECT a.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM a LEFT JOIN kept ON a.doc_id = kept.doc_id
"""

OP9_SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a),
u AS (SELECT doc_id, i, x, lag(x) OVER p AS v, lag(x, 2) OVER p AS t FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, i,
             count(*) OVER (PARTITION BY x) - count(*) OVER (PARTITION BY doc_id, x) AS o1,
             count(*) OVER (PARTITION BY v, x) - count(*) OVER (PARTITION BY doc_id, v, x) AS o2,
             count(*) OVER (PARTITION BY t, v, x) - count(*) OVER (PARTITION BY doc_id, t, v, x) AS o3,
             count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest, v IS NOT NULL AS has2, t IS NOT NULL AS has3 FROM u),
-- grams that are cut off by a text's start count no more than 0; the others' partitions hold no such rows
g AS (SELECT doc_id, i, o1, CASE WHEN has2 THEN o2 ELSE 0 END AS o2, CASE WHEN has3 THEN o3 ELSE 0 END AS o3, rest, has2, has3 FROM o),
c AS (SELECT *, lag(o1) OVER p AS c2, lag(o2) OVER p AS c3 FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, has2, has3, o2, o3, CASE WHEN o1 > 0 THEN o1::DOUBLE ELSE 0.5::DOUBLE END / (rest + 0.5::DOUBLE) AS s1, c2, c3 FROM c),
s2 AS (SELECT *, CASE WHEN NOT has2 THEN s1 WHEN o2 > 0 THEN o2::DOUBLE / c2 ELSE 0.4::DOUBLE * s1 END AS z2 FROM s),
s3 AS (SELECT *, CASE WHEN NOT has3 THEN z2 WHEN o3 > 0 THEN o3::DOUBLE / c3 ELSE 0.4::DOUBLE * z2 END AS z3 FROM s2),
r AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN has3 THEN o3 <= 0 WHEN has2 THEN o2 <= 0 ELSE false END::INT)::BIGINT AS n_backoff, sum(ln(z3)) AS lp FROM s3 GROUP BY 1)
SELECT a.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff,
       round_even(coalesce(lp, 0), 4) AS log_prob, round_even(lp / n_words, 6) AS mean_log_prob
FROM a LEFT JOIN r ON a.doc_id = r.doc_id
"""

OP6_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
        FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM (SELECT *, list_has_any(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), blocked) AS listed
      FROM p, (SELECT list(n || '.' || u) AS blocked FROM (SELECT unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS n),
                                                          (SELECT unnest(['example.com', 'example.net', 'example.org']) AS u))) p
LEFT JOIN fit ON p.page_id = fit.page_id
"""

OP10_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations),
m AS (SELECT row_number() OVER () AS k, *, CASE WHEN role = 'user' THEN conv_id || ':' || CASE WHEN n % 17 = 0 AND turn > 0 THEN 0 ELSE turn END END AS call_id,
             CASE WHEN role = 'user' THEN CASE WHEN n % 13 = 0 THEN 'lookup' ELSE 'reply' END END AS tool,
             CASE WHEN role <> 'user' THEN NULL WHEN n % 11 = 0 THEN to_json([t])::VARCHAR ELSE '{"chars":' || CASE WHEN n % 7 = 1 THEN '"' || n || '"' ELSE n::VARCHAR END
                  || CASE WHEN n % 7 = 2 THEN ',"draft":true' ELSE '' END || CASE WHEN n % 7 = 0 THEN '' ELSE ',"prompt":' || to_json(t)::VARCHAR END || '}' END AS arguments,
             CASE WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS result_of FROM c),
calls AS (SELECT *, min_by(k, (turn, t, k)) OVER (PARTITION BY call_id) AS first_k FROM m WHERE call_id IS NOT NULL),
fc AS (SELECT call_id AS id, turn AS call_turn FROM calls WHERE k = first_k),
results AS (SELECT *, min_by(k, (turn, t, k)) OVER (PARTITION BY result_of) AS first_k FROM m WHERE call_id IS NULL AND result_of IS NOT NULL),
e AS (SELECT DISTINCT conv_id, call_id AS id, conv_id || ':' || u AS used
      FROM (SELECT conv_id, call_id, unnest([CASE WHEN n % 4 <> 0 AND turn >= 2 THEN turn - 2 END, CASE WHEN n % 10 = 0 AND turn >= 4 THEN turn - 4 END, CASE WHEN n % 19 = 0 THEN turn + 2 END]) AS u FROM calls)
      WHERE u IS NOT NULL AND conv_id || ':' || u IN (SELECT id FROM fc)),
size AS (SELECT conv_id, count(DISTINCT call_id) AS calls FROM calls GROUP BY 1),
depth AS (SELECT conv_id, call_id AS id, 0 AS d FROM calls UNION SELECT e.conv_id, e.id, d + 1 FROM depth JOIN e ON e.used = depth.id JOIN size ON size.conv_id = e.conv_id WHERE d < size.calls),
lev AS (SELECT id, CASE WHEN max(d) >= any_value(calls) THEN -1 ELSE max(d) END::BIGINT AS level FROM depth JOIN size USING (conv_id) GROUP BY 1),
x AS (SELECT m.*, fc.call_turn, coalesce(lev.level, 0) AS level, cc.first_k AS call_k, rr.first_k AS result_k, m.call_id IN (SELECT result_of FROM results) AS answered,
             array_to_string(CASE WHEN m.call_id IS NULL THEN [] WHEN json_type(arguments) <> 'OBJECT' THEN ['not an object'] WHEN tool <> 'reply' THEN ['unknown tool'] ELSE list_sort(list_concat(
               CASE WHEN json_extract(arguments, '$.prompt') IS NULL THEN ['missing prompt'] WHEN json_type(arguments, '$.prompt') <> 'VARCHAR' THEN ['type of prompt'] ELSE [] END,
               CASE WHEN json_extract(arguments, '$.chars') IS NULL THEN ['missing chars'] WHEN json_type(arguments, '$.chars') NOT IN ('UBIGINT', 'BIGINT') THEN ['type of chars'] ELSE [] END,
               list_transform(list_filter(json_keys(arguments), lambda q: q NOT IN ('prompt', 'chars')), lambda q: 'unknown ' || q))) END, '; ') AS errors
      FROM m LEFT JOIN fc ON coalesce(m.call_id, m.result_of) = fc.id LEFT JOIN lev ON coalesce(m.call_id, m.result_of) = lev.id LEFT JOIN (SELECT k, first_k FROM calls) cc ON m.k = cc.k LEFT JOIN (SELECT k, first_k FROM results) rr ON m.k = rr.k)
SELECT conv_id, turn, role,
       CASE WHEN call_id IS NOT NULL THEN CASE WHEN k <> call_k THEN 'repeated' WHEN errors <> '' THEN 'invalid' WHEN answered THEN 'answered' ELSE 'open' END
            WHEN result_of IS NOT NULL THEN CASE WHEN call_turn IS NULL THEN 'orphan' WHEN k <> result_k THEN 'repeated' ELSE 'linked' END ELSE 'message' END AS status,
       errors, level, CASE WHEN result_of IS NOT NULL THEN coalesce(call_turn, turn) ELSE turn END AS at, CASE WHEN result_of IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS step,
       '{' || CASE WHEN call_id IS NOT NULL THEN '"arguments":' || arguments || ',"call_id":' || to_json(call_id)::VARCHAR || ',' ELSE '' END
           || '"content":' || to_json(t)::VARCHAR || CASE WHEN result_of IS NOT NULL THEN ',"result_of":' || to_json(result_of)::VARCHAR ELSE '' END
           || ',"role":' || to_json(role)::VARCHAR || CASE WHEN call_id IS NOT NULL THEN ',"tool":"' || tool || '"' ELSE '' END || '}' AS line
FROM x
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s1 AS (SELECT source, ss, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY 1)),
s2 AS (SELECT *, 3 * ss AS cap, row_number() OVER (ORDER BY 3 * ss / w::DOUBLE, source NULLS LAST) AS k FROM s1),
s3 AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM s2),
sh AS (SELECT min_by(share, k) FILTER (w * share <= cap) AS share FROM s3),
t AS (SELECT source, ss, least(w * coalesce(share, 1e300), cap::DOUBLE) AS target FROM s2, sh),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
zl AS (SELECT source, list(struct_pack(z := size::DOUBLE, w := (n * size)::DOUBLE)) AS cells, min(size)::DOUBLE AS least FROM z GROUP BY 1),
y AS (SELECT t.source, ss, target, cells, 0 AS step, CASE WHEN target > 0 AND target < ss THEN ln(target / ss) / least ELSE 0::DOUBLE END AS lo,
             CASE WHEN target > ss AND target < 3 * ss THEN ln(3::DOUBLE) / least ELSE 0::DOUBLE END AS hi FROM t LEFT JOIN zl ON t.source IS NOT DISTINCT FROM zl.source
      UNION ALL
      SELECT source, ss, target, cells, step + 1, CASE WHEN g < target THEN m ELSE lo END, CASE WHEN g < target THEN hi ELSE m END
      FROM (SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(cells, lambda c: c.w * least(exp((lo + hi) / 2 * c.z), 3::DOUBLE))) AS g FROM y WHERE step < 120 AND lo < hi)),
r AS (SELECT source, ss, target, arg_max((lo + hi) / 2, step) AS lam FROM y GROUP BY 1, 2, 3),
q AS (SELECT source, size, n, rate * (n * size) AS want, 3 * n * size AS most
      FROM (SELECT z.*, CASE WHEN target <= 0 THEN 0::DOUBLE WHEN target >= 3 * ss THEN 3::DOUBLE ELSE round(least(exp(lam * size), 3::DOUBLE), 12) END AS rate
            FROM z JOIN r ON z.source IS NOT DISTINCT FROM r.source)),
i AS (SELECT *, coalesce(sum(want) OVER w, 0) AS low, coalesce(sum(most) OVER w, 0) AS m, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS rn FROM q
      WINDOW w AS (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT source, 0::BIGINT AS rn, 0::BIGINT AS size, 1::BIGINT AS n, 0::BIGINT AS total, 0::DOUBLE AS carry FROM (SELECT DISTINCT source FROM i)
  UNION ALL
  SELECT source, rn, size, n, k, due - k * size FROM (
    SELECT *, least(greatest(least(greatest(floor(due / size + 0.5::DOUBLE), ceil((due - (m - low)) / size)), greatest(floor((due + low) / size), 0)), 0), 3 * n)::BIGINT AS k
    FROM (SELECT i.*, f.carry + i.want AS due FROM f JOIN i ON f.source IS NOT DISTINCT FROM i.source AND i.rn = f.rn + 1))),
p AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source, size ORDER BY md5(doc_id::VARCHAR), doc_id) AS place FROM d)
SELECT p.doc_id, p.size, r.ss AS source_size, round_even(r.target, 6) AS target,
       (coalesce(total // n + CASE WHEN place <= total % n THEN 1 ELSE 0 END, 0) * p.size)::BIGINT AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source LEFT JOIN f ON p.source IS NOT DISTINCT FROM f.source AND p.size = f.size AND f.rn > 0
"""

OP8_SQL = r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS g FROM a),
c AS (SELECT g, len(g) AS n, min(doc_id) AS m FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT m, n, unnest(g) AS x FROM c),
o AS (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM u),
p AS (SELECT m, n, x FROM o QUALIFY row_number() OVER (PARTITION BY m ORDER BY df, x) <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT x.m AS a, y.m AS b FROM p x JOIN p y ON x.x = y.x AND x.m < y.m WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
l AS (SELECT a, b FROM (SELECT a, b, x.n + y.n AS t, len(list_intersect(x.g, y.g)) AS k FROM pairs JOIN c x ON a = x.m JOIN c y ON b = y.m) WHERE 100 * k >= 80 * (t - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT m AS node, m AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
k AS (SELECT node, min(root) AS component FROM r GROUP BY 1)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN k ON c.m = k.node
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_source_mixing": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op6_url_filters": OP6_SQL, "op7_quality_rules": OP7_SQL, "op8_near_dedup": OP8_SQL, "op9_lm_scores": OP9_SQL, "op10_chat_formatting": OP10_SQL}
