"""The registered queries of this subpackage, with comparison SQL where SQL can say it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwright.llm import byte_bpe, exact_dedup, language_id, minhash_dedup, mixing, nearest, quality, secrets, substring_dedup, token_counts
from tripwright.llm import fill_middle, spelling, spot_signatures

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("op1_nearest_neighbours")
def op1(spark, sf_dir):
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    return quality.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op3_byte_bpe")
def op3(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encoding_digests(byte_bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN))


@query("op4_language_id")
def op4(spark, sf_dir):
    return language_id.language_id(documents(spark, sf_dir))


SUBSTRING_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM w),
g AS (SELECT doc_id, word, place, string_agg(word, ' ') OVER d AS g, count(*) OVER d AS n FROM e
      WINDOW d AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
k AS (SELECT *, n = 13 AND min(doc_id) OVER (PARTITION BY g, n) < doc_id AS repeated FROM g),
m AS (SELECT doc_id, word, place, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY place
             ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM k)
SELECT w.doc_id, count(word) AS n_words, count(word) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN m USING (doc_id) GROUP BY w.doc_id
"""


@query("op5_substring_dedup", SUBSTRING_SQL)
def op5(spark, sf_dir):
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_secret_scans")
def op6(spark, sf_dir):
    return secrets.span_digests(secrets.scan_secrets(documents(spark, sf_dir)))


MIX_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':mix-1')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number
      FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (number - 1) % 3 AS DOUBLE) AS weight, 3 * source_size AS most,
             CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s),
f AS (SELECT *, CAST(budget - coalesce(sum(most) OVER (ORDER BY most / weight, number
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
             / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
t AS (SELECT *, least(CAST(most AS DOUBLE), max(level) OVER () * weight) AS target FROM f),
q AS (SELECT d.doc_id, d.size, d.h, t.*, CAST(sum(d.size) OVER (PARTITION BY t.number ORDER BY d.h, d.doc_id, d.size
             ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, e.sending, (e.sending * source_size + sent) / target AS finish
      FROM q, (VALUES (0), (1), (2)) e(sending)
      WHERE target > 0 AND e.sending <= least(2, floor(target / source_size))),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, number, sending, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent
      FROM p WHERE finish <= 2),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE spent <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k USING (doc_id)
"""


@query("op7_mix_sources", MIX_SQL)
def op7(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


EXACT_SQL = """
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


@query("op9_exact_dedup", EXACT_SQL)
def op9(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("mark")


NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reached) AS component_id, w.doc_id = min(reached) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""


@query("op10_minhash_dedup", NEAR_SQL)
def op10(spark, sf_dir):
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), size=3, percent=85).drop("mark")


SPOT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
                  lead(coalesce(text, '')) OVER o AS onward FROM documents WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, text, n_chars, coalesce(onward, (SELECT coalesce(text, '') FROM documents ORDER BY doc_id DESC LIMIT 1)) AS onward FROM d),
t AS (SELECT doc_id, n_chars, text, left(text, n_chars - n_chars // 3) || left(onward, n_chars // 3) AS edited, onward FROM e),
k AS (SELECT doc_id, 1 AS kind, text FROM t UNION ALL SELECT doc_id, 2, edited FROM t UNION ALL SELECT doc_id, 3, onward FROM t),
w AS (SELECT doc_id, kind, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM k),
p AS (SELECT doc_id, kind, ws[i] AS word, i, NOT list_contains({list(spot_signatures.COMMON_WORDS)}, ws[i]) AS content
      FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
c AS (SELECT doc_id, kind, word, content, lead(CASE WHEN content THEN word END, 1 IGNORE NULLS) OVER o AS c1,
             lead(CASE WHEN content THEN word END, 2 IGNORE NULLS) OVER o AS c2 FROM p WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
a AS (SELECT doc_id, kind, word || ' ' || c1 || ' ' || c2 AS g FROM c WHERE NOT content AND c2 IS NOT NULL),
f AS (SELECT doc_id, kind, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 2 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g
      FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = w.doc_id AND a.kind = w.kind)),
h AS (SELECT doc_id, kind, list_sort(list_distinct(list(left(md5(g), 8)))) AS h FROM (SELECT * FROM a UNION ALL SELECT * FROM f) GROUP BY ALL),
s AS (SELECT t.doc_id, n_chars, edited, coalesce(x.h, []) AS x, coalesce(y.h, []) AS y, coalesce(z.h, []) AS z FROM t
      LEFT JOIN h x ON x.doc_id = t.doc_id AND x.kind = 1 LEFT JOIN h y ON y.doc_id = t.doc_id AND y.kind = 2
      LEFT JOIN h z ON z.doc_id = t.doc_id AND z.kind = 3)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(x, '') AS fingerprint, array_to_string(y, '') AS edited_fingerprint,
       CASE WHEN x = y THEN 1.0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE) END AS near_edited,
       CASE WHEN x = z THEN 1.0 ELSE len(list_intersect(x, z)) / CAST(len(list_distinct(x || z)) AS DOUBLE) END AS near_next
FROM s
"""


@query("op11_spot_signatures", SPOT_SQL)
def op11(spark, sf_dir):
    compared = spot_signatures.compare_edited(documents(spark, sf_dir))
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                           "near_edited", "near_next")


MIDDLE_SQL = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS us FROM documents),
h AS (SELECT *, len(us) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query("op12_fill_middle", MIDDLE_SQL)
def op12(spark, sf_dir):
    return fill_middle.digests(fill_middle.fill_in_middle(documents(spark, sf_dir)))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.spelling_variants(documents(spark, sf_dir))
