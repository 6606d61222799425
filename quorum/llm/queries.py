"""The subpackage's queries by name, each over its whole table, and oracle SQL where SQL can say the same.

All of them read the columns that they name and no others, give one row per row (op5: per piece), also for repeated rows, take null and empty
texts as their operators say, and give no row for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, flac, hard_negatives, html_main, langid, order_minhash, packing, quality, secret_scan, substring_dedup, suffix_dedup, warc
from .common import docs_of, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs_of(spark, sf_dir), texts=False)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(stored(flac.store(docs_of(spark, sf_dir))))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(docs_of(spark, sf_dir), bpe.vocabulary(bpe.RANKS))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(docs_of(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.pieces(docs_of(spark, sf_dir))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return quality.judged(docs, quality.fit_on(docs, _table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = stored(warc.scan(stored(warc.write(_table(spark, sf_dir, "pages")))))
    return warc.records(scanned).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs_of(spark, sf_dir), texts=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    out = langid.identified(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", F.coalesce(~langid.in_learning(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.shifted(hard_negatives.usable(_table(spark, sf_dir, "embeddings")), 7, 10))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(docs_of(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.digests(rows, conversations.audited(rows))


def queries() -> dict:
    own = (
        op1_substring_dedup, op2_media_columns, op3_byte_bpe, op4_near_dedup, op5_packing, op6_quality_rules, op7_warc, op8_suffix_dedup, op9_language_id, op10_html_main,
        op11_hard_negatives, op12_secret_scan, op13_conversations,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": r"""
            WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            w AS (SELECT r, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i + 34], ' ') END AS win FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
            m AS (SELECT win FROM w WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
            h AS (SELECT w.r, w.i, w.word, max(CASE WHEN m.win IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN m ON w.win = m.win),
            k AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM h GROUP BY r)
            SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r""",
        "op7_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
            f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
            SELECT q.page_id, q.payload_bytes, q.payload_digest, CASE WHEN q.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN q.page_id > f.first THEN f.first END AS refers_to
            FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest""",
        "op8_suffix_dedup": """
            WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
            b AS (SELECT doc_id, r, i, substr(x, 2 * i - 1, 2) AS byte, CASE WHEN 2 * (i + 49) <= length(x) THEN substr(x, 2 * i - 1, 100) END AS s FROM (SELECT doc_id, r, x, unnest(range(1, length(x) // 2 + 1)) AS i FROM d)),
            m AS (SELECT s, min(doc_id) AS first FROM b WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) <> max(doc_id)),
            h AS (SELECT b.r, b.i, b.byte, max(CASE WHEN m.first < b.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY b.r ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM b LEFT JOIN m ON b.s = m.s),
            e AS (SELECT r, i, byte, gone, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS edge FROM h),
            k AS (SELECT r, sum(gone) AS n_removed, sum(edge) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY r)
            SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r""",
        "op11_hard_negatives": """
            WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 0) = 0),
            s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.r <> c.r),
            p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, c) <= 5),
            n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.id NULLS LAST, s.c) AS rank
                FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
            SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
        "op12_secret_scan": r"""
            WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
            m AS (SELECT r, kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS value, unnest(string_split_regex(text, pattern)[1:len(ms)]) AS gap FROM (
                SELECT r, text, 0 AS kind, '{ASSIGN}' AS pattern, regexp_extract_all(text, '{ASSIGN}') AS ms FROM t
                UNION ALL SELECT r, text, 1, 'AKIA[A-Z0-9]+', regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM t
                UNION ALL SELECT r, text, 2, '[0-9a-f]{16,}', regexp_extract_all(text, '[0-9a-f]{16,}') FROM t
                UNION ALL SELECT r, text, 3, '[A-Za-z0-9+/_-]{20,}={0,2}', regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}={0,2}') FROM t) WHERE len(ms) > 0),
            p AS (SELECT r, kind, value, sum(length(gap) + length(value)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM m),
            q AS (SELECT r, kind, value, CAST(stop - length(value) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
                CASE WHEN kind = 3 AND regexp_matches(value, '[0-9]|[a-z][A-Z]') THEN rtrim(value, '=') END AS body FROM p),
            a AS (SELECT DISTINCT value, body FROM q WHERE body IS NOT NULL),
            e AS (SELECT *, CASE WHEN regexp_full_match(body, '[0-9a-f]+') THEN '0123456789abcdef' WHEN regexp_full_match(body, '[0-9A-F]+') THEN '0123456789ABCDEF' WHEN regexp_full_match(body, '[A-Z2-7]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
                WHEN regexp_full_match(body, '[0-9a-z]+') THEN '0123456789abcdefghijklmnopqrstuvwxyz' WHEN regexp_full_match(body, '[0-9A-Z]+') THEN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'
                WHEN regexp_full_match(body, '[A-Za-z0-9]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789' WHEN regexp_full_match(body, '[A-Za-z0-9+/]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'
                WHEN regexp_full_match(body, '[A-Za-z0-9_-]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_' END AS alphabet FROM a),
            v AS (SELECT value, alphabet, CAST(length(body) AS DOUBLE) AS n, CAST(length(alphabet) AS DOUBLE) AS k, length(bin(length(body))) - 1 AS octave, list_transform(string_split(body, ''), lambda x: strpos(alphabet, x) - 1) AS vs FROM e WHERE alphabet IS NOT NULL),
            s AS (SELECT *, list_sum(list_transform(range(0, CAST(k AS BIGINT)), lambda y: power(len(list_filter(vs, lambda x: x = y)), 2))) AS squares,
                list_sum(list_transform(range(1, len(vs)), lambda i: CASE WHEN (2 * vs[i] >= k) <> (2 * vs[i + 1] >= k) THEN 1 ELSE 0 END)) AS changes,
                list_sum(list_transform(range(1, len(vs)), lambda i: (vs[i] - (k - 1) / 2) * (vs[i + 1] - (k - 1) / 2))) AS products FROM v),
            z AS (SELECT *, abs((power((k / n * squares - n) / (k - 1), 1.0::DOUBLE / 3) - (1 - 2 / (9 * (n * (k - 1) / (n - 1))))) / sqrt(2 / (9 * (n * (k - 1) / (n - 1))))) AS z1,
                abs((changes - (n - 1) / 2) / sqrt((n - 1) / 4)) AS z2, abs(products / ((k * k - 1) / 12) / sqrt(n - 1)) AS z3 FROM s),
            w AS (SELECT *, list_min(list_transform([z1, z2, z3], lambda x: 2 * exp(-x * x / 2) * 0.3989422804014327::DOUBLE / (1 + 0.2316419::DOUBLE * x) * (0.319381530::DOUBLE + (-0.356563782::DOUBLE + (1.781477937::DOUBLE + (-1.821255978::DOUBLE + 1.330274429::DOUBLE / (1 + 0.2316419::DOUBLE * x)) / (1 + 0.2316419::DOUBLE * x)) / (1 + 0.2316419::DOUBLE * x)) / (1 + 0.2316419::DOUBLE * x)))) AS least FROM z),
            b AS (SELECT *, ceil(least(1.0::DOUBLE, 3 * least) * 1000000) AS bin FROM w),
            h AS (SELECT *, count(*) OVER (PARTITION BY alphabet, octave) AS everyone, count(*) OVER (PARTITION BY alphabet, octave ORDER BY bin) AS below FROM b),
            g AS (SELECT *, max(CASE WHEN bin * everyone <= 0.05 * 1000000 * below THEN bin END) OVER (PARTITION BY alphabet, octave) AS cut FROM h),
            k AS (SELECT q.r, q.kind, q.start, q.stop FROM q LEFT JOIN g ON q.kind = 3 AND q.value = g.value
                WHERE CASE q.kind WHEN 0 THEN length(regexp_extract(q.value, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 WHEN 1 THEN length(q.value) >= 18 WHEN 2 THEN true ELSE g.bin > coalesce(g.cut, -1) END),
            f AS (SELECT * FROM k WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM k AS o WHERE o.r = k.r AND o.kind < 3 AND o.start <= k.start AND o.stop >= k.stop)),
            j AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_random,
                string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans, string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base FROM f GROUP BY r)
            SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random FROM t LEFT JOIN j ON t.r = j.r""".replace("{ASSIGN}", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""),
        "op13_conversations": r"""
            WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
            x AS (SELECT o.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS crc FROM o),
            d AS (SELECT conv_id, turn, CASE WHEN crc = 4 THEN 'user' ELSE role END AS role, CASE crc WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN crc = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE crc <> 0),
            f AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
            g AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS i, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before
                FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again)),
            s AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS more FROM g),
            c AS (SELECT DISTINCT conv_id FROM conversations),
            q AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
                count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id),
            p AS (SELECT conv_id, 0 AS pos, {'c': 0, 'e': '', 't': ''} AS k0, CAST(NULL AS STRUCT(c INTEGER, e VARCHAR, t VARCHAR)) AS k1, CAST(NULL AS STRUCT(c INTEGER, e VARCHAR, t VARCHAR)) AS k2, CAST(NULL AS STRUCT(c INTEGER, e VARCHAR, t VARCHAR)) AS k3 FROM c
                UNION ALL
                SELECT conv_id, pos,
                    {'c': i0.c + 3, 'e': i0.e || 'D', 't': i0.t} AS k0,
                    least({'c': i1.c + 3, 'e': i1.e || 'D', 't': i1.t}, CASE WHEN NOT gone AND i = 's' THEN {'c': i0.c + more, 'e': i0.e || 'K', 't': role || ':' || text} END) AS k1,
                    least({'c': i2.c + 3, 'e': i2.e || 'D', 't': i2.t}, CASE WHEN NOT gone AND i = 'u' THEN {'c': u.c + more, 'e': u.e || 'K', 't': u.t || role || ':' || text} END, CASE WHEN NOT gone THEN {'c': u.c + 2 + more, 'e': u.e || 'R', 't': u.t || 'user:' || text} END) AS k2,
                    least({'c': i3.c + 3, 'e': i3.e || 'D', 't': i3.t}, CASE WHEN NOT gone AND i = 'a' THEN {'c': i2.c + more, 'e': i2.e || 'K', 't': i2.t || chr(10) || role || ':' || text} END, CASE WHEN NOT gone THEN {'c': i2.c + 2 + more, 'e': i2.e || 'R', 't': i2.t || chr(10) || 'assistant:' || text} END) AS k3
                FROM (SELECT *, least(CASE WHEN i0.c IS NOT NULL THEN {'c': i0.c, 'e': i0.e, 't': ''} END, CASE WHEN i1.c IS NOT NULL THEN {'c': i1.c, 'e': i1.e, 't': i1.t || chr(10)} END, CASE WHEN i3.c IS NOT NULL THEN {'c': i3.c, 'e': i3.e, 't': i3.t || chr(10)} END) AS u
                    FROM (SELECT *, least(k3, CASE WHEN i2.c IS NOT NULL THEN {'c': i2.c + 2, 'e': i2.e || 'I', 't': i2.t || chr(10) || 'assistant:'} END) AS i3
                        FROM (SELECT p.conv_id, s.pos, s.gone, s.more, s.i, s.role, s.text, k0 AS i0, k1 AS i1, k3,
                                least(k2, {'c': k0.c + 2, 'e': k0.e || 'I', 't': 'user:'}, CASE WHEN k1.c IS NOT NULL THEN {'c': k1.c + 2, 'e': k1.e || 'I', 't': k1.t || chr(10) || 'user:'} END, CASE WHEN k3.c IS NOT NULL THEN {'c': k3.c + 2, 'e': k3.e || 'I', 't': k3.t || chr(10) || 'user:'} END) AS i2
                            FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = p.pos + 1)))),
            b AS (SELECT p.conv_id, least(k0, CASE WHEN k1.c IS NOT NULL THEN {'c': k1.c + 4, 'e': k1.e || 'II', 't': k1.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END, CASE WHEN k2.c IS NOT NULL THEN {'c': k2.c + 2, 'e': k2.e || 'I', 't': k2.t || chr(10) || 'assistant:'} END, k3) AS r
                FROM p LEFT JOIN q ON p.conv_id IS NOT DISTINCT FROM q.conv_id WHERE p.pos = coalesce(q.n, 0))
            SELECT b.conv_id, coalesce(q.gaps, 0) AS gaps, coalesce(q.blank, 0) AS blank, coalesce(q.duplicate, 0) AS duplicate, coalesce(q.truncated, 0) AS truncated, coalesce(q.illegal, 0) AS illegal, CAST(b.r.c AS BIGINT) AS cost, b.r.e AS audit, sha256(b.r.t) AS repaired_sha256
            FROM b LEFT JOIN q ON b.conv_id IS NOT DISTINCT FROM q.conv_id""",
    }
