"""The operators bound to the tables of a folder, each with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.change_points import change_points
from lexloom.llm.common import table
from lexloom.llm.hamming import hamming_top_k
from lexloom.llm.html_extract import html_extract
from lexloom.llm.jaccard_join import jaccard_join
from lexloom.llm.lexical_search import ranked_search
from lexloom.llm.license_scan import license_scan
from lexloom.llm.line_dedup import line_dedup
from lexloom.llm.mixing import mix_to_targets
from lexloom.llm.packing import best_fit_packing, tokenizer
from lexloom.llm.pii import pii_scan
from lexloom.llm.quality import quality_rules
from lexloom.llm.sharding import stratified_shards
from lexloom.llm.substring_dedup import substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stratified_shards(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def public_tokenizer() -> dict:
    import public_tokenizers as public

    return tokenizer(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizer(), capacity=2048, end=0)


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, segments=4)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=13, digest=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=5, similarity=0.8, recall=0.999)


def op10_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines")
    return change_points(lines, "vendor_id", "quantity", "shipped_at", least=14, penalty=40000)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op13: what the rules find."""
    return op13_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2: its base columns."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5: its base columns."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def sharding_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4: all but the checksum."""
    return op4_sharding(spark, sf_dir).drop("text_crc32")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_license_scan, op3_html_extract, op4_sharding, op5_quality_rules, op6_best_fit_packing, op7_hamming_top_k, op8_substring_dedup, op9_ngram_jaccard_join, op10_mix_to_targets, op11_change_points, op12_lexical_search, op13_pii, license_scan_base, quality_rules_base, sharding_places, pii_base)
}

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS l
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        keyed AS (SELECT *, translate(trim(l, {_BLANKS}), {_UPPER}, lower({_UPPER})) AS k FROM lines),
        repeated AS (
            SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20
            GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT keyed.*, repeated.keep IS NOT NULL AND repeated.keep <> doc_id AS lost FROM keyed LEFT JOIN repeated USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM split WHERE len(ws) >= 13),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
        firsts AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
        gone AS (
            SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS p
            FROM win JOIN firsts USING (k) WHERE firsts.d < win.doc_id),
        placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM split)
        SELECT split.doc_id, len(split.ws) AS n_words, count(gone.p) AS n_removed,
               sha256(coalesce(string_agg(placed.w, ' ' ORDER BY placed.p) FILTER (gone.p IS NULL), '')) AS kept_sha256
        FROM split LEFT JOIN placed USING (doc_id) LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p
        GROUP BY split.doc_id, split.ws""",
    "op7_hamming_top_k": """
        WITH codes AS (
            SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code
            FROM embeddings WHERE len(embedding) = 64),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
            FROM codes q, codes c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
        FROM pairs QUALIFY rank <= 10""",
    "op11_change_points": """
        WITH RECURSIVE taken AS (
            SELECT vendor_id, CAST(CAST(shipped_at AS DATE) - DATE '1970-01-01' AS BIGINT) AS d, CAST(sum(quantity) AS HUGEINT) AS v
            FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
        days AS (SELECT vendor_id, unnest(range(min(d), max(d) + 1)) AS d FROM taken GROUP BY vendor_id),
        filled AS (SELECT days.vendor_id, days.d, coalesce(v, 0) AS v FROM days LEFT JOIN taken ON days.vendor_id IS NOT DISTINCT FROM taken.vendor_id AND days.d = taken.d),
        summed AS (SELECT *, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY d)),
        series AS (
            SELECT vendor_id, min(d) AS first, count(*) AS n, list_prepend(0::HUGEINT, list(s::HUGEINT ORDER BY d)) AS s, list_prepend(0::HUGEINT, list(q::HUGEINT ORDER BY d)) AS q
            FROM summed GROUP BY vendor_id),
        -- best[i + 1]: a million times the cost of the first i days and penalties, plus the segments; back: the start of their last segment
        dp AS (
            SELECT vendor_id, first, n, s, q, 0::BIGINT AS j, [0::HUGEINT] AS best, [0::BIGINT] AS back FROM series
            UNION ALL
            SELECT vendor_id, first, n, s, q, j + 1, list_append(best, list_min(c)), list_append(back, CASE WHEN list_min(c) IS NULL THEN NULL ELSE list_position(c, list_min(c)) - 1 END)
            FROM (
                SELECT *, list_transform(range(0, j + 1), lambda i: CASE WHEN best[i + 1] IS NOT NULL AND (j + 1 - i >= 14 OR (n < 14 AND j + 1 = n AND i = 0)) THEN
                    best[i + 1] + 1 + 1000000::HUGEINT * (CASE WHEN i > 0 THEN 40000 ELSE 0 END + (j + 1 - i) * floor(1000 * ln(1 +
                        ((j + 1 - i) * (q[j + 2] - q[i + 1]) - (s[j + 2] - s[i + 1]) * (s[j + 2] - s[i + 1])) // ((j + 1 - i) * (j + 1 - i))))::BIGINT) END) AS c
                FROM dp WHERE j < n)),
        walk AS (
            SELECT vendor_id, first, s, q, back, best[n + 1] AS total, n AS z, back[n + 1] AS a FROM dp WHERE j = n
            UNION ALL
            SELECT vendor_id, first, s, q, back, total, a, back[a + 1] FROM walk WHERE a > 0),
        cut AS (
            SELECT vendor_id, first, a, z, total, z - a AS n, s[z + 1] - s[a + 1] AS s, q[z + 1] - q[a + 1] AS q FROM walk),
        measured AS (SELECT *, 1 + (n * q - s * s) // (n * n) AS v FROM cut)
        SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY a) AS INTEGER) AS segment_no, CAST(first + a AS BIGINT) AS first_day, CAST(n AS BIGINT) AS n_days,
               CAST(s AS BIGINT) AS total, CAST(v AS BIGINT) AS spread, CAST(n * floor(1000 * ln(v)) AS BIGINT) AS cost, count(*) OVER (PARTITION BY vendor_id) AS n_segments, CAST(total // 1000000 AS BIGINT) AS best_cost
        FROM measured""",
    "op12_lexical_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, lower({_UPPER})), '{_TERMS}') AS ts FROM documents),
        a AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
        p AS (SELECT doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * a.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, a GROUP BY t, a.n),
        q AS (
            SELECT item_id, t, count(*) AS f FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, lower({_UPPER})), '{_TERMS}')) AS t FROM benchmark) GROUP BY ALL),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(f * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * p.n * a.n) // a.l)))) AS BIGINT) AS score
            FROM q JOIN p USING (t) JOIN w USING (t), a GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "pii_base": rf"""
        WITH parts AS ({" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {k} AS o, regexp_extract_all(coalesce(text, ''), '{form}') AS hits, string_split_regex(coalesce(text, ''), '{form}') AS gaps FROM documents" for k, (kind, form) in enumerate(_PII))}),
        matches AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM parts WHERE len(hits) > 0),
        placed AS (
            SELECT doc_id, kind, o, hits[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS s FROM matches),
        digits AS (SELECT *, reverse(regexp_replace(m, '[^0-9]', '', 'g')) AS d FROM placed),
        good AS (
            SELECT * FROM digits WHERE CASE kind
                WHEN 'email' THEN true
                WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(p, '0') AS INTEGER) END)) <= 255
                WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[i] AS INTEGER) ELSE (2 * CAST(d[i] AS INTEGER)) // 10 + (2 * CAST(d[i] AS INTEGER)) % 10 END)) % 10 = 0
                ELSE length(d) BETWEEN 9 AND 15 END)
        SELECT documents.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
               sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, o), '')) AS base_sha256
        FROM documents LEFT JOIN good ON good.doc_id = documents.doc_id GROUP BY documents.doc_id""",
    "license_scan_base": rf"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, lower({_UPPER})), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        p(words, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        hits AS (SELECT doc_id, i - 1 AS place, label FROM starts JOIN p ON ws[i] = words[1] AND ws[i:i + len(words) - 1] = words)
        SELECT w.doc_id, any_value(len(w.ws)) AS n_words, count(hits.place) AS n_base, min(hits.place) AS first_word, max(hits.place) AS last_word,
               coalesce(string_agg(DISTINCT hits.label, ',' ORDER BY hits.label), '') AS base_labels
        FROM w LEFT JOIN hits ON w.doc_id = hits.doc_id GROUP BY w.doc_id""",
    "quality_rules_base": r"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
               coalesce(dups.n, 0) AS n_dup_lines, coalesce(words.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(words.n, 0) > 50 * len(ws) AS base_failed
        FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN words USING (doc_id)""",
    "sharding_places": """
        WITH d AS (
            SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, md5('lexloom:' || doc_id) AS h,
                   (('0x' || md5('lexloom:' || coalesce(source, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM documents),
        f AS (
            SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size) - u) / count(*) OVER (PARTITION BY source) AS f FROM d),
        p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, doc_id, size) - 1 AS pos, count(*) OVER () AS n FROM f),
        s AS (SELECT *, pos * 8 // n AS shard FROM p)
        SELECT doc_id, size, 'rows' AS law, CAST(shard AS INTEGER) AS shard, pos - (shard * n + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
}
