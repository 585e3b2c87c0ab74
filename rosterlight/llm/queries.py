"""The registered queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, license_scan, lm, minhash, packing, quality, token_counts, token_files, vector_codes, warc, whitening
from .common import id_fold, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), stays="largest")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document, their places a function of its id and length: an insertion, a removal, a replacement."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    place = lambda k: F.pmod(F.coalesce("doc_id", F.lit(0)) * k, size + 1)
    edit = lambda at, remove, insert: F.struct(at.alias("place"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    edits = F.array(edit(place(7919), 0, " an inserted clause, "), edit(place(104729), 12, ""), edit(place(1299709), 5, "it's\n2024"))
    after = token_counts.edited_texts(docs.withColumn("edits", edits), public_tokenizers.path(BYTE_BPE))
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_leaves", "n_encoded")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_fold(docs["doc_id"], 3) == 1
    found = language_id.identified(docs, ~held_out)
    return found.select("doc_id", (id_fold(found["doc_id"], 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_report(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_fold(docs["doc_id"], 10)
    found = lm.scored(docs, fold != 0, fold == 1)
    return found.select("doc_id", (~found["train"]).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_minhash": op4_minhash,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_score": op10_lm_score,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}



def _lloyd_sql(rounds: int) -> str:
    """Every vector part is held against every entry: right at the size of the SQL check, not a way to do the work."""
    nearest = """
        a{k} AS (SELECT r, p, min((d, e)) AS m FROM (SELECT r, parts.p, e, list_sum(list_transform(list_zip(a, z), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d
                 FROM parts JOIN c{k} ON c{k}.p = parts.p) GROUP BY r, p),"""
    moved = """
        t{k} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS z FROM (SELECT p, m[2] AS e, i, sum(a[i])::DOUBLE AS s, count(*) AS n
                 FROM a{k} JOIN parts USING (r, p), range(1, (SELECT max(len(a)) FROM parts) + 1) AS x(i) GROUP BY ALL) GROUP BY p, e),
        c{j} AS (SELECT p, e, coalesce(t{k}.z, c{k}.z) AS z FROM c{k} LEFT JOIN t{k} USING (p, e)),"""
    return f"""
        WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS v FROM embeddings
                      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        parts AS (SELECT r, vec_id, p, v[1 + p * len(v) // 16 : (p + 1) * len(v) // 16] AS a FROM kept, range(16) AS x(p)),
        c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a AS z FROM parts QUALIFY e < 64),{"".join(nearest.format(k=k) + moved.format(k=k, j=k + 1) for k in range(rounds))}{nearest.format(k=rounds)}
        coded AS (SELECT r, string_agg(format('{{:02x}}', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY r),
        books AS (SELECT sha256(string_agg(x.z, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(z, ',') AS z FROM c{rounds}) AS x)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), books
    """


_BLANK = r"[ \t-\r]"

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # every pair that shares a shingle is counted: right at the size of the SQL check, not a way to do the work
    "op4_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents),
        sh AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, either.y FROM reach JOIN either ON either.x = reach.r)
        SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages),
        f AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
        SELECT page_id, bytes::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f
    """,
    "op12_vector_codes": _lloyd_sql(vector_codes.ROUNDS),
    "op9_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, unnest(l) AS word, generate_subscripts(l, 1) AS p
              FROM (SELECT r, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') AS l FROM d)),
        five AS (SELECT r, p, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS g,
                        lead(word, 4) OVER o AS fifth FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
        again AS (SELECT r, p FROM five WHERE fifth IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) >= 2),
        rep AS (SELECT r, count(DISTINCT p + k) AS n FROM again, range(5) AS s(k) GROUP BY r),
        nw AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
        ln AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
        lb AS (SELECT r, x, length(b) AS letters, length(x) - length(b) AS gaps, length(b) - length(regexp_replace(b, '[#*$%&<>]', '', 'g')) AS noise,
                      length(b) - length(replace(b, '!', '')) AS bangs, length(b) - length(replace(b, '|', '')) AS bars,
                      regexp_matches(b, '[.!?:;,"''”»)\]]$') AS ended
               FROM (SELECT r, x, regexp_replace(x, '{_BLANK}', '', 'g') AS b FROM ln)),
        lf AS (SELECT r, x, letters, letters > 0 AND (noise * 10 > letters OR bangs * 10 > letters OR (bars >= 3 AND bars * 4 >= gaps)
                      OR (gaps < 20 AND regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE)}')) OR (gaps < 2 AND NOT ended)) AS fails FROM lb),
        ls AS (SELECT r, count(*) FILTER (letters > 0) - count(DISTINCT x) FILTER (letters > 0) AS dup, sum(CASE WHEN fails THEN 0 ELSE letters END) AS left_ FROM lf GROUP BY r),
        q AS (SELECT doc_id, coalesce(nw.n, 0)::BIGINT AS n_words, coalesce(nw.chars, 0)::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     ls.dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, ls.left_ AS left_
              FROM d JOIN ls USING (r) LEFT JOIN nw USING (r) LEFT JOIN rep USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND left_ >= word_chars * 0.5 AS kept
        FROM q
    """,
}
