"""The operators over their whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import decontamination, exact_dedup, language_id, license_scan, merkle, minhash, packing, quality_classifier, quality_rules, ranked_search, sharding, substring_dedup, url_filter

SHARDS = 16

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, folder))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, folder), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_quality(_documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_failed"
    )


def quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_classifier.classify_quality(_documents(spark, folder), labels).drop("text_hash")


def substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.deduplicate_substrings(_documents(spark, folder))


def contaminated(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.find_contaminated(_documents(spark, folder), items).drop("text_hash")


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, folder))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, folder))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_languages(_documents(spark, folder), language_id.in_held_out_fold())


def urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{folder}/pages.parquet"), URL_RULES)


def copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(_documents(spark, folder))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(merkle.build_manifest(_documents(spark, folder), merkle.tampered_leaf()))


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank_documents(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": license_scans,
    "op2_sharding": shards,
    "op3_quality_rules": rules,
    "op4_quality_classifier": quality,
    "op5_substring_dedup": substrings,
    "op6_decontamination": contaminated,
    "op7_best_fit_packing": packed,
    "op8_minhash_near_dedup": near_duplicates,
    "op9_language_id": languages,
    "op10_url_filters": urls,
    "op11_exact_dedup": copies,
    "op12_merkle_manifest": manifest,
    "op13_ranked_search": ranked,
}

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_L = license_scan


def _template_rows() -> str:
    rows = []
    for number, t in enumerate(_L.BASE + _L.ADDED):
        k = _L.NOTICE_RUN if t.kind == "notice" else _L.PHRASE_RUN
        for at in range(len(t.words) - k + 1):
            run = [f"'{w}'" for w in t.words[at : at + k]] + ["NULL"] * (_L.NOTICE_RUN - k)
            rows.append(f"({number}, '{t.label}', '{t.kind}', {len(t.words)}, {k}, {at}, {', '.join(run)})")
    return ", ".join(rows)


def _leaf_sql(n_chars: str) -> str:
    fields = [f"CAST({n_chars if f == 'n_chars' else f} AS VARCHAR)" for f in merkle.FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


#: CRC-32 of the digits of doc_id: a byte is taken in, then eight times a bit is shifted out.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
          lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384::BIGINT * (d & 1)))), 4294967295::BIGINT)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_WORD, _SPACES, _SYMBOLS = quality_rules.SPACED_WORD, quality_rules.SPACES, quality_rules.SYMBOLS
_R = quality_rules

ORACLES: dict[str, str] = {
    "op1_license_scans": f"""WITH texts AS (SELECT doc_id, row_number() OVER () AS r,
          regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_L.WORD}') AS ws FROM documents),
        words AS (SELECT r, ws[i] AS w0, ws[i + 1] AS w1, ws[i + 2] AS w2, i - 1 AS p FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts)),
        runs(template, label, kind, size, k, "at", t0, t1, t2) AS (VALUES {_template_rows()}),
        diagonals AS (SELECT r, template, label, kind, size, k, p - "at" AS diagonal, list(DISTINCT "at") AS ats
          FROM words JOIN runs ON w0 = t0 AND w1 = t1 AND (t2 IS NULL OR w2 = t2) GROUP BY ALL),
        phrases AS (SELECT r, label, kind, 1.0::DOUBLE AS share, diagonal AS place FROM diagonals WHERE kind <> 'notice' AND len(ats) = size - k + 1),
        gaps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {_L.NEIGHBOURS} THEN 0 ELSE 1 END AS apart
          FROM diagonals WHERE kind = 'notice'),
        parts AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS part FROM gaps),
        votes AS (SELECT r, template, label, kind, size, part, diagonal, unnest(ats) AS "at" FROM parts),
        merged AS (SELECT r, label, kind, size, diagonal + "at" AS first, list("at") OVER (PARTITION BY r, template, part
          ORDER BY (diagonal + "at") / (floor({_L.LONGEST_SPAN} * size) - {_L.NOTICE_RUN} + 0.5) RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ats FROM votes),
        notices AS (SELECT r, label, kind, len(list_distinct(flatten(list_transform(ats, lambda a: [a, a + 1, a + 2])))) / size AS share, first FROM merged),
        found AS (SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(place) FILTER (kind = 'base') AS first_word, max(place) FILTER (kind = 'base') AS last_word,
          array_to_string(list_sort(list(DISTINCT label) FILTER (kind = 'base')), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
          max(share) AS score FROM (SELECT * FROM phrases UNION ALL SELECT r, label, kind, share, first FROM notices
            WHERE share >= {_L.LEAST_COVERED}) GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
          coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM texts LEFT JOIN found USING (r)""",
    "op3_quality_rules": f"""WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
        split AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS ws,
          list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls,
          length(regexp_replace(text, '{_SPACES}', '', 'g')) AS word_chars, len(regexp_extract_all(text, '{_SYMBOLS}')) AS n_symbols FROM texts),
        triples AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
        repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM triples) WHERE c > 1) GROUP BY 1),
        measured AS (SELECT t.doc_id, t.source, len(ws) AS n_words, word_chars, n_symbols, len(ls) AS n_lines,
          len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
          FROM texts t JOIN split USING (r) LEFT JOIN repeated USING (r)),
        judged AS (SELECT *, n_words < {_R.LEAST_WORDS} OR 100 * n_repeat_words > {_R.MOST_REPEATED} * n_words AS base_failed,
          100 * n_symbols > {_R.MOST_SYMBOLS} * n_words OR 100 * n_dup_lines > {_R.MOST_DUP_LINES} * n_lines
          OR word_chars < {_R.SHORTEST_MEAN} * n_words OR word_chars > {_R.LONGEST_MEAN} * n_words AS soft_failed FROM measured),
        hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM judged GROUP BY 1),
        moments AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v, avg(1 / n) AS h FROM hosts),
        prior AS (SELECT m, CASE WHEN v <= 1e-12 THEN {_R.FLAT_PRIOR} WHEN alike * ({_R.STRONGEST_PRIOR} + 1) > 1 THEN greatest(1 / alike - 1, 1.0)
          ELSE {_R.STRONGEST_PRIOR} END AS w FROM (SELECT *, CASE WHEN h < 1 AND v > 1e-12 THEN (v / (m * (1 - m)) - h) / (1 - h) ELSE 0.0 END AS alike FROM moments)),
        verdicts AS (SELECT source, (bad + m * w) / (n + w) > {_R.MOST_FAILING} AS host_failed FROM hosts, prior)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, host_failed,
          NOT base_failed AND NOT (host_failed AND soft_failed) AS kept
        FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source""",
    "op10_url_filters": f"""WITH rules(verdict, host, path) AS (VALUES {_RULES}),
        split AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
          regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM pages),
        fits AS (SELECT s.n, arg_max(r.host || r.path, length(r.host || r.path) * 10000 + length(r.host)) AS rule,
          arg_max(r.verdict, length(r.host || r.path) * 10000 + length(r.host)) AS verdict
          FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY 1)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (n)""",
    "op11_exact_dedup": f"""WITH texts AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
          row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256 FROM texts""",
    "op12_merkle_manifest": f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
          CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS found FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        low AS (SELECT 0 AS level, lang, p, leaf AS node, n FROM placed
          UNION ALL SELECT level + 1, lang, p // 2, sha256(string_agg(node, '' ORDER BY p)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY level, lang, p // 2, n),
        tops AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1),
        high AS (SELECT 0 AS level, p, node, n FROM tops
          UNION ALL SELECT level + 1, p // 2, sha256(string_agg(node, '' ORDER BY p)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, p // 2, n),
        climb AS (SELECT row_number() OVER () AS r, doc_id, lang, leaf, p, n, 0 AS level, found AS node, '' AS proof FROM placed
          UNION ALL SELECT r, doc_id, c.lang, leaf, c.p // 2, (c.n + 1) // 2, c.level + 1,
            sha256(CASE WHEN s.node IS NULL THEN c.node WHEN c.p % 2 = 0 THEN c.node || s.node ELSE s.node || c.node END), proof || coalesce(s.node, '')
          FROM climb c LEFT JOIN low s ON s.level = c.level AND s.lang IS NOT DISTINCT FROM c.lang AND s.p = xor(c.p, 1) WHERE c.n > 1),
        peak AS (SELECT r, doc_id, leaf, t.node AS subroot, t.p, t.n, 0 AS level, c.node, proof FROM climb c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
          UNION ALL SELECT r, doc_id, leaf, subroot, k.p // 2, (k.n + 1) // 2, k.level + 1,
            sha256(CASE WHEN s.node IS NULL THEN k.node WHEN k.p % 2 = 0 THEN k.node || s.node ELSE s.node || k.node END), proof || coalesce(s.node, '')
          FROM peak k LEFT JOIN high s ON s.level = k.level AND s.p = xor(k.p, 1) WHERE k.n > 1)
        SELECT doc_id, leaf, subroot, high.node AS root, sha256(proof) AS proof_sha256, peak.node AS folded_root, peak.node = high.node AS verified
        FROM peak, high WHERE peak.n = 1 AND high.n = 1""",
    "op13_ranked_search": f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS ts FROM documents),
        sized AS (SELECT r, doc_id, len(ts) AS n FROM texts WHERE len(ts) > 0),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
        counts AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM texts) GROUP BY ALL),
        weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
          FROM (SELECT t, count(*) AS df FROM counts GROUP BY t), total),
        items AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
        asked AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM items) GROUP BY ALL),
        scored AS (SELECT i, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
          FROM asked JOIN counts USING (t) JOIN weights USING (t) JOIN sized USING (r), total GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= {ranked_search.BEST}""",
}
