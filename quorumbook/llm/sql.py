"""DuckDB SQL for the queries of this package that SQL can express."""

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

#: The checksum of a word's bytes from the table of its polynomial (0xEDB88320), bit by bit.
_RESAMPLING = r"""
        WITH table256 AS (
            SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                        ORDER BY i) AS entries
            FROM range(256) AS r(i)),
        texts AS (SELECT doc_id, false AS is_target, text FROM documents
                  UNION ALL SELECT NULL, true, text FROM benchmark),
        words AS (SELECT *, row_number() OVER () AS place, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS found FROM texts),
        each AS (SELECT place, is_target, unnest(found) AS word FROM words),
        coded AS (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM each)),
        hashed AS (
            SELECT word, xor(list_reduce(
                list_transform(range(length(code) // 2), lambda k: ('0x' || substr(code, 2 * k + 1, 2))::BIGINT),
                lambda c, byte: xor(entries[(xor(c, byte) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
            FROM coded, table256),
        counts AS (SELECT bucket, count(*) FILTER (NOT is_target) AS s, count(*) FILTER (is_target) AS t
                   FROM each JOIN hashed USING (word) GROUP BY bucket),
        totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000)
                         / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain FROM counts, totals),
        weights AS (SELECT place, sum(gain)::BIGINT AS total FROM each JOIN hashed USING (word) JOIN gains USING (bucket)
                    GROUP BY place),
        scores AS (
            SELECT doc_id, len(found)::BIGINT AS n_features, coalesce(floor(total / len(found))::BIGINT, 0) AS weight,
                   ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
            FROM words LEFT JOIN weights USING (place) WHERE NOT is_target),
        noisy AS (SELECT doc_id, n_features, weight,
                         weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scores),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
                   FROM noisy WHERE n_features >= 20)
        SELECT noisy.*, rank FROM noisy LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= 10 * n // 100) USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM n""",
    "op6_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS chosen FROM p),
        h AS (SELECT *, sha1(html) AS hex FROM g)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
                    (('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT & 31)::INT, 1), ''
                    ORDER BY i) FROM range(32) AS r(i)) AS payload_digest,
               CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = chosen THEN NULL ELSE chosen END AS refers_to
        FROM h""",
    "op13_importance_resampling": _RESAMPLING,
}
