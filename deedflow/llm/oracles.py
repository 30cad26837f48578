"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split_up AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split_up),
keyed AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {BLANKS}), '{UPPER}', '{LOWER}') AS k FROM numbered),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT d.doc_id, i, line, r.k IS NOT NULL AND keeper <> d.doc_id AS gone FROM keyed d LEFT JOIN repeated r ON d.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
keepers AS (SELECT h, max(page_id) AS keeper FROM hashed GROUP BY h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda c:
           substr('{BASE32}', ((('0x' || substr(h, 5 * g::INT + 1, 5))::BIGINT >> (15 - 5 * c::INT)) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM hashed JOIN keepers USING (h)
"""

SUBSTRING_DEDUP = """
WITH split_up AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM split_up WHERE len(w) >= 50),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS words FROM placed),
firsts AS (SELECT words, min(doc_id) AS owner FROM windows GROUP BY words HAVING count(*) > 1),
hits AS (SELECT doc_id, s FROM windows JOIN firsts USING (words) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM hits, (SELECT unnest(range(0, 50)) AS o)),
words AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split_up)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split_up d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN removed r ON r.doc_id = d.doc_id
"""

SQL: dict[str, str] = {"op7_substring_dedup": SUBSTRING_DEDUP, "op5_line_dedup": LINE_DEDUP, "op6_warc": WARC}
