"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP2 = r"""
WITH w AS (
  SELECT doc_id, greatest(1.0, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 1.0 ELSE 1.5 END))::DOUBLE AS weight
  FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0)
           / coalesce(w.weight, 1.0) AS key
  FROM documents LEFT JOIN w USING (doc_id)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), s2 AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS ratio FROM s1
), s3 AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM s2
), s4 AS (
  SELECT *, max(CASE WHEN ratio >= (total - full_) / open_ THEN (total - full_) / open_ END) OVER () AS level FROM s3
), t AS (
  SELECT source, source_size, least(most, weight * level) AS target FROM s4
), t1 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t
), t2 AS (
  SELECT *, floor(target + 0.5)::BIGINT - epochs * source_size AS rest FROM t1
), p AS (
  SELECT d.*, t2.* EXCLUDE (source),
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - (upto - size))))::BIGINT AS taken
FROM p
"""

OP3 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), n AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS nth
  FROM t
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM n
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i : array_to_string(ws[i : i + 4], ' '))) END AS sh
  FROM w
), n AS (
  SELECT doc_id, len(sh)::BIGINT AS n FROM s
), u AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * both_ >= 75 * (a.n + b.n - both_)
), l AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x
)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN 1 & xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], flatten([[ascii(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256] for c in string_split(doc_id::VARCHAR, '')])),
                 lambda crc, b : CASE WHEN b < 256 THEN xor(crc, b) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END)) = 0
               THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents
), f AS (
  SELECT doc_id, source, cut IS DISTINCT FROM text AS changed,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(cut)) || ':' || cut, '-') AS cut_body
  FROM d
), l AS (
  SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS place, doc_id, source, sha256(head || body) AS leaf, sha256(head || cut_body) AS checked FROM f
), n AS (
  SELECT source, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY source) AS wide FROM l
  UNION ALL
  SELECT *, count(*) OVER (PARTITION BY source) FROM (
    SELECT source, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM n WHERE wide > 1 GROUP BY source, level, place // 3)
), s AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS wide FROM n WHERE wide = 1
), t AS (
  SELECT 0 AS level, place, subroot AS digest, wide FROM s
  UNION ALL
  SELECT *, count(*) OVER () FROM (SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE wide > 1 GROUP BY level, place // 3)
), nodes AS (
  SELECT source, false AS top, level, place, digest, wide FROM n UNION ALL SELECT NULL, true, level, place, digest, wide FROM t
), runs AS (
  SELECT source, top, level, place // 3 AS parent, list(digest ORDER BY place) AS run FROM nodes WHERE wide > 1 GROUP BY ALL
), heights AS (
  SELECT source, top, max(level) AS height FROM nodes GROUP BY ALL
), p AS (
  SELECT l.doc_id, l.source, l.leaf, l.place AS row_place, false AS top, 0 AS level, l.place AS place, '' AS siblings, l.checked AS folded FROM l
  UNION ALL
  SELECT p.doc_id, p.source, p.leaf, p.row_place, p.top OR p.level = h.height,
         CASE WHEN NOT p.top AND p.level = h.height THEN 0 ELSE p.level + 1 END,
         CASE WHEN NOT p.top AND p.level = h.height THEN s.place ELSE p.place // 3 END,
         p.siblings || coalesce(array_to_string(list_concat(r.run[:p.place % 3], r.run[p.place % 3 + 2:]), ''), ''),
         CASE WHEN r.run IS NULL THEN p.folded ELSE sha256(array_to_string(list_concat(r.run[:p.place % 3], [p.folded], r.run[p.place % 3 + 2:]), '')) END
  FROM p JOIN heights h ON p.top = h.top AND (p.top OR p.source IS NOT DISTINCT FROM h.source)
  JOIN s ON p.source IS NOT DISTINCT FROM s.source
  LEFT JOIN runs r ON r.top = p.top AND (p.top OR r.source IS NOT DISTINCT FROM p.source) AND r.level = p.level AND r.parent = p.place // 3 AND p.level < h.height
  WHERE NOT (p.top AND p.level = h.height)
)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(p.siblings) AS proof_sha256, p.folded AS folded_root, p.folded = t.digest AS verified
FROM p JOIN heights h ON h.top AND p.top AND p.level = h.height JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN t ON t.wide = 1
"""

OP13 = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
                                   AND len(list_filter(embedding, lambda x : x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings
), l AS (
  SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), c AS (
  SELECT r, r AS other FROM v UNION SELECT c.r, l.y FROM c JOIN l ON c.other = l.x
), m AS (
  SELECT c.r, min(v.vec_id) AS component_id FROM c JOIN v ON c.other = v.r GROUP BY c.r
), k AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id IS NOT DISTINCT FROM m.component_id AS kept
FROM v JOIN m USING (r) LEFT JOIN k ON k.x = v.r
"""

ORACLES = {"op2_mix_sources": OP2, "op3_exact_dedup": OP3, "op9_ngram_join": OP9, "op12_merkle_manifest": OP12, "op13_near_vectors": OP13}
