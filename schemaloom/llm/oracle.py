"""DuckDB twins of the queries that SQL can express."""

SQL = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) AND a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first_id FROM p GROUP BY html),
hexed AS (
  SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS hex, first_id
  FROM p JOIN g USING (html)
), based AS (
  SELECT *, list_aggregate(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
      (CAST('0x' || substr(hex || '0', CAST(i * 5 // 4 + 1 AS INTEGER), 2) AS BIGINT)
        >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM hexed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM based
""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS lim, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), o AS (
  SELECT *,
    (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM l
), t AS (
  SELECT source, source_size,
    least(lim, (SELECT arg_min(level, lim / weight) FROM o WHERE level * weight < lim) * weight) AS target
  FROM o
), placed AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE
    budget // source_size * size + least(size, greatest(0, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), f AS (
  SELECT doc_id, part,
    concat(
      CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), k AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)
), marked AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails = x AS only_x,
    contains(fails, x) AS hit, length(translate(fails, earlier, '')) < length(fails) AS early
  FROM k, steps
), counted AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT hit AND NOT early THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN hit AND NOT early THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND early THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN only_x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT early AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN hit AND NOT early AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM marked GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
""",
    "op12_url_filter": r"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), o AS (
  SELECT doc_id AS page_id, max(CAST(toxic = 1 OR quality = 0 AS INTEGER)) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host
), named AS (
  SELECT *, regexp_replace(host, '^.*@|:\d*$', '', 'g') AS bare, string_split(regexp_replace(host, '^.*@|:\d*$', '', 'g'), '.') AS x FROM h
), sized AS (
  SELECT *, regexp_matches(bare, '(^|\.)\d+$') AS numbers,
    CASE WHEN len(x) > 1 AND list_contains(['ac.jp', 'ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar',
      'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'com.tw', 'edu.au', 'gov.au', 'gov.uk', 'ne.jp', 'net.au', 'or.jp',
      'org.au', 'org.uk'], array_to_string(x[-2:], '.')) THEN 2 ELSE 1 END AS m
  FROM named
), hosts AS (
  SELECT host, n, k, CASE WHEN numbers THEN bare ELSE array_to_string(x[-(m + 1):], '.') END AS domain,
    CASE WHEN numbers THEN bare ELSE array_to_string(x[-m:], '.') END AS suffix
  FROM sized
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM hosts) AS base FROM hosts GROUP BY suffix
), s1 AS (
  SELECT *, 1 / coalesce(CASE WHEN sum(n * (n - 1) * base * (1 - base)) OVER () > 0 THEN least(0.5, greatest(0.001,
    sum((k - n * base) * (k - n * base) - n * base * (1 - base)) OVER () / sum(n * (n - 1) * base * (1 - base)) OVER ())) END, 0.1) - 1 AS w FROM s0
), d0 AS (
  SELECT domain, suffix, sum(hosts.n) AS n, sum(hosts.k) AS k, any_value((s1.k + w * base) / (s1.n + w)) AS base
  FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix
), d1 AS (
  SELECT *, 1 / coalesce(CASE WHEN sum(n * (n - 1) * base * (1 - base)) OVER () > 0 THEN least(0.5, greatest(0.001,
    sum((k - n * base) * (k - n * base) - n * base * (1 - base)) OVER () / sum(n * (n - 1) * base * (1 - base)) OVER ())) END, 0.1) - 1 AS w FROM d0
), h0 AS (
  SELECT host, hosts.n, hosts.k, (d1.k + w * base) / (d1.n + w) AS base FROM hosts JOIN d1 USING (domain, suffix)
), h1 AS (
  SELECT *, 1 / coalesce(CASE WHEN sum(n * (n - 1) * base * (1 - base)) OVER () > 0 THEN least(0.5, greatest(0.001,
    sum((k - n * base) * (k - n * base) - n * base * (1 - base)) OVER () / sum(n * (n - 1) * base * (1 - base)) OVER ())) END, 0.1) - 1 AS w FROM h0
), rated AS (
  SELECT host, n, w, (k + w * base) / (n + w) AS rate FROM h1
), r AS (
  SELECT page_id, host, path, CASE
      WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + w + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN rated USING (host)
""",
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), sizes AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(generate_series(1, len(words) - m + 1), lambda i: words[i:i + m - 1])) AS phrase
    FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(words) >= m
  ) GROUP BY lang, phrase HAVING count(*) >= 10
), c AS (
  SELECT lang, phrase, f AS a, unnest(generate_series(1, len(phrase) - 1)) AS k FROM f WHERE len(phrase) > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
    CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:k] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:]
), lowest AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, phrase[1:2] AS phrase FROM f WHERE len(phrase) = 3
    UNION ALL SELECT lang, f, phrase[2:3] FROM f WHERE len(phrase) = 3
  ) GROUP BY ALL
), kept AS (
  SELECT lowest.*, array_to_string(phrase, ' ') AS text FROM lowest LEFT JOIN around USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, text AS phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, text) AS rank FROM kept
) JOIN sizes USING (lang) WHERE rank <= 2000
""",
}
