"""DuckDB SQL for the queries that SQL can express, written from the contracts, not from the operators."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
lagged AS (SELECT r, i, string_agg(word, ' ') OVER span AS seq, count(*) OVER span AS n FROM pos
           WINDOW span AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
seen AS (SELECT r, i, row_number() OVER (PARTITION BY seq ORDER BY r, i) > 1 AS again FROM lagged WHERE n = 20),
cover AS (SELECT p.r, p.i, p.word,
            coalesce(bool_or(s.again) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
          FROM pos p LEFT JOIN seen s ON s.r = p.r AND s.i = p.i),
kept AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS n_gone, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text
         FROM cover GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n_gone, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

#: A window's 64-bit hash stands for its 400 bytes here: doubled up to 256, then 256 + 128 + 16.
_DOUBLED = "".join(f"h{2 * k} AS (SELECT *, hash(h{k}, lead(h{k}, {k}) OVER (PARTITION BY r ORDER BY i)) AS h{2 * k} FROM h{k}),\n"
                   for k in (1, 2, 4, 8, 16, 32, 64, 128))
ORACLE["op2_suffix_array_dedup"] = f"""
WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, x, regexp_extract_all(x, '..') AS bs FROM w),
pos AS (SELECT r, generate_subscripts(bs, 1) AS i, unnest(bs) AS byte FROM b),
h1 AS (SELECT *, hash(byte) AS h1 FROM pos),
{_DOUBLED}
starts AS (SELECT r, i, byte, hash(h256, lead(h128, 256) OVER o, lead(h16, 384) OVER o) AS seq, lead(1, 399) OVER o IS NOT NULL AS whole
       FROM h256 WINDOW o AS (PARTITION BY r ORDER BY i)),
seen AS (SELECT r, i, byte, whole AND count(*) OVER (PARTITION BY seq, whole) > 1 AS again FROM starts),
cover AS (SELECT r, i, byte, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM seen),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS first FROM cover),
kept AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS n_gone, count(*) FILTER (first) AS n_spans,
                string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS x FROM runs GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(n_gone, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

ORACLE["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM tri),
cov AS (SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, i + k AS i FROM rep, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lin USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END AS base,
    CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END AS more FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base > 0 AS base_failed, base + more = 0 AS kept, (base + more)::BIGINT AS failed FROM f
"""

#: Level by level: shares by weight, full nodes first; then the running total in the seeded order.
ORACLE["op6_mixing"] = r"""
WITH d AS (SELECT doc_id, lang, source,
    CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '^src[1-9]$') THEN 'reference' ELSE 'community' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available FROM d GROUP BY ALL),
root AS (SELECT sum(available)::HUGEINT AS budget FROM leaf),
n0 AS (SELECT domain, sum(available * 2)::HUGEINT AS cap, (CASE domain WHEN 'crawl' THEN 1 WHEN 'reference' THEN 2 ELSE 3 END)::HUGEINT AS w FROM leaf GROUP BY domain),
o0 AS (SELECT n.*, r.budget AS b,
    r.budget - coalesce(sum(n.cap) OVER ( ORDER BY n.cap::DOUBLE / n.w::DOUBLE, n.domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(n.w) OVER () - coalesce(sum(n.w) OVER ( ORDER BY n.cap::DOUBLE / n.w::DOUBLE, n.domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
    FROM n0 n CROSS JOIN root r),
f0 AS (SELECT *, cap * rest <= w * left_ AS full_ FROM o0),
b0 AS (SELECT domain, CASE WHEN full_ THEN cap ELSE w * (b - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0))
    // sum(CASE WHEN NOT full_ THEN w END) OVER () END AS budget FROM f0),
n1 AS (SELECT domain, lang, sum(available * 2)::HUGEINT AS cap, (CASE WHEN lang = 'en' THEN 3 ELSE 1 END)::HUGEINT AS w FROM leaf GROUP BY domain, lang),
o1 AS (SELECT n.*, r.budget AS b,
    r.budget - coalesce(sum(n.cap) OVER (PARTITION BY n.domain ORDER BY n.cap::DOUBLE / n.w::DOUBLE, n.domain, n.lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(n.w) OVER (PARTITION BY n.domain) - coalesce(sum(n.w) OVER (PARTITION BY n.domain ORDER BY n.cap::DOUBLE / n.w::DOUBLE, n.domain, n.lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
    FROM n1 n JOIN b0 r ON n.domain IS NOT DISTINCT FROM r.domain),
f1 AS (SELECT *, cap * rest <= w * left_ AS full_ FROM o1),
b1 AS (SELECT domain, lang, CASE WHEN full_ THEN cap ELSE w * (b - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain), 0))
    // sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY domain) END AS budget FROM f1),
n2 AS (SELECT domain, lang, source, sum(available * 2)::HUGEINT AS cap, (1)::HUGEINT AS w FROM leaf GROUP BY domain, lang, source),
o2 AS (SELECT n.*, r.budget AS b,
    r.budget - coalesce(sum(n.cap) OVER (PARTITION BY n.domain, n.lang ORDER BY n.cap::DOUBLE / n.w::DOUBLE, n.domain, n.lang, n.source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(n.w) OVER (PARTITION BY n.domain, n.lang) - coalesce(sum(n.w) OVER (PARTITION BY n.domain, n.lang ORDER BY n.cap::DOUBLE / n.w::DOUBLE, n.domain, n.lang, n.source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
    FROM n2 n JOIN b1 r ON n.domain IS NOT DISTINCT FROM r.domain AND n.lang IS NOT DISTINCT FROM r.lang),
f2 AS (SELECT *, cap * rest <= w * left_ AS full_ FROM o2),
b2 AS (SELECT domain, lang, source, CASE WHEN full_ THEN cap ELSE w * (b - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain, lang), 0))
    // sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY domain, lang) END AS budget FROM f2),
p AS (SELECT b2.domain, b2.lang, b2.source, available, (budget // available)::BIGINT AS passes, (budget % available)::BIGINT AS remainder
    FROM b2 JOIN leaf USING (domain, lang, source) WHERE available > 0),
x AS (SELECT d.*, passes, remainder, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('7:' || passes || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN p USING (domain, lang, source)),
y AS (SELECT doc_id, domain, lang, source, n_tokens, unnest(range(passes)) AS epoch FROM x
    UNION ALL SELECT doc_id, domain, lang, source, n_tokens, passes FROM x WHERE remainder > 0 AND upto <= remainder)
SELECT * FROM y
"""

#: Every n-gram of 1 to 5 words within pieces, counted; the score at each cut in 128-bit whole numbers.
ORACLE["op11_phrase_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM w, (VALUES (1), (2), (3), (4), (5)) AS o(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 100),
inner_ AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2),
    lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM c),
lost AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a),
kept AS (SELECT * FROM c ANTI JOIN lost USING (lang, phrase)),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
scored AS (SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, n, j,
    ((1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cut JOIN total ON total.lang = cut.lang
    JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:j], ' ')
    JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM scored) WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""

#: Each order is run over the failure masks, step by step.
ORACLE["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest([0, 1, 2, 3, 4]) AS b),
orders AS (SELECT [a.b, b.b, c.b, d.b, e.b] AS o FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
step AS (SELECT array_to_string(list_transform(o, lambda f: 'ABCDE'[f + 1]), '') AS filter_order, s AS step, o[s] AS f,
    coalesce(list_sum(list_transform(o[1:s - 1], lambda g: 1 << g)), 0)::INTEGER AS before
    FROM orders, range(1, 6) r(s)),
run AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (mask & (before | (1 << f)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & (1 << f) <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & (1 << f) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = 1 << f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & (1 << f) <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & (1 << f) <> 0), 0) AS toxic_lost
    FROM cell, step GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM run
"""
