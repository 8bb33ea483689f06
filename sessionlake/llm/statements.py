"""SQL for the registered operators that it can express, each written from the query's definition."""

from __future__ import annotations

#: CRC-32 as sets: `one` the byte table, `term` what a byte at a distance from the end adds, `blank` the
#: checksum of that many zero bytes. `most` is a query of one number, the longest string in bytes.
CHECKSUM = """
one AS (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda v, step: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
    FROM range(256) AS t(b)),
term AS (
    SELECT 0 AS d, b, v FROM one
    UNION ALL
    SELECT t.d + 1, t.b, xor(t.v >> 8, o.v) FROM term t JOIN one o ON o.b = t.v & 255
    WHERE t.d + 1 < ({most})),
blank AS (
    SELECT 0 AS len, 4294967295::BIGINT AS v
    UNION ALL
    SELECT z.len + 1, xor(z.v >> 8, o.v) FROM blank z JOIN one o ON o.b = xor(z.v, 0) & 255
    WHERE z.len < ({most})),
byte AS (
    SELECT s, len, len - 1 - i AS d,
        16 * (strpos('0123456789ABCDEF', hexed[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hexed[2 * i + 2]) - 1 AS b
    FROM (SELECT s, len, hexed, unnest(range(len)) AS i
          FROM (SELECT s, octet_length(encode(s)) AS len, upper(hex(encode(s))) AS hexed FROM ({strings})))),
checksum AS (
    SELECT x.s, xor(xor(z.v, 4294967295), x.v) AS crc
    FROM (SELECT s, any_value(len) AS len, bit_xor(t.v) AS v FROM byte JOIN term t USING (d, b) GROUP BY s) x
    JOIN blank z USING (len))
"""

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPELLING = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, {FOLD.format('run')} AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
    WHERE length(run) >= 6),
named AS (SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs GROUP BY ALL),
{CHECKSUM.format(most="SELECT max(octet_length(encode(s))) FROM named", strings="SELECT DISTINCT s FROM named")},
said AS (
    SELECT CASE WHEN crc % 199 = 0
        THEN substr(run, 1, crc % length(run)) || substr(run, (crc % length(run) + 2)::BIGINT) ELSE run END AS word, times
    FROM named JOIN checksum USING (s)),
words AS (
    SELECT word, sum(times)::BIGINT AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (
    SELECT word, n, i, substr(word, 1, i) || chr(1) || substr(word, i + 2) AS holed,
        substr(word, 1, i) || substr(word, i + 2) AS shorter
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (holed) WHERE a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.shorter = b.word
    UNION
    SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.shorter = b.word),
best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n
    FROM pairs GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
        CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
led AS (
    SELECT word, word AS here, 0 AS step FROM formed
    UNION ALL
    SELECT l.word, f.form, l.step + 1 FROM led l JOIN formed f ON f.word = l.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, max_by(here, step) AS root FROM led GROUP BY word) l USING (word)
"""

_RESAMPLING = f"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS r, 0 AS wanted, doc_id, text FROM documents
    UNION ALL
    SELECT row_number() OVER (), 1, NULL, text FROM benchmark),
listed AS (
    SELECT r, wanted, doc_id,
        regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM texts),
spots AS (SELECT r, wanted, w, unnest(range(len(w))) AS k FROM listed),
grams AS (
    SELECT r, wanted, w[k + 1] AS s FROM spots
    UNION ALL
    SELECT r, wanted, w[k + 1] || ' ' || w[k + 2] FROM spots WHERE k + 1 < len(w)),
said AS (SELECT r, wanted, s, count(*) AS times FROM grams GROUP BY ALL),
{CHECKSUM.format(most="SELECT max(octet_length(encode(s))) FROM said", strings="SELECT DISTINCT s FROM said")},
found AS (SELECT r, wanted, crc % 10000 AS bucket, times FROM said JOIN checksum USING (s)),
held AS (
    SELECT bucket, sum(times) FILTER (wanted = 0) AS s, sum(times) FILTER (wanted = 1) AS t FROM found GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM held),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(held.t, 0) + 1)::DOUBLE * (sums.s + 10000)
        / ((coalesce(held.s, 0) + 1)::DOUBLE * (sums.t + 10000))))::BIGINT AS gain
    FROM held, sums),
weight AS (
    SELECT r, sum(times)::BIGINT AS n, sum(times * gain)::BIGINT AS total
    FROM found JOIN gain USING (bucket) WHERE wanted = 0 GROUP BY r),
noisy AS (
    SELECT r, doc_id, len(w) AS n_words,
        floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
    FROM (SELECT *, list_sum(list_transform(range(8), lambda i:
              (strpos('0123456789abcdef', sha256('7:' || coalesce(doc_id::VARCHAR, ''))[i + 1]) - 1) * 16 ** (7 - i)))
              ::DOUBLE AS h
          FROM listed WHERE wanted = 0)),
scored AS (
    SELECT doc_id, n_words >= 20 AS fit, coalesce(n, 0) AS n_features,
        CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight, noise
    FROM noisy LEFT JOIN weight USING (r)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY fit ORDER BY weight + noise DESC, doc_id, n_features, weight) AS place,
        count(*) OVER (PARTITION BY fit) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
    CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank
FROM placed
"""

_LEAKS = f"""
WITH listed AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w,
        regexp_extract_all(' ' || coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS gaps
    FROM documents),
items AS (
    SELECT item_id::VARCHAR AS name,
        regexp_extract_all({FOLD.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark),
sought AS (
    SELECT DISTINCT name, size, array_to_string(w[k + 1 : k + size], ' ') AS said
    FROM (SELECT name, w, least(len(w), 10) AS size, unnest(range(greatest(len(w) - 9, 1))) AS k FROM items WHERE len(w) > 0)),
spots AS (
    SELECT r, w, size, unnest(range(len(w) - size + 1)) AS k
    FROM listed, (SELECT DISTINCT size FROM sought) WHERE len(w) >= size),
met AS (
    SELECT r, k, size, name
    FROM (SELECT r, k, size, array_to_string(w[k + 1 : k + size], ' ') AS said FROM spots) JOIN sought USING (size, said)),
hit AS (SELECT DISTINCT r, unnest(range(k + 1, k + size + 1)) AS p FROM met),
stretch AS (
    SELECT r, min(p) AS low, max(p) AS high
    FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS island FROM hit) GROUP BY r, island),
placed AS (
    SELECT r, high - low + 1 AS n,
        coalesce(list_sum(list_transform(gaps[1 : low], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(w[1 : low - 1], lambda x: length(x))), 0) - 1 AS starts,
        coalesce(list_sum(list_transform(gaps[1 : high], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(w[1 : high], lambda x: length(x))), 0) - 1 AS ends
    FROM stretch JOIN listed USING (r)),
told AS (
    SELECT r, sum(n) AS n_hit, string_agg(starts::BIGINT || ':' || ends::BIGINT, ',' ORDER BY starts) AS hit_spans
    FROM placed GROUP BY r),
named AS (
    SELECT r, count(DISTINCT name) AS n_items, string_agg(DISTINCT name, ',' ORDER BY name) AS names
    FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hit_spans, '') AS hit_spans
FROM listed LEFT JOIN told USING (r) LEFT JOIN named USING (r)
"""

_LINES = f"""
WITH listed AS (
    SELECT row_number() OVER () AS r, doc_id, source, text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, string_split(text, chr(10)) AS ls
    FROM documents),
cut AS (
    SELECT r, source, text, k, ls[k + 1] AS line, len(ls) = k + 1 AS is_last
    FROM (SELECT r, source, text, ls, unnest(range(len(ls))) AS k FROM listed)),
lines AS (
    SELECT r, source, text, k, n, line || CASE WHEN is_last THEN '' ELSE chr(10) END AS piece,
        {FOLD.format("array_to_string(lw, ' ')")} AS said, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again,
        sum(length(line) + 1) OVER (PARTITION BY r ORDER BY k) - length(line) - 1 AS starts
    FROM (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw, len(lw) AS n FROM cut)),
common AS (
    SELECT source, said FROM (SELECT DISTINCT source, said, text FROM lines WHERE n > 0)
    GROUP BY source, said HAVING count(*) > 10),
marked AS (
    SELECT l.*, c.said IS NOT NULL AS goes
    FROM lines l LEFT JOIN common c ON l.n > 0 AND c.said = l.said AND c.source IS NOT DISTINCT FROM l.source),
told AS (
    SELECT r, count(*) FILTER (n > 0 AND again) AS n_dup_lines, coalesce(sum(n) FILTER (goes), 0) AS lost,
        coalesce(string_agg(starts::BIGINT || ':' || (starts + length(piece))::BIGINT, ',' ORDER BY k) FILTER (goes), '') AS removed,
        coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT goes), '') AS clean
    FROM marked GROUP BY r),
spots AS (
    SELECT r, k, array_to_string(w[k + 1 : k + 8], ' ') AS said
    FROM (SELECT r, w, unnest(range(len(w) - 7)) AS k FROM listed WHERE len(w) > 7)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, said) AS n FROM spots) WHERE n > 1),
covered AS (
    SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(k, k + 8)) FROM twice) GROUP BY r),
measures AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        coalesce(lost, 0)::BIGINT AS n_boilerplate_words, coalesce(removed, '') AS removed,
        CASE WHEN text IS NOT NULL THEN clean END AS text
    FROM listed LEFT JOIN told USING (r) LEFT JOIN covered c USING (r))
SELECT * EXCLUDE (r), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
        AND n_words - n_boilerplate_words >= 0.3::DOUBLE * n_words AS kept
FROM measures
"""

SQL: dict[str, str] = {
    "op5_line_frequency": _LINES,
    "op6_benchmark_windows": _LEAKS, "op11_reduced_alphabet": _SPELLING, "op13_target_resampling": _RESAMPLING,
}
