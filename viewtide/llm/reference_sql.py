"""SQL of another engine that gives the same rows as the corpus queries."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
sentences AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM sentences GROUP BY lang),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM sentences, range(1, 5) t(k)),
frequent AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
    SELECT lang, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rest
    FROM frequent, range(1, 4) t(j) WHERE j < k),
scores AS (
    SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head JOIN frequent y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
    SELECT lang, f, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' '))) AS phrase
    FROM frequent, range(2, 4) t(s) WHERE s < k),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * longer.f < 80 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

RANKED_SEARCH = rf"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
terms AS (
    SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM numbered),
counts AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), whole),
items AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
wanted AS (
    SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
                                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM items),
scores AS (
    SELECT item, item_id, row, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
    FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (row), whole
    GROUP BY item, item_id, row, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 50
"""
