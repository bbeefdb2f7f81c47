"""The numbered queries in SQL, where SQL can express them."""

from __future__ import annotations

from .license_scan import BASE_TEMPLATES, DIGITS, TEMPLATES

ORACLE: dict[str, str] = {}

ORACLE["op3_progressive_dedup"] = """
WITH hashed AS (
    SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents
)
SELECT doc_id, text_sha256,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept
FROM hashed
WINDOW same AS (PARTITION BY text_sha256)
"""

ORACLE["op8_hash_threshold_mix"] = r"""
WITH sized AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
    FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
           CAST(3 * sum(size) AS DOUBLE) AS most
    FROM sized GROUP BY source
), filled AS (
    SELECT *,
           sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
           sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_size
    FROM totals
), levelled AS (
    SELECT *, most * rest_weight <= weight * rest_size AS is_full FROM filled
), targets AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN most ELSE
               weight * max(rest_size) FILTER (NOT is_full) OVER ()
                   / max(rest_weight) FILTER (NOT is_full) OVER () END AS target
    FROM levelled
), budget AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), running AS (
    SELECT doc_id, size, place, source_size, target, whole,
           target - whole * source_size AS wanted,
           sum(size) OVER (PARTITION BY s.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
           sum(size) OVER (PARTITION BY s.source, place) AS own
    FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= wanted OR (upto - own <= wanted
            AND upto - wanted < wanted - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""

ORACLE["op10_rule_cascade"] = r"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT doc_id, w AS place, array_to_string(words[w:w + 4], ' ') AS content
    FROM split, unnest(range(1, len(words) - 3)) AS u(w)
), twice AS (
    SELECT doc_id, place FROM windows
    QUALIFY count(*) OVER (PARTITION BY doc_id, content) > 1
), covered AS (
    SELECT doc_id, sum(least(5, coalesce(after - place, 5))) AS n
    FROM (SELECT *, lead(place) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM twice)
    GROUP BY doc_id
), counted AS (
    SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           len(lines) AS n_lines, len(regexp_extract_all(text, '!')) AS n_marks
    FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
), based AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 30 * n_lines
            OR 10 * n_marks > 5 * n_words OR word_chars > 40 * n_words) AS kept
FROM based
"""

ORACLE["op1_permutation_shards"] = """
WITH RECURSIVE hashed AS (
    SELECT i, printf('shard-%02d', i) AS name FROM range(32) AS r(i)
), preferences AS (
    SELECT list(CAST('0x' || substr(md5(name || '/offset'), 1, 15) AS BIGINT) % 4099 ORDER BY i) AS offsets,
           list(CAST('0x' || substr(md5(name || '/skip'), 1, 15) AS BIGINT) % 4098 + 1 ORDER BY i) AS skips,
           list(name ORDER BY i) AS names
    FROM hashed
), filled AS (
    SELECT 0 AS turn, list_transform(range(4099), lambda x: -1) AS owner
    UNION ALL
    SELECT turn + 1, list_concat(list_append(owner[:slot], turn % 32), owner[slot + 2:])
    FROM (
        SELECT turn, owner, list_filter(
            list_transform(range(4099), lambda j: (offsets[turn % 32 + 1] + j * skips[turn % 32 + 1]) % 4099),
            lambda s: owner[s + 1] < 0)[1] AS slot
        FROM filled, preferences WHERE turn < 4099
    )
), placed AS (
    SELECT unnest(range(4099)) AS slot, unnest(owner) AS shard FROM filled WHERE turn = 4099
), keyed AS (
    SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 4099 AS slot
    FROM documents
)
SELECT doc_id, keyed.slot, names[shard + 1] AS shard
FROM keyed JOIN placed ON keyed.slot = placed.slot, preferences
"""

_TEMPLATE_ROWS = ",\n".join(
    f"    ('{t.name}', '{t.label}', {t in BASE_TEMPLATES}, {w.position}, '{w.word}', {w.mandatory})"
    for t in TEMPLATES for w in t.words
)

ORACLE["op13_license_index"] = rf"""
WITH template(name, label, base, position, word, mandatory) AS (VALUES
{_TEMPLATE_ROWS}
), listed AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), hits AS (
    SELECT doc_id, word, place FROM (
        SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM listed
    ) WHERE word IN (SELECT word FROM template)
), frequency AS (
    SELECT word, count(DISTINCT doc_id) AS df FROM hits GROUP BY word
), weighted AS (
    SELECT t.*, coalesce(df, 0) AS df,
           ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(df, 0))) AS idf
    FROM template t LEFT JOIN frequency f ON t.word = f.word
), ranked AS (
    SELECT *, row_number() OVER rarest AS nth,
           round(sum(idf) OVER rarest / sum(idf) OVER (PARTITION BY name), {DIGITS}) AS share,
           min(position) FILTER (mandatory) OVER (PARTITION BY name) AS key,
           count(*) FILTER (mandatory) OVER (PARTITION BY name) AS needed
    FROM weighted WINDOW rarest AS (PARTITION BY name ORDER BY df, word, position)
), aligned AS (
    SELECT doc_id, name, label, base, place - position AS begin, nth, share, mandatory, key, needed,
           row_number() OVER (PARTITION BY doc_id, name, place - position ORDER BY nth) AS held
    FROM hits h JOIN ranked r ON h.word = r.word
), scored AS (
    SELECT doc_id, max(share) AS score FROM aligned WHERE held = nth GROUP BY doc_id
), verified AS (
    SELECT doc_id, label, base, begin + key AS place FROM aligned WHERE mandatory
    GROUP BY doc_id, name, label, base, begin, key, needed HAVING count(*) = needed
), found AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word,
           max(place) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM verified GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM listed l LEFT JOIN found f ON l.doc_id = f.doc_id LEFT JOIN scored s ON l.doc_id = s.doc_id
"""
