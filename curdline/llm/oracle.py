"""DuckDB counterparts of corpus queries that SQL can express."""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(text) + 11
      + 4 * (length(role || text) - length(replace(role || text, '&', '')))
      + 3 * (length(role || text) - length(replace(role || text, '<', '')))
      + 4 * (length(role || text) - length(replace(replace(role || text, '[', ''), ']', ''))) AS chars
  FROM t),
e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def licences_sql() -> str:
    """The licence scan, from the same fixed sentences and rules."""
    from curdline.llm.licenses import COPYRIGHT_LINE, ENDS, NOT_KEPT, RULES, known_sentences

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    table = ", ".join(f"({text(s)}, {text(i)})" for s, i in known_sentences().items())
    begin, end, line_name = map(text, COPYRIGHT_LINE)
    steps, last = [], "ids"
    for k, (_, rule) in enumerate(RULES):
        wanted = text("".join(f"<{i}>" for i in rule))
        steps.append(f"r{k} AS (SELECT *, contains(s{k}, {wanted}) AS m{k}, replace(s{k}, {wanted}, '|') AS s{k + 1} FROM {last})")
        last = f"r{k}"
    order = []
    for name, _ in RULES:
        if name not in order:
            order.append(name)
    names = ", ".join(
        f"CASE WHEN {' OR '.join(f'm{k}' for k, (n, _) in enumerate(RULES) if n == name)} THEN {text(name)} END" for name in order
    )
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
cut AS (SELECT row_number() OVER () AS r, doc_id,
  string_split(regexp_replace(coalesce(text, ''), {text(ENDS)}, '\\1' || chr(1), 'g'), chr(1)) AS sentences FROM documents),
s AS (SELECT r, doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM cut),
n AS (SELECT s.*, trim(lower(regexp_replace(s, {text(NOT_KEPT)}, ' ', 'g'))) AS normal FROM s),
w AS (SELECT n.*, coalesce(known.id, CASE WHEN starts_with(normal, {begin}) AND ends_with(normal, {end}) THEN {line_name} END) AS id
  FROM n LEFT JOIN known ON sentence = normal),
lines AS (SELECT r, doc_id, i, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS j
  FROM w WHERE id IS NULL),
l AS (SELECT lines.*, trim(lower(regexp_replace(line, {text(NOT_KEPT)}, ' ', 'g'))) AS normal FROM lines),
hits AS (
  SELECT r, doc_id, i, 0 AS j, id FROM w WHERE id IS NOT NULL
  UNION ALL SELECT r, doc_id, i, j, known.id FROM l JOIN known ON sentence = normal
  UNION ALL SELECT r, doc_id, i, j, {line_name} FROM l
    WHERE starts_with(normal, {begin}) AND ends_with(normal, {end}) AND normal NOT IN (SELECT sentence FROM known)),
ids AS (SELECT r, doc_id, string_agg(id, ' ' ORDER BY i, j) AS sentences, string_agg('<' || id || '>', '' ORDER BY i, j) AS s0
  FROM hits GROUP BY r, doc_id),
{", ".join(steps)}
SELECT doc_id, sentences, coalesce(nullif(concat_ws(' ', {names}), ''), 'unknown') AS licences FROM {last}
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775807) AS id,
  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
repeated AS (SELECT key, max(id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT id) >= 3),
j AS (SELECT k.*, coalesce(id < last, FALSE) AS gone FROM k LEFT JOIN repeated USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""

PHRASES = rf"""
WITH pieces AS (SELECT row_number() OVER () AS r, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
grams AS (SELECT lang, unnest([ws[i : i + k - 1] FOR k IN [1, 2, 3, 4] IF i + k - 1 <= len(ws)]) AS p FROM starts),
f AS (SELECT lang, p, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
s AS (SELECT c.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : len(c.p)]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM s),
inner_ AS (SELECT lang, p[i : i + m - 1] AS p, max(a) AS longer FROM (
  SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i FROM (
    SELECT lang, p, f AS a, unnest(range(2, len(p))) AS m FROM f WHERE len(p) > 2)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, p) WHERE place = 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, FALSE)),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

SOURCES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
x AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows_ AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
