"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _escaped(text: str) -> str:
    """The length of a text in the chat template: one more for each backslash, `<` and `[`."""
    return f"(length({text}) + length(regexp_replace({text}, '[^\\\\<\\[]', '', 'g')))"


CHAT = f"""
WITH rows AS MATERIALIZED (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|turn|>') + {_escaped("role")} + 1 + {_escaped("text")} + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS MATERIALIZED (
    SELECT DISTINCT item_id, span, list_slice(w, i + 1, i + span) AS gram
    FROM (SELECT item_id, w, least(len(w), 13) AS span, unnest(range(len(w) - least(len(w), 13) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
spans AS (SELECT DISTINCT span FROM windows),
grams AS MATERIALIZED (
    SELECT doc_id, span, i, list_slice(w, i + 1, i + span) AS gram
    FROM (SELECT doc_id, w, span, unnest(range(greatest(len(w) - span + 1, 0))) AS i FROM docs CROSS JOIN spans)
),
found AS MATERIALIZED (SELECT doc_id, item_id, span, i FROM grams JOIN windows USING (span, gram)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM found) GROUP BY doc_id),
which AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(which.n, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN which USING (doc_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

WARC = f"""
WITH pages_ AS MATERIALIZED (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha, first_value(page_id) OVER same AS original,
        row_number() OVER same AS nth
    FROM pages WINDOW same AS (PARTITION BY coalesce(html, '') ORDER BY page_id)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN original END AS refers_to
FROM pages_
"""

JACCARD = f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(list_slice(w, i + 1, i + 5)) AS s
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)
),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached(doc_id, other) AS (SELECT x, y FROM both_ways UNION SELECT reached.doc_id, y FROM reached JOIN both_ways ON other = x)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, least(docs.doc_id, coalesce(m, docs.doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reached GROUP BY doc_id) USING (doc_id)
"""

MIXING = """
WITH docs AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
    FROM documents
),
sizes AS MATERIALIZED (
    SELECT source, CAST(sum(size) AS HUGEINT) AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM docs GROUP BY source
),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY 2 * size / CAST(weight AS DOUBLE), source NULLS LAST) AS place FROM sizes),
-- The level when the sources up to a place stop at twice their size: the first that no later source is below.
sums AS MATERIALIZED (
    SELECT place, size, weight, sum(3 * size) OVER () - (sum(4 * size) OVER w - 4 * size) AS over, 2 * (sum(weight) OVER () - sum(weight) OVER w + weight) AS under
    FROM ordered WINDOW w AS (ORDER BY place)
),
levels AS (SELECT place, over, under, 2 * size * under >= weight * over AS fits FROM sums),
level AS (SELECT place, over, under FROM levels WHERE fits ORDER BY place LIMIT 1),
targets AS MATERIALIZED (
    SELECT source, size, CASE WHEN o.place < level.place THEN CAST(2 * size AS DOUBLE) ELSE CAST(weight * over AS DOUBLE) / CAST(under AS DOUBLE) END AS target,
        CAST(floor(target) AS HUGEINT) AS wanted, CASE WHEN size > 0 THEN wanted // size ELSE 0 END AS whole, wanted - whole * size AS rest
    FROM ordered o, level
),
hashes AS (SELECT source, hash, sum(size) AS n FROM docs GROUP BY source, hash),
before AS MATERIALIZED (SELECT source, hash, n, sum(n) OVER (PARTITION BY source ORDER BY hash) - n AS b FROM hashes)
SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(t.size AS BIGINT) AS source_size, target,
    CAST(whole * d.size + CASE WHEN b + n <= rest THEN d.size WHEN b < rest THEN d.size * (rest - b) // n ELSE 0 END AS BIGINT) AS taken
FROM docs d JOIN before b ON d.source IS NOT DISTINCT FROM b.source AND d.hash = b.hash JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
"""

def _least(*ways: str) -> str:
    """The cheapest of structs (c, a, t), ties to the least a; null: no way."""
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _way(p: str, cost: str, edits: str, text: str = "''", when: str = "true") -> str:
    """The way p with further cost, edits and repaired lines."""
    return f"CASE WHEN {p} IS NOT NULL AND ({when}) THEN {{'c': {p}.c + {cost}, 'a': {p}.a || '{edits}', 't': {p}.t || {text}}} END"


_LINE = {"u": "'user:' || chr(10)", "a": "'assistant:' || chr(10)"}
_KEEP = "(role || ':' || text || chr(10))"
_REROLE = {x: f"('{x}:' || text || chr(10))" for x in ("user", "assistant")}
_STAYS = "fault NOT IN ('blank', 'duplicate')"
_MORE = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
_ONE_U, _ONE_A, _BOTH = _LINE["u"], _LINE["a"], f"({_LINE['u']} || {_LINE['a']})"


def _closed(v0: str, v1: str, v2: str, v3: str) -> str:
    """The four ways after any inserts, as w0 to w3."""
    w2 = _least(v2, _way(v0, "5", "I", _ONE_U), _way(v1, "5", "I", _ONE_U), _way(v3, "5", "I", _ONE_U))
    w3 = _least(v3, _way(v2, "5", "I", _ONE_A), _way(v0, "10", "II", _BOTH), _way(v1, "10", "II", _BOTH))
    return f"{v0} AS w0, {v1} AS w1, {w2} AS w2, {w3} AS w3"


_READ_U = [way for w in ("w0", "w1", "w3") for way in (_way(w, _MORE, "K", _KEEP, f"letter = 'u' AND {_STAYS}"), _way(w, f"1 + {_MORE}", "R", _REROLE["user"], _STAYS))]
_READ_A = [_way("w2", _MORE, "K", _KEEP, f"letter = 'a' AND {_STAYS}"), _way("w2", f"1 + {_MORE}", "R", _REROLE["assistant"], _STAYS)]
_WAY_TYPE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"

REPAIR = f"""
WITH RECURSIVE crc AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)
),
keyed AS MATERIALIZED (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations
),
ways AS MATERIALIZED (
    SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS way
    FROM keyed, crc
),
rows_ AS MATERIALIZED (
    SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM ways, (SELECT unnest([0, 1]) AS copy) WHERE way <> 0 AND (copy = 0 OR way = 3)
),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS letter FROM rows_
),
faults AS MATERIALIZED (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter NOT IN ('su', 'ua', 'au') AS odd
    FROM placed
),
steps AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 't': ''}} AS {_WAY_TYPE}) AS v0, CAST(NULL AS {_WAY_TYPE}) AS v1, CAST(NULL AS {_WAY_TYPE}) AS v2, CAST(NULL AS {_WAY_TYPE}) AS v3
    FROM (SELECT DISTINCT conv_id FROM placed)
    UNION ALL
    SELECT conv_id, i, {_way("w0", "2", "D")}, {_least(_way("w1", "2", "D"), _way("w0", _MORE, "K", _KEEP, f"letter = 's' AND {_STAYS}"))},
        {_least(_way("w2", "2", "D"), *_READ_U)}, {_least(_way("w3", "2", "D"), *_READ_A)}
    FROM (SELECT s.conv_id, f.i, f.role, f.text, f.letter, f.fault, {_closed("v0", "v1", "v2", "v3")} FROM steps s JOIN faults f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1)
),
counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal
    FROM faults GROUP BY conv_id
),
ends AS (
    SELECT conv_id, i, {_least("v0", _way("v1", "10", "II", _BOTH), _way("v2", "5", "I", _ONE_A), "v3")} AS best FROM steps
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, length(best.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN ends e ON n.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = n.n
"""

PHRASES = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
pieces AS MATERIALIZED (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)
),
runs AS (SELECT lang, k, list_slice(w, i + 1, i + k) AS p FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
counts AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM runs GROUP BY lang, k, p),
sizes AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, p, f FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, p, f, unnest(range(1, k)) AS c FROM candidates),
scored AS (
    SELECT x.lang, x.p, x.f AS a, c, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * x.f // (l.f + r.f) AS BIGINT) AS score
    FROM cuts x JOIN counts l ON l.lang = x.lang AND l.p = list_slice(x.p, 1, c) JOIN counts r ON r.lang = x.lang AND r.p = list_slice(x.p, c + 1, x.k)
),
weakest AS (SELECT lang, p, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, c := c)) AS x FROM scored GROUP BY lang, p, a),
inner_ AS (
    SELECT lang, f, list_slice(p, i + 1, i + k) AS q FROM (SELECT lang, p, f, k, unnest(range(len(p) - k + 1)) AS i
        FROM (SELECT lang, p, f, unnest(range(2, len(p))) AS k FROM candidates WHERE len(p) > 2))
),
within AS MATERIALIZED (SELECT DISTINCT c.lang, c.p FROM inner_ i JOIN candidates c ON c.lang = i.lang AND c.p = i.q WHERE 100::HUGEINT * i.f >= 80::HUGEINT * c.f),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, x.l AS l, x.r AS r, x.score AS score
    FROM weakest ANTI JOIN within USING (lang, p)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op3_chat_formatting": CHAT, "op8_decontamination": DECONTAMINATION, "op9_warc": WARC, "op10_jaccard_join": JACCARD, "op11_phrase_mining": PHRASES, "op12_conversation_repair": REPAIR, "op13_source_mixing": MIXING}
