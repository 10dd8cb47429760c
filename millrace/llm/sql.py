"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .licenses import SPELLINGS, STEPS, forms
from .quality_rules import DELTA, RISK, RULES

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


def quality_features(table: str = "documents") -> str:
    """CTEs, the last of which is f(doc_id, lang, body, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    space = r"\x20\x09-\x0D"
    return f"""
base AS (SELECT doc_id, lang, coalesce(text, '') AS body FROM {table}),
split AS (SELECT doc_id, lang, body, regexp_extract_all(body, '[^{space}]+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines FROM base),
wins AS (SELECT doc_id, i, words[i:i+2] AS win FROM split, unnest(range(1, len(words) - 1)) AS r(i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, unnest([0, 1, 2]) AS s(o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT s.doc_id, s.lang, s.body, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
    FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id)"""


def quality_verdicts(table: str = "documents", risk: float = RISK, delta: float = DELTA) -> str:
    """CTEs after quality_features(), the last of which is verdicts(doc_id, features, base_failed, kept)."""
    tests = [(rule, side, i, t) for rule, (side, cutoffs) in RULES.items() for i, t in enumerate(cutoffs)]
    grid = ", ".join(f"('{rule}', {i}, {t}::DOUBLE)" for rule, _, i, t in tests)
    risk /= len(RULES)
    values = " ".join(f"WHEN '{rule}' THEN {rule}" for rule in RULES)
    return f"""{quality_features(table)},
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length FROM f),
votes AS (SELECT doc_id, max(quality) = 1 AS good FROM (SELECT doc_id, (quality = 1)::INT AS quality FROM labels WHERE quality IS NOT NULL) GROUP BY doc_id),
labelled AS (SELECT coalesce('=' || m.lang, '') AS stratum, base_failed, symbol_ratio, repeat_ratio, dup_line_ratio, word_length, bool_or(good) AS good
    FROM m JOIN votes v ON m.doc_id = v.doc_id GROUP BY m.lang, body, base_failed, symbol_ratio, repeat_ratio, dup_line_ratio, word_length),
grid(rule, strictness, cutoff) AS (VALUES {grid}),
counted AS (SELECT stratum, rule, strictness, cutoff, count(*) FILTER (good) AS n,
    count(*) FILTER (good AND CASE rule {values} END > cutoff) AS k, count(*) FILTER (NOT good AND CASE rule {values} END > cutoff) AS bad
    FROM labelled, grid WHERE NOT base_failed GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k > n * {risk} THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS tail
    FROM counted WHERE bad > 0 AND n > 0),
held AS (SELECT stratum, rule, arg_max(cutoff, (bad, -strictness)) AS cutoff FROM tails
    WHERE tail <= {delta} / ((SELECT count(DISTINCT stratum) FROM labelled) * {len(tests)}) GROUP BY stratum, rule),
placed AS (SELECT *, coalesce('=' || lang, '') AS stratum FROM m),
verdicts AS (SELECT p.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM held h WHERE h.stratum = p.stratum AND CASE h.rule {values} END > h.cutoff) AS kept FROM placed p)"""


def quality_rules(risk: float = RISK, delta: float = DELTA) -> str:
    return f"WITH {quality_verdicts(risk=risk, delta=delta)} SELECT * FROM verdicts"


#: One record for each page; of equal payloads of at least 1000 bytes that with the largest id is the response.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT body, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY body)
SELECT p.page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
    CASE WHEN g.best <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.best <> p.page_id THEN g.best END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body AND n >= 1000
"""


def _canonical(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"lower(coalesce({text}, ''))"
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(to)}, 'g')"
    out = f"' ' || {out} || ' '"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(to)}, 'g')"
    return f"trim({out}, ' ')"


def licenses() -> str:
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in item)) for item in forms())
    return f"""WITH known(license_id, body) AS (VALUES {values}),
forms AS (SELECT {_canonical("body")} AS form, license_id FROM known),
digests AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM forms WHERE form <> '' GROUP BY form),
d AS (SELECT doc_id, sha256({_canonical("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN digests ON canonical_sha256 = digest"""


def license_variants() -> str:
    """What the variants of the known licences must be found as: themselves. Independent of how the operator normalises."""
    from .registry import variants

    rows = ", ".join(f"({i}, '{license_id}')" for i, license_id, _ in variants())
    return f"SELECT doc_id::BIGINT AS doc_id, license_id FROM (VALUES {rows}) AS v(doc_id, license_id) UNION ALL SELECT doc_id, NULL FROM documents"


#: All pairs of a label.
EMBEDDING_DEDUP = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM e LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""


def vector_codes(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8) -> str:
    """Plain Lloyd, one step after the other."""
    step = lambda k: f"""
near{k} AS MATERIALIZED (SELECT vec_id, label, q.p, x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + j)::BIGINT AS m
    FROM q JOIN books{k} b ON q.p = b.p GROUP BY ALL),
sums{k} AS (SELECT p, m % {entries} AS j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k}, range(1, {width + 1}) AS r(i) GROUP BY ALL),
means{k} AS (SELECT p, j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM sums{k} GROUP BY p, j),
books{k + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.j = m.j)"""  # noqa: E731
    return f"""
WITH v AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS MATERIALIZED (SELECT vec_id, label, p, list_transform(v[p * {width} + 1 : p * {width} + {width}], lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM v, range({parts}) AS r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v QUALIFY j < {entries}),
books0 AS MATERIALIZED (SELECT p, j, x AS c FROM q JOIN first ON q.vec_id = first.vec_id),{",".join(step(k) for k in range(rounds + 1))},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM books{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


#: Words with one place left open meet those that are the same there; words less a letter meet that word.
SPELLING = """
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM runs GROUP BY ALL),
bits AS (SELECT run, times, flatten(list_transform(flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END)),
    lambda b: list_transform(range(8), lambda k: (b // (1 << k)::BIGINT) % 2))) AS bits FROM lowered WHERE length(run) >= 5),
digests AS (SELECT run, times, xor(list_reduce([4294967295] || bits, lambda c, m: CASE WHEN xor(c, m) % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h FROM bits),
lost AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run) + 2)::INT) ELSE run END AS word, times FROM digests),
w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM lost WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
gaps AS MATERIALIZED (SELECT word, i, left(word, i::INT - 1) AS head, substring(word, i::INT + 1) AS tail FROM w, unnest(range(1, length(word) + 1)) AS r(i)),
near AS (SELECT a.word AS a, b.word AS b FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT g.word, w.word FROM gaps g JOIN w ON w.word = g.head || g.tail UNION SELECT w.word, g.word FROM gaps g JOIN w ON w.word = g.head || g.tail),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, encode(b)) AS other, max(w.n) AS other_n FROM near JOIN w ON w.word = near.b GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
path(word, stop, n) AS (SELECT word, word, n FROM f UNION ALL SELECT p.word, f.form, f.form_n FROM path p JOIN f ON p.stop = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(stop, n) AS root FROM path GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON f.word = ends.word
"""
