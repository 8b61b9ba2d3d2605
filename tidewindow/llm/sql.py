"""DuckDB SQL for the queries of this subpackage."""

from __future__ import annotations

from tidewindow.llm import quality
from tidewindow.llm.secrets import RULES, Rule

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sets
  UNION
  SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id
FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
"""


def _secret_kind(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT r, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least, regexp_split_to_array(x, '{pattern}') AS pieces,
    regexp_extract_all(x, '{pattern}', 0) AS found, regexp_extract_all(x, '{pattern}', {rule.group}) AS graded FROM texts"""


_TOLD = "kind || ':' || s || ':' || e"
OP3 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents
), matches AS ({" UNION ALL ".join(_secret_kind(i, r) for i, r in enumerate(RULES))}
), each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matches
), placed AS (
  SELECT r, kind, rank, list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0) AS s,
    length(found[i]) AS n FROM each WHERE length(graded[i]) >= least
), spans AS (SELECT r, kind, rank, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM placed)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({_TOLD}, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg({_TOLD}, ',' ORDER BY s, rank), '') AS spans
FROM texts t LEFT JOIN spans p ON t.r = p.r GROUP BY t.r, t.doc_id
"""

_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP4 = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS x, {_ALNUM} AS w FROM documents
), items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)
), places AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits
), words AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r
), found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
), runs AS (
  SELECT r, min(p) AS first, max(p) AS last FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS run FROM places) GROUP BY r, run
), cut AS (
  SELECT r, list_transform(regexp_split_to_array(x, '{_PLAIN_WORD}'), lambda y: length(y)) AS gaps,
    list_transform(regexp_extract_all(x, '{_PLAIN_WORD}'), lambda y: length(y)) AS sizes FROM docs WHERE r IN (SELECT r FROM runs)
), told AS (
  SELECT r, string_agg(CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s) AS spans
  FROM (SELECT r, list_sum(gaps[1:first]) + coalesce(list_sum(sizes[1:first - 1]), 0) AS s, list_sum(gaps[1:last]) + list_sum(sizes[1:last]) AS e FROM runs JOIN cut USING (r)) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r) LEFT JOIN told USING (r)
"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
OP6 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), runs AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS opens FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("text")})) + sum(CASE WHEN opens THEN length({_ESCAPED.format("role")}) + 9 + 8 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM runs GROUP BY conv_id
"""


def _weights(level: str, weights: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END" if weights else "1"


def mixing_sql(weights: dict[str, dict[str, int]], share: float, epochs: int, seed: int) -> str:
    """SQL for operator 8 over levels domain, lang and source."""
    levels = ("domain", "lang", "source")
    steps, nodes = "", "leaves"
    for i, level in enumerate(levels):
        path = ", ".join(levels[: i + 1])
        family = f"PARTITION BY {', '.join(levels[:i])}" if i else ""
        order = f"{family} ORDER BY CAST(cap AS DOUBLE) / weight, {level}"
        steps += f"""
), kids{i} AS (SELECT {path}, CAST(sum(cap) AS BIGINT) AS cap, any_value(budget) AS budget, {_weights(level, weights.get(level, {}))} AS weight FROM {nodes} GROUP BY {path}
), line{i} AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM kids{i}
), full{i} AS (SELECT *, cap * rest <= greatest(budget - bef, 0) * weight AS sated FROM line{i}
), sums{i} AS (SELECT *, coalesce(sum(cap) FILTER (sated) OVER ({family}), 0) AS spent, sum(weight) FILTER (NOT sated) OVER ({family}) AS open FROM full{i}
), part{i} AS (SELECT {path}, CASE WHEN sated THEN cap ELSE CAST((budget - spent) * weight // open AS BIGINT) END AS got FROM sums{i}
), node{i} AS (SELECT n.* REPLACE (p.got AS budget) FROM {nodes} n JOIN part{i} p USING ({path})"""
        nodes = f"node{i}"
    return rf"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4, 0) AS VARCHAR) AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '')) AS n
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {epochs} AS BIGINT) AS cap,
    (SELECT CAST(floor(sum(n) * {share}) AS BIGINT) FROM rows) AS budget FROM rows GROUP BY ALL{steps}
), plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part FROM node2
), keyed AS (SELECT r.*, whole, part, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM rows r JOIN plan USING (domain, lang, source)
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(n) OVER (PARTITION BY domain, lang, source, k) AS bef FROM keyed
), taken AS (SELECT *, whole + CASE WHEN bef < part THEN 1 ELSE 0 END AS epochs FROM placed)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(epochs AS BIGINT) AS epochs FROM taken WHERE epochs > 0
"""


OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), w AS (SELECT d, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id < winner THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < winner THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d AND n >= 1000
"""


def quality_sql() -> str:
    """SQL for operator 10, each round of the estimation as steps of their own: posteriors r, shares c and rates of bad votes b."""
    rules, start = list(quality.RULES), quality.start_model(tuple(quality.RULES), quality.KINDS)
    votes = ", ".join(f"{v} AS v{i}" for i, v in enumerate(quality.RULES.values()))
    columns = ", ".join(f"v{i}" for i in range(len(rules)))
    shares = ", ".join(f"({c}, CAST({x!r} AS DOUBLE))" for c, x in enumerate(start.shares))
    rates = ", ".join(f"({c}, 'v{i}', CAST({x!r} AS DOUBLE))" for c, row in enumerate(start.bad) for i, x in enumerate(row))

    def posteriors(k: int) -> str:
        return f"""
), l{k} AS MATERIALIZED (SELECT pid, n, cls, any_value(ln(p)) + coalesce(sum(ln(CASE v WHEN -1 THEN b ELSE 1 - b END)), 0) AS x
    FROM patterns CROSS JOIN c{k} LEFT JOIN ballots USING (pid) LEFT JOIN b{k} USING (cls, rule) GROUP BY pid, n, cls
), r{k} AS MATERIALIZED (SELECT pid, n, cls, e / sum(e) OVER (PARTITION BY pid) AS p FROM (SELECT *, exp(x - max(x) OVER (PARTITION BY pid)) AS e FROM l{k})"""

    steps = ""
    for k in range(quality.ROUNDS):
        steps += posteriors(k)
        steps += f"""
), c{k + 1} AS MATERIALIZED (SELECT cls, (sum(r.p * n) + any_value(c0.p)) / (sum(n) + 1) AS p FROM r{k} r JOIN c0 USING (cls) GROUP BY cls
), b{k + 1} AS MATERIALIZED (SELECT cls, rule, (coalesce(sum(w) FILTER (v = -1), 0) + any_value(b0.b)) / (coalesce(sum(w), 0) + 1) AS b
    FROM b0 LEFT JOIN (SELECT cls, rule, v, p * n AS w FROM r{k} JOIN ballots USING (pid)) USING (cls, rule) GROUP BY cls, rule"""
    steps += posteriors(quality.ROUNDS)
    signs = quality.SIGNS.replace("'", "''")
    return rf"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM texts)
), twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows
), covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r
), counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols,
    len(list_filter(w, lambda x: translate(x, '{signs}', '') <> '')) AS n_letter_words, length(t) - length(translate(t, '{signs}', '')) AS n_signs,
    length(t) - length(translate(t, '{UPPER}', '')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_shouts, length(t) - length(translate(t, '0123456789', '')) AS n_digits, len(list_distinct(w)) AS n_distinct, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (r)
), voted AS MATERIALIZED (SELECT *, {votes} FROM counts
), patterns AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM (SELECT {columns}, count(*) AS n FROM voted GROUP BY {columns})
), ballots AS MATERIALIZED (SELECT pid, rule, v FROM (UNPIVOT patterns ON {columns} INTO NAME rule VALUE v) WHERE v <> 0
), c0 AS MATERIALIZED (SELECT * FROM (VALUES {shares}) x(cls, p)
), b0 AS MATERIALIZED (SELECT * FROM (VALUES {rates}) x(cls, rule, b){steps}
), judged AS (
  SELECT voted.*, r.p, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM voted JOIN patterns USING ({columns}) JOIN r{quality.ROUNDS} r USING (pid) WHERE cls = 0
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept FROM judged
"""


def _counted(column: str) -> str:
    """A leaf's text of a column: its bytes, a colon and itself, or a hyphen."""
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


_LEAF = " || ".join(_counted(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_CRC = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS BIGINT))"""
#: The digits of the tree of subroots follow on those of a language's tree.
OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf, sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) AS changed,
    n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 7 = 0 AS tampered FROM documents
), ranked AS (
  SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), lower AS (
  SELECT tree, 0 AS lvl, i, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM lower WHERE n > 1 GROUP BY tree, lvl, i // 2, n
), subroots AS (SELECT tree, lvl AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, i, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY lvl, i // 2, n
), steps AS (
  SELECT r.doc_id, r.leaf, r.changed, r.tampered, r.tree, r.i, s.digest AS subroot, k.lvl,
    CASE WHEN k.lvl < s.height THEN r.i >> k.lvl ELSE s.i >> (k.lvl - s.height) END AS at, CASE WHEN k.lvl < s.height THEN k.lvl END AS low, k.lvl - s.height AS high
  FROM ranked r JOIN subroots s ON r.tree = s.tree JOIN (SELECT unnest(range(200)) AS lvl) k ON k.lvl < s.height + (SELECT max(lvl) FROM upper)
), beside AS (
  SELECT p.*, coalesce(l.digest, u.digest, '') AS sibling FROM steps p
  LEFT JOIN lower l ON l.tree = p.tree AND l.lvl = p.low AND l.i = xor(p.at, 1)
  LEFT JOIN upper u ON p.low IS NULL AND u.lvl = p.high AND u.i = xor(p.at, 1)
), paths AS (SELECT tree, i, string_agg(sibling, '' ORDER BY lvl) AS proof FROM beside GROUP BY tree, i
), folds AS (
  SELECT tree, i, 0 AS lvl, CASE WHEN tampered THEN changed ELSE leaf END AS digest FROM ranked
  UNION ALL
  SELECT f.tree, f.i, f.lvl + 1, sha256(CASE WHEN b.at % 2 = 1 THEN b.sibling || f.digest ELSE f.digest || b.sibling END)
  FROM folds f JOIN beside b ON b.tree = f.tree AND b.i = f.i AND b.lvl = f.lvl
), ends AS (SELECT tree, i, arg_max(digest, lvl) AS digest FROM folds GROUP BY tree, i
), root AS (SELECT digest FROM upper WHERE n = 1)
SELECT r.doc_id, r.leaf, s.digest AS subroot, root.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.digest AS folded_root, e.digest = root.digest AS verified
FROM ranked r JOIN subroots s ON r.tree = s.tree JOIN ends e ON e.tree = r.tree AND e.i = r.i LEFT JOIN paths p ON p.tree = r.tree AND p.i = r.i, root
"""
