"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

import re

from webloom.llm import chat_tree
from webloom.llm.mixing import LEVELS, MixConfig
from webloom.llm.quality import QualityConfig
from webloom.llm.vector_codes import CodeConfig


def op1(config: QualityConfig = QualityConfig()) -> str:
    duck = {r.name: r.measure.replace("DIV", "//") for r in config.rules}
    measures = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rule, ({m})::BIGINT AS v FROM st WHERE NOT base_failed" for n, m in duck.items())
    spreads = " ".join(f"WHEN '{r.name}' THEN {r.spread}" for r in config.rules)
    slacks = " ".join(f"WHEN '{r.name}' THEN {r.slack}" for r in config.rules)
    limits = ", ".join(f"max(lim) FILTER (rule = '{r.name}') AS max_{r.name}" for r in config.rules)
    over = " OR ".join(f"coalesce(CASE WHEN word_chars > 0 THEN {duck[r.name]} END > max_{r.name}, false)" for r in config.rules)
    out = ", ".join(f"max_{r.name}" for r in config.rules)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), t AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM t) WHERE n > 1
), c AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid
), l AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid
), s0 AS (
  SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
         len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts
  FROM d LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)
), st AS (
  SELECT *, (n_words < {config.min_words} OR 100 * n_repeat_words > {config.repeat_percent} * n_words) AS base_failed FROM s0
), v AS ({measures}
), b AS (
  SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)::INT) << (length(bin(v)) - 6)::INT END AS bucket, count(*) AS n
  FROM v GROUP BY ALL
), m AS (
  SELECT 's' AS level, lang, source, rule, bucket, sum(n) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 'l', lang, NULL, rule, bucket, sum(n) FROM b GROUP BY ALL
  UNION ALL SELECT 'c', NULL, NULL, rule, bucket, sum(n) FROM b GROUP BY ALL
), cu AS (
  SELECT level, lang, source, rule, bucket, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS seen,
         sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM m
), q AS (
  SELECT level, lang, source, rule, total, min(bucket) FILTER (seen >= (total * 50 + 99) // 100) AS q50,
         min(bucket) FILTER (seen >= (total * 75 + 99) // 100) AS q75 FROM cu GROUP BY ALL
), li AS (
  SELECT level, lang, source, rule, total, (q50 + (CASE rule {spreads} END) * greatest(q75 - q50, CASE rule {slacks} END))::BIGINT AS lim FROM q
), g AS (SELECT level, lang, source, max(total) AS total, {limits} FROM li GROUP BY ALL
), pick AS (
  SELECT s.lang, s.source, CASE WHEN s.total >= {config.min_group} THEN 's' WHEN l.total >= {config.min_group} THEN 'l' ELSE 'c' END AS level
  FROM g s JOIN g l ON l.level = 'l' AND l.lang IS NOT DISTINCT FROM s.lang WHERE s.level = 's'
), lim AS (
  SELECT p.lang, p.source, g.* EXCLUDE (level, lang, source, total) FROM pick p JOIN g ON g.level = p.level
   AND (p.level = 'c' OR g.lang IS NOT DISTINCT FROM p.lang) AND (p.level <> 's' OR g.source IS NOT DISTINCT FROM p.source)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({over})) AS kept, {out}
FROM st LEFT JOIN lim ON st.lang IS NOT DISTINCT FROM lim.lang AND st.source IS NOT DISTINCT FROM lim.source
"""


def _level_sql(name: str, source: str, parents: list[str], level: str, config: MixConfig) -> str:
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = f"{part} ORDER BY capacity / weight, {level} NULLS FIRST"
    return f"""
{name}1 AS (
  SELECT *, given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {source}
), {name}2 AS (SELECT *, capacity * rest <= remaining * weight AS filled FROM {name}1
), {name}3 AS (
  SELECT *, max(rest) FILTER (NOT filled) OVER ({part}) AS r, arg_max(remaining, rest) FILTER (NOT filled) OVER ({part}) AS l FROM {name}2
), {name} AS (SELECT * EXCLUDE (given), CASE WHEN filled THEN capacity ELSE least(capacity, (l * weight) // r) END AS given FROM {name}3)"""


def op4(config: MixConfig = MixConfig()) -> str:
    def weight(level: str) -> str:
        named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(config.weights.get(level, {}).items()))
        return f"(CASE {level} {named} ELSE {config.default_weight} END)" if named else str(config.default_weight)

    ctes = [
        f"""t AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '[0-9]{{1,9}}$') THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % {config.domains}) END AS domain,
         lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents
), total AS (SELECT coalesce(sum(n_tokens), 0)::BIGINT * {config.budget_permille} // 1000 AS b FROM t)"""
    ]
    for depth, level in enumerate(LEVELS):
        keys, parents = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        given = "(SELECT b FROM total)" if not parents else "p.given"
        join = "" if not parents else f"JOIN n{depth - 1} p ON " + " AND ".join(f"g.{k} IS NOT DISTINCT FROM p.{k}" for k in parents)
        ctes.append(
            f"""s{depth} AS (
  SELECT g.*, {given}::HUGEINT AS given FROM (
    SELECT {', '.join(keys)}, sum(n_tokens)::BIGINT AS n_tokens, sum(n_tokens)::BIGINT * {config.max_epochs} AS capacity, {weight(level)}::BIGINT AS weight
    FROM t GROUP BY {', '.join(keys)}) g {join}
), {_level_sql(f'n{depth}', f's{depth}', parents, level, config)}"""
        )
    leaf = " AND ".join(f"t.{k} IS NOT DISTINCT FROM f.{k}" for k in LEVELS)
    return f"""WITH {', '.join(ctes)},
f AS (SELECT domain, lang, source, given::BIGINT AS budget, CASE WHEN n_tokens > 0 THEN given // n_tokens ELSE 0 END::BIGINT AS whole,
             (given - CASE WHEN n_tokens > 0 THEN (given // n_tokens) * n_tokens ELSE 0 END)::BIGINT AS over FROM n2),
h AS (SELECT t.*, budget, whole, over, md5('{config.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM t JOIN f ON {leaf}),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS seen FROM h),
k AS (SELECT *, whole + CASE WHEN seen <= over AND whole < {config.max_epochs} THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, copies))::INT AS epoch, budget FROM k WHERE copies > 0
"""


OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
"""

_ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


#: Links of all pairs of documents with a common shingle, and the smallest doc_id that links lead to.
OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(g)) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS at, doc_id AS low FROM n UNION SELECT m.b, r.low FROM r JOIN m ON m.a = r.at)
SELECT n.doc_id, n.n AS n_shingles, min(r.low) AS component_id FROM n JOIN r ON r.at = n.doc_id GROUP BY ALL"""


def op11(config: CodeConfig = CodeConfig()) -> str:
    k, parts = config.entries, config.parts

    def assigned(round_: int) -> str:
        return f"""a{round_} AS MATERIALIZED (
  SELECT rn, y.p, any_value(y) AS y, min((list_inner_product(y, y) - 2 * list_inner_product(y, c) + list_inner_product(c, c))::BIGINT * {k} + e) AS m
  FROM pt y JOIN b{round_} b ON b.p = y.p GROUP BY rn, y.p)"""

    def better(round_: int) -> str:
        return f"""b{round_ + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{round_} b LEFT JOIN (
    SELECT p, e, list(f ORDER BY i) AS c FROM (
      SELECT p, m % {k} AS e, i, floor(sum(v) / count(*)) AS f FROM (SELECT p, m, unnest(y) AS v, unnest(range(len(y))) AS i FROM a{round_}) GROUP BY ALL)
    GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""

    steps = [s for r in range(config.rounds) for s in (assigned(r), better(r))]
    return f"""
WITH x AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS rn FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
), pt AS MATERIALIZED (
  SELECT rn, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS y FROM (SELECT rn, x, unnest(range({parts})) AS p FROM x)
), b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, y AS c FROM pt WHERE rn <= {k}), {', '.join(steps)}, {assigned(config.rounds)},
s AS (SELECT sha256(string_agg(v::BIGINT, ',' ORDER BY p, e, i)) AS sha FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM b{config.rounds})),
r AS (SELECT rn, string_agg(printf('%02x', m % {k}), '' ORDER BY p) AS code, sum(m // {k})::BIGINT AS error FROM a{config.rounds} GROUP BY rn)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM x JOIN r USING (rn), s
"""


def op13() -> str:
    escaped = "text"
    for first in ("<", "["):
        rests = "|".join(re.escape(m[1:]) for m in chat_tree.MARKS if m[0] == first)
        escaped = rf"regexp_replace({escaped}, '({re.escape(first)})(\\*(?:{rests}))', '\1\\\2', 'g')"
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat_tree.ROLES.items())
    other = f"{sum(map(len, chat_tree.OTHER))} + length({escaped.replace('text', 'role', 1)})"
    odd = ", ".join(f"({chat_tree.ODD_ID}, {k}, '{role}', '{chat_tree.ODD_TEXT}')" for k, role in enumerate(("user", "assistant")))
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {odd})
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(chat_tree.BEGIN)} + sum(length({escaped}) + CASE role {marks} ELSE {other} END))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def all_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op4_mixing": op4(), "op7_jaccard_join": OP7, "op8_warc": OP8, "op9_decontamination": OP9, "op11_vector_codes": op11(), "op13_chat_tree": op13()}
