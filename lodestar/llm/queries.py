"""The registered queries of the training-data operators, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, licenses, mixing, pii, quality, sharding, toxicity, urls
from .common import table

QUERIES = {
    "op1_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op2_jaccard_join": lambda spark, d: jaccard.join(table(spark, d, "documents")),
    "op3_quality_rules": lambda spark, d: quality.judge(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_decontamination": lambda spark, d: decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_url_filters": lambda spark, d: urls.judge(table(spark, d, "pages")),
    "op6_sharding": lambda spark, d: sharding.shard(table(spark, d, "documents")),
    "op7_pii": lambda spark, d: pii.scan(table(spark, d, "documents")),
    "op8_licenses": lambda spark, d: licenses.scan(table(spark, d, "documents")),
    "op9_chat": lambda spark, d: chat.format_chat(table(spark, d, "conversations")),
    "op10_toxicity": lambda spark, d: toxicity.score(table(spark, d, "documents"), table(spark, d, "labels")),
}


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


_MIXING = f"""
WITH RECURSIVE t AS (SELECT doc_id, source, md5(coalesce(text, '')) AS tid, greatest(len({_words('text')}), 1)::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS n FROM t GROUP BY source),
a AS (SELECT sum(n)::DOUBLE AS n FROM s),
p AS (SELECT source, s.n, s.n / a.n AS p FROM s, a),
r AS (SELECT max(p) / min(p) AS r FROM p),
b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN pow(r, 1 - (lo + hi) / 2) <= 2.0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(r, 1 - (lo + hi) / 2) <= 2.0 THEN (lo + hi) / 2 ELSE hi END FROM b, r WHERE i < {mixing.STEPS}),
e AS (SELECT hi AS e FROM b WHERE i = {mixing.STEPS}),
w AS (SELECT source, n, pow(p, e) / (SELECT sum(pow(p, e)) FROM p, e) AS w FROM p, e),
q AS (SELECT source, n, greatest(round(w * 65536), 1)::BIGINT AS quota, round(w * (SELECT max(n / w) FROM w))::BIGINT AS total FROM w),
c AS (SELECT t.doc_id, t.source, t.tid, t.tokens, q.n, q.quota, q.total, unnest(range(0, greatest(1, ceil(total / n)::BIGINT))) AS epoch FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, md5(concat_ws(':', '0', epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''), tid)) AS key FROM c),
o AS (SELECT *, epoch * n + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM k),
x AS (SELECT *, CAST(floor((pos - pos % quota) / quota) AS BIGINT) AS block FROM o WHERE pos < total)
SELECT doc_id, source, tokens, epoch::BIGINT AS epoch, block::BIGINT AS block, (row_number() OVER (PARTITION BY block ORDER BY key, source, doc_id, epoch, tokens) - 1)::BIGINT AS slot FROM x
"""

def _quality_sql() -> str:
    step = " ".join(f"WHEN {quality.RULES[r][0]} > {c}::DOUBLE * {quality.RULES[r][1]} THEN {j}" for j, (r, c) in enumerate(quality.PATH, 1))
    rule = ", ".join(f"'{r}'" for r, _ in quality.PATH)
    return rf"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, {_words('text')} AS w FROM documents),
g AS (SELECT doc_id, i, hash(list_slice(w, i, i + 4)) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
v AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
rp AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM v GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (SELECT doc_id, stratum, md5(text) AS tid, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_bang,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN rp USING (doc_id)),
s AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, CASE {step} END AS step FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
h AS (SELECT stratum, tid, min(step) AS step FROM s JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
c AS (SELECT stratum, count(*) AS n FROM h GROUP BY stratum),
k AS (SELECT c.stratum, n, j, (SELECT count(*) FROM h WHERE h.stratum IS NOT DISTINCT FROM c.stratum AND step <= j) AS k FROM c, range(1, {len(quality.PATH) + 1}) r(j)),
t AS (SELECT *, k < n * 0.05 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) <= 0.05 / (SELECT count(*) FROM c) AS good FROM k),
z AS (SELECT stratum, coalesce(min(CASE WHEN NOT good THEN j END), {len(quality.PATH) + 1}) - 1 AS certified FROM t GROUP BY stratum),
r AS (SELECT s.*, CASE WHEN step <= certified THEN ([{rule}])[step] ELSE '' END AS failed FROM s LEFT JOIN z ON s.stratum IS NOT DISTINCT FROM z.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM r
"""


def _urls_sql() -> str:
    scopes, block, allow = [], [], []
    for r in urls.SCOPES:
        host, _, path = r.scope.partition("/")
        scopes.append((r.scope, r.action, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"))
    scopes.sort(key=lambda x: -len(x[0]))
    for r in urls.PATTERNS:
        (allow if r.action == "allow" else block).append("regexp_matches(host || path, '" + r.pattern.replace(r"\Z", r"\z") + "')")
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for s, _, c in scopes) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for _, a, c in scopes) + f" WHEN {' OR '.join(allow)} THEN 'allow' WHEN {' OR '.join(block)} THEN 'block' ELSE 'allow' END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(x, ''), '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(coalesce(x, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM h)
SELECT * FROM v"""


def _canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    for pattern, to in licenses.STEPS:
        pattern = pattern.replace("\\n", "\n").replace("'", "''")
        to = to.replace("$1", "\\1").replace("\\n", "\n")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out}, ' \n')"


def _licenses_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    whole = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in licenses.TEXTS.items())
    lines = ", ".join(f"({quote(k)}, {quote(x)})" for k, v in licenses.NOTICES.items() for x in v)
    fixed = "".join(f" UNION ALL SELECT {quote(v)}, {quote(k)}" for k, v in licenses.DIGESTS.items())
    digest = f"array_to_string(list_filter(string_split(c, chr(10)), lambda x: x NOT IN ({', '.join(map(quote, licenses.TITLES))})), ' ')"
    return f"""
WITH k AS (SELECT license, {_canonical('text')} AS c FROM (VALUES {whole}) v(license, text)),
t AS (SELECT digest, min(license) AS license FROM (SELECT license, md5({digest}) AS digest FROM k {fixed}) GROUP BY digest),
n AS (SELECT license, md5({_canonical('text')}) AS digest FROM (VALUES {lines}) v(license, text)),
c AS (SELECT doc_id, {_canonical('text')} AS c FROM documents),
d AS (SELECT doc_id, CASE WHEN {digest} <> '' THEN md5({digest}) END AS digest, c FROM c),
l AS (SELECT doc_id, md5(unnest(string_split(c, chr(10)))) AS line FROM d),
m AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN n ON line = n.digest GROUP BY doc_id)
SELECT doc_id, d.digest, license, coalesce(notices, '') AS notices FROM d LEFT JOIN t ON d.digest = t.digest LEFT JOIN m USING (doc_id)"""


_CHAT = """
SELECT conv_id, turn, 0::INT AS rank, 0::INT AS part, 'message' AS kind, NULL::VARCHAR AS call_id, 'none' AS status, TRUE AS valid,
  json_object('content', coalesce(text, ''), 'role', coalesce(role, ''))::VARCHAR AS json FROM conversations
WHERE NOT (coalesce(starts_with(text, '{') AND role IN ('assistant', 'tool'), FALSE))"""

ORACLE = {
    "op1_mixing": _MIXING,
    "op3_quality_rules": _quality_sql(),
    "op5_url_filters": _urls_sql(),
    "op8_licenses": _licenses_sql(),
    "op9_chat": _CHAT,
}
