"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from vellumine.llm.pii import SECRET_NAMES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM b, unnest(range(1, len(w) - k + 2)) AS t(i)),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM b) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
h AS (SELECT r, item_id, i, k FROM dw JOIN bw USING (k, s)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) AS t(p) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def chat(lookalike: str) -> str:
    esc = lambda c: rf"regexp_replace({c}, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '{lookalike}'), (1, 'assistant', '{lookalike}'))),
p AS (SELECT *, length('<s>[INST] ' || {esc("role")} || ' [/INST]' || {esc("text")} || '</s>') AS n FROM t),
c AS (SELECT *, sum(n) OVER w AS upto, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) IS NULL AS last
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role ROWS UNBOUNDED PRECEDING))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def _digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def pii() -> str:
    """Base spans and the seeds of secrets; the tables' other contexts are random, so that the method trusts no pattern there that adds more."""
    kinds = [
        ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
        ("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: x::DOUBLE > 255)) = 0"),
        ("card", 2, r"[0-9](?:[ -]?[0-9])+", f"""length({_digits("m")}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({_digits("m")}), ''),
            lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN 2 * x::INT > 9 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0"""),
        ("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]", f"length({_digits('m')}) BETWEEN 9 AND 15"),
    ]
    each = " UNION ALL ".join(
        f"""SELECT r, '{name}' AS name, {k} AS kind, a, a + length(m) AS z FROM (
        SELECT r, ms[i] AS m, (list_sum(list_transform(ps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS a
        FROM (SELECT r, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM d), unnest(range(1, len(ms) + 1)) AS t(i)) WHERE {ok}"""
        for name, k, p, ok in kinds
    )
    value = """CASE WHEN regexp_full_match(m, 'AKIA[0-9A-Z]{16}') THEN m ELSE regexp_extract(m, '[:=] ?["'']?([A-Za-z0-9_+/-]{8,})$', 1) END"""
    named = f"(?i:{'|'.join(SECRET_NAMES)})[\"'']?[ ]?[:=][ ]?[\"'']?[A-Za-z0-9_+/-]{{8,}}|[A-Za-z0-9]*AKIA[A-Za-z0-9]*"
    each += f""" UNION ALL SELECT r, 'secret' AS name, 4 AS kind, a + length(m) - length(v) AS a, a + length(m) AS z FROM (SELECT *, {value} AS v FROM (
        SELECT r, ms[i] AS m, (list_sum(list_transform(ps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS a
        FROM (SELECT r, regexp_extract_all(text, '{named}') AS ms, string_split_regex(text, '{named}') AS ps FROM d), unnest(range(1, len(ms) + 1)) AS t(i))) WHERE v <> ''"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({each}),
g AS (SELECT r, string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (kind < 4) AS based, string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) AS told, count(*) FILTER (kind = 0) AS e, count(*) FILTER (kind = 1) AS i, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS p FROM s GROUP BY r)
SELECT doc_id, coalesce(e, 0)::BIGINT AS n_email, coalesce(i, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(p, 0)::BIGINT AS n_phone,
  sha256(coalesce(based, '')) AS base_sha256, coalesce(told, '') AS spans, (coalesce(told, '') <> '')::INTEGER AS has_private FROM d LEFT JOIN g USING (r)
"""


#: The tables' pages mark their main text up; the query doesn't know that.
PAGES = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages)
"""


def urls(rules: list[tuple[str, str, str]]) -> str:
    """Pages link to their own hosts only, where a host's scores are its own seeds."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    pick = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(v, h, p)}'" for v, h, p in best) + " END"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (SELECT *, {pick(lambda v, h, p: h + p)} AS rule, {pick(lambda v, h, p: v)} AS said FROM h),
s AS (SELECT host, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
n AS (SELECT nullif(sum(a), 0) AS a, nullif(sum(b), 0) AS b FROM s)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN s.b > 0 AND s.b / n.b >= 0.5 * (coalesce(s.a / n.a, 0) + s.b / n.b) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN s USING (host), n
"""


COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
e AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT piece, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM e),
g AS (SELECT lang, w, w || ' ' || lead(w) OVER o AS ww, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS www FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS (SELECT lang, 1 AS k, w AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, 2 AS k, ww AS phrase, count(*) AS f FROM g WHERE ww IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, 3 AS k, www AS phrase, count(*) AS f FROM g WHERE www IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3] AS phrase, a FROM c WHERE k = 3) GROUP BY lang, phrase),
h AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
x AS (SELECT lang, phrase, a, 1 AS cut, ws[1] AS l, array_to_string(ws[2 :], ' ') AS r FROM h UNION ALL SELECT lang, phrase, a, 2 AS cut, ws[1] || ' ' || ws[2] AS l, ws[3] AS r FROM h WHERE k = 3),
s AS (SELECT x.lang, x.phrase, a, cut, lf.f AS l, rf.f AS r, (1000000 * a::HUGEINT * a::HUGEINT) // (lf.f::HUGEINT * rf.f::HUGEINT) AS score
  FROM x JOIN f AS lf ON lf.lang = x.lang AND lf.phrase = x.l JOIN f AS rf ON rf.lang = x.lang AND rf.phrase = x.r),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def merkle(levels: int = 7, upper: int = 4, arity: int = 16) -> str:
    """Levels are unrolled; one above the root leaves it as it is."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    crc = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda s, b:
        list_reduce(list_transform(range(8), lambda k: k::BIGINT), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(s, b)), 4294967295::BIGINT), 4294967295)"""
    lower = _LOWER.format("text")
    out = [f"d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {hashed('text')} AS leaf, {hashed(f'CASE WHEN ({crc}) % 5 = 0 THEN {lower} ELSE text END')} AS shown FROM documents)"]
    out.append("s0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM d)")

    def tree(name: str, depth: int) -> None:
        for k in range(depth):  # runs: the digests of a run, in order
            out.append(f"{name}r{k} AS (SELECT tree, pos // {arity} AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, (n + {arity - 1}) // {arity} AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")

    tree("s", levels)
    out.append(f"u0 AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM s{levels})")
    tree("u", upper)
    def climb(name: str, depth: int, first: int, same: str) -> None:
        for k in range(depth):
            mine, left, right = f"p{first + k}", f"array_to_string(hs[1 : p % {arity}], '')", f"array_to_string(hs[p % {arity} + 2 :], '')"
            out.append(f"""p{first + k + 1} AS (SELECT doc_id, {mine}.tree, leaf, subroot, p // {arity} AS p, CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f,
              proof || CASE WHEN n = 1 THEN '' ELSE {left} || {right} END AS proof FROM {mine} JOIN {name}r{k} ON {same.format(f"{name}r{k}.tree", mine)} AND run = p // {arity})""")

    out.append(f"p0 AS (SELECT doc_id, s0.tree, leaf, s{levels}.h AS subroot, s0.pos AS p, shown AS f, '' AS proof FROM s0 JOIN s{levels} ON s0.tree = s{levels}.tree)")
    climb("s", levels, 0, "{0} = {1}.tree")
    out.append(f"p{levels + 1} AS (SELECT p{levels}.* REPLACE (u0.pos AS p) FROM p{levels} JOIN u0 ON u0.source = p{levels}.tree)")
    climb("u", upper, levels + 1, "{0} = ''")
    last = f"p{levels + upper + 1}"
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, u{upper}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u{upper}.h AS verified FROM {last}, u{upper}"
