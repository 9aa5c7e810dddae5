"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import chat, decontaminate, licenses, merkle, mixing, packing, quality_model, quality_rules, simhash, structure, toxicity, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The installed vocabulary file that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


@query(
    "op7_benchmark_decontamination",
    r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
items AS (SELECT id, ws, least(13, len(ws)) AS n FROM w WHERE kind = 'b' AND len(ws) > 0),
iw AS (SELECT DISTINCT id AS item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS win
       FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM items)),
docs AS (SELECT id AS doc_id, ws FROM w WHERE kind = 'd'),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: SQL of the statistics and of the levels: they are tested with the exact binomial tail, as the sum of its terms.
_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS q FROM twice) GROUP BY 1),
st AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT doc_id, stratum, unnest([{'rule': 'symbols', 'v': n_symbols / nullif(word_chars, 0)}, {'rule': 'dup_lines', 'v': n_dup_lines / nullif(n_lines, 0)}, {'rule': 'repeats', 'v': n_repeat_words / nullif(n_words, 0)},
 {'rule': 'capitals', 'v': n_capitals / nullif(word_chars, 0)}, {'rule': 'word_length', 'v': word_chars / nullif(n_words, 0)}]) AS r FROM st),
cut AS (SELECT rule, unnest(range(N_LEVELS)) AS level, unnest(cs) AS cutoff FROM (VALUES LADDER) l(rule, cs)),
lv AS (SELECT doc_id, stratum, coalesce(min(level), N_LEVELS) AS level FROM v LEFT JOIN cut ON cut.rule = r.rule AND coalesce(r.v, 0) > cutoff GROUP BY 1, 2),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING max(quality) = 1),
kn AS (SELECT stratum, l AS level, count(*) AS n, count(*) FILTER (lv.level <= l) AS k FROM lv SEMI JOIN good USING (doc_id), range(N_LEVELS) r(l) GROUP BY 1, 2),
tail AS (SELECT *, k <= n * SHARE AND coalesce(list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(SHARE) + (n - i) * ln(1 - SHARE)))), 0) <= DELTA / greatest((SELECT count(DISTINCT stratum) FROM kn), 1) AS ok FROM kn),
frc AS (SELECT stratum, max(level) AS in_force FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY level) AS held FROM tail) WHERE held GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lv.level > coalesce(in_force, -1) AS kept FROM st JOIN lv USING (doc_id) LEFT JOIN frc ON frc.stratum = st.stratum
""".replace("LADDER", ", ".join(f"('{r}', {list(cs)})" for r, cs in quality_rules.LEVELS.items())).replace("N_LEVELS", str(quality_rules.N_LEVELS)).replace("SHARE", f"CAST({quality_rules.ALPHA!r} AS DOUBLE)").replace("DELTA", repr(quality_rules.DELTA))

_WORD_LISTS = ", ".join(f"({k}, '{label}', {sorted(set(text.split(' ')))}, {len(text.split(' '))})" for k, (label, text) in enumerate(licenses.TEMPLATES))
_PLACES = ", ".join("list_filter(range(1, len(ws) + 1), lambda i: " + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split(" "))) + ")" for phrase, _ in licenses.PHRASES)

_OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
p AS (SELECT rid, doc_id, ws, [{_PLACES}] AS ps FROM w),
b AS (SELECT *, flatten(ps) AS places, list_sort(list_filter([{', '.join(f"CASE WHEN len(ps[{k}]) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES, 1))}], lambda x: x IS NOT NULL)) AS base FROM p),
tpl AS (SELECT * FROM (VALUES {_WORD_LISTS}) v(k, label, tw, n)),
ln AS (SELECT DISTINCT rid, list_distinct(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS lw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)),
run AS (SELECT rid, label, tw, unnest(list_transform(list_filter(range(1, len(ws) + 1), lambda i: list_contains(tw, ws[i])), lambda i: list_distinct(ws[i:i + n - 1]))) AS lw
 FROM w, tpl WHERE 100 * len(list_intersect(list_distinct(ws), tw)) >= {round(100 * licenses.THRESHOLD)} * len(tw)),
blk AS (SELECT rid, label, tw, lw FROM ln, tpl UNION ALL SELECT rid, label, tw, lw FROM run),
hit AS (SELECT rid, label, len(list_intersect(lw, tw)) / len(tw) AS share FROM blk WHERE 100 * len(list_intersect(lw, tw)) >= {round(100 * licenses.THRESHOLD)} * len(tw)),
f AS (SELECT rid, list(DISTINCT label) AS found, max(share) AS share FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ','), '') AS labels, CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score FROM b LEFT JOIN f USING (rid)
"""

_OP8 = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z]{{1,3}}|[0-9]|[!-/:-@\[-`{{-~]')) + strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]+', '', 'g')) + {chat.OVERHEAD} AS tokens, row_number() OVER o AS nth,
 length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + {len(chat.TEXT) + len(chat.END)} AS chars FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
x AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth) - tokens AS BIGINT) AS before, nth = 1 AND role = 'system' AND tokens <= {chat.BUDGET // 4} AS sys FROM t),
h AS (SELECT conv_id, tokens, chars FROM x WHERE sys),
own AS (SELECT x.conv_id, x.before, x.tokens, x.chars, x.before // {chat.CHUNK * chat.BUDGET} AS chunk, {chat.BUDGET - chat.HISTORY} - coalesce(h.tokens, 0) AS room FROM x LEFT JOIN h ON x.conv_id IS NOT DISTINCT FROM h.conv_id WHERE NOT x.sys),
w AS (SELECT conv_id, chunk, min(before) AS start FROM own GROUP BY 1, 2
 UNION ALL SELECT conv_id, chunk, (SELECT min(o.before) FROM own o WHERE o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.chunk = w.chunk AND o.before > w.start AND o.before + o.tokens - w.start > o.room) AS start FROM w WHERE start IS NOT NULL),
win AS (SELECT w.conv_id, w.start FROM w JOIN own ON own.conv_id IS NOT DISTINCT FROM w.conv_id AND own.before = w.start AND own.tokens <= own.room),
again AS (SELECT win.conv_id, sum(own.chars + {len(chat.AGAIN)}) AS n FROM win JOIN own ON own.conv_id IS NOT DISTINCT FROM win.conv_id AND own.before < win.start AND own.before >= win.start - {chat.HISTORY} GROUP BY 1),
head AS (SELECT h.conv_id, max(chars) * greatest(1, count(w.start)) + {len(chat.TURN)} + {len(chat.AGAIN)} * (greatest(1, count(w.start)) - 1) AS n FROM h LEFT JOIN w ON h.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS said, coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '') AS loss, coalesce(sum(chars + {len(chat.TURN)}) FILTER (NOT sys), 0) AS n FROM x GROUP BY 1)
SELECT g.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(g.n + coalesce(again.n, 0) + coalesce(head.n, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN again ON g.conv_id IS NOT DISTINCT FROM again.conv_id LEFT JOIN head ON g.conv_id IS NOT DISTINCT FROM head.conv_id
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM o
"""


def _op10_sql(rules) -> str:
    """Links of pages are found tag by tag; aliases are what a recursive walk over them reaches."""

    def parts(url: str) -> str:
        rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        return f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) AS after"

    def first(value: str) -> str:
        ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
        return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in ordered) + " END"

    return f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, {parts('url')} FROM pages),
q AS (SELECT *, regexp_extract(after, '^[^?]*') AS path, CASE WHEN host <> '' THEN host || after END AS node FROM u),
tags AS (SELECT node, host, path, regexp_extract(url, '^[^:/?#]*') AS scheme, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM q WHERE node IS NOT NULL AND html IS NOT NULL),
l AS (SELECT node, host, path, scheme, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*[\"'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)
 WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b') THEN regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*[\"''][^\"''>]*?url\\s*=\\s*([^\"''\\s>;]+)', 1) ELSE '' END, '&amp;', '&') AS link FROM tags),
target AS (SELECT node AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || host || link
 WHEN NOT regexp_matches(link, '^[?#]|^[A-Za-z][A-Za-z0-9+.-]*:') THEN '://' || host || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || link END AS url FROM l WHERE link <> ''),
ends AS (SELECT a, CASE WHEN host <> '' THEN host || after END AS b FROM (SELECT a, {parts('url')} FROM target WHERE url IS NOT NULL)),
e AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT x, b FROM reach JOIN e ON y = a),
nodes AS (SELECT y AS node, regexp_extract(y, '^[^/?#]*') AS host, regexp_extract(y, '^[^/?#]*([^?]*)', 1) AS path FROM (SELECT DISTINCT y FROM reach)),
judged AS (SELECT node, {first('verdict')} AS verdict FROM nodes),
blocked AS (SELECT x AS node FROM reach JOIN judged ON y = judged.node GROUP BY 1 HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false))
SELECT page_id, host, path, {first('name')} AS rule, coalesce({first('verdict')}, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict FROM q
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))), lambda c, b: {bits}), 4294967295::BIGINT)"


def _op11_sql() -> str:
    def hashed(n_chars: str) -> str:
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    def levels(start: str) -> str:
        return f"{start} UNION ALL SELECT t, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM SELF WHERE n > 1 GROUP BY t, lvl, i // 2"

    def fold(start: str, nodes: str) -> str:
        return f"""{start} UNION ALL SELECT rid, f.t, f.lvl + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END), proof || coalesce(s.h, '')
 FROM SELF f LEFT JOIN {nodes} s ON s.t IS NOT DISTINCT FROM f.t AND s.lvl = f.lvl AND s.i = xor(f.i, 1) WHERE f.n > 1"""

    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS t, {hashed('n_chars')} AS leaf, CASE WHEN n_chars IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {hashed('(n_chars + 1)')} END AS forged FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
nodes AS ({levels("SELECT t, 0 AS lvl, i, leaf AS h, n FROM p").replace("SELF", "nodes")}),
sub AS (SELECT t, h, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
high AS ({levels("SELECT 0 AS t, 0 AS lvl, i, h, n FROM sub").replace("SELF", "high")}),
low AS ({fold("SELECT rid, t, 0 AS lvl, i, n, coalesce(forged, leaf) AS h, '' AS proof FROM p", "nodes").replace("SELF", "low")}),
up AS ({fold("SELECT rid, 0 AS t, 0 AS lvl, sub.i, sub.n, low.h, proof FROM low JOIN sub ON sub.t IS NOT DISTINCT FROM low.t WHERE low.n = 1", "high").replace("SELF", "up")})
SELECT doc_id, leaf, sub.h AS subroot, high.h AS root, sha256(proof) AS proof_sha256, up.h AS folded_root, up.h = high.h AS verified
FROM p JOIN sub ON sub.t IS NOT DISTINCT FROM p.t JOIN up ON up.rid = p.rid AND up.n = 1 JOIN high ON high.n = 1
"""


def _op12_sql() -> str:
    n, share, cap = len(mixing.SCHEDULES), f"{mixing.SHARE!r}e0", mixing.CAP
    weights = "[" + ", ".join(f"{mixing.integral(x)!r}e0" for x in mixing.SCHEDULES) + "]"

    def progress(schedule) -> str:
        parts, out = mixing.segments(schedule), None
        need = f"(part * {parts[-1][-1]!r}e0)"
        for start, weight, slope, before, after in reversed(parts):
            left = f"greatest({need} - {before!r}e0, 0e0)"
            root = f"({weight!r}e0 + sqrt(greatest({weight * weight!r}e0 + {2 * slope!r}e0 * {left}, 0e0)))"
            here = f"CASE WHEN {root} > 0 THEN {start!r}e0 + 2e0 * {left} / {root} ELSE {start!r}e0 END"
            out = here if out is None else f"CASE WHEN {need} < {after!r}e0 THEN {here} ELSE {out} END"
        return out

    at = "CASE kind " + " ".join(f"WHEN {k} THEN {progress(x)}" for k, x in enumerate(mixing.SCHEDULES)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} AS kind FROM g),
w AS (SELECT *, {weights}[kind + 1] AS weight FROM s),
-- Filling up in the order of cap by weight: the level is the highest of those that each set of full sources would give.
l AS (SELECT max(level) AS level FROM (SELECT ({share} * (SELECT sum(source_size) FROM w) - coalesce(sum({cap} * source_size) OVER o, 0)) / sum(weight) OVER r AS level FROM w
 WINDOW o AS (ORDER BY source_size / weight, kind, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (ORDER BY source_size / weight, kind, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
t AS (SELECT w.*, least(level * weight, CAST({cap} * source_size AS DOUBLE)) AS target FROM w, l),
q AS (SELECT d.rid, d.doc_id, d.size, t.*, CAST(floor(target + 0.5e0) AS BIGINT) AS quota, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
 FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
c AS (SELECT rid, source, kind, quota, start, greatest(least(quota - start, size), 0) AS words FROM (SELECT *, b + k * source_size AS start FROM q, range({cap}) k(k))),
m AS (SELECT *, (CAST(start AS DOUBLE) + CAST(words AS DOUBLE) / 2e0) / CAST(quota AS DOUBLE) AS part FROM c WHERE words > 0),
z AS (SELECT rid, source, start, words, {at} AS progress FROM m),
o AS (SELECT rid, words, CAST(sum(words) OVER (ORDER BY progress, source NULLS LAST, start ROWS UNBOUNDED PRECEDING) - words AS BIGINT) AS position FROM z),
e AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, min(position) AS first_position FROM o GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_position FROM q LEFT JOIN e USING (rid)
"""


_OP13 = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT *, {_crc32('name')} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS nth, substr(role, 1, 1) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY nth) || i AS pair FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(nth) AS last FROM f GROUP BY 1),
-- Insertions from state a to state q; states: 0 nothing read, 1 system, 2 user, 3 assistant.
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:'), (1, 2, 2, 'I', 'user:'), (3, 2, 2, 'I', 'user:'), (2, 3, 2, 'I', 'assistant:'),
 (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (3, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (2, 2, 4, 'II', 'assistant:' || chr(10) || 'user:')) v(a, q, price, letters, lines)),
-- The cheapest way to each state after each turn and insertions, as cost and letters in one text, and what it says.
best AS (SELECT g.conv_id, CAST(0 AS BIGINT) AS nth, q, lpad(CAST(price AS VARCHAR), 9, '0') || letters AS way, CAST(nullif(lines, '') AS VARCHAR) AS said FROM g, ins WHERE a = 0
 UNION ALL SELECT conv_id, nth, q, min(way), arg_min(said, way) FROM (
  SELECT e.conv_id, e.nth, ins.q, lpad(CAST(e.cost + ins.price AS VARCHAR), 9, '0') || e.letters || ins.letters AS way, nullif(concat_ws(chr(10), e.said, nullif(ins.lines, '')), '') AS said
  FROM (SELECT b.conv_id, f.nth, CAST(left(way, 9) AS BIGINT) + o.price + CASE WHEN o.letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost, substr(way, 10) || o.letter AS letters, o.q,
    CASE WHEN o.letter = 'D' THEN said ELSE concat_ws(chr(10), said, CASE WHEN o.letter = 'K' THEN role WHEN o.q = 2 THEN 'user' ELSE 'assistant' END || ':' || text) END AS said
   FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.nth = b.nth + 1
   JOIN (VALUES (0, 'D', 0, 3, NULL), (1, 'D', 1, 3, NULL), (2, 'D', 2, 3, NULL), (3, 'D', 3, 3, NULL), (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (3, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a'),
    (0, 'R', 2, 2, NULL), (1, 'R', 2, 2, NULL), (3, 'R', 2, 2, NULL), (2, 'R', 3, 2, NULL)) o(a, letter, q, price, i) ON o.a = b.q AND (o.i IS NULL OR o.i = f.i) AND (o.letter = 'D' OR fault NOT IN ('blank', 'duplicate'))) e
  JOIN ins ON ins.a = e.q) GROUP BY conv_id, nth, q),
w AS (SELECT best.conv_id, min(way) AS way, arg_min(coalesce(said, ''), way) AS said FROM best JOIN g ON g.conv_id IS NOT DISTINCT FROM best.conv_id AND nth = last WHERE q IN (0, 3) GROUP BY 1),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(way, 9) AS BIGINT), 0) AS cost,
 coalesce(substr(way, 10), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query("op1_quality_rules", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_license_scans", _OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_chat_formatting", _OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    return chat.digests(chat.format_windows(turns.unionByName(extra)))


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of the contract.
URL_RULES = [url_filters.Rule("block", "com", "/en/"), url_filters.Rule("allow", "example.com", "/en/7"), url_filters.Rule("allow", "net", "/de/"), url_filters.Rule("block", "example.net", "/de/8"), url_filters.Rule("block", "org", "/es/")]


@query("op10_url_filters", _op10_sql(URL_RULES))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_warc_source", _OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_merkle_manifest", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), changed)
    manifest = merkle.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"doc_id": F.col("doc_id"), "forged": tampered})
    proved = merkle.prove(manifest, "forged")
    return proved.select("carry.doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_source_mixing", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op13_structure_repair", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    after = structure.damaged(turns)
    return structure.digests(after, structure.repair(after), turns)
