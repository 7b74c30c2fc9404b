"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from servicenight.llm import collocations, licenses, quality, spelling
from servicenight.llm.common import LOWER, PHRASE_WORD, UPPER
from servicenight.llm.secret_scan import RULES

WORD = r"[^\x20\x09-\x0D]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
twice AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
marked AS (SELECT doc_id, i, i > 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS apart FROM w SEMI JOIN twice USING (s)),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (
    SELECT doc_id, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
kept AS (SELECT doc_id, lo, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM (
    SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, n, n FROM d)),
left_over AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS h FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(left_over.h)) AS kept_sha256
FROM d JOIN left_over USING (doc_id) LEFT JOIN gone USING (doc_id)"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{PHRASE_WORD}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({lower('text')}, '{PHRASE_WORD}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i + 1:i + 10], ' ') AS s
  FROM (SELECT *, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
met AS (SELECT DISTINCT doc_id, i, k, item_id FROM places JOIN windows USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _license_sql() -> str:
    rows = ", ".join(f"({k}, {text(t['label'])}, [{', '.join(map(text, t['words']))}], {t['first']}, {t['length']}, {t['base']})"
                     for k, t in enumerate(licenses.template_table()))
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS v(k, label, words, first, length, base)),
d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{PHRASE_WORD}') AS w FROM documents),
at_first AS (SELECT doc_id, w, k, unnest(range(len(w))) AS p FROM d, t),
places AS (SELECT doc_id, p, label, base, len(list_filter(range(len(words)), lambda o: p - first + o >= 0 AND w[greatest(p - first + o, 0) + 1] = words[o + 1]))
    / len(words)::DOUBLE AS share
  FROM at_first JOIN t USING (k) WHERE w[p + 1] = words[first + 1] AND w[p + 1:p + length] = words[first + 1:first + length]),
good AS (SELECT * FROM places WHERE base OR share >= {licenses.MIN_SHARE})
SELECT d.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM places p WHERE p.doc_id = d.doc_id AND base)::BIGINT AS n_base,
  (SELECT min(p) FROM places x WHERE x.doc_id = d.doc_id AND base)::BIGINT AS first_word,
  (SELECT max(p) FROM places x WHERE x.doc_id = d.doc_id AND base)::BIGINT AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM places x WHERE x.doc_id = d.doc_id AND base), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM good x WHERE x.doc_id = d.doc_id), '') AS labels,
  coalesce((SELECT max(share) FROM good x WHERE x.doc_id = d.doc_id), 0)::DOUBLE AS score
FROM d"""


def _secret_sql() -> str:
    found = " UNION ALL ".join(f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i, gap, size, counted >= {rule.least} AS holds FROM (
    SELECT doc_id, unnest(range(len(m))) AS i, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap,
      unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(c, lambda x: length(x))) AS counted
    FROM (SELECT doc_id, regexp_extract_all(t, {text(rule.pattern)}, 0) AS m, regexp_extract_all(t, {text(rule.pattern)}, {rule.group}) AS c,
            regexp_split_to_array(t, {text(rule.pattern)}) AS g FROM d WHERE regexp_matches(t, {text(rule.pattern)})))"""
                               for rank, rule in enumerate(RULES))
    base = sum(rule.base for rule in RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({found}),
spans AS (SELECT doc_id, rank, kind, s - size AS start, concat_ws(':', kind, (s - size)::BIGINT, s::BIGINT) AS span FROM (
    SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, rank ORDER BY i) AS s FROM parts) WHERE holds)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {base}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
shared AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, top IS NOT NULL AND top <> doc_id AS lost FROM l LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _quality_sql() -> str:
    measures = ["word_length", "symbol_share", "line_share"]
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM c" for m in measures)

    def beyond(measure: str, size: str) -> str:
        fence = lambda side: f"(g.total * g.{measure}_{side} + {quality.PRIOR} * a.{measure}_{side}) / (g.total + {quality.PRIOR})"
        noise = f"{quality.NOISE}::DOUBLE * sqrt({measure} / greatest({size}, 1))"
        return f"WHEN {measure} - {noise} > {fence('high')} OR {measure} + {noise} < {fence('low')} THEN '{measure}'"

    rules = " ".join(map(beyond, measures, ["n_words", "n_words", "full_lines"]))
    middle = f"CASE WHEN bin < 0 THEN 0 ELSE {quality.SMALLEST}::DOUBLE * pow({quality.BIN_WIDTH}::DOUBLE, bin + 0.5::DOUBLE) END"

    def fences(groups: str, rows: str) -> str:
        by = f"{groups}, " if groups else ""
        sides = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {side} END) AS {m}_{side}" for m in measures for side in ("low", "high"))
        return f"""SELECT {by}{sides}, max(total) AS total FROM (
  SELECT {by}measure, total, q1 - {quality.FENCE}::DOUBLE * spread AS low, q3 + {quality.FENCE}::DOUBLE * spread AS high FROM (
    SELECT *, greatest(q3 - q1, off, {quality.BIN_WIDTH - 1}::DOUBLE * q3) AS spread FROM (
      SELECT {by}measure, max(total) AS total, sum(n * abs(v - median)) / max(total) AS off,
        min(v) FILTER (WHERE seen >= 0.25 * total) AS q1, min(v) FILTER (WHERE seen >= 0.75 * total) AS q3
      FROM (SELECT *, min(CASE WHEN seen >= 0.5 * total THEN v END) OVER (PARTITION BY {by}measure) AS median FROM (
        SELECT *, {middle} AS v, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY {by}measure) AS total FROM (
          SELECT {by}measure, bin, count(*) AS n FROM {rows} GROUP BY {by}measure, bin))) GROUP BY {by}measure))) {f'GROUP BY {groups}' if groups else ''}"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) > 1 AS twice FROM (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5))),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows WHERE twice) GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS full_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM d LEFT JOIN (SELECT doc_id, sum(n) AS n, sum(n - 1) AS dup FROM lines GROUP BY doc_id) l USING (doc_id) LEFT JOIN covered v USING (doc_id)),
c AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words::DOUBLE ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words::DOUBLE ELSE 0 END AS symbol_share,
    CASE WHEN full_lines > 0 THEN n_dup_lines / full_lines::DOUBLE ELSE 0 END AS line_share FROM b),
v AS (SELECT lang, source, measure, CASE WHEN v < {quality.SMALLEST} THEN -1 ELSE floor(ln(v / {quality.SMALLEST}::DOUBLE) / ln({quality.BIN_WIDTH}::DOUBLE)) END AS bin FROM ({long})),
a AS ({fences('', 'v')}),
g AS ({fences('lang, source', 'v')}),
judged AS (SELECT c.*, CASE WHEN base_failed THEN 'base' {rules} END AS failed_rule
  FROM c LEFT JOIN g ON g.lang IS NOT DISTINCT FROM c.lang AND g.source IS NOT DISTINCT FROM c.source LEFT JOIN a ON TRUE)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM judged"""


NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id, min(reach.b) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n"""

def _spelling_sql() -> str:
    """Letters beyond ASCII stand as one byte each while edits are counted, since the distance counts bytes; near words share a way to leave out one letter."""
    beyond = "".join(map(chr, range(0xC0, 0x100)))
    plain = "".join(chr(c) for c in [*range(0x21, 0x27), *range(0x28, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), *range(0x41, 0x5B)])[:len(beyond)]
    bits = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384))"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(k)), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT)), lambda crc, byte: {bits})"
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{spelling.LETTERS}+')) AS run FROM documents WHERE text IS NOT NULL),
k AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k, count(*) AS n FROM r WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY 1, 2),
h AS (SELECT run, n, xor({crc}, 4294967295) AS h FROM k),
w AS (SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{beyond}', {text(plain)}) AS bytes FROM w WHERE length(word) >= {spelling.LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
less AS (SELECT DISTINCT word, bytes, n, cut FROM (
  SELECT word, bytes, n, unnest(list_prepend(bytes, list_transform(range(strlen(bytes)), lambda i: substr(bytes, 1, i) || substr(bytes, i + 2)))) AS cut FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.cut = b.cut AND a.word <> b.word WHERE levenshtein(a.bytes, b.bytes) = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
told AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {spelling.FORM_FACTOR} * n THEN other END AS form,
  CASE WHEN other_n >= {spelling.FORM_FACTOR} * n THEN other_n END::BIGINT AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS step FROM told UNION ALL SELECT chain.word, told.form, step + 1 FROM chain JOIN told ON told.word = chain.root WHERE told.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, (SELECT arg_max(root, step) FROM chain c WHERE c.word = told.word) AS root FROM told"""


def _collocation_sql() -> str:
    phrase = lambda lo, hi: f"array_to_string(w[{lo}:{hi}], ' ')"
    sizes = range(1, collocations.LONGEST + 1)
    following = ", ".join(f"lead(w1, {k - 1}) OVER o AS w{k}" for k in sizes[1:])
    runs = " UNION ALL ".join(f"SELECT lang, {k} AS k, {' || chr(32) || '.join(f'w{j}' for j in sizes[:k])} AS p FROM runs" for k in sizes)
    cuts = " UNION ALL ".join(f"SELECT lang, p, k, a, {j} AS j, {phrase(1, j)} AS lp, {phrase(j + 1, 'k')} AS rp FROM c WHERE k > {j}" for j in range(1, collocations.LONGEST))
    inside = " UNION ALL ".join(f"SELECT lang, a, {phrase(i, j)} AS p FROM c WHERE k >= {j} AND k > {j - i + 1}"
                                for i in range(1, collocations.LONGEST + 1) for j in range(i + 1, collocations.LONGEST + 1))
    return f"""
WITH texts AS (SELECT coalesce(lang, '{collocations.NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array({lower('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM texts),
words AS (SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM pieces),
runs AS (SELECT lang, w1, {following} FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT *, string_split(p, ' ') AS w FROM (SELECT lang, k, p, count(*) AS a FROM ({runs}) WHERE p IS NOT NULL GROUP BY lang, k, p)),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {collocations.LEAST_COUNT}),
cut AS ({cuts}),
part AS MATERIALIZED (SELECT lang, p, a FROM f WHERE a >= {collocations.LEAST_COUNT}),
half AS MATERIALIZED (SELECT cut.*, part.a AS l FROM cut JOIN part ON part.lang = cut.lang AND part.p = lp),
scored AS (SELECT half.lang, half.p, half.a, j, l, part.a AS r, (2000000::HUGEINT * half.a) // (l + part.a) AS score
  FROM half JOIN part ON part.lang = half.lang AND part.p = rp),
lowest AS (SELECT lang, p, a, unnest(first(struct_pack(l, r, score) ORDER BY score, j)) FROM scored GROUP BY 1, 2, 3),
longer AS (SELECT lang, p, max(a) AS most FROM ({inside}) GROUP BY 1, 2),
ends AS (SELECT lang, p, max(a) FILTER (WHERE side = 'left') AS best_left, max(a) FILTER (WHERE side = 'right') AS best_right FROM (
  SELECT lang, a, {phrase(2, 'k')} AS p, 'left' AS side FROM c WHERE k > 2 UNION ALL SELECT lang, a, {phrase(1, 'k - 1')}, 'right' FROM c WHERE k > 2) GROUP BY 1, 2),
ranked AS (SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank
  FROM lowest LEFT JOIN longer USING (lang, p) WHERE most IS NULL OR 100 * most < {collocations.ABSORBED_PERCENT} * a)
SELECT ranked.lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score,
  best_left::BIGINT AS best_left, best_right::BIGINT AS best_right
FROM ranked JOIN (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) LEFT JOIN ends USING (lang, p) WHERE rank <= {collocations.TOP}"""


ORACLES = {
    "op1_suffix_dedup": SUFFIX_DEDUP, "op2_decontaminate": DECONTAMINATE, "op3_license_scan": _license_sql(), "op5_secret_scan": _secret_sql(),
    "op6_line_dedup": LINE_DEDUP, "op8_quality_rules": _quality_sql(), "op9_near_dedup": NEAR_DEDUP,
    "op12_spelling": _spelling_sql(), "op13_collocations": _collocation_sql()}
