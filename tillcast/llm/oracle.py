"""DuckDB counterparts of the registered queries, where SQL can express them.

SimHash (XXH64), sharding (key hashes), language identification, toxicity and the personal-data field have
none; tests/llm holds them against brute force, or measures them.
"""

from __future__ import annotations

from tillcast.llm.quality import LEVELS, LIFT, LIMIT, RISK, RULES

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, {LOWER}), '{WORD}'), []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {LOWER}), '{WORD}') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT grams.r, grams.i, grams.n, wins.item FROM grams JOIN wins ON grams.n = wins.n AND grams.g = wins.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

OP5 = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

# The bisection has a closed form for a repetition limit; steps of alpha are 2^-24 here as there.
OP6 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n,
                  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 256 AS block FROM documents),
cells AS (SELECT source, block, sum(n) AS n FROM d GROUP BY ALL),
src AS (SELECT source, sum(n) AS t FROM cells GROUP BY source),
shares AS (SELECT source, t, t / (SELECT sum(t) FROM src) AS p FROM src WHERE t > 0),
best AS (SELECT CASE WHEN max(p) / min(p) <= 2.0 THEN 0.0
                ELSE ceil((1 - ln(2.0) / ln(max(p) / min(p))) * 16777216) / 16777216 END AS alpha FROM shares),
pow AS (SELECT source, t, pow(p, alpha) AS w, alpha FROM shares, best),
sums AS (SELECT sum(w) AS z, max(t / w) AS once FROM pow),
plan AS (SELECT source, t, alpha, w / z AS weight, round(w / z * (once * z) / t, 9) AS times FROM pow, sums),
epochs AS (SELECT cells.*, t, weight, alpha, times, unnest(range(1, CAST(greatest(ceil(times), 1) AS INTEGER) + 1)) AS epoch FROM cells JOIN plan USING (source)),
ranked AS (SELECT *, row_number() OVER w AS block_rank, sum(n) OVER w AS cum FROM (
             SELECT *, CAST(('0x' || substr(md5(source || '|' || epoch || '|' || block), 1, 8)) AS BIGINT) AS draw FROM epochs)
           WINDOW w AS (PARTITION BY source, epoch ORDER BY draw, block ROWS UNBOUNDED PRECEDING))
SELECT d.doc_id, d.source, CAST(epoch AS INTEGER) AS epoch, CAST(d.block AS INTEGER) AS block, CAST(block_rank AS INTEGER) AS block_rank,
       round(weight, 9) AS weight, round(alpha, 6) AS alpha
FROM d JOIN ranked ON d.source = ranked.source AND d.block = ranked.block
WHERE epoch <= times OR cum - ranked.n / 2 <= (times - epoch + 1) * t
"""

OP7 = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {LOWER}) AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN len(string_split(host, '.')) >= 3 AND string_split(host, '.')[-3] IN
              ('adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def _spans_of(kind: str, order: int, pattern: str, keep: str) -> str:
    """Spans of one kind by cutting the text at the matches; ``m`` is a match."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT r, {order} AS k, '{kind}' AS kind, list_sum([len(x) FOR x IN s[1:i]]) + coalesce(list_sum([len(x) FOR x IN a[1:i - 1]]), 0) AS b, a[i] AS m
      FROM (SELECT r, a, string_split_regex(text, '{pattern}') AS s, unnest(range(1, len(a) + 1)) AS i
            FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS a FROM docs)) WHERE {keep.replace('$m', 'a[i]')}"""


_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = " UNION ALL ".join([
    _spans_of("assign", 0, _ASSIGN, "len(regexp_extract($m, '" + _ASSIGN.replace("'", "''") + "', 1)) >= 8"),
    _spans_of("access", 1, "AKIA[A-Z0-9]+", "len($m) >= 16"),
    _spans_of("hex", 2, "[0-9a-f]+", "len($m) >= 32"),
    _spans_of("forge", 3, "gh[pousr]_[A-Za-z0-9]+", "len($m) >= 40"),
    _spans_of("bearer", 4, r"Bearer\x20+[A-Za-z0-9._~+/=-]+", "len($m) >= 24"),
])
OP9 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT r, k, kind, CAST(b AS BIGINT) AS b, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + len(m) AS BIGINT) AS span FROM ({_SECRETS})),
found AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                 coalesce(string_agg(span, ',' ORDER BY b, k) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY b, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (r)
"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {LOWER}) AS t FROM documents),
pieces AS (SELECT r, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)) GROUP BY ALL HAVING f >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
             FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c))) GROUP BY ALL),
free AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE inner_.a IS NULL OR 100 * inner_.a < 80 * c.a),
cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM free)),
scored AS (SELECT cuts.lang, cuts.phrase, a, fl.f AS l, fr.f AS r, CAST(2000000 AS HUGEINT) * a // (fl.f + fr.f) AS score, j
           FROM cuts JOIN f AS fl ON fl.lang = cuts.lang AND fl.phrase = lp JOIN f AS fr ON fr.lang = cuts.lang AND fr.phrase = rp),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS x FROM scored) WHERE x = 1)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst) JOIN totals USING (lang) WHERE rank <= 2000
"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occurrences AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM occurrences GROUP BY ALL HAVING count(DISTINCT r) >= 3),
cells AS (SELECT lang, source, term, count(*) AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM kept GROUP BY lang),
grouped AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grouped LEFT JOIN cells USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // CAST(g.total + v AS HUGEINT) AS p
           FROM totals AS g JOIN kept AS k ON g.lang = k.lang JOIN sizes ON sizes.lang = g.lang
           LEFT JOIN cells ON cells.lang = g.lang AND cells.source = g.source AND cells.term = k.term),
whole AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (all_n + 1) // CAST(total + v AS HUGEINT) AS q FROM kept JOIN sizes USING (lang)),
priced AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
           FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM grouped AS a JOIN grouped AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN priced ON priced.lang = a.lang AND priced.source = a.source AND priced.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranks WHERE part = 'pair' OR rank <= 200
"""


def _level(value: str, cutoffs: tuple[int, ...], small: bool) -> str:
    met = [f"CAST(({value.replace(' div ', ' // ')}) {'<' if small else '>='} {c} AS INTEGER)" for c in cutoffs]
    return "(" + " + ".join(met) + ")"


# Two thirds of the labelled rows order the rungs, the rest certify them (see quality.py). DuckDB has no crc32, so the split is
# spelled out: the table of the polynomial by recursion, then the bytes of the id.
OP13 = rf"""
WITH RECURSIVE tab(n, k, c) AS (
  SELECT range, 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM tab WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM tab WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(nullif(lang, ''), 'und') AS stratum, coalesce(text, '') AS t FROM documents),
split_ AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split_)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (SELECT r, doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct_words, len(l) AS n_lines
      FROM split_ LEFT JOIN repeats USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
lv AS (SELECT *, CASE WHEN NOT base_failed THEN [{", ".join(_level(v, c, s) for _, v, c, s in RULES)}] END AS levels FROM base),
known AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ascii(x) AS UBIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
          lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS c FROM known, crc_table),
e AS (SELECT stratum, good, c % 3 = 1 AS holdout, levels FROM lv JOIN known USING (doc_id) JOIN crc USING (doc_id) WHERE NOT base_failed),
pairs AS (SELECT range // {LEVELS} AS rule, range % {LEVELS} + 1 AS level FROM range({LEVELS * len(RULES)})),
tails AS (SELECT stratum, rule, level, count(*) FILTER (good AND levels[rule + 1] >= level) AS g, count(*) FILTER (NOT good AND levels[rule + 1] >= level) AS b,
                 count(*) FILTER (good) AS all_g, count(*) FILTER (NOT good) AS all_b FROM e, pairs WHERE NOT holdout GROUP BY ALL),
steps AS (SELECT stratum, rule, level, row_number() OVER (PARTITION BY stratum ORDER BY (b + 1.0::DOUBLE) / (g + 1.0::DOUBLE) DESC, rule, level DESC) AS step
          FROM tails WHERE b * all_g > {LIFT} * g * all_b),
held AS (SELECT row_number() OVER () AS h, stratum, levels FROM e WHERE holdout AND good AND stratum IN (SELECT stratum FROM steps)),
firsts AS (SELECT h, any_value(held.stratum) AS stratum, min(step) FILTER (levels[rule + 1] >= level) AS step FROM held JOIN steps ON held.stratum = steps.stratum GROUP BY h),
n_held AS (SELECT stratum, count(*) AS n FROM firsts GROUP BY stratum),
rungs AS (SELECT s.stratum, s.step, n, (SELECT count(*) FROM firsts WHERE firsts.stratum = s.stratum AND firsts.step <= s.step) AS k FROM steps AS s JOIN n_held USING (stratum)),
bounds AS (SELECT stratum, step, CASE WHEN k >= n * {LIMIT} THEN 1.0 ELSE
             list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({LIMIT}) + (n - i) * ln(1 - {LIMIT})) FOR i IN range(0, k + 1)]) END AS p FROM rungs),
fails AS (SELECT stratum, min(step) FILTER (p > {RISK} / (SELECT count(DISTINCT stratum) FROM steps)) AS failed FROM bounds GROUP BY stratum),
cut AS (SELECT steps.* FROM steps JOIN fails USING (stratum) WHERE failed IS NULL OR step < failed),
gone AS (SELECT DISTINCT r FROM lv JOIN cut ON lv.stratum = cut.stratum AND levels[rule + 1] >= level)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM gone) AS kept FROM lv
"""

ORACLE: dict[str, str] = {
    "op3_decontamination": OP3,
    "op5_top_k": OP5,
    "op6_mixing": OP6,
    "op7_url_filter": OP7,
    "op9_secret_scan": OP9,
    "op11_collocations": OP11,
    "op12_divergence": OP12,
    "op13_quality_rules": OP13,
}
