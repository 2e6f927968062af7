"""The catalog's queries in DuckDB SQL, over the same Parquet tables."""

from __future__ import annotations

from textloom.functions import markup
from textloom.functions import text as fx
from textloom.sources import named

ORACLE: dict[str, str] = {}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOKEN = quote(fx.TOKEN_PATTERN)
VOTES = ", ".join(
    f"len(list_filter(tokens, lambda t: lower(t) in ({', '.join(quote(w) for w in ws)}))) AS n_{lang}"
    for lang, ws in fx.STOP_WORDS.items()
)
CODES = sorted(fx.STOP_WORDS)
BEST = f"greatest({', '.join('n_' + c for c in CODES)})"
LANG = f"CASE WHEN {BEST} = 0 THEN NULL " + " ".join(
    f"WHEN n_{c} = {BEST} THEN '{c}'" for c in CODES
) + " END"

BASE = f"""WITH doc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS dir_id, source, lang AS doc_lang,
    'corpus/finetune/' || lang || '/' || regexp_extract(source, '([0-9]+)$', 1) || '/' || source
      || '/' || doc_id || '.xml' AS file
  FROM documents),
corp_doc AS (
  SELECT doc_id, CAST(string_split(file, '/')[4] AS BIGINT) AS sid, string_split(file, '/')[5] AS name,
    array_to_string(string_split(file, '/')[6:], '/') AS file
  FROM doc),
corp_src AS (
  SELECT DISTINCT source AS id, source AS name, 'https://example.org/' || source AS url,
    CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS sid
  FROM documents),
paras AS (
  SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS para_no, unnest(ps) AS para
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: p <> '') AS ps FROM documents)),
doc_raw AS (
  SELECT doc_id, flatten(list_transform(
    list_filter(string_split(text, chr(10)), lambda p: p <> ''),
    lambda p: regexp_extract_all(p, '[^.!?]*[.!?]', 0))) AS ss
  FROM documents),
raw AS (
  SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS six, unnest(ss) AS raw FROM doc_raw),
tok AS (SELECT doc_id, six, raw, regexp_extract_all(raw, {TOKEN}, 0) AS tokens FROM raw),
vote AS (SELECT *, {VOTES} FROM tok),
sent AS (
  SELECT doc_id, six, CAST(six AS VARCHAR) AS sid, {LANG} AS lang, array_to_string(tokens, ' ') AS sent,
    CAST(len(tokens) AS INTEGER) AS toklen, tokens
  FROM vote),
lang_dist AS (
  SELECT doc_id, lang, count(*) AS cnt FROM sent WHERE lang IS NOT NULL GROUP BY doc_id, lang),
lang_prop AS (
  SELECT l.doc_id, l.cnt AS sq_cnt, CAST(l.cnt AS DOUBLE) / t.tot_cnt AS sq_prop, t.other_cnt,
    t.no_lang_cnt, t.tot_cnt
  FROM lang_dist l JOIN (
    SELECT doc_id, count(*) FILTER (lang <> 'en') AS other_cnt, count(*) FILTER (lang IS NULL) AS no_lang_cnt,
      count(*) AS tot_cnt
    FROM sent GROUP BY doc_id) t ON t.doc_id = l.doc_id
  WHERE l.lang = 'en'),
stats AS (SELECT doc_id, avg(length(sent)) AS avg, min(length(sent)) AS min FROM sent GROUP BY doc_id),
doc_keep AS (
  SELECT d.doc_id, cd.name, d.file, l.sq_cnt, l.tot_cnt, l.sq_prop, s.avg, s.min
  FROM doc d JOIN corp_doc cd ON cd.doc_id = d.doc_id JOIN lang_prop l ON l.doc_id = d.doc_id
    JOIN stats s ON s.doc_id = d.doc_id
  WHERE cd.name NOT IN ('src0', 'src1', 'src2') AND l.sq_cnt > 10 AND l.sq_prop > 0.3 AND s.avg > 30),
sent_keep AS (
  SELECT s.* FROM sent s
  WHERE s.doc_id IN (SELECT doc_id FROM doc_keep) AND s.lang = 'en' AND NOT starts_with(s.sent, '"')),
words AS (SELECT doc_id, six, unnest(string_split(sent, ' ')) AS value FROM sent),
span AS (
  SELECT doc_id, six, CASE WHEN count(*) > 1 THEN
      string_agg('(' || st || ',' || (st + n) || ')', ',' ORDER BY i) END AS spans
  FROM (
    SELECT doc_id, six, i, n,
      CAST(coalesce(sum(n + 1) OVER (PARTITION BY doc_id, six ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
    FROM (SELECT doc_id, six, generate_subscripts(tokens, 1) AS i, length(unnest(tokens)) AS n FROM sent))
  GROUP BY doc_id, six)"""


def trims(expr: str, sets=fx.TRIM_SETS) -> str:
    for chars in sets:
        expr = f"trim({expr}, {quote(chars)})"
    return expr


DIGITS = "regexp_replace(sent, '^[0-9]+', '')"
GARBAGE = (
    "starts_with(sent, '% ') OR starts_with(sent, '/ /') OR sent ILIKE '* CAPTCHA%' "
    "OR sent ILIKE '( Burime të%'"
)
CURATED = f""",
trimmed AS (
  SELECT doc_id, six, sid, {trims(DIGITS)} AS sent, toklen FROM sent_keep
  WHERE toklen BETWEEN 5 AND 450 AND NOT ({GARBAGE})),
cleaned AS (
  SELECT * FROM trimmed WHERE (doc_id, six) NOT IN (
    SELECT (doc_id, six) FROM (SELECT doc_id, six FROM trimmed ORDER BY sent, doc_id, six LIMIT 20))
  AND length(sent) >= 10),
curated AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY sent ORDER BY doc_id, six) AS rn FROM cleaned)
  WHERE rn = 1)"""


def vocab_where(t: str = "token") -> str:
    return (
        f"length({t}) BETWEEN 2 AND 20 AND NOT regexp_matches({t}, '[-., $+0-9]') "
        f"AND NOT {t} ILIKE 'www%' AND NOT starts_with({t}, '''')"
    )


def ascii_up(e: str) -> str:
    return f"translate({e}, {quote(fx.ASCII_LOWER)}, {quote(fx.ASCII_UPPER)})"


def case_where(t: str = "token") -> str:
    head = f"substr({t}, 1, 3)"
    return (
        f"NOT ({head} = {ascii_up(head)} AND length({t}) > 3) AND {t} <> {ascii_up(t)}"
    )


def charset_where(n: int, t: str = "token") -> str:
    return f"regexp_full_match({t}, '[\\x{{01}}-\\x{{{n:x}}}]*')"


def o(name: str, body: str, extra: str = "") -> None:
    ORACLE[name] = f"{BASE}{extra}\n{body}"


# --- scalar functions ---
o("split_paragraphs", "SELECT doc_id, para_no, para FROM paras")
o(
    "split_sentences",
    "SELECT doc_id, para_no, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos, unnest(ss) AS sent "
    "FROM (SELECT doc_id, para_no, regexp_extract_all(para, '[^.!?]*[.!?]', 0) AS ss FROM paras)",
)
o("tokenize", "SELECT doc_id, six, sent AS tokens FROM sent")
o("sent_text", "SELECT doc_id, six, sent FROM sent")
o("encode_spans", "SELECT doc_id, six, spans FROM span")
o("decode_spans", "SELECT doc_id, six, array_to_string(tokens, '|') AS tokens FROM sent")
o("check_roundtrip", "SELECT doc_id, six, sid FROM sent WHERE false")
o(
    "toklen",
    "SELECT doc_id, six, toklen, CASE WHEN toklen > 1 THEN toklen END AS toklen_of_spans FROM sent",
)
o("split_path", "SELECT doc_id, sid, name, file AS sub_path FROM corp_doc")
o("detect_lang", "SELECT doc_id, six, lang FROM sent")
_letters = "regexp_replace(lower({}), '[^\\p{{L}}]+', ' ', 'g')"
_grams = (
    "SELECT * EXCLUDE (cs), unnest(list_transform(range(1, len(cs) - 1), lambda i: "
    "(ord(cs[i]) * 8191 + ord(cs[i + 1]) * 127 + ord(cs[i + 2])) % 16384)) AS slot FROM ({})"
)


def _letters_of(col: str, keep: str, table: str) -> str:
    words = f"trim({_letters.format(col)})"
    return f"SELECT {keep}, string_split(' ' || {words} || ' ', '') AS cs FROM {table} WHERE {words} <> ''"


o(
    "detect_lang_profile",
    """SELECT s.doc_id, s.six, b.lang FROM sent s LEFT JOIN best b ON b.doc_id = s.doc_id AND b.six = s.six""",
    f""",
learned AS (
  SELECT lang, slot, count(*) AS n FROM ({_grams.format(_letters_of("text", "lang", "documents WHERE doc_id % 4 <> 2 AND lang IS NOT NULL").replace("IS NOT NULL WHERE", "IS NOT NULL AND"))})
  GROUP BY lang, slot),
sizes AS (SELECT lang, sum(n) + 16384 AS total FROM learned GROUP BY lang),
asked AS ({_grams.format(_letters_of("sent", "doc_id, six", "sent"))}),
scores AS (
  SELECT a.doc_id, a.six, z.lang, count(*) AS grams,
    sum(floor(1000 * ln((coalesce(l.n, 0) + 1.0)::DOUBLE / z.total::DOUBLE))) AS score
  FROM asked a CROSS JOIN sizes z LEFT JOIN learned l ON l.lang = z.lang AND l.slot = a.slot
  GROUP BY a.doc_id, a.six, z.lang),
best AS (
  SELECT doc_id, six, lang FROM scores WHERE score > grams * floor(1000 * ln(1.0::DOUBLE / 16384))
  QUALIFY row_number() OVER (PARTITION BY doc_id, six ORDER BY score DESC, lang) = 1)""",
)
o(
    "detect_lang_fitted",
    """SELECT s.doc_id, s.six, b.lang FROM sent s LEFT JOIN best b ON b.doc_id = s.doc_id AND b.six = s.six""",
    """,
spoken AS (SELECT doc_id, six, unnest(string_split(lower(sent), ' ')) AS word FROM sent),
ranked AS (
  SELECT d.lang, word, row_number() OVER (PARTITION BY d.lang ORDER BY count(*) DESC, word) AS rn
  FROM spoken JOIN documents d ON d.doc_id = spoken.doc_id
  WHERE d.lang IS NOT NULL AND regexp_matches(word, '\\p{L}') GROUP BY d.lang, word),
votes AS (
  SELECT doc_id, six, lang, count(*) AS n FROM spoken JOIN ranked ON ranked.word = spoken.word AND rn <= 100
  GROUP BY doc_id, six, lang),
best AS (SELECT doc_id, six, arg_max(lang, (n, -ascii(lang), -ascii(lang[2]))) AS lang FROM votes GROUP BY doc_id, six)""",
)
o("strip_digits", f"SELECT doc_id, six, {DIGITS} AS sent FROM sent")
o("trim_chain", f"SELECT doc_id, six, {trims('sent')} AS sent FROM sent")
o(
    "trim_token",
    "SELECT doc_id, trim('  ' || w || ' ') AS token FROM "
    "(SELECT doc_id, unnest(string_split(text, chr(10))) AS w FROM documents)",
)
o(
    "fn_scalars",
    f"""SELECT doc_id, six, CAST(length(sent) AS INTEGER) AS len, substr(sent, 2, 5) AS sub,
  CAST(instr(sent, ' ') AS INTEGER) AS pos, replace(sent, 'e', '') AS rep, {ascii_up('sent')} AS up,
  trim(sent) AS trimmed, CAST(sid AS INTEGER) AS num, regexp_matches(sent, '^[0-9]') AS glob_digit,
  sent ILIKE 'the %' AS like_the, true AS is_text FROM sent""",
)
ORACLE["json_fields"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
o("xpath_fields", "SELECT doc_id, six, array_to_string(tokens, '|') AS words, sid FROM sent")
o(
    "set_difference",
    """SELECT doc_id, six,
  array_to_string(list_sort(list_distinct(list_filter(tokens, lambda t: NOT list_contains(tokens[1:3], t)))), '|') AS diff,
  array_to_string(list_sort(list_distinct(tokens)), '|') AS both FROM sent""",
)

_html = "html"
for _p, _r in markup.html_rules():
    _html = f"regexp_replace({_html}, {quote(_p)}, {'chr(10)' if _r else quote('')}, 'g')"
for _e, _c in markup.ENTITIES:
    _html = f"replace({_html}, {quote(_e)}, {quote(_c)})"
ORACLE["strip_html"] = f"""SELECT page_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS para_no, unnest(ps) AS para
FROM (SELECT page_id, list_filter(list_transform(string_split({_html}, chr(10)), lambda p: trim(p)), lambda p: p <> '') AS ps
  FROM pages)"""

# --- filters and projections ---
o("filter_lang", "SELECT doc_id, six, lang FROM sent WHERE lang IS NOT NULL")
o("filter_len", "SELECT doc_id, six, sent FROM sent WHERE length(sent) > 50 AND length(sent) < 120")
o("filter_null_lang", "SELECT doc_id, six, sent FROM sent WHERE lang IS NULL")
o("filter_like", "SELECT doc_id, six, sent FROM sent WHERE sent ILIKE 'the %'")
o(
    "filter_garbage",
    f"SELECT doc_id, six, sent FROM sent WHERE NOT ({GARBAGE} OR sent ILIKE 'and %' OR sent ILIKE '%.')",
)
o("filter_toklen", "SELECT doc_id, six, toklen FROM sent WHERE toklen >= 5 AND toklen <= 450")
o("filter_sources", "SELECT * FROM corp_doc WHERE name NOT IN ('src0', 'src1', 'src2')")
o(
    "filter_doc_quality",
    """SELECT l.doc_id, sq_cnt, round(sq_prop, 6) AS sq_prop, round(avg, 6) AS avg, CAST(min AS INTEGER) AS min
FROM lang_prop l JOIN stats s ON s.doc_id = l.doc_id WHERE sq_cnt > 10 AND sq_prop > 0.3 AND avg > 30""",
)
o(
    "filter_low_prop",
    """SELECT l.doc_id, c.name, c.file, sq_cnt, round(sq_prop, 6) AS sq_prop
FROM lang_prop l JOIN corp_doc c ON c.doc_id = l.doc_id WHERE sq_prop < 0.25""",
)
o("doc_exists", "SELECT count(*) AS cnt FROM doc WHERE doc_id = 3")
o("get_sent", "SELECT doc_id, six, sid, sent, lang, toklen FROM sent WHERE doc_id = 3 AND six = 2")
o(
    "sents_of_doc",
    """SELECT s.sent, p.spans, s.sid, s.six FROM sent s JOIN span p ON p.doc_id = s.doc_id AND p.six = s.six
WHERE s.doc_id = 3 ORDER BY s.six""",
)
o("vocab_filter", f"SELECT DISTINCT value AS token FROM words WHERE value <> '' AND {vocab_where('value')}")
o("vocab_case_filter", f"SELECT DISTINCT value AS token FROM words WHERE value <> '' AND {case_where('value')}")
o(
    "vocab_charset_filter",
    f"SELECT DISTINCT value AS token FROM words WHERE value <> '' AND {charset_where(127, 'value')}",
)
o("project_bool", "SELECT doc_id, sq_cnt, tot_cnt, sq_cnt <> tot_cnt AS mixed FROM lang_prop")
o("strip_quote_tokens", "SELECT doc_id, six, array_to_string(tokens, '|') AS tokens FROM sent")
o("delete_where", "SELECT doc_id, six, lang FROM sent WHERE lang IS DISTINCT FROM 'en'")
o(
    "update_col",
    "SELECT doc_id, six, CASE WHEN regexp_matches(sent, '^[0-9]') THEN substr(sent, 2) ELSE sent END AS sent FROM sent",
)
o("table_scan", "SELECT doc_id, dir_id, file FROM doc")

# --- joins ---
o(
    "join_doc_sent",
    """SELECT d.doc_id, d.file, s.sid, s.sent FROM doc d JOIN sent s ON s.doc_id = d.doc_id
WHERE s.lang <> 'en' AND length(s.sent) > 50""",
)
o(
    "join_source_url",
    "SELECT c.name, c.file, u.url FROM corp_doc c JOIN corp_src u ON u.id = c.name ORDER BY c.name, c.file",
)
o(
    "join_source_by_sid",
    """SELECT u.id, u.name, u.url, c.file, s.sent FROM corp_src u JOIN corp_doc c ON c.sid = u.sid
JOIN sent s ON s.doc_id = c.doc_id WHERE u.id = 'src3'""",
)
o(
    "join_star4",
    """SELECT u.id, u.name, c.file, s.six, s.sent FROM corp_src u JOIN corp_doc c ON c.name = u.id
JOIN doc d ON d.doc_id = c.doc_id JOIN sent s ON s.doc_id = c.doc_id WHERE u.id = 'src3'""",
)
o(
    "count_star4",
    """SELECT count(*) AS cnt FROM corp_src u JOIN corp_doc c ON c.name = u.id
JOIN doc d ON d.doc_id = c.doc_id JOIN sent s ON s.doc_id = c.doc_id WHERE u.id = 'src3' AND s.lang = 'en'""",
)
for _name, _where in (
    ("join_source_by_sid", " WHERE u.id = 'src3'"),
    ("join_star4", " WHERE u.id = 'src3'"),
    ("count_star4", " u.id = 'src3' AND"),
):
    ORACLE[f"{_name}_all"] = ORACLE[_name].replace(_where, "")
_counts = """SELECT d.doc_id, count(s.doc_id) AS cnt FROM doc d LEFT JOIN sent s ON s.doc_id = d.doc_id{} GROUP BY d.doc_id"""
o(
    "join_doc_counts",
    f"""SELECT d.doc_id, c.name AS corpus, d.file, n.cnt FROM doc d JOIN corp_doc c ON c.doc_id = d.doc_id
JOIN ({_counts.format('')}) n ON n.doc_id = d.doc_id ORDER BY n.cnt, d.doc_id""",
)
o(
    "theta_lang_mix",
    """SELECT d.doc_id, d.file, count(*) AS cnt FROM doc d JOIN lang_dist l ON l.doc_id = d.doc_id
JOIN sent s ON s.doc_id = d.doc_id AND s.lang <> l.lang WHERE l.lang = 'en' GROUP BY d.doc_id, d.file""",
)
o(
    "lang_mismatch_sample",
    """SELECT d.doc_id, d.file, l.lang AS dist_lang, s.lang AS sent_lang, l.cnt, s.sent
FROM doc d JOIN sent s ON s.doc_id = d.doc_id JOIN lang_dist l ON l.doc_id = d.doc_id
WHERE l.lang = 'en' AND l.cnt = 1 ORDER BY d.doc_id, s.six LIMIT 50""",
)
o(
    "anti_no_target",
    """SELECT d.doc_id, d.file, (SELECT count(*) FROM sent s WHERE s.doc_id = d.doc_id) AS cnt
FROM doc d LEFT JOIN lang_prop l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL""",
)
o("semi_kept_docs", "SELECT doc_id, six FROM sent WHERE doc_id IN (SELECT doc_id FROM doc_keep)")
o(
    "anti_topn",
    """SELECT doc_id, six, sent FROM (SELECT *, row_number() OVER (ORDER BY sent, doc_id, six) AS rn FROM sent)
WHERE rn > 500""",
)
o("scalar_subquery_counts", _counts.format(" AND s.lang <> 'en'"))
o(
    "join_doc_keep",
    """SELECT doc_id, name, file, sq_cnt, tot_cnt, round(sq_prop, 6) AS sq_prop, round(avg, 6) AS avg,
  CAST(min AS INTEGER) AS min FROM doc_keep ORDER BY tot_cnt DESC, doc_id""",
)
o("join_sent_keep", "SELECT doc_id, six, sent, toklen FROM sent_keep")

# --- aggregations ---
o("count_rows", "SELECT count(*) AS cnt FROM sent")
o("count_distinct_names", "SELECT count(DISTINCT name) AS cnt FROM corp_doc")
o("corpus_doc_counts", "SELECT name, count(name) AS cnt FROM corp_doc GROUP BY name")
ORACLE["single_doc_corpora"] = """SELECT name FROM (
  SELECT source || '-' || lang || '-' || CAST(n_chars // 500 AS VARCHAR) AS name FROM documents)
GROUP BY name HAVING count(name) = 1"""
o("doc_counts", _counts.format(""))
o("lang_dist_by_doc", "SELECT doc_id, lang, cnt FROM lang_dist")
o(
    "no_lang_dist_by_doc",
    """SELECT c.*, l.cnt FROM corp_doc c JOIN (
  SELECT doc_id, count(*) AS cnt FROM sent WHERE lang IS NULL GROUP BY doc_id) l ON l.doc_id = c.doc_id""",
)
o(
    "lang_report",
    "SELECT d.file, l.lang, l.cnt FROM doc d JOIN lang_dist l ON l.doc_id = d.doc_id WHERE l.lang = 'en'",
)
o(
    "lang_prop_by_doc",
    "SELECT doc_id, sq_cnt, round(sq_prop, 6) AS sq_prop, other_cnt, no_lang_cnt, tot_cnt FROM lang_prop",
)
o(
    "lang_prop_report",
    """SELECT d.doc_id, c.name, d.file, round(l.sq_prop, 6) AS sq_prop, l.sq_cnt, l.tot_cnt,
  (SELECT count(*) FROM sent s WHERE s.doc_id = d.doc_id) <> l.tot_cnt AS bad_cnt
FROM doc d JOIN corp_doc c ON c.doc_id = d.doc_id JOIN lang_prop l ON l.doc_id = d.doc_id""",
)
o(
    "low_count_report",
    """SELECT d.doc_id, c.name, d.file, l.sq_cnt, l.tot_cnt, round(l.sq_prop, 6) AS sq_prop
FROM doc d JOIN corp_doc c ON c.doc_id = d.doc_id JOIN lang_prop l ON l.doc_id = d.doc_id""",
)
o(
    "corpus_totals",
    """SELECT name, CAST(sum(tot_cnt) AS BIGINT) AS cnt, 'tot_cnt' AS col
FROM corp_doc c JOIN lang_prop l ON l.doc_id = c.doc_id GROUP BY name
UNION ALL SELECT name, CAST(sum(sq_cnt) AS BIGINT), 'sq_cnt'
FROM corp_doc c JOIN lang_prop l ON l.doc_id = c.doc_id GROUP BY name""",
)
o(
    "corpus_avg_prop",
    """SELECT u.name, u.url, round(avg(l.sq_prop), 6) AS sq_prop_ave
FROM corp_doc c JOIN corp_src u ON u.id = c.name JOIN lang_prop l ON l.doc_id = c.doc_id
GROUP BY u.name, u.url""",
)
o("sent_stats_by_doc", "SELECT doc_id, round(avg, 6) AS avg, CAST(min AS INTEGER) AS min FROM stats")
_foreign = "SELECT doc_id, count(*) AS cnt FROM sent WHERE lang <> 'en' AND length(sent) > 50 GROUP BY doc_id"
o(
    "top_foreign_docs",
    f"""SELECT d.doc_id, d.file, f.cnt FROM doc d JOIN ({_foreign}) f ON f.doc_id = d.doc_id
ORDER BY f.cnt DESC, d.doc_id LIMIT 20""",
)
o(
    "having_foreign_gt",
    f"""SELECT d.doc_id, c.name, d.file FROM doc d JOIN corp_doc c ON c.doc_id = d.doc_id
WHERE d.doc_id IN (SELECT doc_id FROM ({_foreign}) WHERE cnt > 5 ORDER BY doc_id LIMIT 5)""",
)
o(
    "doc_total",
    "SELECT d.file, count(*) AS cnt FROM doc d JOIN sent s ON s.doc_id = d.doc_id WHERE d.doc_id = 3 GROUP BY d.file",
)
o("lang_dist_one_doc", "SELECT lang, count(lang) AS cnt FROM sent WHERE doc_id = 3 GROUP BY lang")
o(
    "lang_dist_low_prop",
    """SELECT lang, count(*) AS cnt FROM sent WHERE lang IS NOT NULL AND doc_id IN (
  SELECT doc_id FROM lang_prop ORDER BY sq_prop, doc_id LIMIT 10) GROUP BY lang""",
)
o("dup_report", "SELECT sent, count(*) AS cnt FROM sent GROUP BY sent")
_dedup = """SELECT doc_id, six, sent, toklen FROM (
  SELECT *, row_number() OVER (PARTITION BY sent ORDER BY doc_id, six) AS rn FROM sent) WHERE rn = 1"""
o("dedup_exact", _dedup)
o("distinct_values", "SELECT DISTINCT value AS token FROM words WHERE value <> ''")
o(
    "sum_tokens_chars",
    "SELECT CAST(sum(toklen) AS BIGINT) AS tokens, CAST(sum(length(sent)) AS BIGINT) AS characters FROM sent",
)
o("max_cast", "SELECT max(TRY_CAST(dir_id AS BIGINT)) AS max_id FROM doc")
_stats = """SELECT 'corpus sources' AS description, count(DISTINCT name) AS value FROM corp_doc
UNION ALL SELECT 'documents', count(*) FROM doc UNION ALL SELECT 'sentences', count(*) FROM {0}
UNION ALL SELECT 'tokens', CAST(sum(toklen) AS BIGINT) FROM {0}
UNION ALL SELECT 'characters', CAST(sum(length(sent)) AS BIGINT) FROM {0}"""
o("corpus_stats", _stats.format("sent"))
_sources = """SELECT u.id AS name, u.url, count(*) AS count FROM corp_src u JOIN corp_doc c ON c.name = u.id
JOIN doc d ON d.doc_id = c.doc_id JOIN sent s ON s.doc_id = c.doc_id GROUP BY u.id, u.url"""
o("corpus_sources", _sources)
ORACLE["cohen_kappa"] = """WITH n AS (
  SELECT count(*)::DOUBLE AS n, sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END)::DOUBLE AS same,
    sum(quality)::DOUBLE AS q1, sum(toxic)::DOUBLE AS t1
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
p AS (SELECT n, same / n AS po, (q1 * t1 + (n - q1) * (n - t1)) / (n * n) AS pe FROM n)
SELECT 'sentences' AS description, n AS value FROM n
UNION ALL SELECT 'flags', round((po - pe) / (1 - pe), 6) FROM p
UNION ALL SELECT 'same', 1.0::DOUBLE"""
o(
    "toklen_histogram",
    """SELECT CAST(b AS INTEGER) AS bin, round(5 + (b - 1) * 4.75, 6)::DOUBLE AS lo, round(5 + b * 4.75, 6)::DOUBLE AS hi,
  (SELECT count(*) FROM sent WHERE toklen BETWEEN 5 AND 100 AND least((toklen - 5) * 20 // 95, 19) + 1 = b) AS cnt
FROM generate_series(1, 20) g(b)""",
)
ORACLE["classification_metrics"] = """WITH k AS (
  SELECT k, (SELECT count(*) FROM labels WHERE quality = k)::DOUBLE AS s,
    (SELECT count(*) FROM labels WHERE toxic = k)::DOUBLE AS d,
    (SELECT count(*) FROM labels WHERE quality = k AND toxic = k)::DOUBLE AS tp
  FROM (SELECT DISTINCT quality AS k FROM labels UNION SELECT DISTINCT toxic FROM labels)),
pr AS (SELECT *, CASE WHEN d > 0 THEN tp / d ELSE 0 END AS p, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS r FROM k),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
m AS (
  SELECT sum(f1 * s) / sum(s) AS weighted_F1, sum(p * s) / sum(s) AS weighted_P, sum(r * s) / sum(s) AS weighted_R,
    avg(f1) AS macro_F1, avg(p) AS macro_P, avg(r) AS macro_R, sum(tp) / sum(s) AS accuracy, sum(s) AS n FROM f)
SELECT 'weighted_F1' AS metric, round(weighted_F1, 6) AS value FROM m
UNION ALL SELECT 'weighted_P', round(weighted_P, 6) FROM m UNION ALL SELECT 'weighted_R', round(weighted_R, 6) FROM m
UNION ALL SELECT 'macro_F1', round(macro_F1, 6) FROM m UNION ALL SELECT 'macro_P', round(macro_P, 6) FROM m
UNION ALL SELECT 'macro_R', round(macro_R, 6) FROM m UNION ALL SELECT 'micro_F1', round(accuracy, 6) FROM m
UNION ALL SELECT 'micro_P', round(accuracy, 6) FROM m UNION ALL SELECT 'micro_R', round(accuracy, 6) FROM m
UNION ALL SELECT 'accuracy', round(accuracy, 6) FROM m UNION ALL SELECT 'n', n FROM m"""

# --- windows, order, limits ---
o("sentence_index", "SELECT doc_id, six, CAST(six AS VARCHAR) AS sid, raw AS sent FROM raw")
o(
    "chunk_docs",
    """SELECT doc_id, six, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY six) - 1) // 20 AS INTEGER) AS chunk_id
FROM sent WHERE lang = 'en'""",
)
o(
    "chunk_docs_sql",
    """SELECT doc_id, six, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY six) - 1) // 20 AS INTEGER) AS chunk_id, sent
FROM sent WHERE lang = 'en'""",
)
o(
    "token_index",
    """SELECT doc_id, six, CAST(i - 1 AS INTEGER) AS i, CAST(coalesce(sum(length(norm) + 1) OVER (
    PARTITION BY doc_id, six ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS idx,
  CAST(i - 1 AS INTEGER) AS i_sent, norm
FROM (SELECT doc_id, six, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS norm FROM sent)""",
)
o("dedup_rank", _dedup)
o("ordered_export", "SELECT doc_id, six, sent FROM sent ORDER BY doc_id, six LIMIT 5000")
o(
    "bottom_k_docs",
    "SELECT doc_id, six, sent FROM sent WHERE doc_id IN (SELECT doc_id FROM lang_prop ORDER BY sq_prop, doc_id LIMIT 2)",
)
o("sorted_peek", "SELECT doc_id, six, sent FROM sent ORDER BY sent, doc_id, six LIMIT 10000")
o("sample_limit", "SELECT doc_id, six, lang, toklen FROM sent ORDER BY doc_id, six LIMIT 50")
o("shuffle_docs", "SELECT doc_id, six, sent, md5('7:' || doc_id) AS doc_hash FROM sent")
o(
    "insert_select",
    """SELECT doc_id, six, sent, toklen FROM sent_keep
UNION ALL SELECT s.doc_id, s.six, s.sent, s.toklen FROM sent s JOIN corp_doc c ON c.doc_id = s.doc_id
WHERE c.name = 'src3' AND s.lang = 'en'""",
)
o("split_words", "SELECT doc_id, six, value FROM words WHERE value <> ''")

# --- curation, vocabulary ---
o(
    "final_sent",
    """SELECT s.doc_id, s.six, s.sid, s.sent, p.spans, s.toklen FROM sent s
JOIN span p ON p.doc_id = s.doc_id AND p.six = s.six""",
)
o(
    "curate_corpus",
    """SELECT s.doc_id, s.six, s.sid, s.sent, p.spans, s.toklen FROM curated s
JOIN span p ON p.doc_id = s.doc_id AND p.six = s.six""",
    CURATED,
)
_vocab = f"""SELECT DISTINCT token FROM (SELECT trim(unnest(string_split(sent, ' '))) AS token FROM {{}})
WHERE {vocab_where()} AND {case_where()} AND {charset_where(255)}"""
o("build_vocab", _vocab.replace('{}', 'curated'), CURATED)

# --- training data ---
o(
    "train_test_split",
    """SELECT doc_id, six, sent, CASE WHEN row_number() OVER (
    ORDER BY md5('7:' || doc_id || ':' || six), doc_id, six) <= ceil((SELECT count(*) FROM sent) * 0.25)
  THEN 'test' ELSE 'train' END AS split FROM sent""",
)
ORACLE["stratified_split"] = """SELECT doc_id, quality, toxic, CASE WHEN rn < floor(n * 0.8::DOUBLE + 0.5) THEN 'train'
  WHEN rn < floor(n * 0.9::DOUBLE + 0.5) THEN 'test' ELSE 'validation' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) - 1 AS rn,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)"""
_indexed = "SELECT *, row_number() OVER (ORDER BY doc_id, six) - 1 AS idx FROM {}"
o(
    "text_batches",
    f"""SELECT idx // 1000 AS batch_id, string_agg(sent, chr(10) ORDER BY idx) AS texts
FROM ({_indexed.format('sent')}) GROUP BY 1""",
)
o(
    "vocab_target",
    """SELECT count(*) AS prev, count(*) + CAST(floor(count(*) * 0.5) AS BIGINT) AS total
FROM (SELECT DISTINCT value FROM words WHERE value <> '')""",
)
o("word_freq", "SELECT value AS word, count(*) AS freq FROM words WHERE value <> '' GROUP BY value")
o(
    "pair_freq",
    """SELECT substr(word, i, 1) AS left, substr(word, i + 1, 1) AS right, CAST(sum(freq) AS BIGINT) AS freq
FROM (SELECT word, freq, CAST(unnest(generate_series(1, length(word) - 1)) AS BIGINT) AS i FROM (
  SELECT value AS word, count(*) AS freq FROM words WHERE value <> '' GROUP BY value))
GROUP BY 1, 2""",
)
ENCODED = f""",
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY token) + 4 AS INTEGER) AS id
  FROM ({_vocab.replace('{}', 'sent')})),
toks AS (
  SELECT doc_id, six, generate_subscripts(string_split(sent, ' '), 1) - 1 AS pos, unnest(string_split(sent, ' ')) AS token
  FROM sent),
encoded AS (
  SELECT doc_id, six, [0] || list(coalesce(id, 3) ORDER BY pos) || [2] AS input_ids,
    [NULL] || list(CAST(pos AS INTEGER) ORDER BY pos) || [NULL] AS word_ids
  FROM toks t LEFT JOIN vocab v ON v.token = t.token GROUP BY doc_id, six),
flat AS (
  SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY idx, j) - 1 AS k, x, w,
    count(*) OVER (PARTITION BY batch_id) AS n
  FROM (
    SELECT idx // 1000 AS batch_id, idx, generate_subscripts(input_ids, 1) AS j, unnest(input_ids) AS x,
      unnest(word_ids) AS w
    FROM ({_indexed.format('encoded')}))),
packed AS (
  SELECT batch_id, CAST(k // 16 AS INTEGER) AS chunk_no, string_agg(CAST(x AS VARCHAR), '|' ORDER BY k) AS input_ids,
    string_agg(coalesce(CAST(w AS VARCHAR), '-'), '|' ORDER BY k) AS word_ids
  FROM flat WHERE k < n // 16 * 16 GROUP BY 1, 2)"""
o(
    "encode_tokens",
    """SELECT doc_id, six, array_to_string(input_ids, '|') AS input_ids,
  array_to_string(list_transform(word_ids, lambda x: coalesce(CAST(x AS VARCHAR), '-')), '|') AS word_ids FROM encoded""",
    ENCODED,
)
o("pack_sequences", "SELECT batch_id, chunk_no, input_ids, word_ids FROM packed", ENCODED)
o("copy_labels", "SELECT batch_id, chunk_no, input_ids, input_ids AS labels FROM packed", ENCODED)
def _drawn(tag: str, i: str) -> str:
    key = f"concat_ws(':', '7:0:{tag}', batch_id, chunk_no, {i})"
    return f"CAST('0x' || substr(md5({key}), 1, 10) AS BIGINT) / 1099511627776.0"


_PLACES = """,
places AS (
  SELECT batch_id, chunk_no, generate_subscripts(x, 1) - 1 AS i, CAST(unnest(x) AS INTEGER) AS x,
    TRY_CAST(unnest(w) AS INTEGER) AS w
  FROM (SELECT batch_id, chunk_no, string_split(input_ids, '|') AS x, string_split(word_ids, '|') AS w FROM packed)),
"""
_masked = """SELECT batch_id, chunk_no, string_agg(CAST(y AS VARCHAR), '|' ORDER BY i) AS input_ids,
  string_agg(CAST(CASE WHEN hit THEN x ELSE -100 END AS VARCHAR), '|' ORDER BY i) AS labels
FROM drawn GROUP BY batch_id, chunk_no"""
o(
    "mask_tokens",
    _masked,
    ENCODED
    + _PLACES
    + f"""hits AS (
  SELECT *, {_drawn('token', 'i')} < 0.15 AND x > 4 AS hit, {_drawn('kind', 'i')} AS kind,
    CAST(floor({_drawn('id', 'i')} * ((SELECT count(*) FROM vocab) + 5)) AS INTEGER) AS r FROM places),
drawn AS (
  SELECT *, CASE WHEN NOT hit OR kind >= 0.9 THEN x WHEN kind < 0.8 THEN 4 ELSE r END AS y FROM hits)""",
)
o(
    "mask_whole_word",
    _masked,
    ENCODED
    + _PLACES
    + f"""turns AS (
  SELECT batch_id, chunk_no, i, CAST(coalesce(w <> lag(w) OVER k, true) AS INTEGER) AS turn FROM places
  WHERE w IS NOT NULL WINDOW k AS (PARTITION BY batch_id, chunk_no ORDER BY i)),
numbers AS (
  SELECT batch_id, chunk_no, i, sum(turn) OVER (PARTITION BY batch_id, chunk_no ORDER BY i) - 1 AS n FROM turns),
hits AS (
  SELECT p.*, coalesce({_drawn('word', 'CAST(n AS BIGINT)')} < 0.15 AND n IS NOT NULL, false) AS hit
  FROM places p LEFT JOIN numbers USING (batch_id, chunk_no, i)),
drawn AS (SELECT *, CASE WHEN hit THEN 4 ELSE x END AS y FROM hits)""",
)
o("steps_per_epoch", "SELECT count(*) // 32 AS steps FROM sent")


def _bits(col: str, cats: tuple[str, ...]) -> str:
    return " || '|' || ".join(f"CASE WHEN {col} = {quote(c)} THEN '1' ELSE '0' END" for c in cats)


ORACLE["one_hot_topic"] = (
    f"SELECT event_id, {_bits('event_type', ('view', 'click', 'purchase', 'signup', 'error'))} AS top FROM events"
)
ORACLE["one_hot_emotion"] = (
    f"SELECT conv_id, turn, {_bits('role', ('user', 'assistant'))} AS emot FROM conversations"
)
ORACLE["label_index"] = """SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1
  WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS INTEGER) AS label_idx FROM events"""
ORACLE["propagate_labels"] = """SELECT sent, topic, emotion, label FROM (
  SELECT trim(unnest(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$', 0))) AS sent, source AS topic, lang AS emotion,
    'n' AS label FROM documents)
WHERE sent <> ''"""


# --- readers ---
_toks = "SELECT doc_id || ':' || six AS sid, sent AS tokens FROM sent"
o("read_tok_xml", _toks)
o("read_sent_xml", _toks)
o(
    "read_tok_xml_splits",
    """SELECT n AS n_splits, CAST(row_number() OVER (PARTITION BY n ORDER BY doc_id, six) - 1 AS INTEGER) AS six,
  doc_id || ':' || six AS sid, sent AS tokens FROM sent CROSS JOIN (SELECT unnest([1, 4, 9]) AS n)""",
)
_plain = "text"
for _e, _c in markup.ENTITIES:
    _plain = f"replace({_plain}, {quote(_e)}, {quote(_c)})"
o(
    "read_wiki",
    f"""SELECT doc_id, six, CAST(six AS VARCHAR) AS sid, array_to_string(regexp_extract_all(s, {TOKEN}, 0), ' ') AS tokens
FROM (SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS six, unnest(ss) AS s FROM (
  SELECT doc_id, flatten(list_transform(string_split(
    source || ' ' || source || '. ' || source || '!' || chr(10) || {_plain}, chr(10)),
    lambda p: regexp_extract_all(p, '[^.!?]*[.!?]', 0))) AS ss
  FROM documents WHERE strlen(text) > 70))""",
)
_CHARS = quote("[]{}|<>='&!")
ORACLE["strip_markup"] = (
    f"SELECT doc_id, source || chr(10) || translate(text, {_CHARS}, '') || chr(10) || lang "
    "|| ' ' || source || chr(10) || chr(10) || chr(10) || ' ' || lang || chr(10) AS text FROM documents"
)
_crawl = """WITH crawl AS (
  SELECT *, CASE doc_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_warnings,
    string_split(text, chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, lang, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS text
  FROM crawl)"""
ORACLE["read_crawl_jsonl"] = (
    f"{_crawl} SELECT text AS content, n_warnings, CAST(len(lines) AS INTEGER) AS n_lines FROM crawl"
)
ORACLE["read_tolerant"] = """SELECT text AS content, true AS ok FROM documents
UNION ALL SELECT '{"content": bad ' || doc_id, false FROM documents WHERE doc_id % 5 = 0"""
ORACLE["read_registered"] = (
    f"{_crawl} SELECT array_to_string(regexp_extract_all(text, {TOKEN}, 0), ' ') AS tokens "
    "FROM lines WHERE lang = 'en' AND line_no % 5 > 1 AND doc_id % 4 <> 3"
)
ORACLE["filter_quality_warnings"] = f"{_crawl} SELECT text AS content FROM crawl WHERE doc_id % 4 <> 3"
ORACLE["filter_lang_prob"] = (
    f"{_crawl} SELECT line_no, text FROM lines WHERE lang = 'en' AND line_no % 5 > 1"
)
ORACLE["read_crawl"] = (
    f"{_crawl} SELECT array_to_string(regexp_extract_all(text, {TOKEN}, 0), ' ') AS tokens "
    "FROM lines WHERE lang = 'en' AND line_no % 5 > 1 AND doc_id % 4 <> 3"
)
o("read_sources", "SELECT id, name, url FROM corp_src")
ORACLE["read_reviews"] = """SELECT text, CASE doc_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE 'n' END AS label,
  CASE WHEN doc_id % 7 <> 0 THEN source END AS topic, 'joy' AS emotion FROM documents WHERE lang = 'en'"""
ORACLE["read_annotations"] = """SELECT source AS a1_topic, source AS a2_topic, lang AS a1_emotion,
  CASE WHEN l.doc_id % 2 = 0 THEN lang ELSE 'en' END AS a2_emotion, quality AS a1_label, toxic AS a2_label
FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id % 9 <> 0"""
_split = ORACLE["stratified_split"]
ORACLE["read_split_ids"] = f"SELECT doc_id AS row_id, split FROM ({_split})"
ORACLE["apply_split_ids"] = (
    f"SELECT d.doc_id, d.lang, s.split FROM documents d JOIN ({_split}) s ON s.doc_id = d.doc_id"
)
o("named_query", _sources)
for _name, _sql in named.NAMED.items():
    for _arg in named.EXAMPLES.get(_name, ()):
        _sql = _sql.replace("?", str(_arg), 1)
    o(f"named_{_name}", _sql.replace("LEFT SEMI JOIN", "SEMI JOIN"), f", vocab AS ({_vocab.replace('{}', 'sent')})")
o(
    "named_select_sent_by_doc_id",
    """SELECT s.sent, p.spans, s.sid, s.six FROM sent s JOIN span p ON p.doc_id = s.doc_id AND p.six = s.six
WHERE s.doc_id = 3""",
)
o("read_dataset", "SELECT sent AS text FROM sent ORDER BY doc_id, six LIMIT 2000")
o("stage_docs", "SELECT doc_id, six, CAST(six AS VARCHAR) AS sid, sent AS tokens FROM sent")

# --- writers ---
o(
    "create_schema",
    """SELECT 'doc' AS name, count(*) AS cnt FROM doc UNION ALL SELECT 'sent', 0 UNION ALL SELECT 'corp_doc', 0
UNION ALL SELECT 'corp_src', 0""",
)
o(
    "append_docs",
    """SELECT n + rn AS doc_id, CAST(n + rn AS VARCHAR) AS dir_id, file FROM (
  SELECT file, row_number() OVER (ORDER BY file) - 1 AS rn, count(*) OVER () AS n FROM doc)""",
)
o(
    "append_sents",
    """SELECT s.doc_id, s.six, s.sid, s.lang, s.sent, p.spans, s.toklen FROM sent s
JOIN span p ON p.doc_id = s.doc_id AND p.six = s.six""",
)
o(
    "assign_dir_id",
    """SELECT doc_id, file, CAST(m + row_number() OVER (ORDER BY file) AS VARCHAR) AS dir_id
FROM (SELECT *, max(CAST(dir_id AS BIGINT)) OVER () AS m FROM doc)""",
)
o("recreate_or_append", "SELECT 2 * count(*) AS appended, count(*) AS cnt FROM corp_doc")
o("load_if_empty", "SELECT doc_id, dir_id, file, true AS first, false AS second FROM doc")
o("refresh_corp_doc", "SELECT * FROM corp_doc")
o("refresh_corp_src", "SELECT id, name, url FROM corp_src")
o(
    "insert_source",
    "SELECT id, name, url FROM corp_src UNION ALL SELECT 'extra', 'Extra', 'https://example.org/extra'",
)
o("ctas", "SELECT * FROM corp_doc")
o("dump_csv", "SELECT doc_id AS did, doc_id || '-' || six AS sid, sent AS text FROM sent")
o("write_dataset", f"SELECT sent AS text, idx FROM ({_indexed.format('sent')})")
o("write_report", _stats.format("sent"))
ORACLE["write_metrics"] = ORACLE["classification_metrics"]

# --- jobs ---
o(
    "build_corpus",
    """SELECT s.doc_id || ':' || s.six AS sid, s.lang, s.sent, p.spans, s.toklen FROM sent s
JOIN span p ON p.doc_id = s.doc_id AND p.six = s.six""",
)
o("print_stats", _stats.format("sent"))
o("write_stats", _sources)
o("dump_corpus", "SELECT doc_id AS did, doc_id || '-' || six AS sid, sent AS text FROM curated", CURATED)
o(
    "curate_increments",
    """SELECT s.doc_id, s.six, s.sid, s.sent, p.spans, s.toklen FROM curated s
JOIN span p ON p.doc_id = s.doc_id AND p.six = s.six""",
    CURATED.replace("LIMIT 20", "LIMIT 0"),
)
o("ingest_stream", "SELECT doc_id, six, sid, lang, sent, toklen FROM sent")

ORACLE["list_files"] = """SELECT source AS name, CAST(sum(strlen(text) + 1) AS BIGINT) AS size
FROM documents GROUP BY source"""
ORACLE["sentiment_classifier"] = f"""SELECT split, count(*) AS cnt, true AS accurate FROM ({_split})
WHERE split <> 'train' GROUP BY split"""
o(
    "cooccurrence",
    """SELECT a.value AS word, b.value AS context, count(*) AS n FROM placed a JOIN placed b
  ON b.doc_id = a.doc_id AND b.six = a.six AND b.pos <> a.pos AND abs(b.pos - a.pos) <= 5
WHERE a.value IN (SELECT value FROM known) AND b.value IN (SELECT value FROM known)
GROUP BY a.value, b.value""",
    """,
placed AS (
  SELECT doc_id, six, generate_subscripts(ws, 1) AS pos, unnest(ws) AS value
  FROM (SELECT doc_id, six, list_filter(string_split(sent, ' '), lambda w: w <> '') AS ws FROM sent)),
known AS (SELECT value FROM placed GROUP BY value HAVING count(*) >= 5)""",
)
o("word_vectors_sharded", "SELECT doc_id, six, 50 AS size, true AS finite FROM sent")
o("word_vectors", "SELECT doc_id, six, 50 AS size, true AS finite FROM sent")
