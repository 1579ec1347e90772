"""DuckDB SQL for the registered queries, written on its own rather than derived from the plans."""

from __future__ import annotations

from redpen.lexicons import ACADEMIC_STOP_WORDS, CHARACTER_CONFUSIONS, COVID_18, COVID_VARIANTS, OCR_PAIRS, PROSE_KEYWORDS, PROTECTED_WORDS
from redpen.operators.cases import QUOTA
from redpen.plans.queries import UI_TOKENS

ORACLE: dict[str, str] = {}

WS = r"[ \t\n\r\f\x0B]"
URL = r"http[^ \t\n\r\f\x0B]+|www\.[^ \t\n\r\f\x0B]+"
PIECE = r"([\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*|[^\p{L}\p{N} \t\n\r\f\x0B]+)([ \t\n\r\f\x0B]*)"
GREEK = [("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("κ", "kappa"), ("μ", "mu"), ("τ", "tau"), ("λ", "lambda"), ("Α", "alpha"), ("Β", "beta"), ("Γ", "gamma"), ("Δ", "delta"), ("Κ", "kappa"), ("Μ", "mu"), ("Τ", "tau"), ("Λ", "lambda")]


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def academic(e: str) -> str:
    e = f"regexp_replace(lower(coalesce({e}, '')), '{URL}', ' ', 'g')"
    e = f"regexp_replace({e}, '<.*?>', ' ', 'g')"
    return squeeze(rf"regexp_replace({e}, '\[[ \t\n\r\f\x0B]*[0-9]+(?:[ \t\n\r\f\x0B,–-]*[0-9]+)*[ \t\n\r\f\x0B]*\]', ' ', 'g')")


def surface(e: str) -> str:
    e = f"regexp_replace(regexp_replace(coalesce({e}, ''), '{URL}', ' ', 'g'), '<.*?>', ' ', 'g')"
    return squeeze(rf"regexp_replace({e}, '[\x00-\x1F\x7F]+', ' ', 'g')")


def normal(e: str) -> str:
    e = f"translate(coalesce({e}, ''), '‐‑‒–—−’‘', '------''''')"
    for a, b in GREEK:
        e = f"replace({e}, '{a}', '{b}')"
    return e


def virus(e: str) -> str:
    e = rf"regexp_replace({e}, '(?i)\b(covid){WS}*[-]?{WS}*(19)\b', '\1-\2', 'g')"
    return rf"regexp_replace({e}, '(?i)\b(sars){WS}*[-]?{WS}*(cov){WS}*[-]?{WS}*(2)\b', '\1-\2-\3', 'g')"


def milli(e: str) -> str:
    return f"CAST(floor({e} * 1000 + 0.5) AS BIGINT)"


def hash_int(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


TOKENS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')"
WORDS = "regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)', 1)"

ORACLE["doc_length_filter"] = f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len({TOKENS}) AS BIGINT) AS n_tokens FROM documents WHERE length(text) > 200 AND len({TOKENS}) > 3"
ORACLE["clean_academic"] = f"SELECT page_id, {academic('html')} AS clean FROM pages"
ORACLE["clean_surface_pages"] = f"SELECT page_id, {surface('html')} AS clean FROM pages"
_prefixed = "('Covid 19 – α’s SARS cov-2 ' || text)"
ORACLE["normalize_text"] = f"SELECT doc_id, {virus(normal(_prefixed))} AS norm FROM documents"
ORACLE["tokens_whitespace"] = f"SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM (SELECT doc_id, {TOKENS} AS t FROM documents)"
ORACLE["tokens_pieces"] = f"SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS text, unnest(b) AS ws FROM (SELECT doc_id, regexp_extract_all(text, '{PIECE}', 1) AS a, regexp_extract_all(text, '{PIECE}', 2) AS b FROM documents)"
ORACLE["tokens_chunks"] = rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS BIGINT) AS n_chunks, regexp_replace(text, '^{WS}+', '') AS rebuilt FROM documents"
_spelling = virus(normal(surface("text")))
ORACLE["tokens_spelling"] = rf"SELECT tok, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower({_spelling}), 'n''t\b', ' not', 'g'), '([a-z0-9]+(?:-[a-z0-9]+)*[+]?)', 1)) AS tok FROM documents WHERE lang = 'en') WHERE regexp_matches(tok, '[a-z]') GROUP BY tok"
_c1 = r"regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 \t\n\r\f\x0B_/-]', ' ', 'g')"
_c2 = rf"regexp_replace(translate(regexp_replace(coalesce(text, ''), '{URL}', ' ', 'g'), '‐‑‒–—−', '------'), '[^A-Za-z0-9 \t\n\r\f\x0B-]', ' ', 'g')"
ORACLE["classification_text"] = f"SELECT doc_id, {squeeze(_c1)} AS clean, {squeeze(_c2)} AS noise_clean FROM documents"
ORACLE["sentence_split"] = rf"""SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.?!]){WS}+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM documents) WHERE length(s) >= 20 GROUP BY doc_id"""

_title, _abstract = academic("substr(text, 1, 80)"), academic("substr(text, 81)")
_score = {k: " + ".join(f"CASE WHEN contains(title, '{w}') THEN 2 WHEN contains(abstract, '{w}') THEN 1 ELSE 0 END" for w in ws) for k, ws in PROSE_KEYWORDS.items()}
LABELLED = f"""SELECT doc_id, CASE WHEN a >= 2 AND a > b AND a > c THEN 'Prevention' WHEN b >= 2 AND b > a AND b > c THEN 'Treatment' WHEN c >= 2 AND c > a AND c > b THEN 'Epidemiology' END AS label
  FROM (SELECT doc_id, {_score['Prevention']} AS a, {_score['Treatment']} AS b, {_score['Epidemiology']} AS c FROM (SELECT doc_id, {_title} AS title, {_abstract} AS abstract FROM documents WHERE lang = 'en'))"""
ORACLE["weak_label"] = LABELLED
ORACLE["label_cap"] = f"SELECT * FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rank FROM ({LABELLED}) WHERE label IS NOT NULL) WHERE rank <= 10000"
ORACLE["corpus_lines"] = "SELECT doc_id AS row_id, CAST(0 AS BIGINT) AS field, trim(substr(text, 1, 80)) AS line FROM documents WHERE lang = 'en' AND trim(substr(text, 1, 80)) <> '' UNION ALL SELECT doc_id, 1, trim(substr(text, 81)) FROM documents WHERE lang = 'en' AND trim(substr(text, 81)) <> ''"
ORACLE["stratified_split"] = f"SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {hash_int('42', 'doc_id')}, doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.2 + 0.5) AS is_test FROM labels WHERE quality IS NOT NULL"
ORACLE["class_token_stats"] = f"SELECT quality, count(*) AS n_rows, CAST(sum(len({TOKENS})) AS BIGINT) AS n_tokens, {milli(f'sum(len({TOKENS})) / count(*)')} AS mean_milli FROM labels JOIN documents USING (doc_id) GROUP BY quality"

ORACLE["full_text"] = "SELECT doc_id, substr(text, 1, 80) || '. ' || substr(text, 81) AS full_text FROM documents WHERE lang = 'en'"
ORACLE["label_ids"] = f"SELECT doc_id, label, CAST(CASE label WHEN 'Prevention' THEN 0 WHEN 'Treatment' THEN 1 ELSE 2 END AS INTEGER) AS label_id FROM ({LABELLED}) WHERE label IS NOT NULL"
ORACLE["validation_sample"] = f"SELECT doc_id, label FROM ({LABELLED}) WHERE label IS NOT NULL ORDER BY {hash_int('99', 'doc_id')}, doc_id LIMIT 50"
_case = "regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9][A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*)', 1)"
_joined = "regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*)', 1)"
ORACLE["case_tokens"] = f"SELECT doc_id, CAST(len({_case}) AS BIGINT) AS n_case, md5(array_to_string({_case}, ' ')) AS case_md5, CAST(len({_joined}) AS BIGINT) AS n_joined, md5(array_to_string({_joined}, ' ')) AS joined_md5 FROM documents"
_frag = lambda n: f"array_to_string(list_concat(list_concat(list_transform(a[greatest(1, pos + 1 - {n}):pos], lambda x: lower(x)), ['<' || a[pos + 1] || '>']), list_transform(a[pos + 2:pos + 1 + {n}], lambda x: lower(x))), ' ')"
ORACLE["case_fragments"] = f"SELECT item_id, pos, {_frag(5)} AS wide, {_frag(4)} AS narrow FROM (SELECT item_id, a, unnest(range(len(a))) AS pos FROM (SELECT item_id, {_case} AS a FROM benchmark))"
ORACLE["common_words"] = rf"""SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(s, '([A-Za-z0-9][A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*)', 1))) AS word FROM (
  SELECT trim(unnest(string_split(regexp_replace(text, '([.?!]){WS}+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM documents WHERE lang = 'en') WHERE length(s) >= 20) WHERE regexp_full_match(word, '[a-z]{{4,}}') GROUP BY word HAVING count(*) >= 50"""

W = f"w AS (SELECT doc_id, {WORDS} AS a FROM documents WHERE lang = 'en')"
U = "u AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(a) AS word FROM w) GROUP BY word)"
B = "b AS (SELECT prev, word, count(*) AS cnt FROM (SELECT unnest(a[1:len(a)-1]) AS prev, unnest(a[2:len(a)]) AS word FROM w WHERE len(a) > 1) GROUP BY prev, word)"
_stop = ", ".join(f"'{x}'" for x in ACADEMIC_STOP_WORDS)
ORACLE["lexicon_unigrams"] = f"WITH {W}, {U} SELECT * FROM u WHERE cnt >= 3"
ORACLE["lexicon_bigrams"] = f"WITH {W}, {B} SELECT * FROM b"
ORACLE["lexicon_vocab"] = f"WITH {W}, {U} SELECT word FROM u WHERE cnt >= 3"
ORACLE["lexicon_totals"] = f"WITH {W}, {U}, {B} SELECT CAST(greatest(coalesce(sum(cnt), 0), 1) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (cnt >= 3) AS vocab, (SELECT count(*) FROM b) AS bigram_types FROM u"
ORACLE["top_terms"] = rf"WITH {W}, {U} SELECT * FROM u WHERE regexp_full_match(word, '\p{{L}}+') AND length(word) > 5 AND word NOT IN ({_stop}) ORDER BY cnt DESC, word LIMIT 15"
ORACLE["top_bigrams"] = f"WITH {W}, {B} SELECT * FROM b WHERE length(prev) >= 3 AND length(word) >= 3 AND prev NOT IN ({_stop}) AND word NOT IN ({_stop}) ORDER BY cnt DESC, prev, word LIMIT 15"
ORACLE["term_search"] = f"WITH {W}, {U} SELECT * FROM u WHERE contains(word, 'tion') ORDER BY cnt DESC, word LIMIT 50"
ORACLE["top_ngrams_per_class"] = f"""WITH {W}, f AS (SELECT quality, list_filter(a, lambda x: x NOT IN ('the', 'of', 'and', 'in', 'to')) AS a FROM w JOIN labels USING (doc_id)),
g AS (SELECT quality, unnest(a) AS term FROM f UNION ALL SELECT quality, unnest(a[1:len(a)-1]) || ' ' || unnest(a[2:len(a)]) FROM f WHERE len(a) > 1),
c AS (SELECT quality, term, count(*) AS cnt FROM g GROUP BY quality, term) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY cnt DESC, term) AS rank FROM c) WHERE rank <= 10"""

GATE = r"""CASE WHEN tok = '' THEN NULL WHEN NOT regexp_matches(tok, '\p{L}') THEN 'non_alpha' WHEN length(tok) <= 3 THEN 'short_token'
  WHEN regexp_full_match(split_part(tok, '-', 1), '[A-Z]{2,}') THEN 'pattern_allcaps'
  WHEN regexp_matches(regexp_replace(tok, '[+.,;:-]+$', ''), '^(?:[A-Z]{1,3}[0-9]|[A-Z]{1,3}-[0-9]|rs[0-9]+|[A-Z]{1,5}[0-9]{2,}|[a-z]{1,3}[0-9]{2,}|[A-Z]+[0-9]+[A-Za-z]*|[0-9]+[A-Za-z]+[0-9]*)') THEN 'pattern_biomed_id'
  WHEN 1.0 * length(regexp_replace(tok, '\p{L}', '', 'g')) / length(tok) > 0.5 THEN 'pattern_numeric_heavy' END"""
ORACLE["gate_assign"] = f"SELECT tok, {GATE} AS gate FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{PIECE}', 1)) AS tok FROM documents)"
ORACLE["gate_counts"] = f"SELECT coalesce({GATE}, 'none') AS gate, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{PIECE}', 1)) AS tok FROM conversations) GROUP BY 1"
RULE = r"""CASE WHEN lower(tok) IN ('covid-18', 'covid18', 'covd-18') THEN 'covid-19' WHEN lower(tok) LIKE 'covid%18' THEN 'covid-19'
  WHEN translate(lower(tok), '(),._/–—-', '') LIKE 'covid%19%' AND lower(tok) <> 'covid-19' THEN 'covid-19' WHEN lower(tok) = 'covid-19' AND tok <> 'covid-19' THEN 'covid-19'
  WHEN lower(tok) IN ('versus', 'virtues', 'verses') AND (prev IN ('corona', 'covid', 'covid-19', 'sars', 'mers', 'hiv', 'cov') OR next IN ('infection', 'infections', 'variant', 'variants', 'pathogen', 'epidemic')) THEN 'virus'
  WHEN lower(tok) = 'significance' AND (prev LIKE '%ly' OR next IN ('difference', 'differences', 'increase', 'increases', 'decrease', 'decreases', 'reduction', 'reductions', 'change', 'changes')) THEN 'significant'
  WHEN lower(tok) = 'lose' AND next = 'of' THEN 'loss' WHEN lower(tok) = 'road' AND (prev = 'viral' OR next = 'levels') THEN 'load' WHEN lower(tok) = 'police' AND next = 'measures' THEN 'policy' END"""


def rule_rows() -> str:
    from redpen.plans.queries import RULE_TOKENS

    text = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({i}, {', '.join(map(text, r))})" for i, r in enumerate(RULE_TOKENS))


ORACLE["domain_rules"] = f"SELECT CAST(id AS BIGINT) AS id, {RULE} AS rule FROM (VALUES {rule_rows()}) AS t(id, tok, prev, next)"


def keys(w: str) -> str:
    once = lambda x: f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, 1, i - 1) || substr({x}, i + 1))"
    twice = "flatten(list_transform(" + once(w) + ", lambda y: list_transform(range(1, length(y) + 1), lambda j: substr(y, 1, j - 1) || substr(y, j + 1))))"
    return f"list_distinct(list_concat([{w}], list_concat({once(w)}, {twice})))"


ORACLE["deletion_index"] = f"WITH {W}, {U} SELECT del_key, count(*) AS n_words, min(word) AS first_word FROM (SELECT word, unnest({keys('word')}) AS del_key FROM u WHERE cnt >= 3 AND length(word) <= 30) GROUP BY del_key"


def one_byte(w: str) -> str:
    """DuckDB measures distance in bytes; letters of two bytes get a capital each, which lower-case words don't have."""
    return f"translate({w}, 'éèêëàâäáãçîïíìôöóòûüúùñßœæ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def near(asked: str, rank: bool = True, p: str = "", u: str = "u") -> str:
    """CTEs k1, k2, n: candidates of the words of ``asked`` (tok) among u; all of them, or the 80 most frequent."""
    return f"""{p}k1 AS (SELECT word, unnest({keys('word')}) AS k FROM {u} WHERE cnt >= 3 AND length(word) <= 30),
{p}k2 AS (SELECT tok, unnest({keys('tok')}) AS k FROM ({asked}) WHERE length(tok) <= 32),
{p}n AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY cnt DESC, dist, cand DESC) AS rnk FROM (
  SELECT tok, cand, damerau_levenshtein({one_byte('tok')}, {one_byte('cand')}) AS dist, {u}.cnt FROM (SELECT DISTINCT tok, word AS cand FROM {p}k2 JOIN {p}k1 USING (k) WHERE tok <> word AND abs(length(tok) - length(word)) <= 2) JOIN {u} ON {u}.word = cand
) WHERE dist <= 2{' QUALIFY rnk <= 80' if rank else ''})"""


RARE = "SELECT word AS tok FROM u WHERE cnt < 3 AND length(word) > 3"
ORACLE["candidates"] = f"WITH {W}, {U}, {near(RARE)} SELECT tok, cand, CAST(dist AS BIGINT) AS dist, cnt, rnk FROM n"
ORACLE["bigram_logprob"] = f"""WITH {W}, {U}, {B}, s AS (SELECT sum(cnt) AS n, count(*) AS v FROM u), t AS (SELECT prev, sum(cnt) AS total FROM b GROUP BY prev)
SELECT prev, word, {milli('ln((b.cnt + 0.01) / (total + 0.01 * v))')} AS logp_milli, {milli('ln((u.cnt + 1) / (n + v))')} AS alone_milli FROM b JOIN t USING (prev) JOIN u USING (word), s"""
ORACLE["suggestions"] = f"""WITH {W}, {U}, {near(RARE)}, s AS (SELECT sum(cnt) AS nn, count(*) AS v FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY round(2.2 * ln((cnt + 1) / (nn + v)) + 0.08 * log10(cnt + 1) - 2.2 * dist, 9) DESC, rnk) AS r FROM n, s QUALIFY r <= 8)
SELECT tok, cand, CAST(dist AS BIGINT) AS dist, row_number() OVER (PARTITION BY tok ORDER BY dist, cnt DESC, cand) AS rank FROM f QUALIFY rank <= 5"""

_protect = ", ".join("'" + x.replace("'", "''") + "'" for x in PROTECTED_WORDS)
LM = rf"""w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{PIECE}', 1), lambda x: lower(x)), lambda x: regexp_matches(x, '\p{{L}}')) AS a FROM documents WHERE lang = 'en'),
{U}, {B}, s AS (SELECT sum(cnt) AS nn, count(*) AS v FROM u), tt AS (SELECT prev, sum(cnt) AS total FROM b GROUP BY prev)"""
#: What the corrector makes of the rows of t1: tok, tl, prev, next in lower case, and any others.
DECIDE = rf"""t2 AS (SELECT t1.*, {GATE} AS gate0, {RULE} AS rule, coalesce(u.cnt, 0) >= 3 AS known, length(tl) <= 3 OR tl IN ({_protect}) AS common FROM t1 LEFT JOIN u ON u.word = tl),
work AS (SELECT DISTINCT tl, prev, next, known FROM t2 WHERE gate0 IS NULL AND rule IS NULL AND NOT (known AND common)),
{near('SELECT DISTINCT tl AS tok FROM work')},
opt AS (SELECT tok, cand, dist, cnt, rnk FROM n UNION ALL SELECT DISTINCT tl, tl, 0, coalesce(u.cnt, 0), 0 FROM work LEFT JOIN u ON u.word = tl),
j AS (SELECT work.*, opt.cand, opt.dist, opt.rnk, ln((opt.cnt + 1) / (nn + v)) AS alone, opt.cnt AS cnt, ln((coalesce(un.cnt, 0) + 1) / (nn + v)) AS nalone, v, bl.cnt AS lc, tp.total AS lt, br.cnt AS rc, tc.total AS rt
  FROM work JOIN opt ON opt.tok = work.tl CROSS JOIN s LEFT JOIN u AS un ON un.word = work.next LEFT JOIN b AS bl ON bl.prev = work.prev AND bl.word = opt.cand LEFT JOIN tt AS tp ON tp.prev = work.prev
  LEFT JOIN b AS br ON br.prev = opt.cand AND br.word = work.next LEFT JOIN tt AS tc ON tc.prev = opt.cand),
sc AS (SELECT tl, prev, next, known, cand, rnk, alone + 1.2 * (CASE WHEN prev IS NULL OR lt IS NULL THEN alone WHEN lc > 0 THEN ln((lc + 0.01) / (lt + 0.01 * v)) ELSE ln(0.4) + alone END)
  + (CASE WHEN next IS NULL THEN 0 WHEN rt IS NULL THEN nalone WHEN rc > 0 THEN ln((rc + 0.01) / (rt + 0.01 * v)) ELSE ln(0.4) + nalone END) + 0.08 * log10(cnt + 1) - 2.2 * dist
  - (CASE WHEN rnk = 0 THEN 0 ELSE (CASE WHEN known THEN 0 ELSE 4.0 * dist END) + 0.5 * abs(length(cand) - length(tl)) END) AS score, CASE WHEN prev IS NULL OR lt IS NULL THEN alone WHEN lc > 0 THEN ln((lc + 0.01) / (lt + 0.01 * v)) ELSE ln(0.4) + alone END AS ll, dist FROM j),
best AS (SELECT tl, prev, next, known, cand, rnk, score FROM sc WHERE known OR rnk > 0 QUALIFY row_number() OVER (PARTITION BY tl, prev, next, known ORDER BY round(score, 9) DESC, rnk) = 1),
ch AS (SELECT best.tl, best.prev, best.next, best.cand, best.rnk > 0 AS moved, best.score - o.score AS margin, round(best.score - o.score, 9) >= (CASE WHEN best.known THEN 5 ELSE 0 END) AS enough
  FROM best JOIN sc AS o ON o.rnk = 0 AND o.tl = best.tl AND o.prev IS NOT DISTINCT FROM best.prev AND o.next IS NOT DISTINCT FROM best.next),
fin AS (SELECT t2.* EXCLUDE (gate0, rule), CASE WHEN gate0 IS NULL AND rule IS NOT NULL THEN rule WHEN moved AND enough THEN ch.cand ELSE tok END AS corrected,
  CASE WHEN gate0 IS NOT NULL THEN 'Correct' WHEN rule IS NOT NULL THEN 'Real-word error' WHEN moved AND enough THEN (CASE WHEN known THEN 'Real-word error' ELSE 'Non-word error' END) WHEN known THEN 'Correct' ELSE 'Unknown (OOV)' END AS error_type,
  CASE WHEN (gate0 IS NULL AND rule IS NOT NULL) OR (moved AND enough) THEN 'apply' ELSE 'abstain' END AS decision,
  CASE WHEN gate0 IS NOT NULL THEN gate0 WHEN rule IS NOT NULL THEN NULL WHEN known AND common THEN 'real_word_protect' WHEN moved AND NOT enough THEN (CASE WHEN known THEN 'margin_delta_rw' ELSE 'margin_delta' END) END AS gate,
  CASE WHEN moved THEN margin END AS margin, gate0 IS NULL AND rule IS NULL AND NOT (known AND common) AS open
  FROM t2 LEFT JOIN ch ON ch.tl = t2.tl AND ch.prev IS NOT DISTINCT FROM t2.prev AND ch.next IS NOT DISTINCT FROM t2.next AND t2.gate0 IS NULL AND t2.rule IS NULL)"""
PIECES_OF = lambda source, key: rf"""t0 AS (SELECT {key}, unnest(range(len(a))) AS pos, unnest(a) AS tok, unnest(ws) AS ws FROM (SELECT {key}, regexp_extract_all(text, '{PIECE}', 1) AS a, regexp_extract_all(text, '{PIECE}', 2) AS ws FROM {source})),
t1 AS (SELECT *, lower(tok) AS tl, lower(lag(tok) OVER o) AS prev, lower(lead(tok) OVER o) AS next FROM t0 WINDOW o AS (PARTITION BY {key} ORDER BY pos))"""  # noqa: E731
CORRECTED = f"{LM}, {PIECES_OF("(SELECT * FROM documents WHERE lang = 'en')", 'doc_id')}, {DECIDE}"
SUMMARY = "SELECT doc_id, count(*) AS total_tokens, count(*) FILTER (decision = 'apply') AS tokens_changed, count(*) FILTER (gate IS NOT NULL) AS tokens_protected, count(*) FILTER (decision = 'abstain' AND gate IS NULL) AS tokens_abstained FROM fin GROUP BY doc_id"
ORACLE["correct_tokens"] = f"WITH {CORRECTED} SELECT doc_id, pos, tok, corrected, error_type, decision, gate IS NOT NULL AS protected, gate, {milli('margin')} AS margin_milli FROM fin"
ORACLE["doc_summary"] = f"WITH {CORRECTED} {SUMMARY}"
ORACLE["edit_rate_report"] = f"WITH {CORRECTED} SELECT count(*) AS total_docs, count(*) FILTER (r > 0.01) AS alerts, {milli('round(avg(r), 6)')} AS mean_milli FROM (SELECT round(tokens_changed / total_tokens, 6) AS r FROM ({SUMMARY}))"
ORACLE["trace_filter"] = f"WITH {CORRECTED} SELECT coalesce(gate, 'none') AS gate, decision, error_type, count(*) AS n FROM fin GROUP BY ALL"
ORACLE["corrected_text"] = f"WITH {CORRECTED} SELECT doc_id, rtrim(string_agg(corrected || ws, '' ORDER BY pos)) AS corrected_text FROM fin GROUP BY doc_id"


ORACLE["respaced_text"] = rf"""WITH {LM}, t1 AS (SELECT *, lower(tok) AS tl, lower(lag(tok) OVER o) AS prev, lower(lead(tok) OVER o) AS next FROM (SELECT item_id, unnest(range(len(a))) AS pos, unnest(a) AS tok FROM (SELECT item_id, {TOKENS} AS a FROM benchmark)) WINDOW o AS (PARTITION BY item_id ORDER BY pos)), {DECIDE}
SELECT item_id, string_agg(corrected, ' ' ORDER BY pos) AS corrected_text FROM fin GROUP BY item_id"""
ORACLE["ratio_rule"] = f"""WITH {LM}, {PIECES_OF("(SELECT * FROM documents WHERE lang = 'en')", 'doc_id')}, ra AS (SELECT prev AS before, coalesce(sum(cnt) FILTER (word = 'and'), 0) AS was, coalesce(sum(cnt) FILTER (word = 'of'), 0) AS new FROM b GROUP BY prev)
SELECT doc_id, pos, tok, prev, 'of' AS by_ratio FROM t1 JOIN ra ON ra.before = t1.prev WHERE tl = 'and' AND new > 0 AND new >= 2 * (was + 1)"""


def uniform(*parts: str) -> str:
    return f"({hash_int(*parts)} / 4294967296.0)"


def letter(u: str) -> str:
    return f"substr('abcdefghijklmnopqrstuvwxyz', CAST(floor({u} * 26) AS BIGINT) + 1, 1)"


NOISE_STOP = "the and with from that this were was are for into over under than then have has had been being these those their there here such also using used".split()
_ns = ", ".join(f"'{x}'" for x in NOISE_STOP)
NOISE_TOKEN = r"([A-Za-z]+(?:[-''][A-Za-z0-9]+)*|\p{Nd}+(?:\.\p{Nd}+)?|[ \t\n\r\f\x0B]+|[^\p{L}\p{N}_ \t\n\r\f\x0B])"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
SCAN = "[" + ", ".join(f"{{'a': {_quoted(a)}, 'b': {_quoted(b)}}}" for a, b in OCR_PAIRS) + "]"


def alike(c: str, u: str) -> str:
    cases = " ".join(f"WHEN {c} = '{k}' THEN substr('{v}', CAST(floor({u} * {len(v)}) AS BIGINT) + 1, 1)" for k, v in CHARACTER_CONFUSIONS.items())
    return f"(CASE {cases} ELSE {letter(u)} END)"


def typo(w: str, op: str, at: str, let: str) -> str:
    """``w`` after one edit at place ``at`` (from 1)."""
    return f"""(CASE WHEN {op} = 'substitute' THEN substr({w}, 1, {at} - 1) || {alike(f'substr({w}, {at}, 1)', let)} || substr({w}, {at} + 1) WHEN {op} = 'delete' THEN substr({w}, 1, {at} - 1) || substr({w}, {at} + 1)
  WHEN {op} = 'insert' THEN substr({w}, 1, {at} - 1) || {letter(let)} || substr({w}, {at}) WHEN {op} = 'transpose' THEN substr({w}, 1, {at} - 1) || substr({w}, {at} + 1, 1) || substr({w}, {at}, 1) || substr({w}, {at} + 2) ELSE {w} END)"""


def recap(old: str, new: str) -> str:
    return f"(CASE WHEN regexp_matches({old}, '^[A-Z]') THEN upper(substr({new}, 1, 1)) || substr({new}, 2) ELSE {new} END)"


def edit_ctes(source: str, out: str, k: str, when: str) -> str:
    """CTEs that give the rows of ``source`` (seed_variant, pos, tok) one edit each where ``when`` holds."""
    u = lambda x: uniform("seed_variant", "pos", f"'{k}{x}'")
    return f"""{out}1 AS MATERIALIZED (SELECT *, lower(tok) AS w, {when} AS now, ['transpose', 'delete', 'insert', 'substitute'][CAST(floor({u('op')} * 4) AS BIGINT) + 1] AS op, list_filter({SCAN}, lambda p: contains(lower(tok), p['a'])) AS apt FROM {source}),
{out}2 AS MATERIALIZED (SELECT *, CAST(floor({u('at')} * (CASE WHEN op = 'transpose' THEN length(w) - 1 WHEN op = 'insert' THEN length(w) + 1 ELSE length(w) END)) AS BIGINT) + 1 AS pl, apt[CAST(floor({u('pair')} * len(apt)) AS BIGINT) + 1] AS pair FROM {out}1),
{out} AS MATERIALIZED (SELECT * EXCLUDE (tok, w, now, op, apt, pl, pair), CASE WHEN NOT now THEN tok WHEN {u('ocr')} < CAST(0.35 AS DOUBLE) AND len(apt) > 0 THEN {recap('tok', "(substr(w, 1, position(pair['a'] IN w) - 1) || pair['b'] || substr(w, position(pair['a'] IN w) + length(pair['a'])))")}
  ELSE {recap('tok', typo('w', 'op', 'pl', u('let')))} END AS tok FROM {out}2)"""


_v = lambda k: uniform("seed_variant", "pos", f"'{k}'")
ORACLE["noise_levels"] = f"""WITH l(corruption_level, p, m) AS (VALUES ('mild', 0.035, 1), ('moderate', 0.070, 1), ('severe', 0.110, 2)), v(variant_id) AS (VALUES (0), (1)),
r AS (SELECT item_id, text, corruption_level, CAST(p AS DOUBLE) AS p, m, CAST(variant_id AS BIGINT) AS variant_id, {hash_int('7', 'item_id', 'corruption_level', 'variant_id')} AS seed_variant FROM benchmark, l, v),
t AS (SELECT * EXCLUDE (text, a), unnest(range(len(a))) AS pos, unnest(a) AS tok FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '{NOISE_TOKEN}', 1) AS a FROM r)),
h AS (SELECT *, regexp_full_match(tok, '[A-Za-z]+') AS word, regexp_full_match(tok, '[A-Za-z]{{5,}}') AND lower(tok) NOT IN ({_ns}) AND {_v('hit')} < p AS hit FROM t),
{edit_ctes('h', 'one', 'a', 'hit')}, {edit_ctes('one', 'two', 'b', f"hit AND floor({_v('edits')} * m) + 1 > 1")},
f AS (SELECT *, CASE WHEN tok IN (',', '.', ';', ':') AND {_v('mark')} < p / 6 AND {_v('drop')} < CAST(0.5 AS DOUBLE) THEN '' ELSE tok END AS said FROM two)
SELECT item_id, corruption_level, variant_id, seed_variant, string_agg(said, '' ORDER BY pos) AS noisy_text, count(*) FILTER (hit) AS edited_tokens, count(*) FILTER (word) AS total_word_tokens FROM f GROUP BY ALL"""
_u = lambda k: uniform("11", "doc_id", "pos", f"'{k}'")
PAPER = f"""pn0 AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS tok FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{NOISE_TOKEN}', 1) AS a FROM documents WHERE lang = 'en')),
pn1 AS (SELECT *, lower(tok) AS w, regexp_full_match(tok, '[A-Za-z]+') AS word, regexp_full_match(tok, '[A-Za-z]+') AND {_u('hit')} < CAST(0.15 AS DOUBLE) / sqrt(length(tok)) AS hit, CASE WHEN {_u('op')} < 0.5 THEN 'substitute' WHEN {_u('op')} >= 0.75 THEN 'insert' WHEN length(tok) > 1 THEN 'delete' ELSE 'none' END AS op FROM pn0),
pn2 AS (SELECT *, CAST(floor({_u('at')} * (CASE WHEN op = 'insert' THEN length(w) + 1 ELSE length(w) END)) AS BIGINT) + 1 AS pl FROM pn1),
noisy AS (SELECT doc_id, string_agg(CASE WHEN hit THEN {recap('tok', typo('w', 'op', 'pl', _u('let')))} ELSE tok END, '' ORDER BY pos) AS noisy_text, count(*) FILTER (hit) AS edited_tokens, count(*) FILTER (word) AS total_word_tokens FROM pn2 GROUP BY doc_id)"""
ORACLE["noise_paper"] = f"WITH {PAPER} SELECT doc_id AS row_id, noisy_text, edited_tokens, total_word_tokens FROM noisy"

TF = f"""{W}, lw AS (SELECT doc_id, quality, a FROM labels JOIN w USING (doc_id) WHERE quality IS NOT NULL AND len(a) > 0), nd AS (SELECT count(*) AS n FROM lw),
tf AS (SELECT doc_id, quality, term, count(*) AS tf FROM (SELECT doc_id, quality, unnest(a) AS term FROM lw UNION ALL SELECT doc_id, quality, unnest(a[1:len(a)-1]) || ' ' || unnest(a[2:len(a)]) FROM lw WHERE len(a) > 1) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf, nd GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.95 * n)"""
WEIGHT = "raw AS (SELECT doc_id, term, tf, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS raw FROM tf JOIN df USING (term), nd), wt AS (SELECT doc_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"
BAYES = """cn AS (SELECT quality, term, sum(tf) AS n FROM tf GROUP BY ALL), vv AS (SELECT count(DISTINCT term) AS v FROM tf), ct AS (SELECT quality, sum(n) AS total FROM cn GROUP BY quality),
m AS (SELECT quality, term, ln((n + 1) / (total + v)) AS logp FROM cn JOIN ct USING (quality), vv)"""
ORACLE["doc_frequency"] = f"WITH {TF} SELECT * FROM df"
ORACLE["tfidf"] = f"WITH {TF}, {WEIGHT} SELECT doc_id, term, tf, {milli('weight')} AS weight_milli FROM wt"
ORACLE["naive_bayes"] = f"""WITH {TF}, {BAYES}, pr AS (SELECT quality, count(*) AS nd, (SELECT n FROM nd) AS alld FROM lw GROUP BY quality),
g AS (SELECT d.doc_id, ct.quality, ln(nd / alld) + d.len * ln(1 / (total + v)) + coalesce((SELECT sum(tf.tf * (m.logp - ln(1 / (total + v)))) FROM tf JOIN m ON m.term = tf.term AND m.quality = ct.quality WHERE tf.doc_id = d.doc_id), 0) AS score
  FROM (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id) AS d CROSS JOIN ct JOIN pr ON pr.quality = ct.quality, vv)
SELECT doc_id, quality AS predicted FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, quality) = 1"""
ORACLE["explain_terms"] = f"""WITH {TF}, {WEIGHT}, {BAYES}, co AS (SELECT term, sum(CASE WHEN quality = 1 THEN logp ELSE -logp END) AS c FROM m GROUP BY term)
SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight * c, 9) DESC, term) AS rank FROM wt JOIN co USING (term) QUALIFY rank <= 15"""

BOTH = "(SELECT 'clean' AS run, doc_id, text FROM sp WHERE is_test UNION ALL SELECT 'noisy', doc_id, noisy_text FROM sp JOIN noisy USING (doc_id) WHERE is_test)"
_grams = lambda source, keep: f"SELECT {keep}, unnest(a) AS term FROM {source} UNION ALL SELECT {keep}, unnest(a[1:len(a)-1]) || ' ' || unnest(a[2:len(a)]) FROM {source} WHERE len(a) > 1"
PRED = f"""{LM}, {PAPER}, sp AS (SELECT doc_id, quality, text, row_number() OVER (PARTITION BY quality ORDER BY {hash_int('42', 'doc_id')}, doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.2 + 0.5) AS is_test
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND lang = 'en'),
{PIECES_OF(BOTH, 'run, doc_id')}, {DECIDE},
tx AS (SELECT 'original' AS run, doc_id, text FROM sp WHERE is_test UNION ALL SELECT 'noisy', doc_id, noisy_text FROM sp JOIN noisy USING (doc_id) WHERE is_test
  UNION ALL SELECT CASE WHEN run = 'noisy' THEN 'restored' ELSE 'safety' END, doc_id, rtrim(string_agg(corrected || ws, '' ORDER BY pos)) FROM fin GROUP BY run, doc_id),
ta AS (SELECT doc_id, quality, {WORDS} AS a FROM sp WHERE NOT is_test), xa AS (SELECT run, doc_id, {WORDS} AS a FROM tx),
mg AS (SELECT quality, term, count(*) AS n FROM ({_grams('ta', 'quality')}) GROUP BY ALL), mv AS (SELECT count(DISTINCT term) AS nv FROM mg), mc AS (SELECT quality, sum(n) AS total FROM mg GROUP BY quality),
md AS (SELECT quality, count(*) AS nd, sum(count(*)) OVER () AS alld FROM ta WHERE len(a) > 0 GROUP BY quality),
xg AS (SELECT run, doc_id, term, count(*) AS tf FROM ({_grams('xa', 'run, doc_id')}) GROUP BY ALL),
gain AS (SELECT run, doc_id, quality, sum(tf * (ln((n + 1) / (total + nv)) - ln(1 / (total + nv)))) AS g FROM xg JOIN mg USING (term) JOIN mc USING (quality), mv GROUP BY ALL),
best_class AS (SELECT run, doc_id, quality FROM (SELECT l.run, l.doc_id, mc.quality, ln(nd / alld) + l.len * ln(1 / (total + nv)) + coalesce(g, 0) AS score FROM (SELECT run, doc_id, sum(tf) AS len FROM xg GROUP BY ALL) AS l CROSS JOIN mc JOIN md USING (quality) CROSS JOIN mv
  LEFT JOIN gain ON gain.run = l.run AND gain.doc_id = l.doc_id AND gain.quality = mc.quality) QUALIFY row_number() OVER (PARTITION BY run, doc_id ORDER BY round(score, 6) DESC, quality) = 1),
p AS (SELECT sp.doc_id, sp.quality AS truth, a1.quality AS original, a2.quality AS noisy, a3.quality AS restored, a4.quality AS safety FROM sp
  JOIN best_class AS a1 ON a1.run = 'original' AND a1.doc_id = sp.doc_id JOIN best_class AS a2 ON a2.run = 'noisy' AND a2.doc_id = sp.doc_id JOIN best_class AS a3 ON a3.run = 'restored' AND a3.doc_id = sp.doc_id JOIN best_class AS a4 ON a4.run = 'safety' AND a4.doc_id = sp.doc_id)"""
ORACLE["four_runs"] = f"WITH {PRED} SELECT * FROM p"


def per_class(run: str) -> str:
    return f"SELECT l.label, count(*) FILTER (truth = l.label) AS support, count(*) FILTER ({run} = l.label) AS guessed, count(*) FILTER (truth = l.label AND {run} = l.label) AS tp FROM p, (SELECT truth AS label FROM p UNION SELECT {run} FROM p) AS l GROUP BY l.label"


def f1(run: str) -> str:
    return f"(SELECT avg(2.0 * tp / (support + guessed)) FROM ({per_class(run)}))"


ORACLE["confusion"] = f"WITH {PRED} SELECT truth, noisy AS predicted, count(*) AS n FROM p GROUP BY ALL"
ORACLE["class_report"] = f"WITH {PRED} SELECT label, support, {milli('CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END')} AS precision_milli, {milli('CASE WHEN support > 0 THEN tp / support ELSE 0 END')} AS recall_milli, {milli('2.0 * tp / (support + guessed)')} AS f1_milli FROM ({per_class('noisy')})"
ORACLE["macro_f1"] = f"WITH {PRED} SELECT {milli('(SELECT avg(CASE WHEN truth = restored THEN 1.0 ELSE 0.0 END) FROM p)')} AS accuracy_milli, {milli(f1('restored'))} AS f1_milli"
ORACLE["impact_deltas"] = f"""WITH {PRED}, f AS (SELECT {f1('original')} AS o, {f1('noisy')} AS n, {f1('restored')} AS r, {f1('safety')} AS s)
SELECT {milli('(r - n)')} AS delta_recovery_milli, {milli('(o - s)')} AS safety_drop_milli, {milli('(CASE WHEN o - n > 1e-12 THEN (r - n) / (o - n) END)')} AS err_recovery_milli, {milli('(CASE WHEN 1 - n > 1e-12 THEN (r - n) / (1 - n) END)')} AS err_alternative_milli FROM f"""
ORACLE["label_flips"] = f"WITH {PRED} SELECT doc_id, CAST(noisy IS DISTINCT FROM restored AS BIGINT) AS flip FROM p"
_share = lambda c: f"(SELECT CAST({c} AS VARCHAR) AS label, count(*) / (SELECT count(*) FROM p) AS q FROM p GROUP BY 1)"
ORACLE["prob_shift"] = f"WITH {PRED} SELECT coalesce(a.label, b.label) AS label, {milli('coalesce(a.q, 0)')} AS before_milli, {milli('coalesce(b.q, 0)')} AS after_milli, {milli('(coalesce(b.q, 0) - coalesce(a.q, 0))')} AS delta_milli FROM {_share('noisy')} AS a FULL JOIN {_share('safety')} AS b ON a.label = b.label"

_k = lambda k: uniform(f"'{k}'", "word")
_place = lambda k, n: f"CAST(floor({_k(k)} * ({n})) AS BIGINT) + 1"
_other = lambda c: f"chr(CAST((ascii({c}) - 97 + floor({_k('let')} * 25) + 1) % 26 + 97 AS INTEGER))"
_swap = lambda w, i: f"substr({w}, 1, {i} - 1) || substr({w}, {i} + 1, 1) || substr({w}, {i}, 1) || substr({w}, {i} + 2)"
_put = lambda w, i: f"substr({w}, 1, {i} - 1) || {_other(f'substr({w}, {i}, 1)')} || substr({w}, {i} + 1)"
_covid = ", ".join(f"('covid-18-variant', '{v}')" for v in COVID_18) + ", " + ", ".join(f"('variant', '{v}')" for v in COVID_VARIANTS)
_seen = lambda a, b, name: f"LEFT JOIN b AS {name} ON {name}.prev = rp.{a} AND {name}.word = rp.{b}"
_strong = lambda x, y: f"round(log10((coalesce({x}.cnt, 0) + 1.0) / (coalesce({y}.cnt, 0) + 1.0)), 9)"
CASES = f"""cl AS (SELECT word, first(prev ORDER BY cnt DESC, prev) AS prev FROM b GROUP BY word), cr AS (SELECT prev AS word, first(b.word ORDER BY cnt DESC, b.word) AS next FROM b GROUP BY prev),
tc0 AS MATERIALIZED (SELECT word, cnt, length(word) AS n, {hash_int("'kind'", 'word')} % 10 AS draw, ['trans', 'rep', 'ins', 'del', 'dist2_del_rep'][CAST(floor({_k('op')} * 5) AS BIGINT) + 1] AS op FROM u WHERE cnt >= 20 AND regexp_full_match(word, '[a-z]{{4,14}}') AND word NOT IN ({_protect})),
tc1 AS MATERIALIZED (SELECT *, CASE WHEN draw = 0 THEN 'negative' WHEN draw <= 2 AND cnt >= 50 THEN 'general-english' ELSE 'non-word' END AS category, {_place('at', 'n')} AS i, {_place('at', 'n - 1')} AS j, {_place('at', 'n + 1')} AS h, {_place('at2', 'n - 1')} AS i2 FROM tc0),
tc2 AS MATERIALIZED (SELECT *, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM tc1),
tc3 AS (SELECT word, cnt, category, CASE WHEN category = 'negative' THEN 'do-no-harm' ELSE op END AS subcategory, CASE WHEN category = 'negative' THEN word WHEN op = 'trans' THEN {_swap('word', 'j')} WHEN op = 'rep' THEN {_put('word', 'i')} WHEN op = 'ins' THEN substr(word, 1, h - 1) || {letter(_k('let'))} || substr(word, h) WHEN op = 'del' THEN shorter ELSE {_put('shorter', 'i2')} END AS wrong FROM tc2),
typos AS (SELECT category, subcategory, cl.prev, wrong, cr.next, tc3.word AS expected, cnt FROM tc3 LEFT JOIN cl USING (word) LEFT JOIN cr ON cr.word = tc3.word WHERE category = 'negative' OR wrong <> tc3.word)"""
REAL = f"""uu AS (SELECT * FROM u WHERE cnt >= 10 AND length(word) >= 4), ask AS (SELECT * FROM uu ORDER BY cnt DESC, word LIMIT 2500), {near('SELECT word AS tok FROM ask', rank=False, p='r', u='uu')},
rp AS (SELECT tok AS expected, cand AS wrong, ask.cnt, rn.cnt AS wrong_cnt, cl.prev, cr.next FROM (SELECT * FROM rn WHERE dist = 1 QUALIFY row_number() OVER (PARTITION BY tok ORDER BY cnt DESC, cand) <= 8) AS rn JOIN ask ON ask.word = tok LEFT JOIN cl ON cl.word = tok LEFT JOIN cr ON cr.word = tok),
rq AS (SELECT rp.*, lo.cnt AS lo, lw.cnt AS lw, ro.cnt AS ro, rw.cnt AS rw, {_strong('lo', 'lw')} AS ls, {_strong('ro', 'rw')} AS rs FROM rp {_seen('prev', 'expected', 'lo')} {_seen('prev', 'wrong', 'lw')} {_seen('expected', 'next', 'ro')} {_seen('wrong', 'next', 'rw')}),
reals AS (SELECT *, CASE WHEN ls >= 0.8 AND lo >= 2 AND rs >= 0.8 AND ro >= 2 THEN 'both-needed' WHEN ls >= 0.8 AND lo >= 2 AND rs <= 0.2 THEN 'left-only' WHEN rs >= 0.8 AND ro >= 2 AND ls <= 0.2 THEN 'right-only' ELSE 'either-side' END AS subcategory FROM rq)"""
ALL_CASES = f"""{LM}, {CASES}, {REAL}, c AS (SELECT *, concat_ws('|', category, subcategory, coalesce(prev, ''), wrong, coalesce(next, ''), expected) AS case_id FROM (SELECT * FROM typos UNION SELECT 'real-word', subcategory, prev, wrong, next, expected, cnt FROM reals
  UNION SELECT 'covid-normalization', v.s, NULL, v.w, NULL, 'covid-19', 0 FROM (VALUES {_covid}) AS v(s, w)))"""
FIXED = f"""{ALL_CASES}, t1 AS (SELECT case_id, category, subcategory, expected, wrong, wrong AS tok, lower(wrong) AS tl, prev, next FROM c), {DECIDE}"""
ORACLE["mined_cases"] = f"WITH {ALL_CASES} SELECT case_id, category, subcategory, prev, wrong, next, expected, CAST(cnt AS BIGINT) AS cnt FROM c"
ORACLE["case_histogram"] = f"WITH {ALL_CASES} SELECT category, subcategory, count(*) AS n FROM c GROUP BY ALL"
ORACLE["category_breakdown"] = f"""WITH {FIXED} SELECT category, count(*) AS n_total, count(*) FILTER (expected <> wrong) AS n_error, count(*) FILTER (expected = wrong) AS n_negative,
  {milli('(100 * count(*) FILTER (expected <> wrong AND corrected = expected) / nullif(count(*) FILTER (expected <> wrong), 0))')} AS recall_milli, {milli('(100 * count(*) FILTER (expected = wrong AND corrected <> expected) / nullif(count(*) FILTER (expected = wrong), 0))')} AS fpr_milli FROM fin GROUP BY category"""
ORACLE["intrinsic_metrics"] = f"WITH {FIXED} SELECT count(*) FILTER (category <> 'negative') AS total_errors, count(*) FILTER (category = 'negative') AS total_negatives, count(*) FILTER (category <> 'negative' AND corrected = expected) AS hits, count(*) FILTER (category = 'negative' AND corrected <> expected) AS harmful FROM fin"
ORACLE["overall_rates"] = f"""WITH {FIXED}, k AS (SELECT count(*) FILTER (expected <> wrong AND corrected = expected) AS tp, count(*) FILTER (expected <> wrong AND corrected <> expected) AS fn, count(*) FILTER (expected = wrong AND corrected = expected) AS tn, count(*) FILTER (expected = wrong AND corrected <> expected) AS fp FROM fin)
SELECT tp, fn, tn, fp, {milli('(100 * tp / nullif(tp + fn, 0))')} AS recall_milli, {milli('(100 * fp / nullif(fp + tn, 0))')} AS fpr_milli FROM k"""
TUNED = f"""{LM}, {CASES}, t1 AS (SELECT expected, wrong, wrong AS tok, lower(wrong) AS tl, prev, next FROM typos), {DECIDE},
g AS (SELECT CAST(d * 27 + (rw - 4) * 9 + wi * 3 + li AS BIGINT) AS ordinal, CAST(d AS DOUBLE) AS delta, CAST(rw AS DOUBLE) AS delta_rw, CAST([1.8, 2.2, 2.6][wi + 1] AS DOUBLE) AS w_dist, CAST([1.0, 1.2, 1.4][li + 1] AS DOUBLE) AS w_left FROM range(3) AS a(d), range(4, 7) AS b2(rw), range(3) AS c2(wi), range(3) AS e(li)),
gs AS (SELECT g.*, sc.* EXCLUDE (score), score + (w_left - CAST(1.2 AS DOUBLE)) * ll - (w_dist - CAST(2.2 AS DOUBLE)) * dist AS score FROM sc, g),
gb AS (SELECT * FROM gs WHERE known OR rnk > 0 QUALIFY row_number() OVER (PARTITION BY ordinal, tl, prev, next, known ORDER BY round(score, 9) DESC, rnk) = 1),
gw AS (SELECT gb.ordinal, gb.tl, gb.prev, gb.next, gb.cand FROM gb JOIN gs AS o ON o.rnk = 0 AND o.ordinal = gb.ordinal AND o.tl = gb.tl AND o.prev IS NOT DISTINCT FROM gb.prev AND o.next IS NOT DISTINCT FROM gb.next WHERE gb.rnk > 0 AND round(gb.score - o.score, 9) >= (CASE WHEN gb.known THEN gb.delta_rw ELSE gb.delta END)),
gc AS (SELECT g.*, fin.wrong, fin.expected, CASE WHEN fin.open THEN coalesce(gw.cand, fin.wrong) ELSE fin.corrected END AS made FROM fin CROSS JOIN g LEFT JOIN gw ON fin.open AND gw.ordinal = g.ordinal AND gw.tl = fin.tl AND gw.prev IS NOT DISTINCT FROM fin.prev AND gw.next IS NOT DISTINCT FROM fin.next),
tr AS (SELECT ordinal, delta, delta_rw, w_dist, w_left, count(*) FILTER (wrong <> expected) AS total_errors, count(*) FILTER (wrong = expected) AS total_negatives, count(*) FILTER (wrong <> expected AND made = expected) AS hits, count(*) FILTER (wrong = expected AND made <> expected) AS harmful FROM gc GROUP BY ALL),
tm AS (SELECT *, {milli('(100 * hits / total_errors)')} AS recall_milli FROM tr)"""
ORACLE["tuning_results"] = f"WITH {TUNED} SELECT * FROM tm"
ORACLE["tuning_select"] = f"WITH {TUNED} SELECT ordinal, delta, delta_rw, w_dist, w_left, recall_milli FROM tm WHERE harmful = 0 ORDER BY recall_milli DESC, ordinal LIMIT 1"
_hard = """round(CASE WHEN category = 'real-word' THEN 10.0 + CASE subcategory WHEN 'both-needed' THEN 3 WHEN 'right-only' THEN 2 WHEN 'left-only' THEN 1 ELSE 0 END
  WHEN category = 'non-word' THEN 7.0 + CASE subcategory WHEN 'dist2_del_rep' THEN 3 WHEN 'trans' THEN 2 WHEN 'rep' THEN 1 ELSE 0 END WHEN category = 'covid-normalization' THEN 6.0
  WHEN category = 'general-english' THEN 5.0 + CASE subcategory WHEN 'dist2_del_rep' THEN 2 ELSE 0 END ELSE 1.0 END + CAST(0.12 AS DOUBLE) * length(wrong) + CAST(0.05 AS DOUBLE) * length(expected), 6)"""
ORACLE["case_hardness"] = f"WITH {ALL_CASES} SELECT case_id, {milli(_hard)} AS hardness_milli FROM c"


def hard_picks() -> str:
    """One CTE a kind, in the order of the quota: its rows in order, less what the caps leave no room for."""
    out, had = [], {}
    for i, (cat, sub, n) in enumerate(QUOTA):
        cap = 1 if cat == "covid-normalization" else 2
        before = " UNION ALL ".join(f"SELECT wrong, expected FROM h{k}" for k in had.get(cat, [])) or "SELECT '' AS wrong, '' AS expected WHERE false"
        out.append(f"""h{i} AS (SELECT *, row_number() OVER (ORDER BY hardness DESC, case_id) AS place FROM (SELECT * FROM (SELECT * FROM hc WHERE category = '{cat}' AND subcategory = '{sub}'
  QUALIFY row_number() OVER (PARTITION BY wrong, expected ORDER BY hardness DESC, case_id) + (SELECT count(*) FROM ({before}) AS q WHERE q.wrong = hc.wrong AND q.expected = hc.expected) <= 2)  AS hp
  QUALIFY row_number() OVER (PARTITION BY wrong ORDER BY hardness DESC, case_id) + (SELECT count(*) FROM ({before}) AS q WHERE q.wrong = hp.wrong) <= {cap}) QUALIFY place <= {n})""")
        had.setdefault(cat, []).append(i)
    return ", ".join(out)


ORACLE["hard_subset"] = f"WITH {ALL_CASES}, hc AS (SELECT *, {_hard} AS hardness FROM c), {hard_picks()} " + " UNION ALL ".join(f"SELECT category, subcategory, case_id, place FROM h{i}" for i in range(len(QUOTA)))
_zipf = "round(log10(wrong_cnt + 1), 9)"
_sup, _was = "(coalesce(lo, 0) + coalesce(ro, 0))", "(coalesce(lw, 0) + coalesce(rw, 0))"
_asked = f"""round(greatest(CAST(5 AS DOUBLE) - 0.4 + CASE WHEN {_zipf} >= 5.5 THEN 1.0 WHEN {_zipf} >= 4.5 THEN 0.6 WHEN {_zipf} <= 2.0 THEN -0.7 WHEN {_zipf} <= 2.5 THEN -0.4 ELSE 0 END
  - least(CASE WHEN {_sup} > 0 THEN greatest(0, least(3, log10(({_sup} + 1.0) / ({_was} + 1.0)) * 1.3)) + CASE WHEN {_sup} >= 50 THEN 0.5 ELSE 0 END + CASE WHEN {_sup} >= 200 THEN 0.5 ELSE 0 END ELSE 0 END
  + greatest(0, least(1, log10((cnt + 1.0) / (wrong_cnt + 1.0)) * 0.8)), 4), 1.5), 6)"""
ORACLE["adaptive_threshold"] = f"WITH {LM}, {CASES}, {REAL} SELECT wrong, expected, subcategory, {milli(_asked)} AS asked_milli FROM reals"
ORACLE["ui_gates"] = rf"""SELECT tok, NOT regexp_matches(tok, '\p{{L}}') OR length(tok) < 3 OR length(tok) >= 26 AND NOT regexp_full_match(lower(tok), 'covid|covid19|covid-?19|sars-?cov-?2|2019-?ncov|ncov')
  OR regexp_matches(tok, '[0-9<>=/\\+*%_\x{{0370}}-\x{{03FF}}\x{{1F00}}-\x{{1FFF}}]') AND NOT regexp_full_match(lower(tok), 'covid|covid19|covid-?19|sars-?cov-?2|2019-?ncov|ncov') AS left_alone
FROM (SELECT DISTINCT tok FROM (SELECT unnest(regexp_extract_all(text, '{PIECE}', 1)) AS tok FROM conversations UNION ALL SELECT unnest([{", ".join("'" + t + "'" for t in UI_TOKENS)}])))"""
ALPHABETIC = rf"""t0 AS (SELECT item_id, unnest(range(len(a))) AS pos, unnest(a) AS tok, unnest(ws) AS ws FROM (SELECT item_id, regexp_extract_all(text, '{PIECE}', 1) AS a, regexp_extract_all(text, '{PIECE}', 2) AS ws FROM benchmark)),
ta AS (SELECT *, CASE WHEN regexp_full_match(tok, '\p{{L}}+') THEN lower(tok) END AS al FROM t0),
tb AS (SELECT item_id, pos, tok, ws, last_value(al IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, first_value(al IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM ta)"""
ORACLE["alphabetic_context"] = f"WITH {ALPHABETIC} SELECT item_id, pos, tok, prev, next FROM tb"
_alone = ORACLE["ui_gates"][len("SELECT tok, ") : ORACLE["ui_gates"].index(" AS left_alone")]
ORACLE["interactive_correction"] = rf"""WITH {LM}, {ALPHABETIC}, t1 AS (SELECT item_id, pos, tok, ws, lower(tok) AS tl, prev, next FROM tb WHERE NOT ({_alone})), {DECIDE}
SELECT item_id, pos, tok, CASE WHEN tok = upper(tok) AND tok <> lower(tok) AND length(tok) > 1 THEN upper(corrected) WHEN substr(tok, 1, 1) = upper(substr(tok, 1, 1)) AND substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) THEN upper(substr(corrected, 1, 1)) || substr(corrected, 2) ELSE corrected END AS corrected, error_type FROM fin
UNION ALL SELECT item_id, pos, tok, tok, 'Correct' FROM tb WHERE {_alone}"""
ORACLE["confusion_pairs"] = f"""WITH {W}, u AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(a) AS word FROM w) GROUP BY word HAVING count(*) >= 10 AND length(word) >= 4), {near('SELECT word AS tok FROM u', rank=False)}
SELECT tok AS expected, cand AS wrong, row_number() OVER (PARTITION BY tok ORDER BY cnt DESC, cand) AS k FROM n WHERE dist = 1 QUALIFY k <= 8"""
