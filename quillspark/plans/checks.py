"""SQL for DuckDB that says the same as each query, written from the definitions. RE2 has no
lookaround and knows ASCII words only, so word limits are spelled out."""

from __future__ import annotations

from ..functions import rules
from .queries import ENTRY, KEYS, LIBRARY, MADE, PARTS

W = r"\pL\pN_"


def limits(p: str) -> str:
    """A test pattern with \\b at its ends spelled out."""
    if p.startswith(r"\b"):
        p = rf"(?:^|[^{W}])" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + rf"(?:$|[^{W}])"
    return p


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_in(items) -> str:
    return "(" + ", ".join(quote(w) for w in items) + ")"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def sents(text: str, cols: str, source: str = "documents") -> str:
    cut = rf"regexp_replace(regexp_replace({text}, '(\\cite[pt]?\{{[^}}]+\}})', ' \1 ', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    parts = f"list_filter(list_transform(regexp_split_to_array({cut}, chr(1) || '|' || chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"
    return f"(SELECT {cols}, idx, sentence FROM (SELECT {cols}, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS idx FROM (SELECT {cols}, {parts} AS p FROM {source})) WHERE length(sentence) >= 20)"


def need(sent: str) -> str:
    tag = lambda table, pre: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(sentence, {quote(limits(p))}, 'i') THEN {quote(pre + t)} END" for p, t in table) + "], lambda x: x IS NOT NULL)"
    tech = rf"len(list_filter(regexp_extract_all(sentence, '[{W}]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+(ing|tion|ment|ness|ity)')))"
    return rf"""
t AS (SELECT *, {tag(rules.NEED, "")} AS a, {tag(rules.COMMON, "reduced:")} AS b FROM {sent}),
s1 AS (SELECT *, len(a) * 0.25::DOUBLE AS x1 FROM t),
s2 AS (SELECT *, CASE len(b) WHEN 0 THEN x1 WHEN 1 THEN x1 - 0.15::DOUBLE WHEN 2 THEN x1 - 0.15::DOUBLE - 0.15::DOUBLE WHEN 3 THEN x1 - 0.15::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE ELSE x1 - 0.15::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE END AS x2 FROM s1),
s3 AS (SELECT *, CASE WHEN len(regexp_split_to_array(sentence, '\s+')) > 15 AND x2 > 0 THEN x2 + 0.1::DOUBLE ELSE x2 END AS x3 FROM s2),
s4 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x3 + 0.1::DOUBLE * least({tech}, 3))) AS confidence, list_concat(a, b) AS tags FROM s3)"""


def cites(text: str) -> str:
    alls = ", ".join(f"regexp_extract_all({text}, {quote(p)}, {g})" for p, g in rules.CITATIONS)
    return f"list_filter(list_transform(flatten([{alls}]), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


def plain(text: str) -> str:
    for p, by in ((r"\\textbf\{([^}]*)\}", r"\1"), (r"\\textit\{([^}]*)\}", r"\1"), (r"\\[a-zA-Z]+\{([^}]*)\}", r"\1"), (r"\$([^$]*)\$", r"\1"), (r"\\[a-zA-Z]+", " "), (r"[{}]", " "), (r"\s+", " ")):
        text = f"regexp_replace({text}, '{p}', '{by}', 'g')"
    return f"trim({text})"


def bounded(text: str, inner: str, trail: str = "") -> str:
    """Matches of [A-Za-z][inner]+ between word limits. Letters outside ASCII become a mark that
    belongs to words; runs with it hold no match."""
    runs = rf"regexp_extract_all(regexp_replace({text}, '[^\x00-\x7F]', chr(1), 'g'), '[A-Za-z0-9_{inner}' || chr(1) || '-]+')"
    return rf"list_filter(list_transform({runs}, lambda x: regexp_replace(regexp_replace(x, '^([0-9_][A-Za-z0-9_]*)?[-/]+', ''), '[{inner}-]+$', '')), lambda x: regexp_full_match(x, '[A-Za-z][A-Za-z0-9{inner}-]+'))"


def ordered(list_sql: str) -> str:
    """First appearances, in order."""
    return f"list_transform(list_sort(list_transform(list_distinct({list_sql}), lambda d: {{'i': list_position({list_sql}, d), 'd': d}})), lambda r: r.d)"


def terms(text: str, name: str, source: str) -> str:
    """CTE name(…, terms) over source's columns; text is an expression of it."""
    return rf"""
{name}0 AS (SELECT *, {plain(text)} AS p FROM {source}),
{name}1 AS (SELECT *, list_filter({bounded("lower(p)", "_")}, lambda x: x NOT IN {words_in(rules.STOP_WORDS)}) AS w0, list_transform(list_filter(regexp_extract_all(' ' || regexp_replace(p, '([{W}]+)', ' \1 ', 'g') || ' ', '( [A-Z][a-z]+ (?:\s+ [A-Z][a-z]+ )+)', 1), lambda x: true), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS ph,
  list_filter(regexp_extract_all(lower(p), '[{W}]+'), lambda x: x IN {words_in(rules.DOMAIN_TERMS)}) AS sp FROM {name}0),
{name}2 AS (SELECT *, {ordered("w0")} AS w, {ordered("sp")} AS s FROM {name}1),
{name} AS (SELECT * EXCLUDE (p, w0, ph, sp, w, s), list_slice(list_concat(list_reverse(list_filter(s, lambda x: NOT list_contains(w, x))), list_concat(w, ph)), 1, 8) AS terms FROM {name}2)"""


def anchors(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({plain(text)}), {quote(limits(p))}) THEN {quote(n)} END" for n, p in rules.ANCHORS) + "], lambda x: x IS NOT NULL)"


def doi_sql(x: str) -> dict[str, str]:
    x = f"trim({x})"
    rest = rf"regexp_replace({x}, '^(https://doi\.org/|http://doi\.org/|doi:)', '', 'i')"
    doi = r"""'10\.\d{4,9}/[^\s\?"<>#]+'"""
    n = lambda s, p, g=0: f"nullif(regexp_extract({s}, {p}, {g}), '')"
    norm = rf"""CASE WHEN {x} LIKE '10.%' THEN {x} WHEN {rest} LIKE '10.%' THEN rtrim({rest}, '/') ELSE coalesce({n(rest, doi)}, {n(rest, r"'^(\d{4}\.\d{4,5})'", 1)}, {n(rest, r"'arxiv\.org/(?:abs|pdf)/(\d+\.\d+)'", 1)}, {rest}) END"""
    return {"x": x, "norm": norm, "clean": f"rtrim({norm}, '/')", "url_doi": f"rtrim({n(x, doi)}, '/')", "arxiv": n(x, r"'arxiv\.org/(?:abs|pdf)/(\d+\.\d+)'", 1), "pmid": n(x, r"'pubmed\.ncbi\.nlm\.nih\.gov/(\d+)'", 1)}


def url_sql(u: str) -> str:
    return rf"""(SELECT lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)) || rtrim(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/')
  || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda q: regexp_matches(q, '=.+') AND NOT regexp_matches(q, '^(utm_|fbclid|gclid)', 'i')), '&'), ''), ''))"""


def sql() -> dict[str, str]:
    e = {n: x for n, x in ENTRY.items()}
    d = doi_sql(MADE["identifier"])
    out = {}
    out["q_sentence_split"] = f"SELECT doc_id, idx, sentence FROM {sents('text', 'doc_id')}"
    out["q_citation_need"] = f"WITH {need(sents('text', 'doc_id'))} SELECT doc_id, idx, confidence, confidence >= 0.3 AND len({cites('sentence')}) = 0 AS needs_citation, CASE WHEN len({cites('sentence')}) > 0 THEN 'Already has citation' WHEN confidence >= 0.3 THEN 'Citation recommended: ' || array_to_string(tags[1:3], ', ') ELSE 'Common knowledge or opinion statement' END AS reason FROM s4"
    made_docs = f"(SELECT lang, {MADE['cited']} AS text FROM documents)"
    out["q_audit_counts"] = f"WITH {need(sents('text', 'lang', made_docs))}, c AS (SELECT lang, confidence, len({cites('sentence')}) > 0 AS has FROM s4) SELECT lang, count(*) AS total, count(*) FILTER (has) AS with_citations, count(*) FILTER (NOT has AND confidence >= 0.3) AS needing, count(*) FILTER (NOT has AND confidence < 0.3) AS ok FROM c GROUP BY lang"
    out["q_find_citations"] = f"SELECT doc_id, array_to_string({cites(MADE['cited'])}, '|') AS citations FROM documents"
    out["q_search_terms"] = f"WITH {terms('text', 't', '(SELECT doc_id, text FROM documents)')} SELECT doc_id, array_to_string(terms, '|') AS terms FROM t"
    out["q_title_terms"] = f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({bounded('lower(' + plain('text') + ')', '/', '/')}, lambda x: length(x) > 2 AND x NOT IN {words_in(rules.TITLE_STOP_WORDS)}))), '|') AS terms FROM benchmark"
    claim = r"'(\d+(?:\.\d+)?)\s*(%|[A-Za-zμµ]+)?'"
    out["q_quant_claims"] = f"SELECT doc_id, array_to_string(regexp_extract_all(text, {claim}, 1), '|') AS vals, array_to_string(list_transform(regexp_extract_all(text, {claim}, 2), lambda x: coalesce(x, '')), '|') AS units FROM documents"
    hit = r"'\d+(?:\.\d+)?\s*(?:%|[A-Za-zμµ]+)?'"
    out["q_claim_snippets"] = rf"""WITH a AS (SELECT doc_id, text, regexp_extract_all(text, {hit}) AS h, string_split(regexp_replace(text, {hit}, chr(1), 'g'), chr(1)) AS g FROM documents),
b AS (SELECT doc_id, text, i, h[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS k FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM a)),
c AS (SELECT doc_id, string_agg({STRIP.format('substr(text, (greatest(0, k - 18) + 1)::BIGINT, (k + length(m) + 18 - greatest(0, k - 18))::BIGINT)')}, '|' ORDER BY i) AS s FROM b GROUP BY doc_id) SELECT doc_id, coalesce(s, '') AS snippets FROM documents LEFT JOIN c USING (doc_id)"""
    out["q_anchor_terms"] = f"SELECT doc_id, array_to_string({anchors(MADE['anchored'])}, '|') AS anchors FROM documents"
    out["q_strip_latex"] = f"SELECT doc_id, {plain(MADE['latex'])} AS plain FROM documents"
    out["q_titles"] = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' of {$T_c$} in ' || p_brand WHEN 1 THEN p_name || ' of {$T_c$} in ' || p_brand WHEN 2 THEN p_name || ' in NbSe2' WHEN 3 THEN p_name || ' {$T_c$} of ' || p_brand WHEN 4 THEN p_name || ' {$x$} of ' || p_brand ELSE '3He ' || p_name END AS bibtex, CASE p_partkey % 6 WHEN 0 THEN p_name || ' of Tc in ' || p_brand WHEN 1 THEN p_name || ' of Tc in ' || p_brand WHEN 2 THEN p_name || ' in NbSe2' WHEN 3 THEN p_name || ' Tc of ' || p_brand WHEN 4 THEN p_name || ' x of ' || p_brand ELSE '3He ' || p_name END AS plain FROM part"
    out["q_normalize_doi"] = f"SELECT doc_id, {d['norm']} AS norm, {d['clean']} AS clean, {d['url_doi']} AS url_doi, {d['arxiv']} AS arxiv, {d['pmid']} AS pmid FROM documents"
    url = f"regexp_matches({d['x']}, '^https?://')"
    out["q_id_route"] = rf"""WITH r AS (SELECT doc_id, {d['x']} AS x, {d['clean']} AS clean, {d['url_doi']} AS u, {d['arxiv']} AS a, {d['pmid']} AS p, {url} AS url FROM documents)
SELECT doc_id, CASE WHEN url AND u IS NOT NULL THEN 'crossref' WHEN url AND a IS NOT NULL THEN 'arxiv' WHEN url AND p IS NOT NULL THEN 'pubmed' WHEN url THEN 'none' WHEN regexp_full_match(x, '\d+') THEN 'pubmed' WHEN regexp_full_match(x, '\d{{4}}\.\d{{4,5}}') THEN 'arxiv' ELSE 'crossref' END AS source,
 CASE WHEN url THEN coalesce(u, a, p) WHEN regexp_full_match(x, '\d+|\d{{4}}\.\d{{4,5}}') THEN x ELSE clean END AS id FROM r"""
    out["q_normalize_url"] = f"SELECT page_id, {url_sql('url')} AS url FROM pages"
    out["q_normalize_title"] = "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS title_key, lower(source || ' b ' || lang) AS author_key FROM documents"
    out["q_dup_pairs"] = f"""WITH x AS (SELECT {e['key']} AS key, nullif(lower({e['doi']}), '') AS doi, nullif(regexp_replace(lower({e['title']}), '[^a-z0-9]', '', 'g'), '') AS title, trim(regexp_replace(lower({e['author']}), '\\s+', ' ', 'g')) || chr(1) || {e['year']} AS who FROM documents)
SELECT a.key AS key1, b.key AS key2 FROM x a JOIN x b ON a.key < b.key AND (a.doi = b.doi OR a.title = b.title OR a.who = b.who)"""
    out["q_cited_semi"] = "SELECT c_custkey AS key, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey * 2 = c_custkey)"
    out["q_missing_anti"] = "SELECT DISTINCT o_custkey * 2 AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey * 2)"
    out["q_cite_order"] = "SELECT c_custkey AS key, max(o_orderkey) AS cite_order FROM customer LEFT JOIN orders ON o_custkey * 2 = c_custkey GROUP BY c_custkey"
    out["q_sort_cite_order"] = "WITH c AS (SELECT c_custkey AS key, max(o_orderkey) AS cite_order FROM customer LEFT JOIN orders ON o_custkey * 2 = c_custkey GROUP BY c_custkey) SELECT key, cite_order, row_number() OVER (ORDER BY coalesce(cite_order, 9999), key) AS rank FROM c"
    low = f"lower({d['clean']})"
    out["q_reuse_lookup"] = f"""WITH ids AS (SELECT DISTINCT {MADE['identifier']} AS id, {low} AS v, {url} AS u FROM documents),
lib AS (SELECT doc_id AS pos, {e['key']} AS key, '10.1234/' || source || '.' || lang AS doi, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id AS url, '2106.' || (10003 + doc_id) AS eprint FROM documents),
m AS (SELECT id, pos, key FROM ids JOIN lib ON v = doi UNION ALL SELECT id, pos, key FROM ids JOIN lib ON u AND rtrim(id, '/') = url UNION ALL SELECT id, pos, key FROM ids JOIN lib ON v = eprint) SELECT id, arg_min(key, pos) AS key FROM m GROUP BY id"""
    hay = "lower(title || ' ' || abstract || ' J')"
    scored = rf"""WITH sent AS (SELECT doc_id AS sent_id, {MADE['anchored']} AS sentence FROM documents),
cand AS (SELECT item_id AS pos, 'b' || item_id AS cite_key, CASE item_id % 4 WHEN 0 THEN 'Acoustic modes of a phonon' WHEN 1 THEN 'A qubit at 3.2 K' ELSE '' END AS title, text AS abstract FROM benchmark),
{terms('sentence', 'st', 'sent')}, {terms("title || ' ' || abstract || ' J'", 'ct', 'cand')},
a AS (SELECT *, {anchors('sentence')} AS anc, list_transform(list_zip(regexp_extract_all(sentence, {claim}, 1), regexp_extract_all(sentence, {claim}, 2)), lambda z: {{'v': z[1]::DOUBLE, 'u': lower(coalesce(z[2], ''))}}) AS cl FROM st),
b AS (SELECT *, {hay} AS hay, list_transform(regexp_extract_all({hay}, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS nums FROM ct),
p AS (SELECT sent_id, pos, cite_key, CASE WHEN len(a.terms) > 0 AND len(b.terms) > 0 THEN len(list_intersect(list_distinct(a.terms), b.terms)) / len(list_distinct(a.terms))::DOUBLE ELSE 0 END AS ov,
  coalesce(list_sum(list_transform(cl, lambda c: CASE WHEN len(list_filter(nums, lambda x: abs(x - c.v) <= greatest(0.15::DOUBLE, c.v * 0.08::DOUBLE))) > 0 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN c.u <> '' AND contains(hay, c.u) THEN 0.35::DOUBLE ELSE 0 END)), 0) + CASE WHEN len(cl) > 0 THEN 0.25::DOUBLE * ({' + '.join(f"(contains(lower(sentence), '{x}') AND contains(hay, '{x}'))::INT" for x in rules.SHARED_TERMS)}) ELSE 0 END AS qn,
  coalesce(list_sum(list_transform(anc, lambda x: CASE WHEN contains(hay, x) THEN CASE WHEN contains(lower(title), x) THEN 1.4::DOUBLE ELSE 0.8::DOUBLE END ELSE 0 END)), 0) AS an, len(list_filter(anc, lambda x: contains(hay, x))) AS anchor_matches, len(anc) AS n_anc FROM a, b),
f AS (SELECT *, CASE WHEN n_anc > 0 AND anchor_matches = 0 THEN 0 ELSE round(ov + qn + an, 4) END AS score FROM p)
"""
    out["q_rerank_topn"] = f"""{scored} SELECT sent_id, cite_key, score, anchor_matches::BIGINT AS anchor_matches, rank FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, pos) AS rank FROM f WHERE score > 0) WHERE rank <= 3"""
    weights = " ".join(f"+ CASE WHEN regexp_matches(lower(s), {quote(limits(p))}) THEN {w}::DOUBLE ELSE 0 END" for p, w in (*rules.CONTRIBUTION, *rules.BACKGROUND))
    back = " OR ".join(f"regexp_matches(lower(s), {quote(limits(p))})" for p, _ in rules.BACKGROUND)
    tt = f"list_distinct(list_filter({bounded('lower(t)', '/', '/')}, lambda x: length(x) > 2 AND x NOT IN {words_in(rules.TITLE_STOP_WORDS)}))"
    evidence = rf"""ex AS (SELECT {{key}}, t, list_filter(list_transform(string_split(regexp_replace(a, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS p FROM ed),
es AS (SELECT {{key}}, t, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS i FROM ex),
er AS (SELECT *, len(regexp_split_to_array(s, '\s+')) AS n, (0::DOUBLE {weights} - CASE WHEN i = 0 AND ({back}) THEN 1.0::DOUBLE ELSE 0 END + least(0.35::DOUBLE * len(list_intersect(list_distinct({bounded('lower(s)', '/', '/')}), {tt})), 2.0::DOUBLE)) AS z FROM es),
eb AS (SELECT {{key}}, s FROM (SELECT *, row_number() OVER (PARTITION BY {{key}} ORDER BY z + CASE WHEN n BETWEEN 8 AND 35 THEN 0.4::DOUBLE WHEN n < 5 THEN -0.8::DOUBLE ELSE 0 END DESC, i) AS k FROM er) WHERE k = 1)"""
    noted = "coalesce(s, t) AS best_evidence, CASE WHEN s IS NULL THEN t WHEN contains(lower(s), lower(t)) OR t = '' THEN s ELSE t || '. ' || s END AS reference_note"
    out["q_best_evidence"] = rf"""WITH ed AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'the and of' ELSE concat('This study of ', source) END AS t, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {plain('text')} END AS a FROM documents),
{evidence.replace("{key}", "doc_id")}
SELECT doc_id, {noted} FROM ed LEFT JOIN eb USING (doc_id)"""
    out["q_source_fallback"] = "WITH r AS (SELECT doc_id, 0 AS tier, 'local' AS name FROM labels UNION ALL SELECT doc_id, 1, source FROM documents WHERE n_chars > 2000 UNION ALL SELECT doc_id, 2, lang FROM documents) SELECT * FROM r QUALIFY tier = min(tier) OVER (PARTITION BY doc_id)"
    out["q_inverted_index"] = "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations"
    lacks = lambda n: f"(o_orderkey % {n} < 2)"
    out["q_validate"] = f"WITH i AS (SELECT o_orderkey, list_filter([CASE WHEN {lacks(5)} THEN 'author' END, CASE WHEN {lacks(3)} THEN 'title' END, CASE WHEN {lacks(2)} AND {lacks(7)} THEN 'journal or year' END, CASE WHEN {lacks(4)} AND {lacks(2)} THEN 'doi or url' END], lambda x: x IS NOT NULL) AS l FROM orders) SELECT o_orderkey, array_to_string(l, '|') AS issues, len(l)::BIGINT AS n FROM i"
    out["q_fix_entries"] = "SELECT s_suppkey, 'https://doi.org/10.1/' || s_name AS doi, s_name || ' and ' || regexp_extract('Anna Maria ' || replace(s_name, '#', ' '), '([^ ]*)$', 1) || ', ' || regexp_extract('Anna Maria ' || replace(s_name, '#', ' '), '^(.*) [^ ]*$', 1) || ' and Doe, J. and Plato' AS authors FROM supplier"
    short = "CASE p_partkey % 5 WHEN 0 THEN 'Nat. Commun.' WHEN 1 THEN 'Phys. Rev. B' WHEN 2 THEN 'Nano Lett.' WHEN 3 THEN '' ELSE p_brand END"
    out["q_backfill"] = f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '9' ELSE p_size::VARCHAR END AS number, CASE WHEN p_partkey % 4 = 0 THEN '1-2' WHEN p_partkey % 5 = 0 THEN '4979' ELSE '17' END AS pages, p_name AS title, {short} AS journal, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 3 THEN 'misc' ELSE 'article' END AS type FROM part"
    out["q_inline_citation"] = f"""WITH f AS (SELECT p_partkey AS k, {short} AS j, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS v, CASE WHEN p_partkey % 7 > 0 THEN '2025' ELSE '' END AS y FROM part),
b AS (SELECT *, trim(CASE WHEN v <> '' THEN j || ' ' || v ELSE j END) AS b1 FROM f), c AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE WHEN b1 = '' THEN '12' ELSE b1 || ', 12' END ELSE b1 END AS b2 FROM b)
SELECT k AS p_partkey, CASE WHEN k % 4 = 0 AND j = '' THEN 'arXiv:2511.05763' || CASE WHEN y <> '' THEN ', (2025)' ELSE '' END ELSE trim(b2 || CASE WHEN y <> '' THEN ' (2025)' ELSE '' END) END AS cite FROM c"""
    out["q_citation_key"] = r"""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN '2024' ELSE (1990 + doc_id % 3)::VARCHAR END AS y, list_filter(regexp_split_to_array(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN lang ELSE text END, '[{}''".,;:]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, regexp_replace(source || y || CASE WHEN len(w) >= 2 THEN w[1] || left(w[2], 3) WHEN len(w) = 1 THEN left(w[1], 7) ELSE 'Paper' END, '[^a-zA-Z0-9]', '', 'g') AS base FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM b) SELECT doc_id, base || CASE WHEN n = 1 THEN '' WHEN n <= 6 THEN substr('abcde', (n - 1)::INT, 1) ELSE (n - 6)::VARCHAR END AS citekey FROM n"""
    out["q_citation_key_gaps"] = f"""WITH d AS (SELECT doc_id, source || {KEYS["year"]} || lang AS base, {KEYS["end"]} AS tail FROM documents),
t AS (SELECT DISTINCT base, CASE WHEN tail = '' THEN 0 WHEN tail = 'c' THEN 3 WHEN tail IN ('x', '0') THEN -1 ELSE tail::BIGINT + 5 END AS p FROM d),
n AS (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM d),
s AS (SELECT base, unnest(generate_series(0, count(*) + 60)) AS p FROM d GROUP BY base),
f AS (SELECT s.base, s.p, row_number() OVER (PARTITION BY s.base ORDER BY s.p) AS n FROM s LEFT JOIN t ON t.base = s.base AND t.p = s.p WHERE t.p IS NULL)
SELECT doc_id, base || CASE WHEN p = 0 THEN '' WHEN p <= 5 THEN substr('abcde', p::INT, 1) ELSE (p - 5)::VARCHAR END AS citekey FROM n JOIN f USING (base, n)"""
    pad = ", ".join(f"CASE WHEN {x} <> '' THEN '  {n.ljust(10)} = {{' || {x} || '}}' END" for n, x in PARTS.items())
    out["q_bibtex_build"] = f"SELECT p_partkey, '@article{{k-' || p_partkey || ',' || chr(10) || array_to_string(list_filter([{pad}], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS content FROM part"
    out["q_bibtex_roundtrip"] = "SELECT p_partkey, 0 AS pos, 'article' AS type, 'k-' || p_partkey AS key, " + ", ".join(f"{x} AS {n}" for n, x in PARTS.items()) + " FROM part"
    out["q_bbl_keys"] = "SELECT doc_id, source || '-' || lang || '|e' || doc_id || '|t|' || lang AS keys FROM documents"
    out["q_list_files"] = "SELECT doc_id, source || '|' || lang || '|#x|' || doc_id AS items, lang || '|main|' || source || '.bib' AS files FROM documents"
    out["q_json_works"] = "SELECT doc_id, '10.1/' || doc_id AS doi, text AS title, source || ', ' || lang || ' and Solo' AS authors, CASE WHEN doc_id % 2 = 0 THEN '2001' ELSE (1990 + doc_id % 30)::VARCHAR END AS year FROM documents"
    out["q_html_meta"] = "SELECT doc_id, 'Doe, J and ' || lang AS author, 'A & ' || source AS title, '2024' AS year, 'https://arxiv.org/abs/' || source AS url FROM documents"
    out["q_xml_authors"] = "SELECT doc_id, lang || ' King, Ada and Plato' AS author, source AS title, '2023' AS year, lang AS eprint FROM documents"
    out |= commands(scored, made_docs, evidence, noted)
    return out


def commands(scored: str, made_docs: str, evidence: str, noted: str) -> dict[str, str]:
    """scored: CTEs whose last, f, has the score of every sentence and candidate."""
    out, lib = {}, LIBRARY
    shelf = f"lib AS (SELECT c_custkey AS pos, {lib['key']} AS key, {lib['doi']} AS doi FROM customer WHERE c_custkey % 3 > 0), orig AS (SELECT {lib['key']} AS key, nullif(CASE WHEN trim(w) LIKE 'http%' THEN regexp_extract(w, '10[.].*$') WHEN trim(w) LIKE 'doi:%' THEN trim(substr(trim(w), 5)) ELSE trim(w) END, '') AS doi FROM (SELECT c_custkey, {lib['written']} AS w FROM customer))"
    cited = "cited AS (SELECT 'c' || o_custkey AS key, o_orderkey AS ord FROM orders)"
    out["q_doi_for_key"] = f"WITH {shelf}, {cited} SELECT key, doi FROM (SELECT DISTINCT key FROM cited) LEFT JOIN orig USING (key)"
    lost = "lost AS (SELECT key, doi FROM (SELECT DISTINCT key FROM cited) ANTI JOIN lib USING (key) LEFT JOIN orig USING (key))"
    out["q_missing_doi"] = f"WITH {shelf}, {cited}, {lost} SELECT key FROM lost WHERE doi IS NULL"
    synced = "last AS (SELECT key, max(ord) AS cite_order, min(ord) AS from_ FROM cited GROUP BY key), added AS (SELECT key FROM lost JOIN customer ON c_custkey % 7 > 0 AND doi = '10.7000/c' || c_custkey), every AS (SELECT key, pos, false AS added FROM lib UNION ALL SELECT key, 1099511627776 + from_, true FROM added JOIN last USING (key)), synced AS (SELECT key, cite_order, added, row_number() OVER (ORDER BY coalesce(cite_order, 9999), pos) AS rank FROM every LEFT JOIN last USING (key))"
    out["q_sync_library"] = f"WITH {shelf}, {cited}, {lost}, {synced} SELECT key, cite_order, rank, added, CASE WHEN added THEN 'Nano Lett.' END AS journal, CASE WHEN added THEN 'article' END AS type FROM synced"
    bbl = "cited AS (SELECT 'c' || n_nationkey * 3 AS key, 1 AS ord FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 'c2', 2 FROM nation WHERE n_nationkey > 0)"
    out["q_bbl_sync"] = f"WITH {shelf}, {bbl}, {lost}, {synced} SELECT key, cite_order, added FROM synced"
    k = "c_custkey"
    asked = f"""a AS (SELECT {k} AS k, CASE WHEN {k} % 4 = 2 THEN 'pubmed' WHEN {k} % 4 = 3 THEN 'arxiv' ELSE 'crossref' END AS source, CASE {k} % 4 WHEN 2 THEN (40000000 + {k})::VARCHAR WHEN 3 THEN '2301.' || (10000 + {k}) ELSE '10.7000/C' || {k} END AS ref, c_name AS t,
  CASE WHEN {k} % 4 < 2 AND {k} % 3 = 0 THEN 'existing' WHEN {k} % 4 < 2 AND {k} % 7 > 0 OR {k} % 4 = 2 AND {k} % 5 > 0 THEN 'added' ELSE 'failed' END AS status FROM customer),
w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(t, '[{{}}''".,;:]', '', 'g'), '\\s+'), lambda x: x <> '') AS w FROM a),
x AS (SELECT k AS pos, source, ref, status, CASE status WHEN 'existing' THEN 'c' || k WHEN 'added' THEN regexp_replace(CASE WHEN source = 'pubmed' THEN 'Roe' || k || '2019' ELSE 'Doe' || k || '2020' END || CASE WHEN len(w) > 1 THEN w[1] || left(w[2], 3) ELSE left(w[1], 7) END, '[^a-zA-Z0-9]', '', 'g') END AS key FROM w)"""
    out["q_extract"] = f"WITH {asked} SELECT pos, source, ref, status, key FROM x"
    out["q_batch_counts"] = f"WITH {asked} SELECT count(*) FILTER (status <> 'failed') AS successful, count(*) FILTER (status = 'failed') AS failed FROM x"
    out["q_finalise"] = f"WITH {asked} SELECT ref AS doi, status FROM x WHERE pos % 4 = 1"
    out["q_append"] = f"WITH {asked} SELECT 'c' || {k} AS key, '' AS journal FROM customer WHERE {k} % 3 = 0 UNION ALL SELECT key, CASE source WHEN 'pubmed' THEN 'Science' ELSE 'Nano Lett.' END FROM x WHERE status = 'added'"
    out["q_upsert"] = f"WITH {shelf}, n AS (SELECT {k} AS pos, 'n' || {k} // 2 AS key, '10.7000/c' || {k} // 3 AS d FROM customer), m AS (SELECT * FROM n WHERE d NOT IN (SELECT doi FROM lib) QUALIFY row_number() OVER (PARTITION BY d ORDER BY pos) = 1) SELECT key, pos FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1) UNION ALL SELECT key, pos FROM lib"
    e = ENTRY
    marks = f"x AS (SELECT {e['key']} AS key, nullif(lower({e['doi']}), '') AS doi, nullif(regexp_replace(lower({e['title']}), '[^a-z0-9]', '', 'g'), '') AS title, trim(regexp_replace(lower({e['author']}), '\\s+', ' ', 'g')) || chr(1) || {e['year']} AS who FROM documents)"
    pairs = "SELECT a.key AS key1, b.key AS key2 FROM x a JOIN x b ON a.key < b.key AND (a.doi = b.doi OR a.title = b.title OR a.who = b.who)"
    out["q_ordered_duplicates"] = f"WITH {marks} SELECT key1, key2, row_number() OVER (ORDER BY key1, key2) AS place FROM ({pairs})"
    out["q_duplicate_count"] = f"WITH {marks} SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS code FROM ({pairs})"
    out["q_duplicate_groups"] = f"WITH {marks}, l AS (SELECT key, 'doi' AS kind, doi AS v FROM x UNION ALL SELECT key, 'title', title FROM x UNION ALL SELECT key, 'who', who FROM x) SELECT key, kind, min(key) OVER (PARTITION BY kind, v) AS representative, count(*) OVER (PARTITION BY kind, v) AS n FROM l WHERE v IS NOT NULL QUALIFY n > 1"
    out["q_scan_duplicates"] = "WITH p AS (SELECT 'k' || p_partkey AS k, p_partkey % 50 AS d, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS t FROM part WHERE p_partkey < 200) SELECT a.k AS key1, b.k AS key2, row_number() OVER (ORDER BY a.k, b.k) AS place FROM p a JOIN p b ON a.k < b.k AND (a.d = b.d OR a.t = b.t AND a.t <> '')"
    out["q_manage_validate"] = f"WITH i AS (SELECT {lib['key']} AS key, array_to_string(list_filter([CASE WHEN {k} % 2 = 1 THEN 'title' END, CASE WHEN {k} % 3 > 0 THEN 'journal or year' END, CASE WHEN {k} % 5 = 0 THEN 'doi or url' END], lambda x: x IS NOT NULL), '|') AS issues FROM customer) SELECT * FROM i WHERE issues <> ''"
    out["q_validate_code"] = "SELECT 0 AS n, 0 AS code"
    out["q_manage_main"] = f"WITH {shelf} SELECT pos, key FROM lib WHERE key IN (SELECT 'c' || o_custkey // 2 FROM orders)"
    out["q_manage_migrate"] = f"WITH {shelf}, n AS (SELECT {k} AS pos, key, doi FROM orig JOIN customer ON key = 'c' || {k} WHERE {k} % 2 = 0) SELECT pos, key FROM lib UNION ALL SELECT pos, key FROM n WHERE key NOT IN (SELECT key FROM lib) AND (doi IS NULL OR doi NOT IN (SELECT doi FROM lib))"
    out["q_candidates"] = "SELECT 'k-' || p_partkey AS cite_key, regexp_replace(trim(regexp_replace(p_name || ' of ' || p_type, '\\s+', ' ', 'g')), '^', '') AS title, p_brand AS authors, (1950 + p_size)::VARCHAR AS year, '10.' || p_partkey || '/x' AS doi, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS abstract, 'article' AS type, 'local-bib' AS source FROM part"
    out["q_render"] = "SELECT s_suppkey AS pos, '@misc{s' || s_suppkey || ',' || chr(10) || 'title = {' || s_name || '}' || chr(10) || '}' || chr(10) AS value FROM supplier"
    out["q_set_field"] = "SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE 'none' END AS cite_order, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM supplier"
    out["q_splice_field"] = """SELECT doc_id, '% kept ' || lang || ', by hand' || chr(10) || chr(10) || '@article{' || source || '-1,' || chr(10) || '  Title  =  {A, {B}},   % a note' || chr(10) || '    year = 2001'
      || CASE doc_id % 4 WHEN 0 THEN ',' || chr(10) || '    cite_order = {' || lang || '},' || chr(10) WHEN 1 THEN ',' || chr(10) || '  cite_order = "' || lang || '",' || chr(10) WHEN 2 THEN ',' || chr(10) ELSE ',' || chr(10) || '  cite_order = "7",' || chr(10) END
      || '}' || chr(10) || '@misc{other, cite_order={1}}' || chr(10) || '% tail ' || source AS content FROM documents"""
    out["q_legacy_keys"] = "SELECT doc_id, source || '-1|' || lang || ':2' AS keys FROM documents"
    out["q_as_misc"] = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '@misc{' ELSE '@article{' END || source || ', note = {@data{x}}}' AS bibtex FROM documents"
    out["q_split_entries"] = "SELECT doc_id, '@article{' || source || ', a={b}}|@misc{' || lang || ', c={d}}' AS entries FROM documents"
    out["q_crossref_search"] = "SELECT doc_id, '10.1/' || doc_id AS doi, source AS title, array_to_string(list_transform(generate_series(1, least(3, 2 + doc_id % 4)), lambda k: 'F' || k || ', ' || lang), ' and ') AS authors, CASE WHEN doc_id % 2 = 0 THEN '2001' ELSE '' END AS year, 'J' AS journal, 'CrossRef' AS source FROM documents"
    out["q_openalex"] = "SELECT doc_id, '10.2/' || doc_id AS doi, source AS title, array_to_string(list_transform(generate_series(1, least(3, 2 + doc_id % 4)), lambda k: lang || k), '; ') AS authors, '2020' AS year, 'a b a b' AS abstract, 'openalex' AS source FROM documents"
    out["q_scholar"] = "SELECT doc_id, '10.3/' || doc_id AS doi, source AS title, '2018' AS year, CASE WHEN doc_id % 3 = 0 THEN 'J' ELSE lang END AS journal, 'semantic-scholar' AS source FROM documents WHERE doc_id % 2 = 0"
    out["q_pubmed"] = "SELECT doc_id, source || ', ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Q' END AS authors, 'T' AS title, 'J' AS journal, '3' AS volume, '2011' AS year FROM documents"
    out["q_without_arxiv"] = "SELECT doc_id FROM documents WHERE doc_id % 5 > 0 AND (doc_id % 3 = 0 OR doc_id % 4 > 0)"
    found = f"""{scored}, g AS (SELECT *, CASE pos % 7 WHEN 0 THEN '10.48550/arxiv.1' WHEN 1 THEN '' ELSE '10.7000/c' || pos END AS doi FROM f),
own AS (SELECT sent_id, pos, cite_key, doi, 'local-bib' AS source, score, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, pos) AS rank FROM g WHERE pos % 6 = 0 AND score > 0),
far AS (SELECT *, (pos // 10 % 3)::INT AS tier FROM g WHERE pos % 2 = 1 AND pos % 10 = sent_id % 10 AND sent_id NOT IN (SELECT sent_id FROM own) QUALIFY row_number() OVER (PARTITION BY sent_id, tier ORDER BY pos) <= 6),
one AS (SELECT * FROM far WHERE doi NOT LIKE '%arxiv%' QUALIFY tier = min(tier) OVER (PARTITION BY sent_id)),
best AS (SELECT sent_id, pos, cite_key, doi, CASE tier WHEN 0 THEN 'CrossRef' WHEN 1 THEN 'openalex' ELSE 'semantic-scholar' END AS source, score, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, pos) AS rank FROM one WHERE score > 0),
every AS (SELECT * FROM own WHERE rank <= 3 UNION ALL SELECT * FROM best WHERE rank <= 3),
ed AS (SELECT pos, {plain('title')} AS t, {plain('abstract')} AS a FROM cand), {evidence.replace("{key}", "pos")},
note AS (SELECT pos, {noted} FROM ed LEFT JOIN eb USING (pos))"""
    cite = "CASE WHEN every.doi = '' THEN CASE WHEN source = 'local-bib' THEN 'J (2020)' ELSE '' END WHEN every.doi LIKE '%arxiv%' THEN '' WHEN pos % 3 > 0 OR pos % 12 = 0 THEN 'Nano Lett. ' || pos || CASE WHEN pos % 2 = 0 THEN ', 12' ELSE '' END || ' (2021)' ELSE '' END"
    shown = "source, score, rank, best_evidence, reference_note, " + cite + " AS inline_citation"
    out["q_suggest"] = f"{found} SELECT sent_id, cite_key, {shown} FROM every JOIN note USING (pos)"
    out["q_suggest_final"] = f"{found}, {shelf} SELECT sent_id, coalesce(lib.key, cite_key) AS cite_key, {shown} FROM every JOIN note USING (pos) LEFT JOIN lib ON every.doi <> '' AND every.doi = lib.doi WHERE lib.key IS NOT NULL OR every.doi = '' AND source = 'local-bib'"
    judged = need(sents("text", "doc_id", f"(SELECT doc_id, {MADE['anchored']} AS text FROM documents)"))
    asked = f"WITH {judged}, sent AS (SELECT doc_id * 1000000 + idx AS sent_id, sentence FROM s4 WHERE confidence >= 0.3 AND len({cites('sentence')}) = 0)"
    out["q_audit_suggest"] = f"{asked}{found[found.index(chr(10)) - 1 :]} SELECT sent_id // 1000000 AS doc_id, sent_id % 1000000 AS idx, rank - 1 AS place, title, every.doi AS doi, {shown.partition('rank, ')[2]} FROM (SELECT * FROM own WHERE rank <= 3) AS every JOIN note USING (pos) JOIN cand USING (pos) WHERE sent_id IN (SELECT sent_id FROM st WHERE len(terms) > 0)"
    docs = f"(SELECT doc_id, text FROM (SELECT doc_id, {MADE['cited']} AS text FROM documents))"
    judged = f"{need(sents('text', 'doc_id', docs))}, c AS (SELECT doc_id, idx, sentence, confidence, tags, len({cites('sentence')}) > 0 AS has FROM s4)"
    out["q_report_json"] = f"WITH {judged} SELECT doc_id, count(*) AS total_sentences, count(*) FILTER (NOT has AND confidence >= 0.3) AS sentences_needing_citation, count(*) FILTER (has) AS sentences_with_citations, count(*) FILTER (NOT has AND confidence < 0.3) AS sentences_ok, count(*) AS n, arg_min(sentence, idx) AS first FROM c GROUP BY doc_id"
    out["q_report"] = f"""WITH {judged}, {terms('sentence', 'tm', "(SELECT * FROM c WHERE NOT has AND confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) <= 20)")},
l AS (SELECT doc_id, string_agg(chr(10) || '• "' || left(sentence, 80) || '..."' || chr(10) || '  Confidence: ' || round(confidence * 100)::INT || '%' || chr(10) || '  Reason: Citation recommended: ' || array_to_string(tags[1:3], ', ') || CASE WHEN len(terms) > 0 THEN chr(10) || '  Search: ' || array_to_string(terms[1:4], ' ') ELSE '' END, chr(10) ORDER BY idx) AS need FROM tm GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS total, count(*) FILTER (has) AS cited, count(*) FILTER (NOT has AND confidence >= 0.3) AS needing, count(*) FILTER (NOT has AND confidence < 0.3) AS ok FROM c GROUP BY doc_id)
SELECT doc_id, repeat('=', 60) || chr(10) || 'Citation Need Analysis Report' || chr(10) || repeat('=', 60) || chr(10) || 'Total sentences: ' || total || chr(10) || 'Sentences with citations: ' || cited || chr(10) || 'Sentences needing citation: ' || needing || chr(10) || 'Sentences OK (no citation needed): ' || ok
  || CASE WHEN need IS NOT NULL THEN chr(10) || repeat('-', 60) || chr(10) || 'Sentences Needing Citations:' || chr(10) || repeat('-', 60) || chr(10) || need ELSE '' END AS report FROM n LEFT JOIN l USING (doc_id)"""
    return out
