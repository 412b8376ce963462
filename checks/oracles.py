"""The same queries as plain SQL for DuckDB, written from the rules and not from our expressions."""

from __future__ import annotations

import re

from checks.fixtures import (
    CONTENT_TYPES,
    CREDIBILITIES,
    LEVELS,
    MODALITIES,
    OBSERVATIONS,
    QUALITIES,
    REGIONS,
)
from wardloom.functions.text import WHITESPACE
from wardloom.operators.vector_index import LISTS, ROUNDS, SAMPLED, TRAIN
from wardloom.plans import prompts
from wardloom.reference_data import (
    CREDIBILITY_RANK,
    DIFFICULTY_RULES,
    DRUG_LABEL_HEADERS,
    IMAGING_BODY_REGIONS,
    IMAGING_TERMS,
    LAB_PANELS,
    REWARDS,
    SPECIALTY_KEYWORDS,
    TRIAL_HEADERS,
)

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


def pick(items, index: str) -> str:
    return f"list_extract({listed(items)}, CAST({index} AS INTEGER) + 1)"


NL = "chr(10)"
BLANKS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(expr: str) -> str:
    return f"trim({expr}, {BLANKS})"


def _sectioned(headers) -> str:
    return (
        f"array_to_string(list_transform(string_split(text, {NL}), lambda l, i: CASE WHEN (i - 1) % 5 = 2 "
        f"THEN list_extract({listed(headers)}, CAST(((i - 1) // 5) % {len(headers)} AS INTEGER) + 1) || {NL} || l "
        f"ELSE l END), {NL})"
    )


DOCS = f"""
docs AS (
  SELECT source, CAST(doc_id AS VARCHAR) AS source_id, split_part(text, {NL}, 1) AS title,
    CASE doc_id % 4 WHEN 2 THEN {_sectioned(DRUG_LABEL_HEADERS)} WHEN 3 THEN {_sectioned(TRIAL_HEADERS)}
      ELSE replace(text, {NL}, {NL} || {NL}) END AS content,
    {pick(CONTENT_TYPES, 'doc_id % 4')} AS content_type,
    lang AS authors,
    DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS published,
    CASE WHEN doc_id % 7 = 0 THEN ['triage_desk', 'general'] ELSE []::VARCHAR[] END AS specialty,
    {pick(CREDIBILITIES, 'doc_id % 5')} AS credibility,
    'https://example.org/doc/' || doc_id AS url,
    CASE WHEN doc_id % 3 <> 0 THEN '10.1/' || doc_id END AS doi
  FROM documents)"""


def _pieces(headers) -> str:
    names = "|".join(headers)
    return (
        f"list_filter(string_split(regexp_replace(content, '(?m)^({names})$', chr(1) || '\\1' || {NL}, 'g'), chr(1)), "
        f"lambda p: {strip('p')} <> '')"
    )


def chunks(size: int = 500, overlap: int = 50) -> str:
    """Chunks of ``docs``: whole, by section, and by size as a fold over paragraph numbers."""
    return f"""
sections AS (
  SELECT d.*, CASE content_type WHEN 'abstract' THEN [content]
    WHEN 'drug_label' THEN {_pieces(DRUG_LABEL_HEADERS)} WHEN 'trial_protocol' THEN {_pieces(TRIAL_HEADERS)} END AS pieces
  FROM docs d WHERE content_type <> 'full_text'),
split_chunks AS (
  SELECT source, source_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS position
  FROM (SELECT * REPLACE (CASE WHEN len(pieces) = 0 THEN [content] ELSE pieces END AS pieces) FROM sections)),
paragraphs AS (
  SELECT source, source_id, content,
    list_filter(list_transform(string_split_regex(content, '\\n\\n+'), lambda p: {strip('p')}), lambda p: p <> '') AS paras
  FROM docs WHERE content_type = 'full_text'),
fold AS (
  SELECT source, source_id, paras, 0 AS i, []::VARCHAR[] AS opened, 0::BIGINT AS n, NULL::VARCHAR AS closed FROM paragraphs
  UNION ALL
  SELECT source, source_id, paras, i + 1,
    CASE WHEN spill THEN list_append(tail, para) ELSE list_append(opened, para) END,
    CASE WHEN spill THEN coalesce(list_sum(list_transform(tail, lambda q: length(q))), 0)::BIGINT + length(para)
      ELSE n + length(para) END,
    CASE WHEN spill THEN array_to_string(opened, {NL} || {NL}) END
  FROM (
    SELECT *, paras[i + 1] AS para, (n + length(paras[i + 1]) > {size} AND len(opened) > 0) AS spill,
      list_filter(opened, lambda o, k: list_sum(list_transform(opened[k:], lambda q: length(q))) <= {overlap}) AS tail
    FROM fold WHERE i < len(paras))),
sized AS (
  SELECT source, source_id, i, closed AS piece FROM fold WHERE closed IS NOT NULL
  UNION ALL
  SELECT source, source_id, 1000000000, array_to_string(opened, {NL} || {NL}) FROM fold WHERE i = len(paras) AND i > 0
  UNION ALL
  SELECT source, source_id, 0, content FROM paragraphs WHERE len(paras) = 0),
all_pieces AS (
  SELECT source, source_id, piece, position FROM split_chunks
  UNION ALL
  SELECT source, source_id, piece, row_number() OVER (PARTITION BY source, source_id ORDER BY i) - 1 FROM sized),
chunks AS (
  SELECT sha256(p.source || ':' || p.source_id || ':' || position) AS chunk_id,
    p.source || ':' || p.source_id AS source_document_id, {strip('piece')} AS text, CAST(position AS INTEGER) AS position,
    d.source, d.authors, d.specialty, d.credibility, d.url, d.doi, d.content_type
  FROM all_pieces p JOIN docs d ON d.source = p.source AND d.source_id = p.source_id
  WHERE {strip('piece')} <> '')"""


CHUNKS = chunks()
WITH_CHUNKS = f"WITH RECURSIVE {DOCS}, {CHUNKS}"

WEB = r"""
web AS (
  SELECT url AS source_id,
    CASE WHEN title <> '' THEN title ELSE url END AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
      '<[^>]*>', ' ', 'g'), '[ \n\t\r]+', ' ', 'g'), ' ') AS content, url
  FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))"""

ORACLES["union_sources"] = f"""WITH {DOCS}, {WEB},
both_kinds AS (
  SELECT source, content_type, content FROM docs UNION ALL SELECT 'firecrawl', 'full_text', content FROM web)
SELECT source, content_type, count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS characters
FROM both_kinds GROUP BY ALL"""
ORACLES["normalize_web"] = f"""WITH {WEB}
SELECT 'firecrawl' AS source, source_id, title, content, 'full_text' AS content_type,
  'peer_reviewed' AS credibility, url FROM web"""
ORACLES["filter_sources"] = f"WITH {DOCS} SELECT source, source_id, title FROM docs WHERE source IN ('src1', 'src7', 'nowhere')"
ORACLES["limit_per_source"] = f"""WITH {DOCS}
SELECT source, source_id FROM docs
QUALIFY row_number() OVER (PARTITION BY source ORDER BY published DESC, source_id) <= 20"""
ORACLES["match_any_term"] = f"""WITH {DOCS}
SELECT source, source_id, title FROM docs
WHERE len(list_filter(['stent', 'rash', 'erenes'], lambda t: contains(lower(title), t) OR contains(lower(content), t))) > 0
ORDER BY CAST(source_id AS BIGINT) LIMIT 20"""
ORACLES["recent_documents"] = f"""WITH {DOCS}
SELECT source, source_id, CAST(published AS VARCHAR) AS published FROM docs
WHERE published BETWEEN DATE '2024-05-31' AND DATE '2024-06-30'"""
ORACLES["get_document"] = f"WITH {DOCS} SELECT source, source_id, title, content FROM docs WHERE source_id = '0'"

_FIRST = f"split_part(text, {NL}, 1)"
_ARTICLES = f"""
articles AS (
  SELECT *, {pick(['2019', '2020', '2021', 'soon', '2023', '2024'], '(doc_id % 11) % 6')} AS y,
    CASE WHEN doc_id % 7 <> 0 THEN {pick(['Jan', 'feb', '07', 'Dec', '13', 'x'], 'doc_id % 6')} END AS mon,
    CASE WHEN doc_id % 4 <> 0 THEN doc_id % 33 ELSE 1 END AS d FROM documents WHERE doc_id % 9 <> 8),
dated AS (
  SELECT *, CASE lower(coalesce(mon, '')) WHEN 'feb' THEN 2 WHEN 'dec' THEN 12 ELSE 1 END AS m FROM articles WHERE y <> 'soon')"""
ORACLES["source_pubmed"] = f"""WITH {_ARTICLES}
SELECT 'pubmed' AS source, CAST(doc_id AS VARCHAR) AS source_id, 'On ' || doc_id || ' & more' AS title,
  'AIM: a' || doc_id || {NL} || {NL} || text AS content, 'abstract' AS content_type, 'Roe Ann|Group' AS authors,
  CAST(coalesce(TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE),
    make_date(CAST(y AS INT), m, 1)) AS VARCHAR) AS published, '' AS specialty,
  CASE WHEN doc_id % 5 = 0 THEN 'guideline' ELSE 'peer_reviewed' END AS credibility,
  'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url, '10.1/' || doc_id AS doi FROM dated"""
ORACLES["source_openfda"] = f"""
SELECT 'openfda' AS source, 'set' || doc_id AS source_id,
  CASE WHEN doc_id % 6 = 0 THEN 'Brand ' || doc_id || ' (generic ' || doc_id || ')' WHEN doc_id % 2 = 0 THEN 'Brand ' || doc_id
    WHEN doc_id % 3 = 0 THEN 'generic ' || doc_id ELSE 'set' || doc_id END AS title,
  CASE WHEN doc_id % 4 = 0 THEN 'INDICATIONS AND USAGE' || {NL} || 'plain' || {NL} || {NL} ELSE '' END || 'WARNINGS' || {NL} || text AS content,
  'drug_label' AS content_type, CASE WHEN doc_id % 5 <> 0 THEN source ELSE '' END AS authors,
  CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN '2023-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-15' END AS published, '' AS specialty,
  'fda_label' AS credibility, 'https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid=set' || doc_id AS url, NULL::VARCHAR AS doi FROM documents"""
_LABEL_BODY = f"""CASE doc_id % 4 WHEN 0 THEN 'INDICATIONS AND USAGE' WHEN 1 THEN 'ADVERSE REACTIONS' WHEN 2 THEN 'OVERDOSAGE' END
  || {NL} || {strip("text || ' end'")} || {NL} || {NL}"""
ORACLES["source_dailymed"] = f"""
SELECT 'dailymed' AS source, 'id' || doc_id AS source_id, 'Label ' || doc_id AS title,
  coalesce({_LABEL_BODY}, '') || 'DESCRIPTION' || {NL} || 'described' AS content, 'drug_label' AS content_type, '' AS authors,
  NULL::VARCHAR AS published, '' AS specialty, 'fda_label' AS credibility,
  'https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid=id' || doc_id AS url, NULL::VARCHAR AS doi FROM documents WHERE doc_id % 10 <> 9"""
ORACLES["source_rxnorm"] = f"""
SELECT 'rxnorm' AS source, CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title,
  'Drug: ' || p_name || {NL} || 'RxCUI: ' || p_partkey || {NL} || 'Term Type: ' || p_type AS content, 'drug_info' AS content_type, '' AS authors,
  NULL::VARCHAR AS published, '' AS specialty, 'curated' AS credibility,
  'https://mor.nlm.nih.gov/RxNav/search?searchBy=RXCUI&searchTerm=' || p_partkey AS url, NULL::VARCHAR AS doi FROM part"""
ORACLES["source_medrxiv"] = f"""
SELECT 'medrxiv' AS source, '10.1/' || doc_id AS source_id, {_FIRST} AS title, text AS content, 'abstract' AS content_type, 'A, B|C' AS authors,
  CAST(TRY_CAST('2024-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 31 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) AS published,
  CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS specialty, 'preprint' AS credibility,
  'https://www.medrxiv.org/content/10.1/' || doc_id AS url, '10.1/' || doc_id AS doi FROM documents"""
_TITLE = "CASE WHEN o_orderkey % 4 <> 0 THEN 'Brief ' || o_orderkey ELSE 'Official' END"
ORACLES["source_trials"] = f"""
SELECT 'clinicaltrials' AS source, 'NCT' || o_orderkey AS source_id, {_TITLE} AS title,
  concat_ws({NL} || {NL}, 'Title: ' || {_TITLE}, 'NCT ID: NCT' || o_orderkey,
    'Status: ' || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE 'Unknown' END,
    CASE WHEN o_orderkey % 3 = 1 THEN 'Phase: PHASE1, PHASE2' END,
    'Eligibility' || CASE WHEN o_orderkey % 2 = 0 THEN ' (Age: 18 Years - )' ELSE '' END || ':' || {NL} || 'Must be ' || o_orderkey,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Primary Outcomes:' || {NL} || '- ' || o_orderpriority || ' (1 year)' END) AS content,
  'trial_protocol' AS content_type, '' AS authors, NULL::VARCHAR AS published, '' AS specialty, 'peer_reviewed' AS credibility,
  'https://clinicaltrials.gov/study/NCT' || o_orderkey AS url, NULL::VARCHAR AS doi FROM orders"""
ORACLES["source_curated"] = f"""
SELECT 'glass' AS source, CAST(doc_id AS VARCHAR) AS source_id, {_FIRST} AS title, text AS content, 'curated' AS content_type, '' AS authors,
  NULL::VARCHAR AS published, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS specialty, 'curated' AS credibility, 'https://x/' || doc_id AS url,
  NULL::VARCHAR AS doi FROM documents"""
ORACLES["source_fulltext"] = f"""
SELECT 'annas_archive' AS source, CAST(doc_id AS VARCHAR) AS source_id, {_FIRST} AS title, text AS content, 'full_text' AS content_type, 'A|B' AS authors,
  NULL::VARCHAR AS published, '' AS specialty, 'peer_reviewed' AS credibility, NULL::VARCHAR AS url,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS doi FROM documents"""
ORACLES["source_rejected"] = f"""WITH {_ARTICLES}
SELECT 'pubmed' AS source, (SELECT count(*) FROM documents WHERE doc_id % 9 = 8) + count(*) AS rows, count(*) AS undated FROM articles WHERE y = 'soon'
UNION ALL SELECT 'dailymed', count(*), 0 FROM documents WHERE doc_id % 10 = 9"""
ORACLES["stream_labels"] = f"""WITH RECURSIVE docs AS ({ORACLES["source_dailymed"]}), {CHUNKS}
SELECT source_document_id, position, text FROM chunks"""
ORACLES["stream_quarantine"] = "SELECT 'dailymed' AS source, 'id' || doc_id AS label FROM documents WHERE doc_id % 10 = 9"
ORACLES["stream_batches"] = "SELECT 3::BIGINT AS batches, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 9) AS documents"

_PLAIN = "SELECT chunk_id, source_document_id, position, text FROM chunks"
ORACLES["chunk_abstract"] = f"{WITH_CHUNKS} {_PLAIN} WHERE content_type = 'abstract'"
ORACLES["chunk_sections"] = f"{WITH_CHUNKS} {_PLAIN} WHERE content_type IN ('drug_label', 'trial_protocol')"
ORACLES["chunk_by_size"] = f"WITH RECURSIVE {DOCS}, {chunks(500, 200)} {_PLAIN} WHERE content_type = 'full_text'"
ORACLES["chunk_ids"] = f"""WITH {DOCS}
SELECT source, source_id, sha256(source || ':' || source_id || ':0') AS first_chunk_id FROM docs"""
ORACLES["chunk_documents"] = f"""{WITH_CHUNKS}
SELECT chunk_id, position, CAST(length(text) AS INTEGER) AS characters, credibility, authors,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM chunks"""

_FOUND = "[" + ", ".join(
    f"CASE WHEN regexp_matches(lower(text), {text('|'.join(words))}) THEN {text(name)} END"
    for name, words in SPECIALTY_KEYWORDS.items()
) + "]"


def _tagged(found: str) -> str:
    return f"""tagged AS (
  SELECT *, CASE WHEN len(list_filter(found, lambda f: NOT list_contains(specialty, f))) > 0
    THEN list_sort(list_distinct(list_concat(specialty, found))) ELSE specialty END AS tags
  FROM (SELECT *, {found} AS found FROM chunks))"""


_TAGGED = _tagged(f"list_filter({_FOUND}, lambda f: f IS NOT NULL)")
ORACLES["tag_specialty"] = f"{WITH_CHUNKS}, {_TAGGED} SELECT chunk_id, array_to_string(tags, ',') AS specialty FROM tagged"
_TERMS = """terms AS (
  SELECT 'group_' || substr(keyword, 1, 1) AS specialty, keyword
  FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark)
  WHERE length(keyword) >= 4)"""
_TERM_TAGS = f"""{WITH_CHUNKS}, {_TERMS},
hits AS (
  SELECT c.chunk_id, list(DISTINCT t.specialty) AS found
  FROM chunks c JOIN terms t ON contains(lower(c.text), t.keyword) GROUP BY c.chunk_id)
SELECT c.chunk_id, array_to_string(CASE
    WHEN len(list_filter(coalesce(h.found, []), lambda f: NOT list_contains(c.specialty, f))) > 0
    THEN list_sort(list_distinct(list_concat(c.specialty, h.found))) ELSE c.specialty END, ',') AS specialty
FROM chunks c LEFT JOIN hits h USING (chunk_id)"""
ORACLES["tag_with_table"] = _TERM_TAGS
ORACLES["tag_by_join"] = _TERM_TAGS
ORACLES["specialty_counts"] = f"""{WITH_CHUNKS}, {_TAGGED}
SELECT source, specialty, count(*) AS chunks FROM (
  SELECT source, unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE tags END) AS specialty FROM tagged)
GROUP BY ALL"""

_SUMMARY = f"""{WITH_CHUNKS},
counted AS (SELECT source, 1 AS d, 0 AS c FROM docs UNION ALL SELECT source, 0, 1 FROM chunks)
SELECT source, grouping(source) = 1 AS is_total, CAST(sum(d) AS BIGINT) AS documents, CAST(sum(c) AS BIGINT) AS chunks
FROM counted GROUP BY ROLLUP (source)"""
ORACLES["ingest_summary"] = _SUMMARY
ORACLES["ingest_summary_of_documents"] = _SUMMARY
ORACLES["kb_flat_metadata"] = f"""{WITH_CHUNKS}
SELECT chunk_id, source_document_id, source, position, credibility, array_to_string(specialty, ',') AS specialty,
  authors, coalesce(doi, '') AS doi, coalesce(url, '') AS url FROM chunks"""
_UNSOURCED = DOCS.replace("SELECT source, CAST", "SELECT CASE WHEN source = 'src3' THEN '' ELSE source END AS source, CAST")


def _stored(new_text: str, changed: str) -> str:
    """Chunks of which some have a new text; tags follow the text."""
    return f"""WITH RECURSIVE {_UNSOURCED}, {CHUNKS.replace(chr(10) + "chunks AS (", chr(10) + "old_chunks AS (")},
chunks AS (
  SELECT c.* REPLACE (CASE WHEN {changed} THEN {strip(new_text)} ELSE text END AS text)
  FROM old_chunks c JOIN (SELECT source AS s, source_id AS i, content FROM docs) d ON source_document_id = d.s || ':' || d.i),
{_TAGGED}
SELECT chunk_id, source, position, text, array_to_string(tags, ',') AS specialty, credibility, authors, coalesce(doi, '') AS doi,
  384 AS width, CASE WHEN regexp_matches(text, '[\\pL\\pN]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM tagged"""


ORACLES["kb_upsert"] = _stored("content || ' again'", "content_type = 'abstract'")
ORACLES["kb_increment"] = _stored("'changed'", "content_type = 'abstract' AND CAST(i AS BIGINT) % 100 = 0")
ORACLES["kb_count"] = f"{WITH_CHUNKS} SELECT count(*) AS chunks FROM chunks"
ORACLES["embed_chunks"] = f"""{WITH_CHUNKS},
terms AS (SELECT chunk_id, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN]+')) AS term FROM chunks),
counted AS (
  SELECT chunk_id, CAST('0x' || left(md5(term), 8) AS BIGINT) % 384 AS place, count(*) AS n FROM terms WHERE term <> '' GROUP BY ALL),
idf AS (
  SELECT place, ln(CAST((SELECT count(*) FROM chunks) + 1 AS DOUBLE) / (count(*) + 1)) AS w FROM counted GROUP BY place),
weights AS (SELECT chunk_id, place, n * w AS x FROM counted JOIN idf USING (place) WHERE w <> 0),
unit AS (
  SELECT chunk_id, place, CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS FLOAT) AS DOUBLE) AS x FROM weights)
SELECT chunk_id, 384 AS width, round(coalesce(sum(x * x), 0), 4) AS norm, CAST(count(x) AS INTEGER) AS filled,
  round(coalesce(max(x), 0), 4) AS heaviest, round(coalesce(sum(x), 0), 4) AS total,
  round(coalesce(sum(x * place), 0), 3) AS by_place, round(coalesce(sum(x * (place % 7)), 0), 4) AS by_seventh
FROM chunks LEFT JOIN unit USING (chunk_id) GROUP BY chunk_id"""

# --- search -------------------------------------------------------------------------

KB = f"""
kb AS (
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'chunk text ' || vec_id AS text, 'src' || label % 3 AS source,
    'src' || label % 3 || ':' || vec_id AS source_document_id, 's' || label AS specialty,
    {pick([*CREDIBILITIES, 'blog'], 'vec_id % 7')} AS credibility,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings),
q AS (SELECT v FROM kb WHERE chunk_id = '0')"""
_ONE = """SELECT kb.*, list_cosine_similarity(kb.v, q.v) AS raw FROM kb, q"""
ORACLES["search_topk"] = f"""WITH {KB}, scored AS ({_ONE})
SELECT chunk_id, text, source, round(raw, 6) AS score FROM scored ORDER BY raw DESC, chunk_id LIMIT 10"""
ORACLES["search_by_source"] = f"""WITH {KB}, scored AS ({_ONE})
SELECT chunk_id, text, source, round(raw, 6) AS score FROM scored WHERE source = 'src1' ORDER BY raw DESC, chunk_id LIMIT 10"""
ORACLES["search_many"] = f"""WITH {KB},
pairs AS (
  SELECT a.chunk_id AS query_id, kb.chunk_id, kb.source, list_cosine_similarity(kb.v, a.v) AS raw FROM kb, kb a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM pairs)
SELECT query_id, chunk_id, source, CAST(rank AS INTEGER) AS rank, round(raw, 6) AS score FROM ranked WHERE rank <= 10"""
_RANK = (
    "coalesce(CASE credibility "
    + " ".join(f"WHEN {text(c)} THEN {r}" for c, r in CREDIBILITY_RANK.items())
    + " END, 99)"
)
ORACLES["retrieve_rerank"] = f"""WITH {KB},
hits AS (
  SELECT * REPLACE (coalesce(credibility, 'preprint') AS credibility)
  FROM ({_ONE}) ORDER BY raw DESC, chunk_id LIMIT 25)
SELECT CAST(row_number() OVER (ORDER BY {_RANK}, raw DESC, chunk_id) AS INTEGER) AS place, chunk_id, text,
  round(raw, 6) AS score, credibility, {_RANK} AS credibility_rank, source_document_id, source, specialty,
  '' AS doi, '' AS url FROM hits"""
_TOPIC_HITS = f"""WITH {KB},
pairs AS (
  SELECT 'topic ' || a.chunk_id AS topic, kb.* EXCLUDE (v, credibility), coalesce(kb.credibility, 'preprint') AS credibility,
    list_cosine_similarity(kb.v, a.v) AS raw FROM kb, kb a),
hits AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY topic ORDER BY raw DESC, chunk_id) <= 25),
placed AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_RANK}, raw DESC, chunk_id) AS place FROM hits)"""
ORACLES["format_context"] = f"""{_TOPIC_HITS}
SELECT topic, string_agg('[Source ' || place || '] (' || credibility || ', ' || source || ')' || {NL} || text,
  {NL} || {NL} || '---' || {NL} || {NL} ORDER BY place) AS context FROM placed GROUP BY topic"""
ORACLES["source_refs"] = f"""{_TOPIC_HITS}
SELECT topic, CAST(place - 1 AS INTEGER) AS pos, source AS type, source_document_id AS reference, chunk_id AS chunk_ids FROM placed"""

# --- cases ----------------------------------------------------------------------------

CASES = f"""
cases AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderkey, o_custkey, c_mktsegment AS topic,
    {pick(LEVELS, 'o_orderkey % 3')} AS difficulty, lower(c_mktsegment) || ',' || o_orderpriority AS specialty, c_name,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 100 / 100.0 END::DOUBLE AS accuracy_score,
    CASE WHEN o_orderkey % 10 <> 0 AND o_custkey % 17 <> 0 THEN o_custkey % 100 / 100.0 END::DOUBLE AS pedagogy_score,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 100 / 100.0 END::DOUBLE AS bias_score,
    'model-' || o_orderstatus AS model, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS generated_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
PHASES = f"""
phases AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l.*,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_shipdate, l_returnflag, l_linestatus) AS INTEGER) AS phase_number,
    CAST(l_quantity AS INTEGER) AS qty,
    CASE l_partkey % 6 WHEN 0 THEN 'T+' || CAST(l_quantity AS INTEGER) || 'min' WHEN 1 THEN 'T+' || CAST(l_quantity AS INTEGER) || 'h'
      WHEN 2 THEN 'T+' || CAST(l_quantity AS INTEGER) || 'sec' WHEN 3 THEN 'T+' || CAST(l_quantity AS INTEGER) || ' days'
      WHEN 4 THEN 'T+1h' || CAST(l_quantity AS INTEGER) || 'min' ELSE 'T+' || CAST(l_quantity AS INTEGER) || 'w' END AS time_offset,
    'Line ' || l_partkey || ' ' || l_returnflag AS narrative
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
decisions AS (
  SELECT case_id, phase_number, j, 'action ' || (l_suppkey + j) % 12 AS action,
    (j = l_partkey % 3 OR j = l_suppkey % 7) AS is_optimal, {pick(QUALITIES, '(l_partkey + j) % 6')} AS quality,
    'reason ' || j AS reasoning, 'outcome ' || l_returnflag AS clinical_outcome
  FROM phases, range(1, 6) r(j) WHERE j <= l_partkey % 6)"""
WITH_CASES = f"WITH {CASES}, {PHASES}"
_LISTED = "case_id, topic, difficulty, specialty, accuracy_score, model, generated_at"

ORACLES["list_cases"] = f"""WITH {CASES} SELECT {_LISTED} FROM cases
WHERE topic = 'BUILDING' AND difficulty = 'resident' AND accuracy_score >= 0.5
ORDER BY generated_at DESC, case_id LIMIT 100"""
ORACLES["list_cases_unfiltered"] = f"WITH {CASES} SELECT {_LISTED} FROM cases ORDER BY generated_at DESC, case_id LIMIT 20"
ORACLES["case_get"] = f"""{WITH_CASES}
SELECT case_id, topic, CAST((SELECT count(*) FROM phases p WHERE p.case_id = c.case_id) AS INTEGER) AS phases,
  accuracy_score, 3 AS choices, c_name AS demographics FROM cases c WHERE case_id = '17'"""
ORACLES["case_count"] = f"WITH {CASES} SELECT count(*) AS cases FROM cases"
ORACLES["case_upsert"] = f"""WITH {CASES}
SELECT CASE WHEN difficulty = 'attending' THEN 'REPLACED' ELSE topic END AS topic, difficulty, count(*) AS cases,
  count(accuracy_score) AS reviewed, count(*) AS decoded FROM cases GROUP BY ALL"""
ORACLES["multi_step_cases"] = f"""{WITH_CASES}
SELECT case_id, CAST(count(*) AS INTEGER) AS phases FROM phases GROUP BY case_id HAVING count(*) > 1"""
ORACLES["export_jsonl"] = f"""{WITH_CASES}
SELECT c.case_id, topic, difficulty, CAST(o_custkey % 60 + 20 AS BIGINT) AS age, 'dx ' || c.case_id AS diagnosis,
  'choice 1' AS second_choice, model, p.narrative AS first_narrative
FROM (SELECT * FROM cases WHERE difficulty = 'attending') c
LEFT JOIN (SELECT case_id, narrative FROM phases WHERE phase_number = 1) p ON p.case_id = c.case_id"""
ORACLES["case_summary"] = f"""WITH {CASES}
SELECT case_id, format('[{{}}] {{}} ({{}}) — accuracy: {{:.2f}}', substr(case_id, 1, 8), topic, difficulty,
  coalesce(accuracy_score, 0)::DOUBLE) AS line FROM cases"""

# --- exports ----------------------------------------------------------------------------

ORACLES["rl_steps"] = f"""{WITH_CASES},
acts AS (
  SELECT case_id, phase_number, count(*) AS actions, max(CASE WHEN is_optimal THEN j END) AS last_optimal
  FROM decisions GROUP BY ALL)
SELECT p.case_id, c.difficulty, p.phase_number AS step_number,
  CASE WHEN last_optimal IS NULL THEN '' ELSE 'p' || p.phase_number || '_a' || (last_optimal - 1) END AS optimal_action,
  CAST(coalesce(actions, 0) AS INTEGER) AS actions, narrative, time_offset AS time_elapsed, 0 AS pending_orders,
  CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END AS labs, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS imaging,
  CASE WHEN l_linenumber % 4 <> 0 THEN qty + 60 END AS hr
FROM phases p JOIN cases c USING (case_id) LEFT JOIN acts a ON a.case_id = p.case_id AND a.phase_number = p.phase_number"""


def _rewards(table) -> str:
    value = "CASE quality " + " ".join(f"WHEN {text(q)} THEN {r}" for q, r in table.items()) + " ELSE 0.0 END"
    return f"""{WITH_CASES}
SELECT case_id, phase_number AS step_number, 'p' || phase_number || '_a' || (j - 1) AS action_id,
  action AS description, quality, CAST({value} AS DOUBLE) AS reward FROM decisions"""


ORACLES["rl_rewards"] = _rewards(REWARDS)
ORACLES["rl_rewards_custom"] = _rewards({"optimal": 10.0, "harmful": -3.0})
_MODALITY = pick(MODALITIES, "l_suppkey % 6")
_REGION = pick(REGIONS, "(l_partkey + l_suppkey) % 6")
_OBSERVED = pick(OBSERVATIONS, "(l_partkey // 3) % 6")
_LACTATE_UNIT = "CASE WHEN l_partkey % 13 = 0 THEN 'mg/dL' WHEN l_partkey % 13 <> 1 THEN 'mmol/L' END"
_NA = "(l_suppkey % 50 + 115) + CASE WHEN l_partkey % 9 = 0 THEN 0.5 ELSE 0.0 END"
_SYSTEM = f"""narrative
  || CASE WHEN l_linenumber % 4 <> 0 THEN {NL} || 'Vitals: HR ' || (qty + 60) || ', BP ' || (l_suppkey % 60 + 100) || '/'
    || (l_suppkey % 30 + 60) || ', RR ' || (l_linenumber + 12) || ', SpO2 ' || CAST(l_partkey % 10 + 90.5 AS DOUBLE)
    || '%, Temp ' || CAST((l_partkey % 4) * 0.5 + 36.5 AS DOUBLE) || '°C'
    || CASE WHEN l_partkey % 2 = 0 THEN ', GCS 15' ELSE '' END ELSE '' END
  || {NL} || 'BMP (' || time_offset || '): K ' || CAST((l_partkey % 60 + 20) / 10.0 AS DOUBLE) || ' mEq/L, Na '
  || CAST({_NA} AS DOUBLE) || ' mEq/L'
  || CASE WHEN l_suppkey % 3 = 0 THEN {NL} || CASE WHEN l_suppkey % 11 = 0 THEN 'XYZ' ELSE 'ABG' END || ' (' || time_offset
    || '): Lactate ' || CAST((l_partkey % 55) / 10.0 AS DOUBLE) || ' ' || coalesce({_LACTATE_UNIT}, '') ELSE '' END
  || CASE WHEN l_partkey % 3 = 0 THEN {NL} || {_MODALITY} || ' ' || {_REGION} || ' (' || time_offset || '): organ: '
    || {_OBSERVED} || '; field: clear. Impression: see findings' ELSE '' END
  || CASE WHEN l_linestatus = 'F' THEN {NL} || 'Update: shipped ' || strftime(l_shipdate, '%Y-%m-%d') ELSE '' END"""


def _answers(wrong: bool) -> str:
    wanted, fallback = ("NOT is_optimal", "max(j)") if wrong else ("is_optimal", "min(j)")
    return f"""chosen AS (
  SELECT case_id, phase_number, coalesce(min(CASE WHEN {wanted} THEN j END), {fallback}) AS j
  FROM decisions GROUP BY ALL),
answers AS (
  SELECT p.case_id, p.phase_number, CASE WHEN d.action IS NULL THEN 'No clinical decision options available for this phase.'
    ELSE 'Based on the clinical presentation, I would ' || d.action || '. Reasoning: ' || d.reasoning
      || '. Expected outcome: ' || d.clinical_outcome || '.' END AS content
  FROM phases p LEFT JOIN chosen c ON c.case_id = p.case_id AND c.phase_number = p.phase_number
  LEFT JOIN decisions d ON d.case_id = c.case_id AND d.phase_number = c.phase_number AND d.j = c.j)"""


ORACLES["sft_turns"] = f"""{WITH_CASES}, {_answers(False)}
SELECT case_id, (phase_number - 1) * 2 AS turn, 'system' AS role, {_SYSTEM} AS content FROM phases
UNION ALL SELECT case_id, (phase_number - 1) * 2 + 1, 'assistant', content FROM answers"""
ORACLES["sft_wrong_path"] = f"""{WITH_CASES}, {_answers(True)}
SELECT case_id, (phase_number - 1) * 2 AS turn, 'system' AS role, {_SYSTEM} AS content FROM phases
UNION ALL SELECT case_id, (phase_number - 1) * 2 + 1 AS turn, 'assistant' AS role, content FROM answers"""
# every record of the export by its steps and turns
ORACLES["export_training"] = f"""{WITH_CASES},
picked AS (
  SELECT c.case_id FROM cases c JOIN phases p USING (case_id) WHERE accuracy_score >= 0.2 GROUP BY c.case_id HAVING count(*) > 1),
wrong AS (WITH {_answers(True)} SELECT * FROM answers),
good AS (WITH {_answers(False)} SELECT * FROM answers)
SELECT 'rl_episode' AS type, p.case_id, phase_number - 1 AS pos, narrative AS said, time_offset AS answered FROM phases p JOIN picked USING (case_id)
UNION ALL SELECT 'sft_conversation', p.case_id, p.phase_number - 1, {_SYSTEM}, g.content
FROM phases p JOIN picked USING (case_id) JOIN good g ON g.case_id = p.case_id AND g.phase_number = p.phase_number
UNION ALL SELECT 'sft_wrong_path', p.case_id, p.phase_number - 1, {_SYSTEM}, w.content
FROM phases p JOIN picked USING (case_id) JOIN wrong w ON w.case_id = p.case_id AND w.phase_number = p.phase_number"""
ORACLES["case_decode"] = f"""{WITH_CASES}
SELECT c.case_id, o_orderkey % 10 = 3 AS unreadable, CASE WHEN o_orderkey % 10 <> 3 THEN topic END AS topic,
  CASE WHEN o_orderkey % 10 <> 3 THEN CAST((SELECT count(*) FROM phases p WHERE p.case_id = c.case_id) AS INTEGER) END AS phases FROM cases c"""

# --- validation -------------------------------------------------------------------------


def _number(value) -> str:
    return "NULL" if value is None else str(value)


_PANEL_ROWS = ",\n".join(
    f"({text(panel)}, {p}, {text(c[0])}, {i}, {text(c[1])}, {', '.join(_number(x) for x in c[2:])})"
    for p, (panel, components) in enumerate(LAB_PANELS.items())
    for i, c in enumerate(components)
)
LABS = f"""
panels(panel, panel_pos, name, component_pos, unit, low, high, crit_low, crit_high, prec) AS (VALUES {_PANEL_ROWS}),
labs AS (
  SELECT case_id, phase_number, 'BMP' AS panel, 'K' AS name, CAST((l_partkey % 60 + 20) / 10.0 AS DOUBLE) AS value, 'mEq/L' AS unit FROM phases
  UNION ALL SELECT case_id, phase_number, 'BMP', 'Na', CAST({_NA} AS DOUBLE), 'mEq/L' FROM phases
  UNION ALL SELECT case_id, phase_number, CASE WHEN l_suppkey % 11 = 0 THEN 'XYZ' ELSE 'ABG' END, 'Lactate',
    CAST((l_partkey % 55) / 10.0 AS DOUBLE), {_LACTATE_UNIT} FROM phases WHERE l_suppkey % 3 = 0)"""
ORACLES["lab_flags"] = f"""{WITH_CASES}, {LABS}
SELECT case_id, phase_number, l.panel, l.name, value,
  CASE WHEN value < crit_low OR value > crit_high THEN 'critical' WHEN value > high THEN 'H' WHEN value < low THEN 'L' END AS flag
FROM labs l LEFT JOIN panels p ON p.panel = l.panel AND p.name = l.name"""
ORACLES["lab_conformance"] = f"""{WITH_CASES}, {LABS}
SELECT * FROM (
  SELECT case_id, phase_number, l.panel, l.name, value, l.unit, concat_ws('; ',
    CASE WHEN p.name IS NULL THEN 'unknown component' END,
    CASE WHEN p.name IS NOT NULL AND p.unit IS DISTINCT FROM l.unit THEN 'wrong unit' END,
    CASE WHEN abs(value - round(value, prec)) > 1e-9 THEN 'wrong precision' END) AS issues
  FROM labs l LEFT JOIN panels p ON p.panel = l.panel AND p.name = l.name) WHERE issues <> ''"""
_ALL_LABS = f"""{WITH_CASES}, {LABS},
numbered AS (SELECT *, row_number() OVER (ORDER BY panel_pos, component_pos) - 1 AS nth FROM panels),
all_labs AS (
  SELECT n.*, round(low::DOUBLE + (l_partkey % 41 - 10) / 20.0::DOUBLE * (high::DOUBLE - low::DOUBLE), CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 4 END) AS value,
    CASE WHEN l_suppkey % 9 = 0 THEN 'odd' ELSE unit END AS given
  FROM lineitem JOIN numbered n ON nth = (l_partkey * 7 + l_suppkey) % 67)"""
ORACLES["lab_flags_all"] = f"""{_ALL_LABS}
SELECT panel, name, CASE WHEN value < crit_low OR value > crit_high THEN 'critical' WHEN value > high THEN 'H' WHEN value < low THEN 'L' END AS flag,
  count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS BIGINT) AS total FROM all_labs GROUP BY ALL"""
ORACLES["lab_conformance_all"] = f"""{_ALL_LABS},
judged AS (
  SELECT panel, name, concat_ws('; ', CASE WHEN unit <> given THEN 'wrong unit' END,
    CASE WHEN abs(value - round(value, prec)) > 1e-9 THEN 'wrong precision' END) AS issues FROM all_labs)
SELECT panel, name, issues, count(*) AS n FROM judged WHERE issues <> '' GROUP BY panel, name, issues"""
ORACLES["lab_panels_used"] = f"""{WITH_CASES}, {LABS}
SELECT p.panel, panel_pos, p.name AS component, component_pos, p.unit, prec AS precision, count(l.value) AS n
FROM panels p LEFT JOIN labs l ON p.panel = l.panel AND p.name = l.name GROUP BY ALL"""
_TERM_ROWS = ", ".join(
    f"({text(m)}, {text(t)})" for m, groups in IMAGING_TERMS.items() for t in sorted({t for g in groups.values() for t in g})
)
STUDIES = f"""
studies AS (
  SELECT case_id, phase_number, 0 AS study_pos, {_MODALITY} AS modality, {_REGION} AS body_region,
    lower('organ ' || {_OBSERVED} || chr(10) || 'field clear') AS words
  FROM phases WHERE l_partkey % 3 = 0)"""
ORACLES["imaging_terms"] = f"""{WITH_CASES}, {STUDIES}, terms(modality, term) AS (VALUES {_TERM_ROWS}),
known AS (SELECT DISTINCT modality FROM terms)
SELECT case_id, phase_number, study_pos, s.modality, t.term AS foreign_term
FROM studies s JOIN known USING (modality) JOIN (SELECT DISTINCT term FROM terms) t
  ON contains(' ' || regexp_replace(s.words, '[^\\pL\\pN]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(t.term), '[^\\pL\\pN]+', ' ', 'g') || ' ')
WHERE NOT EXISTS (SELECT 1 FROM terms o WHERE o.modality = s.modality AND o.term = t.term)"""
_REGION_ROWS = ", ".join(f"({text(m)}, {text(r)})" for m, regions in IMAGING_BODY_REGIONS.items() for r in regions)
ORACLES["imaging_regions"] = f"""{WITH_CASES}, {STUDIES}, regions(modality, region) AS (VALUES {_REGION_ROWS})
SELECT case_id, phase_number, study_pos, modality, body_region,
  CASE WHEN modality NOT IN (SELECT modality FROM regions) THEN 'unknown modality' ELSE 'invalid body region' END AS issue
FROM studies s WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.modality = s.modality AND r.region = s.body_region)"""
ORACLES["one_optimal"] = f"""{WITH_CASES}
SELECT p.case_id, p.phase_number, CAST(count(d.j) AS INTEGER) AS optimal
FROM phases p LEFT JOIN decisions d ON d.case_id = p.case_id AND d.phase_number = p.phase_number AND d.is_optimal
GROUP BY p.case_id, p.phase_number HAVING count(d.j) <> 1"""
_RULE_ROWS = ", ".join(
    f"({text(level)}, {r['phase_count_min']}, {r['phase_count_max']}, {r['decisions_per_phase'].split('-')[0]}, {r['decisions_per_phase'].split('-')[1]})"
    for level, r in DIFFICULTY_RULES.items()
)
ORACLES["difficulty_shape"] = f"""{WITH_CASES}, rules(difficulty, lo, hi, dlo, dhi) AS (VALUES {_RULE_ROWS}),
per_phase AS (
  SELECT p.case_id, p.phase_number, count(d.j) AS n FROM phases p LEFT JOIN decisions d
    ON d.case_id = p.case_id AND d.phase_number = p.phase_number GROUP BY ALL)
SELECT c.case_id, c.difficulty, true AS known_difficulty, CAST(count(x.n) AS INTEGER) AS phase_count,
  count(x.n) BETWEEN lo AND hi AS phases_fit,
  CAST(count(*) FILTER (x.n IS NOT NULL AND x.n NOT BETWEEN dlo AND dhi) AS INTEGER) AS phases_off
FROM cases c JOIN rules USING (difficulty) LEFT JOIN per_phase x ON x.case_id = c.case_id
GROUP BY c.case_id, c.difficulty, lo, hi"""
ORACLES["score_gate"] = f"""WITH {CASES}
SELECT case_id, least(accuracy_score, pedagogy_score, bias_score) AS lowest_score,
  least(accuracy_score, pedagogy_score, bias_score) >= 0.7 AND pedagogy_score IS NOT NULL AS passes, accuracy_score >= 0.7 AS approved
FROM cases WHERE accuracy_score IS NOT NULL"""
ORACLES["offset_order"] = f"""{WITH_CASES}
SELECT * FROM (
  SELECT case_id, phase_number, minutes, last_value(minutes IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY phase_number
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_minutes
  FROM (SELECT *, CAST(CASE l_partkey % 6 WHEN 0 THEN qty WHEN 1 THEN qty * 60 WHEN 2 THEN qty * (1.0::DOUBLE / 60) WHEN 3 THEN qty * 1440
      WHEN 4 THEN 60 + qty END AS DOUBLE) AS minutes FROM phases)) WHERE minutes IS NULL OR minutes < previous_minutes"""
_VITALS = {
    "hr": "qty + 60", "bp_systolic": "l_suppkey % 60 + 100", "bp_diastolic": "l_suppkey % 30 + 60",
    "rr": "l_linenumber + 12", "spo2": "l_partkey % 10 + 90.5", "temp_c": "(l_partkey % 4) * 0.5 + 36.5",
    "gcs": "CASE WHEN l_partkey % 2 = 0 THEN 15 END",
}
_DELTAS = f"""vitals AS (
  SELECT case_id, phase_number, {', '.join(f'CAST(CASE WHEN l_linenumber % 4 <> 0 THEN {e} END AS DOUBLE) AS {n}' for n, e in _VITALS.items())}
  FROM phases),
deltas AS (
  SELECT case_id, phase_number, {', '.join(f'{n} - lag({n}) OVER (PARTITION BY case_id ORDER BY phase_number) AS {n}_delta' for n in _VITALS)}
  FROM vitals)"""
ORACLES["vitals_delta"] = f"{WITH_CASES}, {_DELTAS} SELECT * FROM deltas"
ORACLES["vitals_jumps"] = f"""{WITH_CASES}, {_DELTAS}
SELECT case_id, phase_number, hr_delta, spo2_delta FROM deltas WHERE abs(hr_delta) > 30 OR abs(spo2_delta) > 5"""
ORACLES["repeat_action"] = f"""{WITH_CASES}
SELECT DISTINCT d.case_id, d.phase_number, d.action FROM decisions d
WHERE EXISTS (SELECT 1 FROM decisions e WHERE e.case_id = d.case_id AND e.phase_number < d.phase_number
  AND e.is_optimal AND e.action = d.action)"""

# --- grading ------------------------------------------------------------------------------

CHOICES = """
choices AS (
  SELECT case_id, CAST(j AS INTEGER) AS position, 'choice ' || j AS choice, o_orderkey % 4 = j AS is_correct,
    CASE WHEN o_orderkey % 4 <> j THEN CASE WHEN (o_orderkey + j) % 2 = 0 THEN 'catastrophic' ELSE 'common_mistake' END END AS error_type,
    'why ' || j AS reasoning, 'outcome ' || o_orderkey AS outcome, CASE WHEN o_orderkey % 4 <> j THEN 'harm ' || j END AS consequence
  FROM cases, range(3) r(j))"""
ORACLES["grade_answers"] = f"""WITH {CASES}, {CHOICES}
SELECT CAST(event_id AS VARCHAR) AS answer_id, CAST(user_id AS VARCHAR) AS case_id, CAST(event_id % 4 AS INTEGER) AS chosen, c.choice, c.is_correct, c.error_type,
  CASE WHEN k.case_id IS NULL THEN 'unknown case' WHEN c.case_id IS NULL THEN 'unknown choice' WHEN c.is_correct THEN 'Correct!'
    WHEN c.error_type = 'catastrophic' THEN 'Catastrophic Error' ELSE 'Incorrect' END AS verdict,
  c.outcome, c.reasoning, c.consequence, CASE WHEN NOT c.is_correct THEN g.choice END AS correct_choice
FROM events LEFT JOIN cases k ON k.case_id = CAST(user_id AS VARCHAR) LEFT JOIN choices c ON c.case_id = CAST(user_id AS VARCHAR) AND c.position = event_id % 4
LEFT JOIN choices g ON g.case_id = c.case_id AND g.is_correct"""
ORACLES["decision_classes"] = f"""WITH {CASES}, {CHOICES}
SELECT case_id, position, choice, CASE WHEN is_correct THEN 'correct' WHEN error_type = 'catastrophic' THEN 'catastrophic'
  ELSE 'other' END AS class, outcome FROM choices"""

# --- generation ----------------------------------------------------------------------------

SLOTS = f"""
slots AS (
  SELECT CAST(c_custkey AS VARCHAR) AS slot_id, c_custkey AS n, c_mktsegment AS topic, {pick(LEVELS, 'c_custkey % 3')} AS difficulty
  FROM customer)"""
# what is answered in each round: the order of that round, or the last one before it
ASKED = """
ranked AS (
  SELECT slot_id, o_orderkey AS o, row_number() OVER (PARTITION BY slot_id ORDER BY o_orderkey) - 1 AS k FROM slot_orders
  QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY o_orderkey) <= 3),
asked AS (
  SELECT slot_id, r, arg_max(o, k) AS o, max(k) = r AS fresh FROM ranked JOIN range(3) x(r) ON k <= r GROUP BY slot_id, r)"""
_OF_CUSTOMER = "slot_orders AS (SELECT CAST(o_custkey AS VARCHAR) AS slot_id, o_orderkey FROM orders)"
_SINGLE_ROUNDS = f"""{ASKED},
tried AS (SELECT *, o % 13 <> 0 AS written, o % 13 <> 0 AND o % 3 = 0 AS ok FROM asked),
ended AS (SELECT slot_id, min(r) FILTER (ok) AS last FROM tried GROUP BY slot_id),
spent AS (SELECT *, CASE WHEN written THEN 3 ELSE 1 END AS calls FROM tried JOIN ended USING (slot_id) WHERE last IS NULL OR r <= last)"""
_TOTALS = """
own AS (
  SELECT slot_id, sum(calls * (10 + o % 7)) AS tokens_in, sum(calls * (5 + o % 3)) AS tokens_out FROM spent GROUP BY slot_id),
totals AS (
  SELECT slots.*, CAST(sum(coalesce(tokens_in, 0)) OVER (ORDER BY n) AS BIGINT) AS total_input_tokens,
    CAST(sum(coalesce(tokens_out, 0)) OVER (ORDER BY n) AS BIGINT) AS total_output_tokens FROM slots LEFT JOIN own USING (slot_id)),
done AS (SELECT slot_id, o, r FROM spent WHERE r = last)"""
SINGLE = f"{SLOTS}, {_OF_CUSTOMER}, {_SINGLE_ROUNDS}, {_TOTALS}"
ORACLES["generate_single_step"] = f"""WITH {SINGLE}
SELECT slot_id, sha256('case|' || slot_id) AS case_id, topic, difficulty, 'vignette ' || o AS vignette,
  'dx ' || o AS diagnosis, CAST(r AS INTEGER) AS retry_count, (SELECT CAST(least(25, count(*)) AS INTEGER) FROM embeddings) AS sources, total_input_tokens, total_output_tokens,
  2 AS choices, true AS approved FROM totals JOIN done USING (slot_id)"""
ORACLES["generate_single_step_summary"] = f"""WITH {SINGLE}
SELECT (SELECT count(*) FROM done) AS generated, count(*) - (SELECT count(*) FROM done) AS failed,
  max(total_input_tokens) AS total_input_tokens, max(total_output_tokens) AS total_output_tokens FROM totals"""
# a round of an earlier order's answers has its last plan approved at once
ORACLES["generate_multi_step"] = f"""WITH {SLOTS}, {_OF_CUSTOMER}, {ASKED},
tried AS (
  SELECT *, CASE WHEN o % 11 = 10 THEN 0 ELSE 2 + o % 3 END AS p, o % 7 = 6 AS lasting, o % 5 = 3 AND o % 7 <> 6 AND fresh AS passing FROM asked),
ended AS (SELECT slot_id, min(r) FILTER (p > 0 AND NOT lasting AND o % 3 = 0) AS last FROM tried GROUP BY slot_id),
spent AS (
  SELECT *, CASE WHEN fresh AND o % 2 = 1 THEN 4 ELSE 2 END
    + CASE WHEN p = 0 THEN 0 WHEN lasting THEN p + 5 WHEN passing THEN p + 4 ELSE p + 2 END AS calls
  FROM tried JOIN ended USING (slot_id) WHERE last IS NULL OR r <= last), {_TOTALS}
SELECT slot_id, topic, array_to_string(list_transform(range(1, p + 1),
    lambda i: 'phase ' || i || ' of ' || o || CASE WHEN i = 1 AND passing THEN ' mended' ELSE '' END), {NL} || {NL}) AS vignette,
  'action ' || o || '.1' AS optimal_next_step, CAST(p AS INTEGER) AS phases, CAST(r AS INTEGER) AS retry_count,
  total_input_tokens, total_output_tokens FROM totals JOIN done USING (slot_id) JOIN spent USING (slot_id, o, r)"""
_CONTEXTS = f"""WITH {SLOTS}, {KB},
topic_vectors AS (SELECT DISTINCT topic, v FROM slots JOIN kb ON kb.chunk_id = CAST(length(topic) AS VARCHAR)),
pairs AS (
  SELECT t.topic, kb.* EXCLUDE (v, credibility), coalesce(kb.credibility, 'preprint') AS credibility,
    list_cosine_similarity(kb.v, t.v) AS raw FROM kb, topic_vectors t),
hits AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY topic ORDER BY raw DESC, chunk_id) <= 25),
placed AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_RANK}, raw DESC, chunk_id) AS place FROM hits),
contexts AS (
  SELECT topic, string_agg('[Source ' || place || '] (' || credibility || ', ' || source || ')' || {NL} || text,
    {NL} || {NL} || '---' || {NL} || {NL} ORDER BY place) AS context FROM placed GROUP BY topic)"""


def _rule_of(name: str) -> str:
    whens = " ".join(f"WHEN {text(level)} THEN {text(str(r[name]))}" for level, r in DIFFICULTY_RULES.items())
    return f"CASE difficulty {whens} ELSE {text(str(DIFFICULTY_RULES['resident'][name]))} END"


def _prompt(template: str) -> str:
    """A prompt template as a SQL concatenation."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            parts.append(text(piece))
        else:
            parts.append(_rule_of(piece[:-5]) if piece.endswith("_rule") else piece)
    return " || ".join(parts)


ORACLES["prompt_requests"] = f"""{_CONTEXTS}
SELECT sha256('case_writer|' || slot_id || '|0') AS request_id, slot_id, 'case_writer' AS stage, 0 AS round,
  {_prompt(prompts.CASE_WRITER.prompt)} AS prompt, 'case_writer' AS schema_name
FROM slots JOIN contexts USING (topic)"""
ORACLES["plan_requests"] = f"""{_CONTEXTS}
SELECT slot_id, 'planner' AS stage, {_prompt(prompts.PLANNER.prompt)} AS prompt, 'planner' AS schema_name
FROM slots JOIN contexts USING (topic)"""
ORACLES["make_slots"] = """WITH topics AS (SELECT DISTINCT c_name AS topic FROM customer),
ranked AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS r FROM topics)
SELECT topic || '|attending|' || n AS slot_id, r * 4 + n AS slot_seq, topic, 'attending' AS difficulty FROM ranked, range(4) x(n)"""
ORACLES["generate_to_export"] = f"""WITH
slot_orders AS (
  SELECT c_name || '|resident|' || (o_orderkey % 2) AS slot_id, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
{_SINGLE_ROUNDS}
SELECT split_part(slot_id, '|', 1) AS topic, 'vignette ' || o AS vignette FROM spent WHERE r = last"""


def _json_prompt(stage: str, prompt: str, rows: str, schema: str) -> str:
    return f"SELECT slot_id, '{stage}' AS stage, {_prompt(prompt)} AS prompt, '{schema}' AS schema_name FROM ({rows})"


_BLUEPRINT = """'{"diagnosis":"dx ' || case_id || '","phases":[{"phase_number":1,"correct_action":"Case of ' || c_name || '"}]}'"""
_WRITTEN = f"""SELECT *, case_id AS slot_id, 'known of ' || topic AS context, 'Case of ' || c_name AS vignette,
  '{{"diagnosis":"dx ' || case_id || '","optimal_next_step":"treat","rationale":"because","key_findings":["' || o_orderpriority || '"]}}' AS ground_truth,
  '{{"case_id":"' || case_id || '","topic":"' || topic || '","difficulty":"' || difficulty || '"}}' AS case_json, '0.7' AS threshold,
  {_BLUEPRINT} AS blueprint_json, '{{"phase_number":1,"correct_action":"Case of ' || c_name || '"}}' AS phase_json, 'LABS' AS lab_context
  FROM (SELECT c.*, o.o_orderpriority FROM cases c JOIN orders o ON o.o_orderkey = c.o_orderkey)"""
for _name, _stage in (("tree_requests", prompts.DECISION_TREE), ("review_requests", prompts.REVIEW),
                      ("blueprint_review_requests", prompts.BLUEPRINT_REVIEW), ("phase_requests", prompts.PHASE_RENDERER)):
    ORACLES[_name] = f"WITH {CASES} " + _json_prompt(_stage.name, _stage.prompt, _WRITTEN, _stage.schema_name)
ORACLES["consistency_requests"] = f"{WITH_CASES} " + _json_prompt(
    prompts.CONSISTENCY.name, prompts.CONSISTENCY.prompt,
    """SELECT case_id AS slot_id, '[' || string_agg('{"n":' || phase_number || ',"said":"' || narrative || '"}', ',' ORDER BY phase_number) || ']' AS phases_json
    FROM phases GROUP BY case_id""", prompts.CONSISTENCY.schema_name)
_RETRY = prompts.RETRY.replace("{prompt}", "{old}").replace("{notes}", "{listed}")
ORACLES["retry_prompts"] = f"""WITH {CASES}
SELECT case_id, CASE WHEN accuracy_score IS NULL THEN old ELSE {_prompt(_RETRY)} END AS prompt
FROM (SELECT *, 'prompt ' || case_id AS old, '- note ' || case_id AS listed FROM cases)"""
_RULE_NAMES = list(DIFFICULTY_RULES["resident"])
ORACLES["difficulty_rules"] = f"""WITH {CASES},
asked AS (SELECT case_id, CASE WHEN topic = 'BUILDING' THEN 'expert' ELSE difficulty END AS difficulty FROM cases)
SELECT case_id, difficulty, difficulty <> 'expert' AS valid_difficulty,
  {', '.join((f'CAST({_rule_of(n)} AS INTEGER)' if n.startswith('phase_count') else _rule_of(n)) + f' AS {n}' for n in _RULE_NAMES)}
FROM asked"""
_REVIEWS = """
answers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS slot_id, o_orderkey, o_custkey,
    CAST(year(o_orderdate) % 3 AS INTEGER) AS round, (CAST(floor(o_totalprice) AS BIGINT) % 100 / 100.0)::DOUBLE AS accuracy_score,
    o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AS readable, o_orderkey % 50 + 10 AS input_tokens, o_custkey % 20 + 5 AS output_tokens
  FROM orders)"""
ORACLES["parse_responses"] = f"""WITH {_REVIEWS}
SELECT request_id, slot_id, round, accuracy_score, accuracy_score >= 0.7 AS approved, 'note ' || request_id AS note
FROM answers WHERE readable"""
ORACLES["rejected_responses"] = f"""WITH {_REVIEWS}
SELECT request_id, CASE WHEN o_orderkey % 13 = 0 THEN '{{broken'
  ELSE '{{"accuracy_score":' || accuracy_score || ',"pedagogy_score":0.8,"approved":' || (accuracy_score >= 0.7)
    || ',"notes":["note ' || request_id || '"]}}' END AS payload
FROM answers WHERE NOT readable"""
_VALUES = {"case_writer": "'dx ' || o_orderkey", "decision_tree": "'o' || o_orderkey", "planner": "o_orderpriority",
           "blueprint_review": "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END", "consistency": "'jump ' || o_orderkey"}


def _readable(schema: str) -> str:
    # a plan without phases lacks nothing
    return "o_orderkey % 7 <> 0 OR o_orderkey % 4 = 0" if schema == "planner" else "o_orderkey % 7 <> 0"


ORACLES["parse_stages"] = " UNION ALL ".join(
    f"SELECT '{n}' AS schema_name, CAST(o_orderkey AS VARCHAR) AS request_id, {_readable(n)} AS valid, CASE WHEN {_readable(n)} THEN {v} END AS value FROM orders"
    for n, v in _VALUES.items())
# a lab value without a unit is not complete either
_WHOLE_PHASE = "l_orderkey % 7 <> 0 AND NOT (l_suppkey % 3 = 0 AND l_partkey % 13 = 1)"
ORACLES["parse_phases"] = f"""{WITH_CASES}
SELECT case_id || '.' || (phase_number - 1) AS request_id, CASE WHEN {_WHOLE_PHASE} THEN narrative END AS narrative,
  CASE WHEN {_WHOLE_PHASE} THEN CAST(l_partkey % 6 AS INTEGER) END AS decisions FROM phases"""
ORACLES["assemble_single"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS slot_id, sha256('case|' || o_orderkey) AS case_id, 'v ' || o_orderkey AS vignette,
  CAST(o_orderkey % 60 + 20 AS INTEGER) AS age, 'dx ' || o_orderkey AS diagnosis, 'o' || o_orderkey AS second_outcome, 1 AS complications,
  CAST(o_orderkey % 3 AS INTEGER) AS retry_count, 'm' AS model FROM orders WHERE o_orderkey % 7 <> 0"""
ORACLES["assemble_multi"] = f"""{WITH_CASES}
SELECT case_id AS slot_id, string_agg(narrative, {NL} || {NL} ORDER BY phase_number) AS vignette, 'dx ' || case_id AS diagnosis,
  'act ' || case_id || '.1' AS optimal_next_step, CAST(count(*) AS INTEGER) AS phases, CAST(o_orderkey % 4 AS INTEGER) AS planned,
  o_orderpriority AS specialty, true AS multi_step
FROM phases JOIN orders ON o_orderkey = l_orderkey WHERE {_WHOLE_PHASE} AND o_orderkey % 4 <> 0 GROUP BY case_id, o_orderkey, o_orderpriority"""
ORACLES["empty_plans"] = "SELECT CAST(o_orderkey AS VARCHAR) AS slot_id, 'Blueprint has no phases' AS notes FROM orders WHERE o_orderkey % 4 = 0"
ORACLES["affected_phases"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS slot_id, CAST(o_orderkey % 3 AS INTEGER) AS pos, 'act ' || o_orderkey || '.' || (o_orderkey % 3 + 1) AS action
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 + 1 <= o_orderkey % 4"""
_GATED = f"""WITH {SLOTS}, {_REVIEWS},
latest AS (SELECT * FROM answers WHERE readable QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY o_orderkey DESC) = 1),
gated AS (
  SELECT s.slot_id, s.topic, l.accuracy_score, coalesce(l.accuracy_score >= 0.7, false) AS approved,
    coalesce('note ' || l.request_id, 'old note') AS notes FROM slots s LEFT JOIN latest l USING (slot_id))"""
ORACLES["review_gate"] = f"{_GATED} SELECT slot_id, topic, accuracy_score FROM gated WHERE approved"
ORACLES["retry_round"] = f"{_GATED} SELECT slot_id, notes FROM gated WHERE NOT approved"
ORACLES["rerender_phases"] = f"""{WITH_CASES}
SELECT case_id AS slot_id, phase_number - 1 AS pos,
  CASE WHEN l_partkey % 6 = 0 THEN 'new ' || narrative ELSE narrative END AS narrative FROM phases"""
ORACLES["collect_phases"] = f"""{WITH_CASES}
SELECT case_id AS slot_id, string_agg(narrative, {NL} || {NL} ORDER BY phase_number) AS vignette,
  CAST(count(*) AS INTEGER) AS phases, 'm' AS phase_model FROM phases GROUP BY case_id"""
ORACLES["batch_summary"] = f"""{_GATED}
SELECT count(*) FILTER (approved) AS generated, count(*) FILTER (NOT approved) AS failed,
  (SELECT CAST(sum(input_tokens) AS BIGINT) FROM answers) AS total_input_tokens,
  (SELECT CAST(sum(output_tokens) AS BIGINT) FROM answers) AS total_output_tokens FROM gated"""
ORACLES["running_tokens"] = f"""WITH {_REVIEWS}
SELECT request_id, CAST(sum(input_tokens) OVER (ORDER BY o_orderkey) AS BIGINT) AS running_input_tokens,
  CAST(sum(output_tokens) OVER (ORDER BY o_orderkey) AS BIGINT) AS running_output_tokens FROM answers"""
ORACLES["lab_context"] = f"""{WITH_CASES}, {LABS},
lines AS (
  SELECT panel_pos, panel || ': ' || string_agg(name || ' ' || CAST(low AS DOUBLE) || '-' || CAST(high AS DOUBLE) || ' ' || unit, ', '
    ORDER BY component_pos) AS line FROM panels GROUP BY panel, panel_pos)
SELECT (SELECT string_agg(line, {NL} ORDER BY panel_pos) FROM lines) AS lab_context, count(*) AS "values" FROM labs"""

# --- streaming -------------------------------------------------------------------------------

ORACLES["stream_ingest"] = f"""WITH {WEB}
SELECT sha256('firecrawl:' || source_id || ':0') AS chunk_id, 'firecrawl:' || source_id AS source_document_id,
  'firecrawl' AS source, 0 AS position, {strip('content')} AS text FROM web WHERE {strip('content')} <> ''"""
ORACLES["stream_versions"] = _stored("content || ' again'", "content_type = 'abstract' AND CAST(i AS BIGINT) % 3 < 2")
ORACLES["stream_progress"] = _SUMMARY.replace("SELECT source, grouping", "SELECT CAST(0 AS BIGINT) AS batch_id, source, grouping")

# --- search through lists ----------------------------------------------------------------------

ORACLES["search_by_lists"] = ORACLES["search_many"]
def _unit(vector: str) -> str:
    return f"list_transform({vector}, lambda x: x / sqrt(list_dot_product({vector}, {vector})))"


def _round(r: int) -> str:
    """Vectors of the sample go to their nearest centroid, and centroids to the direction of the sum of theirs."""
    return f"""dealt{r} AS MATERIALIZED (
  SELECT s.chunk_id, s.u, s.size, c.list FROM sample s, lists{r} c
  QUALIFY row_number() OVER (PARTITION BY s.chunk_id ORDER BY list_dot_product(s.u, c.c) DESC, c.list) = 1),
moved{r} AS (
  SELECT list, list(x ORDER BY place) AS c
  FROM (SELECT list, place, sum(u[place]) AS x FROM dealt{r}, range(1, 65) p(place) WHERE size > 0 GROUP BY ALL) GROUP BY list),
lists{r + 1} AS MATERIALIZED (
  SELECT c.list, {_unit('coalesce(m.c, c.c)')} AS c FROM lists{r} c LEFT JOIN moved{r} m ON m.list = c.list)"""


# the index: centroids trained in rounds, rows in the list of the nearest, lists visited until a sample finds 95 in a hundred
_LISTS = f"""{KB},
sized AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS size FROM kb WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL)) = 0),
usable AS MATERIALIZED (
  SELECT chunk_id, source, v, size, list_transform(v, lambda x: x / CASE WHEN size > 0 THEN size ELSE 1 END) AS u FROM sized),
counted AS (SELECT count(*) AS n, least({LISTS}, greatest(1, CAST(ceil(sqrt(count(*))) AS INT))) AS lists FROM usable),
sample AS MATERIALIZED (
  SELECT * FROM usable, (SELECT CAST(floor(least(1, {TRAIN} / greatest(n, 1)) * 1048576) AS BIGINT) AS share FROM counted)
  WHERE share >= 1048576 OR substr(md5(chunk_id), 28, 5) < printf('%05x', share)),
lists0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY md5(chunk_id), chunk_id) - 1 AS list, u AS c FROM usable
  QUALIFY row_number() OVER (ORDER BY md5(chunk_id), chunk_id) <= (SELECT lists FROM counted)),
{", ".join(_round(r) for r in range(ROUNDS))},
near_lists AS MATERIALIZED (
  SELECT chunk_id, list, row_number() OVER (PARTITION BY chunk_id ORDER BY list_dot_product(u, c) DESC, list) AS place
  FROM usable, lists{ROUNDS}),
listed AS MATERIALIZED (SELECT chunk_id, list FROM near_lists WHERE place = 1),
routes AS MATERIALIZED (
  SELECT chunk_id AS query_id, list, row_number() OVER (PARTITION BY chunk_id ORDER BY place) AS place
  FROM near_lists WHERE list IN (SELECT list FROM listed)),
scored AS MATERIALIZED (
  SELECT a.chunk_id AS query_id, b.chunk_id, b.source, list_cosine_similarity(b.v, a.v) AS raw, l.list
  FROM usable a, usable b JOIN listed l ON l.chunk_id = b.chunk_id),
near AS MATERIALIZED (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) <= 10),
asked AS (SELECT chunk_id AS query_id FROM usable ORDER BY substr(md5(chunk_id), 9, 24), chunk_id LIMIT {SAMPLED}),
places AS MATERIALIZED (SELECT query_id, place FROM asked JOIN near USING (query_id) JOIN routes USING (query_id, list)),
shares AS (
  SELECT p AS visited, query_id, avg(CASE WHEN place <= p THEN 1.0 ELSE 0 END) AS share
  FROM places, range(1, (SELECT count(DISTINCT list) + 1 FROM listed)) r(p) GROUP BY ALL),
probes AS MATERIALIZED (
  SELECT min(visited) AS visited FROM (
    SELECT visited, avg(share) AS mean, stddev_pop(share) / sqrt(count(*)) AS error FROM shares GROUP BY visited)
  WHERE mean - 2 * error >= 0.95 - 1e-12 OR mean >= 1 - 1e-12),
found AS MATERIALIZED (
  SELECT s.* EXCLUDE (list), row_number() OVER (PARTITION BY s.query_id ORDER BY raw DESC, s.chunk_id) AS rank
  FROM scored s JOIN routes r ON r.query_id = s.query_id AND r.list = s.list WHERE r.place <= (SELECT visited FROM probes)
  QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY raw DESC, s.chunk_id) <= 10)"""
ORACLES["search_recall"] = f"""WITH {_LISTS},
recall AS (
  SELECT n.query_id, count(*) AS nearest, count(f.chunk_id) AS found
  FROM near n LEFT JOIN found f ON f.query_id = n.query_id AND f.chunk_id = n.chunk_id GROUP BY n.query_id)
SELECT *, (SELECT 100 * sum(found) >= 95 * sum(nearest) FROM recall) AS reached FROM recall"""
_LETTER_COUNTS = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "aeinr")
ORACLES["embed_plugin"] = f"""{WITH_CHUNKS}
SELECT chunk_id, {', '.join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS BIGINT) AS e{i}" for i, c in enumerate('aeinr'))}, 1::BIGINT AS e5 FROM chunks"""
ORACLES["search_by_text"] = f"""{WITH_CHUNKS},
held AS (SELECT chunk_id, list_transform([{_LETTER_COUNTS.replace('(t', '(text')}, 1], lambda x: CAST(x AS DOUBLE)) AS v FROM chunks),
asked AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_transform([{_LETTER_COUNTS.replace('(t', '(text')}, 1], lambda x: CAST(x AS DOUBLE)) AS v FROM benchmark),
pairs AS (SELECT query_id, chunk_id, list_cosine_similarity(held.v, asked.v) AS raw FROM held, asked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, round(raw, 6) AS score FROM ranked WHERE rank <= 3"""
