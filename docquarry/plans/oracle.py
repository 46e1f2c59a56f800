"""The registered queries once more, as DuckDB SQL over the same tables, to check results by value."""

from __future__ import annotations

from docquarry import config as cf
from docquarry.operators.metrics import ANSWER_METRICS, INFORMAL_WORDS, MARK_BOUNDS, TOXIC_WORDS
from docquarry.plans.answering import NO_PASSAGE, REFUSAL
from docquarry.plans.queries import CELLS, DIM, GATE, PROBES, RUN, SWEEP

_BLANKS = "' ' || chr(9) || chr(13) || chr(10)"
URL = "source || '/' || doc_id || '.txt'"


def _texts(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def words(x: str) -> str:
    return (f"(CASE WHEN trim({x}, {_BLANKS}) = '' THEN []::VARCHAR[] "
            rf"ELSE string_split_regex(trim({x}, {_BLANKS}), '[ \t\r\n]+') END)")


def normalize(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def keywords(x: str) -> str:
    return f"list_distinct({words(normalize(x))})"


def sentences(x: str) -> str:
    return (rf"list_filter(list_transform(regexp_extract_all(regexp_replace({x}, ' ?\.', '.', 'g'), '[^.?!\n]+[.?!]*'), "
            "lambda u: trim(u)), lambda u: u <> '')")


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def containment(part: str, whole: str) -> str:
    return f"(CASE WHEN len({part}) = 0 THEN 0.0::DOUBLE ELSE {shared(part, whole)} / len({part}) END)"


def five_point(x: str) -> str:
    return f"least(5, floor(({x}) * 5)::INTEGER + 1)"


def windows(size: int, overlap: int, name: str = "chunks") -> str:
    """CTEs up to ``name(doc_id, url, chunk_no, content)``."""
    return f"""
doc_words AS (SELECT doc_id, {URL} AS url, {words('text')} AS w FROM documents),
starts AS (SELECT doc_id, url, w, unnest(range(0, greatest(len(w) - {overlap}, 1), {size - overlap})) AS st
           FROM doc_words WHERE len(w) > 0),
{name} AS (SELECT doc_id, url, (st // {size - overlap})::INTEGER AS chunk_no,
           array_to_string(w[st + 1 : st + {size}], ' ') AS content FROM starts)"""


def embedded(name: str, source: str, keys: str, text: str) -> str:
    """CTE chain up to ``name(keys, v, norm)`` with dense hashed word counts."""
    on = " AND ".join(f"g.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    grid = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_tok AS (SELECT {keys}, unnest(string_split({normalize(text)}, ' ')) AS w FROM {source}),
{name}_cnt AS (SELECT {keys}, ('0x' || md5(w)[1:8])::BIGINT % {DIM} AS b,
       sum(CASE WHEN md5(w)[9:9] >= '8' THEN -1 ELSE 1 END)::DOUBLE AS v
       FROM {name}_tok WHERE w <> '' GROUP BY ALL),
{name}_vec AS (SELECT {grid}, list(coalesce(c.v, 0)::DOUBLE ORDER BY g.b) AS v
       FROM (SELECT {keys}, unnest(range({DIM})) AS b FROM {source}) g
       LEFT JOIN {name}_cnt c ON {on} AND g.b = c.b GROUP BY {grid}),
{name} AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM {name}_vec)"""


def cosine_value(a: str, b: str) -> str:
    return (f"(CASE WHEN {a}.norm * {b}.norm = 0 THEN 0.0::DOUBLE "
            f"ELSE list_dot_product({a}.v, {b}.v) / ({a}.norm * {b}.norm) END)")


def cosine(a: str, b: str) -> str:
    return (f"(CASE WHEN {a}.norm * {b}.norm = 0 THEN 0.0::DOUBLE "
            f"ELSE round(list_dot_product({a}.v, {b}.v) / ({a}.norm * {b}.norm), 6) + 0.0 END)")


def hits(name: str, queries: str, keys: str, k: int) -> str:
    q = ", ".join(f"q.{c.strip()}" for c in keys.split(","))
    return f"""
{name}_all AS (SELECT {q}, c.doc_id, c.chunk_no, {cosine('q', 'c')} AS score FROM {queries} q CROSS JOIN chunk_vec_n c),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id, chunk_no)::INTEGER AS rank
       FROM {name}_all QUALIFY rank <= {k})"""


def passages(name: str, hit_table: str, asked: str, keys: str) -> str:
    """``name(keys, context, sources, contexts, result)``."""
    on = " AND ".join(f"h.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    back = " AND ".join(f"a.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    best = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"h.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_text AS (SELECT {own}, h.rank, c.url, c.content, a.question FROM {hit_table} h
       JOIN chunks c USING (doc_id, chunk_no) JOIN {asked} a ON {on}),
{name}_sent AS (SELECT {keys}, rank, question, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos
       FROM (SELECT *, {sentences('content')} AS ss FROM {name}_text)),
{name}_best AS (SELECT {keys}, sentence FROM {name}_sent
       QUALIFY row_number() OVER (PARTITION BY {keys}
               ORDER BY {shared(keywords('sentence'), keywords('question'))} DESC, rank, pos) = 1),
{name}_group AS (SELECT {keys}, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context,
       string_agg(url, chr(10) ORDER BY rank) AS sources, list(content ORDER BY rank) AS contexts
       FROM {name}_text GROUP BY {keys}),
{name} AS (SELECT {mine}, coalesce(g.context, '') AS context, coalesce(g.sources, '') AS sources,
       coalesce(g.contexts, []) AS contexts, coalesce(b.sentence, '{NO_PASSAGE}') AS result
       FROM {asked} a LEFT JOIN {name}_group g ON {back} LEFT JOIN {name}_best b ON {best})"""


CHUNKS = windows(RUN.size, RUN.overlap)
CHUNK_VECTORS = CHUNKS + "," + embedded("chunk_vec_n", "chunks", "doc_id, chunk_no", "content")
LAST = """
last_turn AS (SELECT conv_id, max(turn) AS lt FROM conversations GROUP BY conv_id)"""
STATE = LAST + """,
state AS (SELECT conv_id, arg_max(text, turn) AS question,
       arg_max(text, turn) FILTER (role = 'user' AND turn < lt) AS previous_user,
       count(*) FILTER (turn < lt) AS n_history
       FROM conversations JOIN last_turn USING (conv_id) GROUP BY conv_id)"""
GATED = STATE + f""",
gated AS (SELECT *, CASE WHEN trim(question) = '' THEN 'unclear'
       WHEN {shared(keywords('question'), _texts(GATE.terms))}
          + {shared(keywords("coalesce(previous_user, '')"), _texts(GATE.terms))} >= {GATE.min_hits} THEN 'Yes'
       ELSE 'No' END AS reply FROM state),
labelled AS (SELECT *, CASE WHEN reply = 'Yes' THEN 'yes' WHEN reply = 'No' THEN 'no' ELSE 'other' END AS label,
       CASE WHEN n_history > 0 THEN concat_ws(' ', previous_user, question) ELSE question END AS query FROM gated)"""
PAIRS = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS expected_answer
       FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant')"""
QA_KEYS = "conv_id, turn"
PREDICTED = (
    CHUNK_VECTORS + "," + PAIRS + "," + embedded("pair_vec", "pairs", QA_KEYS, "question") + ","
    + hits("pair_hits", "pair_vec", QA_KEYS, RUN.k) + "," + passages("found", "pair_hits", "pairs", QA_KEYS)
    + """,
eval_rows AS (SELECT conv_id, turn, question, result AS answer, contexts, context, sources,
       expected_answer AS ground_truth FROM found JOIN pairs USING (conv_id, turn))""")


ASKED = (
    CHUNK_VECTORS + """,
asked AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),"""
    + embedded("asked_vec", "asked", QA_KEYS, "question") + ","
    + hits("asked_hits", "asked_vec", QA_KEYS, RUN.k) + "," + passages("found", "asked_hits", "asked", QA_KEYS))


def readability(x: str) -> dict[str, str]:
    return {
        "n_words": f"len({words(x)})::INTEGER",
        "n_sentences": f"len({sentences(x)})::INTEGER",
        "n_syllables": f"len(regexp_extract_all(lower({x}), '[aeiouy]+'))::INTEGER",
        "n_letters": rf"length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g'))::INTEGER",
    }


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


GRADES = """round(0.39::DOUBLE * (n_words / nullif(n_sentences, 0)) + 11.8::DOUBLE * (n_syllables / nullif(n_words, 0)) - 15.59::DOUBLE, 6) AS flesch_kincaid,
       round(4.71::DOUBLE * (n_letters / nullif(n_words, 0)) + 0.5::DOUBLE * (n_words / nullif(n_sentences, 0)) - 21.43::DOUBLE, 6) AS ari"""


def toxicity(x: str) -> str:
    return f"round({containment(keywords(x), _texts(TOXIC_WORDS))}, 6)"


def professionalism(x: str) -> str:
    marks = (rf"(len(regexp_extract_all({x}, '\p{{L}}[''’]\p{{L}}')) + len(regexp_extract_all({x}, '!')) "
             f"+ {shared(keywords(x), _texts(INFORMAL_WORDS))})")
    over = " - ".join(f"(100 * {marks} > {bound} * len({words(x)}))::INTEGER" for bound in MARK_BOUNDS)
    return f"({len(MARK_BOUNDS) + 1} - {over})::INTEGER"


def overlap_f1(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE 2.0::DOUBLE * {shared(a, b)} / (len({a}) + len({b})) END)")


ANSWER_TABLE = PREDICTED + f""",
keyed AS (SELECT *, {keywords('question')} AS qk, {keywords('answer')} AS ak, {keywords('ground_truth')} AS gk,
       {keywords('array_to_string(contexts, chr(10) || chr(10))')} AS ck, {_select(readability('answer'))} FROM eval_rows),
answer_table AS (SELECT conv_id, turn,
       (answer = ground_truth)::INTEGER::DOUBLE AS exact_match, n_words::DOUBLE AS token_count,
       {toxicity('answer')} AS toxicity, {GRADES},
       {five_point(overlap_f1('ak', 'gk'))}::DOUBLE AS answer_correctness,
       {five_point(containment('qk', 'ak'))}::DOUBLE AS answer_relevance,
       {five_point(containment('ak', 'ck'))}::DOUBLE AS faithfulness,
       {professionalism('answer')}::DOUBLE AS professionalism FROM keyed)"""

_UNITS = f"list_transform({sentences('%s')}, lambda s: {keywords('s')})"


def units(x: str) -> str:
    return _UNITS % x


def supported(us: str, evidence: str) -> str:
    return f"len(list_filter({us}, lambda u: {containment('u', evidence)} >= 0.5))"


def share(us: str, evidence: str) -> str:
    return f"round(CASE WHEN len({us}) = 0 THEN 0.0::DOUBLE ELSE {supported(us, evidence)} / len({us}) END, 6)"


COMPONENT_TABLE = (
    PREDICTED
    + "," + embedded("ans_vec", "eval_rows", QA_KEYS, "answer")
    + "," + embedded("truth_vec", "eval_rows", QA_KEYS, "ground_truth")
    + f""",
parts AS (SELECT conv_id, turn, {keywords('question')} AS qk, {keywords('answer')} AS ak, {keywords('ground_truth')} AS gk,
       {keywords("array_to_string(contexts, ' ')")} AS ck, {units('answer')} AS au, {units('ground_truth')} AS gu,
       flatten(list_transform(contexts, lambda t: {units('t')})) AS cu,
       list_transform(contexts, lambda t: {keywords('t')}) AS cks FROM eval_rows),
counted AS (SELECT *, {supported('au', 'gk')} AS tp, len(gu) - {supported('gu', 'ak')} AS fn,
       list_transform(cks, lambda c: {containment('gk', 'c')} >= 0.5) AS rel FROM parts),
resembling AS (SELECT a.conv_id, a.turn, {cosine_value('a', 't')} AS similarity, {cosine('q', 'a')} AS relevancy
       FROM ans_vec a JOIN truth_vec t USING (conv_id, turn) JOIN pair_vec q USING (conv_id, turn)),
component_table AS (SELECT conv_id, turn,
       round(CASE WHEN len(list_filter(rel, lambda f: f)) = 0 THEN 0.0::DOUBLE ELSE
         list_sum(list_transform(rel, lambda f, i: CASE WHEN f THEN
           len(list_filter(rel[1:i], lambda g: g)) / i ELSE 0.0::DOUBLE END)) / len(list_filter(rel, lambda f: f)) END, 6) AS context_precision,
       {share('au', 'ck')} AS faithfulness, relevancy AS answer_relevancy, {share('gu', 'ck')} AS context_recall,
       {share('cu', 'qk')} AS context_relevancy,
       round(0.75::DOUBLE * (CASE WHEN tp + 0.5::DOUBLE * (len(au) - tp + fn) = 0 THEN 0.0::DOUBLE
         ELSE tp / (tp + 0.5::DOUBLE * (len(au) - tp + fn)) END) + 0.25::DOUBLE * similarity, 6) AS answer_correctness,
       round(similarity, 6) AS answer_similarity
       FROM counted JOIN resembling USING (conv_id, turn))""")


def sentence_packing(size: int, overlap: int) -> str:
    """CTEs up to ``packed(doc_id, url, chunk_no, content)``."""
    return f"""
listed AS (SELECT doc_id, {URL} AS url, {sentences('text')} AS us FROM documents),
unit AS (SELECT doc_id, url, unnest(us) AS u, generate_subscripts(us, 1)::INTEGER - 1 AS i FROM listed),
sized AS (SELECT *, len({words('u')}) AS n FROM unit),
summed AS (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS c1 FROM sized),
based AS (SELECT *, c1 - n AS c0 FROM summed),
bases AS (SELECT doc_id, list(c0 ORDER BY i) AS cs FROM based GROUP BY doc_id),
ready AS (SELECT doc_id, url, i, u, c0, c1,
       len(list_filter(cs, lambda c: c < c0 - {overlap}))::INTEGER AS lo FROM based JOIN bases USING (doc_id)),
looked AS (SELECT a.*, b.c0 AS lo_c0 FROM ready a JOIN ready b ON a.doc_id = b.doc_id AND b.i = a.lo),
steps AS (
  SELECT doc_id, i, 0 AS s, 0::BIGINT AS sc, 0 AS chunk_no FROM looked WHERE i = 0
  UNION ALL
  SELECT k.doc_id, k.i,
    CASE WHEN k.c1 - r.sc > {size} THEN greatest(r.s, k.lo) ELSE r.s END,
    CASE WHEN k.c1 - r.sc > {size} AND k.lo >= r.s THEN k.lo_c0 ELSE r.sc END,
    CASE WHEN k.c1 - r.sc > {size} THEN r.chunk_no + 1 ELSE r.chunk_no END
  FROM steps r JOIN looked k ON k.doc_id = r.doc_id AND k.i = r.i + 1),
spans AS (SELECT doc_id, chunk_no, min(s) AS s, max(i) AS e FROM steps GROUP BY doc_id, chunk_no),
packed AS (SELECT p.doc_id, r.url, p.chunk_no, string_agg(r.u, ' ' ORDER BY r.i) AS content
       FROM spans p JOIN ready r ON r.doc_id = p.doc_id AND r.i BETWEEN p.s AND p.e GROUP BY ALL)"""


VECTORS = """
vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
       sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"""


def nearest(k: int, where: str = "true") -> str:
    return f"""
scored AS (SELECT q.vec_id, c.vec_id AS vec_id_hit, {cosine('q', 'c')} AS score FROM vec q CROSS JOIN vec c),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, vec_id_hit)::INTEGER AS rank
       FROM scored WHERE {where} QUALIFY rank <= {k})"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


HREFS = "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"


def file_name(x: str) -> str:
    return f"regexp_extract(regexp_replace({x}, '[?#].*$', ''), '[^/]+$')"


LINKED = f"""
known AS (SELECT DISTINCT {file_name('s')} AS name FROM (
       SELECT unnest({HREFS}) AS s FROM pages) WHERE name <> '' AND md5(name) < '8'),
cited AS (SELECT page_id, s, row_number() OVER (PARTITION BY page_id ORDER BY first_at)::INTEGER - 1 AS source_no FROM (
       SELECT page_id, s, min(pos) AS first_at FROM (
         SELECT page_id, unnest({HREFS}) AS s, generate_subscripts({HREFS}, 1) AS pos FROM pages) GROUP BY ALL)),
linked AS (SELECT page_id, source_no, {file_name('s')} AS name,
       CASE WHEN k.name IS NOT NULL THEN replace('https://library.example/by name/' || k.name, ' ', '%20') END AS link
       FROM cited LEFT JOIN known k ON k.name = {file_name('s')})"""

_MEANS = "context_precision faithfulness answer_relevancy context_recall context_relevancy answer_correctness answer_similarity".split()

ORACLE_SQL: dict[str, str] = {
    "answer_dialogs": _with(
        CHUNK_VECTORS + "," + GATED + ", relevant AS (SELECT * FROM labelled WHERE label = 'yes'),"
        + embedded("asked_vec", "relevant", "conv_id", "query") + "," + hits("asked_hits", "asked_vec", "conv_id", RUN.k)
        + "," + passages("found", "asked_hits", "relevant", "conv_id"),
        f"""SELECT conv_id, 'yes' AS label, result, sources FROM found
UNION ALL SELECT conv_id, label, '{REFUSAL}', '' FROM labelled WHERE label <> 'yes'"""),
    "question_chunks": _with(
        CHUNK_VECTORS + "," + STATE + "," + embedded("asked_vec", "state", "conv_id", "question") + ","
        + hits("asked_hits", "asked_vec", "conv_id", RUN.k),
        "SELECT conv_id, doc_id, chunk_no, rank, score FROM asked_hits"),
    "question_contexts": _with(
        CHUNK_VECTORS + "," + STATE + "," + embedded("asked_vec", "state", "conv_id", "question") + ","
        + hits("asked_hits", "asked_vec", "conv_id", RUN.k) + "," + passages("found", "asked_hits", "state", "conv_id"),
        "SELECT conv_id, context, sources FROM found"),
    "document_preview": "SELECT * FROM documents ORDER BY doc_id LIMIT 10",
    "page_urls": "SELECT url FROM pages",
    "sitemap_urls": "SELECT url FROM pages",
    "article_html": "SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<article(?:\\s[^>]*)?>.*?</article>')), '') AS article FROM pages",
    "article_texts": r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(nullif(trim(regexp_extract(html, '(?s)<article(?:\s[^>]*)?>.*?</article>')), ''), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text
FROM pages""",
    "pages_with_article": r"""
SELECT url, length(nullif(trim(regexp_extract(html, '(?s)<article(?:\s[^>]*)?>.*?</article>')), ''))::INTEGER AS article_chars
FROM pages WHERE article_chars IS NOT NULL""",
    "url_content": f"SELECT doc_id, {URL} AS url, text AS content, length(text)::INTEGER AS content_chars, length(text) > 2000 AS is_long FROM documents",
    "labelled_documents": """
SELECT doc_id, text AS inputs, quality AS targets FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""",
    "html_page_preview": "SELECT page_id, url FROM pages WHERE url LIKE '%.html' ORDER BY page_id LIMIT 10",
    "sampled_documents": """
SELECT doc_id, lang FROM documents WHERE ('0x' || md5('40:' || doc_id)[1:8])::BIGINT < floor(0.3 * 4294967296)::BIGINT""",
    "document_batches": """
SELECT doc_id, source, ((row_number() OVER (ORDER BY doc_id) - 1) // 5)::BIGINT AS page,
  ((row_number() OVER (ORDER BY doc_id) - 1) % 5)::INTEGER AS row_in_page FROM documents""",
    "numbered_chunks": _with(CHUNKS, """
SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) AS id FROM chunks"""),
    "first_questions": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 50",
    "document_lines": """
SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line_no FROM documents""",
    "document_count": "SELECT count(*) AS n FROM documents",
    "cleaned_documents": r"SELECT doc_id, regexp_replace(replace(text, chr(10), ''), ' ?\.', '.', 'g') AS cleaned FROM documents",
    "merged_sections": r"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda s: regexp_replace(replace(s, chr(10), ''), ' ?\.', '.', 'g')), chr(10)) AS merged FROM documents""",
    "sentence_chunks": _with(sentence_packing(RUN.size, RUN.overlap), "SELECT doc_id, chunk_no, content FROM packed", True),
    "evalset_sentence_chunks": _with(
        sentence_packing(cf.EVALSET_CHUNK_SIZE, cf.EVALSET_CHUNK_OVERLAP), "SELECT url, chunk_no, content FROM packed", True),
    "token_windows": _with(CHUNKS, "SELECT doc_id, url, chunk_no, content FROM chunks"),
    "evalset_windows": _with(
        windows(cf.EVALSET_CHUNK_SIZE, cf.EVALSET_CHUNK_OVERLAP), "SELECT doc_id, url, chunk_no, content FROM chunks"),
    "document_token_counts": f"SELECT doc_id, len({words('text')})::INTEGER AS token_count FROM documents",
    "json_fields": f"""
SELECT event_id, json_extract_string(props, '$.k') AS present, props AS missing, event_type AS no_json,
  '{cf.NO_QUESTION}' AS nulled FROM events""",
    "turn_prompts": """
SELECT conv_id, turn, 'Role ' || role || ' asks at turn ' || turn || ':' || chr(10) || text AS prompt FROM conversations""",
    "parsed_labels": r"""
SELECT conv_id, turn,
  CASE WHEN contains(lower(text), 'yes') THEN 'yes' WHEN contains(lower(text), 'no') THEN 'no' ELSE 'other' END AS label,
  CASE WHEN regexp_matches(lower(text), '\byes\b') THEN 'yes' WHEN regexp_matches(lower(text), '\bno\b') THEN 'no' ELSE 'other' END AS strict_label
FROM conversations""",
    "page_file_names": f"""
SELECT page_id, {file_name('url')} AS file_name,
  CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS without_prefix FROM pages""",
    "escaped_turns": """
SELECT conv_id, turn, replace(text, chr(10), '<br/>') AS with_breaks, replace(text, ' ', '%20') AS without_spaces FROM conversations""",
    "version_checks": """
SELECT event_id, user_id::INTEGER AS major, json_extract_string(props, '$.k')::INTEGER AS minor,
  (user_id, json_extract_string(props, '$.k')::INTEGER) >= (50, 30) AS recent FROM events""",
    "source_table_names": f"SELECT DISTINCT '{RUN.catalog}.{RUN.database}.' || lang || '_' || source AS table_name FROM documents",
    "document_embeddings": _with(
        embedded("d", "documents", "doc_id", "text"),
        "SELECT doc_id, b::INTEGER AS bucket, v::FLOAT AS weight FROM d_cnt WHERE v <> 0"),
    "nearest_vectors": _with(VECTORS + "," + nearest(cf.RETRIEVAL_K), "SELECT vec_id, vec_id_hit, rank, score FROM near"),
    "nearest_vectors_tiled": _with(VECTORS + "," + nearest(cf.RETRIEVAL_K), "SELECT vec_id, vec_id_hit, rank, score FROM near"),
    "nearest_neighbour": _with(
        VECTORS + "," + nearest(1, "vec_id <> vec_id_hit"), "SELECT vec_id, vec_id_hit, rank, score FROM near"),
    "nearest_above_score": _with(
        VECTORS + "," + nearest(cf.EVALSET_K, "vec_id <> vec_id_hit AND score >= 0.25"),
        "SELECT vec_id, vec_id_hit, rank, score FROM near"),
    "nearest_vectors_approx": _with(VECTORS + f""",
centres AS (SELECT *, row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) - 1 AS cell FROM vec QUALIFY cell < {CELLS}),
placed AS (SELECT e.vec_id, s.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY {cosine('e', 's')} DESC, s.cell) AS pos
       FROM vec e CROSS JOIN centres s),
scored AS (SELECT q.vec_id, c.vec_id AS vec_id_hit, {cosine('qe', 'ce')} AS score
       FROM placed q JOIN placed c ON q.cell = c.cell AND c.pos = 1 AND q.pos <= {PROBES}
       JOIN vec qe ON qe.vec_id = q.vec_id JOIN vec ce ON ce.vec_id = c.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, vec_id_hit)::INTEGER AS rank
       FROM scored QUALIFY rank <= {cf.RETRIEVAL_K})""", "SELECT vec_id, vec_id_hit, rank, score FROM near"),
    "index_sync": """
SELECT vec_id, label, CASE WHEN label >= 7 THEN 'added' WHEN label = 0 AND embedding <> list_reverse(embedding) THEN 'updated' ELSE 'kept' END AS sync_action
FROM embeddings""",
    "synced_index_state": """
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS INTEGER) AS label, len(embedding)::INT AS n
        FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 13 <> 0 AND vec_id % 17 <> 0""",
    "stored_index_search": _with(
        VECTORS + "," + nearest(cf.RETRIEVAL_K, "vec_id % 50 = 0 AND vec_id_hit % 11 <> 0"), "SELECT vec_id, vec_id_hit, rank, score FROM near"),
    "missing_index_rows": "SELECT vec_id, label FROM embeddings WHERE label >= 7",
    "latest_user_events": """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "dimension_counts": "SELECT vec_id, CASE WHEN label = 0 THEN 'quarantined' ELSE 'usable' END AS state FROM embeddings",
    "last_questions": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id",
    "last_user_questions": """
SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "dialog_history": _with(LAST, """
SELECT conv_id, turn, role, text FROM conversations JOIN last_turn USING (conv_id) WHERE turn < lt"""),
    "rendered_history": _with(LAST, """
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat_history
FROM conversations JOIN last_turn USING (conv_id) WHERE turn < lt GROUP BY conv_id"""),
    "transcripts": """
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '> ' ELSE '< ' END || replace(text, chr(10), '<br/>'),
  chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""",
    "gate_labels": _with(GATED, "SELECT conv_id, n_history, reply, label FROM labelled"),
    "rewritten_queries": _with(GATED, "SELECT conv_id, query FROM labelled"),
    "appended_turns": _with(STATE, """
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, lt + 1, 'user', 'Tell me more: ' || question FROM state JOIN last_turn USING (conv_id)
UNION ALL SELECT conv_id, lt + 2, 'assistant', 'About turn ' || lt FROM last_turn"""),
    "resolved_sources": _with(LINKED, "SELECT page_id, source_no, name, link FROM linked"),
    "source_link_lists": _with(LINKED, """
SELECT page_id, string_agg(coalesce(link, name), chr(10) ORDER BY source_no) AS links FROM linked GROUP BY page_id"""),
    "cloze_eval_set": _with(windows(cf.EVALSET_CHUNK_SIZE, cf.EVALSET_CHUNK_OVERLAP) + f""",
worded AS (SELECT url, chunk_no, {words('content')} AS w FROM chunks),
placed AS (SELECT *, list_position(list_transform(w, lambda x: length(x)), list_max(list_transform(w, lambda x: length(x)))) AS pos
       FROM worded),
made AS (SELECT url, chunk_no, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = pos THEN '____' ELSE x END), ' ') AS question,
       nullif({normalize('w[pos]')}, '') AS answer FROM placed)""",
        "SELECT url, chunk_no, question, answer FROM made WHERE answer IS NOT NULL"),
    "document_readability": f"""
SELECT *, {GRADES} FROM (SELECT doc_id, {_select(readability('text'))} FROM documents)""",
    "document_toxicity": f"SELECT doc_id, toxic, {toxicity('text')} AS toxicity FROM documents LEFT JOIN labels USING (doc_id)",
    "harmfulness": f"""
SELECT toxic, flagged, count(*) AS n FROM (SELECT toxic, {toxicity('text')} > 0 AS flagged FROM documents LEFT JOIN labels USING (doc_id))
GROUP BY ALL""",
    "turn_professionalism": f"""
SELECT conv_id, turn, {professionalism('text')} AS professionalism FROM conversations WHERE role = 'assistant'""",
    "predicted_answers": _with(ASKED, "SELECT conv_id, turn, result AS answer, sources FROM found"),
    "rag_eval_rows": _with(PREDICTED, """
SELECT conv_id, turn, question, answer, array_to_string(contexts, chr(10)) AS contexts, ground_truth FROM eval_rows"""),
    "answer_eval_table": _with(ANSWER_TABLE, "SELECT * FROM answer_table"),
    "answer_eval_summary": _with(ANSWER_TABLE + f""",
long AS (UNPIVOT answer_table ON {', '.join(ANSWER_METRICS)} INTO NAME metric VALUE score)""", """
SELECT metric, count(*) AS n, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS variance,
  round(quantile_cont(score, 0.9), 6) AS p90 FROM long GROUP BY metric"""),
    "component_eval_table": _with(COMPONENT_TABLE, "SELECT * FROM component_table"),
    "judged_components": _with(COMPONENT_TABLE, "SELECT *, 0 AS n_failed FROM component_table"),
    "regenerated_relevancy": _with(
        PAIRS + "," + embedded("pair_vec", "pairs", QA_KEYS, "question") + """,
asked_anew AS (SELECT conv_id, turn, i, i || ' ' || expected_answer AS made FROM pairs, range(1, 4) AS r(i) WHERE trim(expected_answer) <> ''),"""
        + embedded("made_vec", "asked_anew", QA_KEYS + ", i", "made") + f""",
compared AS (SELECT conv_id, turn, avg({cosine_value('q', 'm')}) AS mean, count(*)::INTEGER AS n
       FROM pair_vec q JOIN made_vec m USING (conv_id, turn) GROUP BY ALL)""",
        "SELECT conv_id, turn, coalesce(round(mean, 6), 0.0::DOUBLE) AS answer_relevancy, coalesce(n, 0) AS n_questions, 0 AS n_failed FROM pairs LEFT JOIN compared USING (conv_id, turn)"),
    "evaluate_rag": _with(COMPONENT_TABLE, "SELECT " + ", ".join(
        f"round(avg({m}), 6) AS {m}" for m in _MEANS) + " FROM component_table"),
    "quality_distribution": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",
    "token_histogram": f"""
SELECT (len({words('text')}) // 50) * 50 AS lower, count(*) AS n FROM documents GROUP BY ALL""",
    "toxicity_scatter": "SELECT toxic * 100 AS toxicity, quality AS correctness FROM labels",
    "toxicity_quality": "SELECT toxic, quality, count(*) AS n FROM labels GROUP BY ALL",
    "toxicity_correlation": "SELECT round(corr(toxic, quality), 6) AS correlation FROM labels",
    "label_context_precision": _with(VECTORS + "," + nearest(10, "vec_id <> vec_id_hit") + """,
judged AS (SELECT n.vec_id, n.rank, (a.label = b.label)::INTEGER AS rel FROM near n
       JOIN vec a ON a.vec_id = n.vec_id JOIN vec b ON b.vec_id = n.vec_id_hit),
ranked AS (SELECT *, sum(rel) OVER (PARTITION BY vec_id ORDER BY rank) / rank AS p FROM judged)""", """
SELECT vec_id, round(coalesce(sum(p * rel) / nullif(sum(rel), 0), 0), 6) AS context_precision FROM ranked GROUP BY vec_id"""),
    "label_mate_similarity": _with(VECTORS + "," + nearest(3, "vec_id <> vec_id_hit"), """
SELECT vec_id, round(avg(score), 6) AS answer_relevancy FROM near GROUP BY vec_id"""),
    "latest_versions": """
SELECT event_type, greatest(1, max(json_extract_string(props, '$.k')::INTEGER)) AS latest_version FROM events GROUP BY event_type""",
    "missing_responses": """
SELECT conv_id, turn, text FROM conversations u WHERE role = 'user' AND NOT EXISTS (
  SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""",
    "log_completeness": """
SELECT count(*) AS n_requests, count(a.conv_id) AS n_answered, count(*) = count(a.conv_id) AS complete
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "replayed_questions": _with(
        CHUNK_VECTORS + """,
pairs AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 50),"""
        + embedded("pair_vec", "pairs", QA_KEYS, "question") + "," + hits("pair_hits", "pair_vec", QA_KEYS, RUN.k) + ","
        + passages("found", "pair_hits", "pairs", QA_KEYS),
        "SELECT conv_id, turn, result AS answer FROM found"),
}

_SWEEP = ", ".join(f"({s}, {o})" for s, o in SWEEP)
_SWEPT = f"""
counted AS (SELECT len({words('text')}) AS n FROM documents),
config(size, overlap) AS (VALUES {_SWEEP}),
started AS (SELECT size, overlap, n, unnest(range(0, greatest(n - overlap, 1), size - overlap)) AS st
       FROM counted CROSS JOIN config WHERE n > 0),
swept AS (SELECT size, overlap, count(*) AS n_chunks, sum(least(size, n - st))::BIGINT AS n_tokens,
       min(least(size, n - st))::INTEGER AS shortest, max(least(size, n - st))::INTEGER AS longest,
       round(sum(least(size, n - st)) / count(*), 6) AS mean_tokens FROM started GROUP BY size, overlap)"""
ORACLE_SQL["chunk_sweep"] = _with(_SWEPT, "SELECT * FROM swept")
ORACLE_SQL["run_ranking"] = _with(_SWEPT, """
SELECT size, overlap, 1::BIGINT AS n, round(mean_tokens / size, 6) AS mean_score,
  row_number() OVER (ORDER BY round(mean_tokens / size, 6) DESC, size, overlap)::INTEGER AS rank FROM swept""")

ORACLE_SQL["streamed_chunks"] = ORACLE_SQL["sentence_chunks"]
ORACLE_SQL["streamed_index"] = """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
ORACLE_SQL["streamed_eval_set"] = ORACLE_SQL["cloze_eval_set"]

ORACLE_SQL |= {
    "csv_eval_set": _with(PAIRS, """
SELECT conv_id * 1000 + turn AS id, question, 'On ' || question AS answer,
  CASE WHEN turn % 2 = 0 THEN question || chr(10) || expected_answer ELSE '' END AS contexts, expected_answer AS ground_truth
FROM pairs WHERE turn % 3 <> 0"""),
    "csv_without_id": "SELECT quality, toxic FROM labels",
    "stored_labels": "SELECT doc_id, quality, toxic, NULL::VARCHAR AS judge, true AS found, true AS empty FROM labels WHERE quality IN (0, 1)",
    "streamed_files": """
SELECT doc_id // 50 AS batch, sum(strlen(text) + 1)::BIGINT AS length,
  CASE WHEN doc_id // 50 > 0 THEN len(string_split_regex(string_agg(text, chr(10) ORDER BY doc_id) || chr(10), '\\n{2,}')) END::INTEGER AS sections
FROM documents GROUP BY 1""",
    "fetch_log": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN length(html) END::INTEGER AS body_chars FROM pages",
    "threaded_model_turns": "SELECT conv_id, turn, role || ':' || length(text) AS reply FROM conversations",
    "guarded_eval_set": _with(windows(cf.EVALSET_CHUNK_SIZE, cf.EVALSET_CHUNK_OVERLAP), """
SELECT url, chunk_no, CASE WHEN length(content) % 7 <> 0 THEN left(content, 20) END AS question,
  CASE WHEN length(content) % 7 <> 0 THEN left(content, 20) || '!' END AS answer,
  CASE WHEN length(content) % 7 = 0 THEN 'ValueError: unlucky length' END AS error FROM chunks"""),
    "judged_answers": _with(PAIRS, """
SELECT conv_id, turn, length(expected_answer) % 10 / 10.0::DOUBLE AS toxicity, points::DOUBLE AS answer_correctness, points::DOUBLE AS answer_relevance,
  ((length(question) + 2 * length(expected_answer) + 2) % 5 + 1)::DOUBLE AS faithfulness, points::DOUBLE AS tone
FROM (SELECT *, (length(question) + length(expected_answer)) % 5 + 1 AS points FROM pairs)"""),
    "unusable_vectors": """
SELECT q.vec_id, c.vec_id AS hit, q.label <= 2 AS unusable FROM embeddings q JOIN embeddings c ON c.label > 2
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id) = 1""",
    "stored_eval_replies": _with(windows(cf.EVALSET_CHUNK_SIZE, cf.EVALSET_CHUNK_OVERLAP) + """,
spoken AS (SELECT DISTINCT content FROM chunks JOIN documents USING (doc_id) WHERE lang = 'en')""", """
SELECT doc_id, chunk_no, CASE WHEN length(content) % 7 <> 0 THEN left(content, 20) END AS question,
  CASE WHEN length(content) % 7 <> 0 THEN left(content, 20) || '!' END AS answer,
  CASE WHEN length(content) % 7 = 0 THEN 'ValueError: unlucky length' END AS error,
  CASE WHEN length(content) % 7 <> 0 AND content IN (SELECT content FROM spoken) THEN 1 ELSE 2 END::INTEGER AS reply_batch FROM chunks"""),
    "numbered_appends": _with(CHUNKS, """
SELECT c.doc_id, chunk_no, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, c.doc_id, chunk_no) AS id
FROM chunks c JOIN documents d ON c.doc_id = d.doc_id"""),
    "awaited_log": """
SELECT conv_id, turn, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS n_log
FROM conversations u WHERE role = 'user' AND NOT EXISTS (
  SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""",
    "stream_head": "SELECT least(50, count(*)) AS n, least(50, count(*)) AS n_known FROM documents",
    "rebuilt_labels": "SELECT doc_id, quality, toxic, true AS gone FROM labels",
}
