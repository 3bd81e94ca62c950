"""The same queries for DuckDB."""

from __future__ import annotations

from .. import engine
from ..config import ASSISTANTS, DEFAULT
from ..functions.text import BLANK, SENTENCE, TRIM
from ..operators import booking, fusion, proximity, routing
from . import fixtures


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_WORDS = "regexp_extract_all({}, '[^ \\n\\r\\t]+')"
#: (size of a text, its last n characters or words, what a joiner counts)
_CHARS = ("length({})", "right({}, {})", 1)
_TOKENS = (f"len({_WORDS})", "array_to_string(" + _WORDS.replace("{}", "{0}") + "[-{1}:], ' ')", 0)


def _pack(units: str, most: int, overlap: int, joiner: str, measure=_CHARS) -> str:
    size, tail, gap = measure
    cur, new = size.format("a.cur"), size.format("x.cur")
    carry = f"CASE WHEN least({overlap}, {cur}) + {gap} + {new} <= {most} THEN {tail.format('a.cur', overlap)} || {joiner} || x.cur ELSE x.cur END" if overlap else "x.cur"
    start = f"list_transform({units}, lambda u: {{'done': []::VARCHAR[], 'cur': u}})"
    step = f"CASE WHEN {cur} + {gap} + {new} <= {most} THEN {{'done': a.done, 'cur': a.cur || {joiner} || x.cur}} ELSE {{'done': list_append(a.done, a.cur), 'cur': {carry}}} END"
    return f"(SELECT CASE WHEN len(pk) = 0 THEN []::VARCHAR[] ELSE list_append(r.done, r.cur) END FROM (SELECT pk, CASE WHEN len(pk) > 0 THEN list_reduce(pk, lambda a, x: {step}) END AS r FROM (SELECT {start} AS pk)))"


def _chunks(table: str, key: str, others: str, most: int, overlap: int, measure=_CHARS) -> str:
    """Units level by level as rows, then packed: (key, others, chunks)."""
    fits = lambda c: f"{measure[0].format(c)} <= {most}"
    cut = f"flatten(list_transform(ws, lambda x: list_transform(generate_series(0, (length(x) - 1) // {most}), lambda n: substr(x, n * {most} + 1, {most}))))"
    words, cut = ("list_filter(string_split(s, ' '), lambda x: length(x) > 0)", cut) if measure is _CHARS else (_WORDS.format("s"), "ws")
    u = f"""
    p AS (SELECT {key}, {others}, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p, generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) AS i FROM {table}),
    l AS (SELECT {key}, {others}, i, unnest(CASE WHEN {fits("p")} THEN [p] ELSE string_split(p, chr(10)) END) AS l, unnest(generate_series(1, len(CASE WHEN {fits("p")} THEN [p] ELSE string_split(p, chr(10)) END))) AS j FROM p),
    s AS (SELECT {key}, {others}, i, j, unnest(CASE WHEN {fits("l")} THEN [l] ELSE regexp_extract_all(l, '{SENTENCE}') END) AS s, unnest(generate_series(1, len(CASE WHEN {fits("l")} THEN [l] ELSE regexp_extract_all(l, '{SENTENCE}') END))) AS k FROM l),
    w AS (SELECT *, {words} AS ws FROM s),
    c AS (SELECT * EXCLUDE (ws), {cut} AS cs FROM w),
    u AS (SELECT {key}, {others}, i, j, k, CASE WHEN {fits("s")} THEN [s] ELSE {_pack("cs", most, 0, "' '", measure)} END AS us FROM c),
    g AS (SELECT {key}, {others}, list_filter(flatten(list(us ORDER BY i, j, k)), lambda x: regexp_matches(x, '\\S')) AS us FROM u GROUP BY {key}, {others}),
    d AS (SELECT {key}, {others}, {_pack("us", most, overlap, "chr(10)", measure)} AS cs FROM g)
    """
    return f"(WITH {u} SELECT {key}, {others}, unnest(cs) AS text, unnest(generate_series(0, len(cs) - 1)) AS ordinal FROM d)"


PARENTS = f"parents AS (SELECT doc_id || '#' || ordinal AS parent_id, ordinal::INT AS ordinal, text, doc_id, source FROM {_chunks('documents', 'doc_id', 'source', DEFAULT.parent_chars, DEFAULT.parent_overlap)})"
CHILDREN = f"{PARENTS}, children AS (SELECT parent_id || '#' || ordinal AS child_id, parent_id, doc_id, ordinal::INT AS ordinal, text FROM {_chunks('parents', 'parent_id', 'doc_id', DEFAULT.child_chars, DEFAULT.child_overlap)})"


def _toks(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({c}), '([\\x{{4e00}}-\\x{{9fff}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(items: str, key: str, k: int, queries: str = "(SELECT item_id AS query_id, 0 AS variant, text FROM benchmark)") -> str:
    return f"""
    bt AS (SELECT {key}, {_toks("text")} AS ts FROM {items}),
    st AS (SELECT count(*) AS docs, avg(len(ts)) AS mean FROM bt),
    po AS (SELECT {key}, term, n, count(*) AS tf FROM (SELECT {key}, len(ts) AS n, unnest(ts) AS term FROM bt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    qt AS (SELECT query_id, variant, unnest(list_distinct({_toks("text")})) AS term FROM {queries}),
    sc AS (SELECT query_id, variant, {key}, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * {DEFAULT.bm25_k1 + 1} / (tf + {DEFAULT.bm25_k1} * ({1 - DEFAULT.bm25_b} + {DEFAULT.bm25_b} * n / mean)))), 6) AS score
      FROM po JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, {key}) AS rank FROM sc) WHERE rank <= {k})"""


def _assistant(name: str) -> str:
    """The prompt of an assistant with a memory per key for each conversation's last user message."""
    a = ASSISTANTS[name]
    own = " || text || ".join(_q(x) for x in a.user.split("{{message}}"))
    others = "role <> 'system'" if a.system else "true"
    system = f"UNION ALL SELECT conv_id, -1, 'system', {_q(a.system.replace('{{current_date}}', '2025-04-14'))} FROM said" if a.system else ""
    return f"""WITH said AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
    m AS (SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN said USING (conv_id) WHERE c.turn < said.turn AND {others} UNION ALL SELECT conv_id, turn, 'user', {own} FROM said {system}),
    w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r, max((role = 'system')::INT) OVER (PARTITION BY conv_id) AS has FROM m),
    k AS (SELECT * FROM w WHERE CASE WHEN role = 'system' THEN r = 1 ELSE r <= {a.memory} - has END)
    SELECT conv_id, max(turn) AS turn, count(*)::INT AS n, string_agg(role || ': ' || text, chr(10) ORDER BY role <> 'system', turn) AS prompt FROM k GROUP BY conv_id"""


_IDF = "ln(1 + (docs - df + 0.5) / (df + 0.5))"
_FEEDBACK = f"""{_bm25("documents", "doc_id", DEFAULT.per_retriever)},
    fb AS (SELECT *, score / sum(score) OVER (PARTITION BY query_id) AS share FROM bm WHERE rank <= {DEFAULT.feedback_chunks}),
    fw AS (SELECT query_id, term, round(sum(share * tf / n) * min({_IDF}), 9) AS w FROM fb JOIN po USING (doc_id) JOIN df USING (term), st WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM qt) GROUP BY ALL),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS r, max(w) OVER (PARTITION BY query_id) AS most FROM fw WHERE w > 0),
    wt AS (SELECT query_id, term, 1.0::DOUBLE AS weight FROM qt UNION ALL SELECT query_id, term, w / most * {DEFAULT.feedback_weight} FROM fr WHERE r <= {DEFAULT.feedback_terms}),
    sw AS (SELECT query_id, doc_id, round(sum(weight * {_IDF} * (tf * {DEFAULT.bm25_k1 + 1} / (tf + {DEFAULT.bm25_k1} * ({1 - DEFAULT.bm25_b} + {DEFAULT.bm25_b} * n / mean)))), 6) AS score FROM po JOIN df USING (term) JOIN wt USING (term), st GROUP BY ALL),
    fm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sw) WHERE rank <= {DEFAULT.per_retriever})"""


def _embed(c: str) -> str:
    return f"(SELECT list_transform(generate_series(0, {DEFAULT.dims - 1}), lambda i: len(list_filter(hs, lambda h: h = i))::DOUBLE) FROM (SELECT list_transform({_toks(c)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {DEFAULT.dims}) AS hs))"


def _knn(queries: str, items: str, key: str, k: int, min_score: float = DEFAULT.min_score, p: str = "k") -> str:
    return f"""
    {p}q AS (SELECT query_id, variant, e, sqrt(list_dot_product(e, e)) AS n FROM {queries}),
    {p}i AS (SELECT {key}, e, sqrt(list_dot_product(e, e)) AS n FROM {items}),
    {p}s AS (SELECT query_id, variant, {key}, round((1 + list_dot_product(q.e, i.e) / (q.n * i.n)) / 2, 6) AS score FROM {p}q q, {p}i i WHERE q.n > 0 AND i.n > 0),
    {p}n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, {key}) AS rank FROM {p}s WHERE score >= {min_score}) WHERE rank <= {k})"""


_VEC = "(SELECT vec_id AS query_id, 0 AS variant, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0)"
_VECS = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_CE = f"(SELECT child_id, {_embed('text')} AS e FROM children)"
_ONE = "(SELECT item_id AS query_id, 0 AS variant, text FROM benchmark)"
_TWO = f"(SELECT query_id, variant, text FROM (SELECT item_id AS query_id, 0 AS variant, text FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(list_filter({_toks('text')}, lambda t: length(t) > 4), ' ') FROM benchmark) WHERE variant = 0 OR length(trim(text)) > 0)"
_QE = f"(SELECT item_id AS query_id, 0 AS variant, {_embed('text')} AS e FROM benchmark)"


def _hits(queries: str = _ONE) -> str:
    """Both retrievers over all wordings, fused, and what follows up to the texts of the answer."""
    vectors = f"(SELECT query_id, variant, {_embed('text')} AS e FROM {queries})"
    first = "ORDER BY variant, retriever, rank, child_id, parent_id"
    return f"""{CHILDREN}, {_bm25("children", "child_id", DEFAULT.per_retriever, queries)}, {_knn(vectors, _CE, "child_id", DEFAULT.per_retriever)},
    hits AS (SELECT h.*, parent_id, doc_id, text FROM (SELECT query_id, variant, 'bm25' AS retriever, rank, child_id FROM bm UNION ALL SELECT query_id, variant, 'knn', rank, child_id FROM kn) h JOIN children USING (child_id)),
    fused AS (SELECT query_id, text, round(sum(1.0::DOUBLE / ({DEFAULT.rrf_k} + rank)), 10) AS score, first(child_id {first}) AS child_id, first(parent_id {first}) AS parent_id FROM hits GROUP BY query_id, text),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM fused) WHERE rank <= {DEFAULT.top_children}),
    found AS (SELECT * FROM (SELECT query_id, parent_id, min(rank) AS position FROM best GROUP BY ALL) JOIN parents USING (parent_id)),
    rs AS (SELECT f.*, len(list_distinct(list_concat(a, b))) AS n, len(list_intersect(a, b)) AS shared FROM (SELECT found.*, benchmark.text AS question, list_distinct({_toks("found.text")}) AS b, list_distinct({_toks("benchmark.text")}) AS a FROM found JOIN benchmark ON item_id = query_id) f),
    rd AS (SELECT *, CASE WHEN n > 0 THEN round(shared / n, 6) ELSE 0.0 END AS rscore, row_number() OVER (PARTITION BY query_id, text, doc_id, source ORDER BY position, parent_id) AS dup FROM rs),
    top3 AS (SELECT * FROM (SELECT query_id, parent_id AS chunk_id, text, rscore AS score, row_number() OVER (PARTITION BY query_id ORDER BY rscore DESC, position, parent_id) AS rank FROM rd WHERE dup = 1) WHERE rank <= {DEFAULT.top_parents}),
    off3 AS (SELECT * FROM (SELECT query_id, parent_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position, parent_id) AS rank FROM found) WHERE rank <= {DEFAULT.top_parents}),
    aug AS (SELECT query_id, rank, chunk_id, text, score, 'parent' AS kind FROM top3 UNION ALL SELECT query_id, rank, child_id, text, NULL, 'child' FROM best WHERE query_id NOT IN (SELECT query_id FROM found)),
    part AS (SELECT *, CASE WHEN length(question) % 3 > 0 AND length(text) % 2 = 0 THEN rscore END AS pscore FROM rd),
    pany AS (SELECT *, max((pscore IS NOT NULL)::INT) OVER (PARTITION BY query_id) AS scored FROM part),
    part3 AS (SELECT * FROM (SELECT query_id, parent_id AS chunk_id, pscore AS score, row_number() OVER (PARTITION BY query_id ORDER BY pscore DESC NULLS LAST, position, parent_id) AS rank FROM pany WHERE scored = 0 OR dup = 1 AND pscore IS NOT NULL) WHERE rank <= {DEFAULT.top_parents})"""


def _near(toks: str, gap: int) -> str:
    """Distinct pairs of words, the second 1 to ``gap`` words after the first."""
    return f"list_distinct(flatten(list_transform(generate_series(1, {gap}), lambda g: list_transform(generate_series(1, len({toks}) - g), lambda i: {toks}[i] || ' ' || {toks}[i + g]))))"


def _share(n: str, of: str) -> str:
    return f"CASE WHEN len({of}) > 0 THEN round({n} / len({of}), 6) ELSE 0.0 END"


_STRETCH = f"list_max(list_transform(b, lambda x, i: CASE WHEN list_contains(qd, x) THEN len(list_intersect(b[i:i + {proximity.SPAN - 1}], qd)) ELSE 0 END))"
PLACES = f"""pw AS (SELECT found.*, {_toks("benchmark.text")} AS a, {_toks("found.text")} AS b FROM found JOIN benchmark ON query_id = item_id),
    pp AS (SELECT *, list_distinct(a) AS qd, {_near("a", 1)} AS qp, {_near("b", 1)} AS t1, {_near("b", proximity.NEAR)} AS tn FROM pw),
    places AS (SELECT query_id, parent_id, text, doc_id, source, position, {_share("len(list_intersect(qd, b))", "qd")} AS covered, {_share("len(list_intersect(qp, t1))", "qp")} AS adjacent,
      {_share("len(list_intersect(qp, tn))", "qp")} AS near, {_share(f"coalesce({_STRETCH}, 0)", "qd")} AS tight, {_share("len(list_intersect(qd, b))", "list_distinct(list_concat(a, b))")} AS overlap FROM pp),
    ps AS (SELECT *, round(0.2::DOUBLE * covered + 0.2::DOUBLE * adjacent + 0.2::DOUBLE * near + 0.2::DOUBLE * tight + 0.2::DOUBLE * overlap, 6) AS score, row_number() OVER (PARTITION BY query_id, text, doc_id, source ORDER BY position, parent_id) AS dup FROM places),
    ptop AS (SELECT query_id, parent_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position, parent_id) AS rank FROM ps WHERE dup = 1)"""
HITS, HITS2 = _hits(), _hits(_TWO)
_FOUND = f"SELECT query_id, string_agg('[来源：' || coalesce(doc_id::VARCHAR, '未知') || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS answer FROM tn JOIN children USING (child_id) GROUP BY query_id"


def _tool(min_score: float) -> str:
    return f"{_knn(_QE, _CE, 'child_id', DEFAULT.tool_k, min_score, 't')}, tool AS (SELECT item_id AS query_id, coalesce(answer, {_q(fusion.NO_MATCH)}) AS answer FROM benchmark LEFT JOIN ({_FOUND}) ON item_id = query_id)"


TOOL, TOOL_NEAR = _tool(DEFAULT.min_score), _tool(fixtures.NEAR)
_CTX = f"ctx AS (SELECT item_id AS query_id, benchmark.text || coalesce({_q(fusion.INJECT)} || ctx, '') AS prompt FROM benchmark LEFT JOIN (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS ctx FROM aug GROUP BY query_id) ON item_id = query_id)"
_AGENT = f"agent AS (SELECT query_id, text || {_q(fusion.INJECT)} || answer AS prompt FROM tool JOIN benchmark ON item_id = query_id)"


def _route(source: str, keep: str, rest: str) -> str:
    q = f"regexp_replace(text, '{TRIM}', '', 'g')"
    when = [f"WHEN text IS NULL OR regexp_matches(text, '{BLANK}') THEN ['{routing.SIMPLE}', '空问题']", f"WHEN len(regexp_extract_all({q}, '[?？]')) >= 2 THEN ['{routing.AGENTIC}', '规则·多问句']", f"WHEN length({q}) > {DEFAULT.complex_min_chars} THEN ['{routing.AGENTIC}', '规则·超长问题(>{DEFAULT.complex_min_chars}字)']"]
    when += [f"WHEN regexp_matches({q}, '{p}') THEN ['{routing.AGENTIC}', '规则·{n}']" for n, p in routing.COMPLEX_SIGNALS]
    when += [f"WHEN regexp_matches({q}, '{p}') THEN ['{routing.SIMPLE}', '规则·{n}']" for n, p in routing.SIMPLE_SIGNALS]
    when += [f"WHEN length({q}) <= {DEFAULT.simple_max_chars} THEN ['{routing.SIMPLE}', '规则·短句(<={DEFAULT.simple_max_chars}字)']"]
    return f"(SELECT {keep}, d[1] AS route, d[2] AS reason FROM (SELECT *, CASE {' '.join(when)} ELSE {rest} END AS d FROM {source}))"


_CLOSED = f"['{routing.SIMPLE}', '规则未命中且LLM兜底已关闭']"
_LABELLED = "[" + ", ".join(f"{{'text': {_q(t)}, 'expected': {_q(e)}}}" for t, e in fixtures.ROUTES) + "]"
_CASES = f"(SELECT conv_id, turn, labelled.text || ' ' || regexp_extract(said, '{fixtures.FIRST}') AS text, labelled.expected AS expected FROM (SELECT conv_id, turn, text AS said, {_LABELLED}[(conv_id * 7 + turn) % {len(fixtures.ROUTES)} + 1] AS labelled FROM conversations WHERE role = 'user'))"
_ANSWERED = f"CASE length(text) % 3 WHEN 0 THEN ['{routing.AGENTIC}', 'LLM·complex'] WHEN 1 THEN ['{routing.SIMPLE}', 'LLM·SIMPLE'] ELSE ['{routing.SIMPLE}', 'LLM·空响应降级'] END"
_FAILED = f"CASE WHEN length(trim(text)) % 2 = 0 THEN ['{routing.AGENTIC}', 'LLM·COMPLEX'] ELSE ['{routing.SIMPLE}', 'LLM分类失败降级'] END"
_USER = _route("(SELECT * FROM conversations WHERE role = 'user')", "conv_id, turn", _CLOSED)
_ROW = "id, username, idCard, department, date, time, doctorName"
_SLOT = "SELECT o_orderkey + 1 AS {}, 'c' || o_custkey AS username, lpad(o_custkey::VARCHAR, 18, '0') AS idCard, o_orderpriority AS department, year(o_orderdate)::VARCHAR AS date, CASE WHEN o_orderkey % 2 = 0 THEN '上午' ELSE '下午' END AS time, 'd' || (o_orderkey % 17)::VARCHAR AS doctorName FROM orders WHERE o_orderstatus {} 'O'"
_BOOK, _REQ = f"b AS ({_SLOT.format('id', '<>')})", f"r AS ({_SLOT.format('request_id', '=')})"
_SAME = " AND ".join(f"r.{k} = b.{k}" for k in booking.KEY)
_FREE = f"{_BOOK}, {_REQ}, f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME}) AND NOT EXISTS (SELECT 1 FROM r e WHERE e.request_id < r.request_id AND {_SAME.replace('b.', 'e.')}))"
_HIT = f"{_BOOK}, {_REQ}, h AS (SELECT request_id, min(b.id) AS id FROM r JOIN b ON {_SAME} GROUP BY request_id)"


_GUARDED = f"(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || chr(12288) || ' ' WHEN 2 THEN chr(9) || '  ' || substr(text, 1, {DEFAULT.simple_max_chars}) || ' ' || chr(10) ELSE text END AS text FROM conversations)"
_BOTH = f"(SELECT conv_id, turn, '我想预约，' || text AS text FROM {_CASES})"


def _window(n: int) -> str:
    return f"""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS rn, max((role = 'system')::INT) OVER (PARTITION BY conv_id) AS has FROM conversations)
    WHERE CASE WHEN role = 'system' THEN rn = 1 ELSE rn <= {n} - has END"""


def _knn_sql(k: int, min_score: float = DEFAULT.min_score) -> str:
    return f"WITH {_knn(_VEC, _VECS, 'vec_id', k, min_score)} SELECT query_id, rank, vec_id, score FROM kn"


ORACLES = {
    "chunk_parents": f"WITH {PARENTS} SELECT parent_id, ordinal, text, doc_id, source FROM parents",
    "chunk_children": f"WITH {CHILDREN} SELECT child_id, parent_id, doc_id, ordinal, text, parent_id AS meta_parent FROM children",
    "ingest_stats": f"WITH {CHILDREN} SELECT 'documents' AS key, (SELECT count(*) FROM documents) AS value UNION ALL SELECT 'parents', (SELECT count(*) FROM parents) UNION ALL SELECT 'children', (SELECT count(*) FROM children)",
    "tokenize_docs": f"SELECT doc_id, len({_toks('text')})::INT AS n_tokens, len(list_distinct({_toks('text')}))::INT AS n_distinct FROM documents",
    "bm25_postings": f"SELECT doc_id, term, count(*) AS tf, length FROM (SELECT doc_id, len({_toks('text')})::INT AS length, unnest({_toks('text')}) AS term FROM documents) GROUP BY ALL",
    "bm25_top20": f"WITH {_bm25('documents', 'doc_id', DEFAULT.per_retriever)} SELECT query_id, rank, doc_id, score FROM bm",
    "feedback_top20": f"WITH {_FEEDBACK} SELECT query_id, rank, doc_id, score FROM fm",
    "feedback_recall": f"WITH {_FEEDBACK}, truth AS (SELECT item_id AS query_id, doc_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)), hits AS (SELECT 'asked' AS way, query_id, doc_id FROM bm UNION ALL SELECT 'feedback', query_id, doc_id FROM fm) SELECT way, (SELECT count(*) FROM truth) AS pairs, count(t.doc_id) AS hits FROM hits LEFT JOIN truth AS t USING (query_id, doc_id) GROUP BY way",
    "knn_top20": _knn_sql(20),
    "knn_top5_tool": _knn_sql(5),
    "knn_top1": _knn_sql(1),
    "hash_embed": f"SELECT query_id, unnest(generate_series(0, {DEFAULT.dims - 1}))::INT AS dim, unnest(e) AS value FROM {_QE}",
    "rrf_fuse": f"WITH {HITS} SELECT query_id, child_id, score FROM fused",
    "rrf_top8": f"WITH {HITS} SELECT query_id, rank, child_id, score FROM best",
    "parent_expand": f"WITH {HITS} SELECT query_id, parent_id, position, doc_id FROM found",
    "rerank_top3": f"WITH {HITS} SELECT query_id, rank, chunk_id, score FROM top3",
    "rerank_features": f"WITH {HITS}, {PLACES} SELECT query_id, parent_id, covered, adjacent, near, tight, overlap FROM places",
    "proximity_top3": f"WITH {HITS}, {PLACES} SELECT query_id, rank, chunk_id, score FROM ptop WHERE rank <= {DEFAULT.top_parents}",
    "rerank_off_top3": f"WITH {HITS} SELECT query_id, rank, chunk_id FROM off3",
    "fallback_children": f"WITH {HITS} SELECT query_id, rank, child_id AS chunk_id, 'child' AS kind FROM best",
    "rrf_retrieve": (_RETRIEVE := f"WITH {HITS} SELECT query_id, rank, chunk_id, text, score, kind FROM aug"),
    "append_retrieve": _RETRIEVE,
    "stream_retrieve": _RETRIEVE,
    "delete_retrieve": _RETRIEVE.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS documents"),
    "cells_exact_top20": _knn_sql(20),
    "route_rules": f"SELECT * FROM {_USER}",
    "route_reason_counts": f"SELECT route, reason, count(*) AS n FROM {_USER} GROUP BY ALL",
    "route_eval": f"SELECT conv_id, turn, expected, route, reason FROM {_route(_CASES, 'conv_id, turn, expected', chr(91) + _q('open') + ', ' + _q('open') + chr(93))}",
    "rule_hit_rate": f"SELECT count(*) AS cases, round(avg((route = expected)::INT), 6) AS accuracy, round(avg(starts_with(reason, '规则')::INT), 6) AS rule_hit_rate FROM {_route(_CASES, 'expected', _CLOSED)}",
    "route_fallback": f"SELECT conv_id, turn, route, reason FROM {_route(_CASES, 'conv_id, turn', _ANSWERED)}",
    "route_disabled": f"SELECT conv_id, turn, '{routing.SIMPLE}' AS route, '路由已关闭' AS reason FROM {_CASES}",
    "route_guard": f"SELECT conv_id, turn, route, reason FROM {_route(_GUARDED, 'conv_id, turn', _CLOSED)}",
    "route_order": f"SELECT conv_id, turn, route, reason FROM {_route(_BOTH, 'conv_id, turn', 'NULL')} WHERE route IS NOT NULL",
    "memory_read": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 1",
    "store_read": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 1",
    "booking_find": f"WITH {_BOOK} SELECT {', '.join(booking.KEY)} FROM b WHERE id = (SELECT min(id) FROM b)",
    "search_no_match": f"WITH {CHILDREN}, {TOOL_NEAR} SELECT query_id, answer FROM tool",
    "expand_orphans": f"WITH {HITS} SELECT query_id, parent_id, min(rank) AS position, parents.doc_id FROM best JOIN parents USING (parent_id) WHERE rank % 3 > 0 GROUP BY ALL",
    "scan_flat_dir": "SELECT doc_id FROM documents WHERE lang = 'en'",
    "find_row": "SELECT * FROM orders WHERE o_orderkey = 7",
    "declared_table": "SELECT doc_id::VARCHAR AS doc_id, text, NULL::VARCHAR AS source, n_chars::DOUBLE AS n_chars FROM documents",
    "append_rows": "SELECT conv_id, turn, role, text FROM conversations",
    "append_vectors": _knn_sql(20),
    "knn_in_memory": _knn_sql(20),
    "memory_window_4": _window(4),
    "memory_window_10": _window(10),
    "memory_window_20": _window(20),
    "memory_json": "SELECT conv_id, turn, role, text FROM conversations",
    "assistant_separate": _assistant("separate"),
    "assistant_friend": _assistant("friend"),
    "memory_upsert": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') UNION ALL SELECT conv_id, turn, role, '[new] ' || text FROM conversations WHERE role = 'system'",
    "store_upsert": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') UNION ALL SELECT conv_id, turn, role, '[new] ' || text FROM conversations WHERE role = 'system'",
    "memory_delete": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "store_delete": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "booking_insert_if_absent": f"WITH {_FREE} SELECT {_ROW} FROM b UNION ALL SELECT (SELECT max(id) FROM b) + request_id, {_ROW.removeprefix('id, ')} FROM f",
    "booking_messages": f"WITH {_FREE} SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM f) THEN {_q(booking.BOOKED)} ELSE {_q(booking.TAKEN)} END AS message FROM r",
    "booking_cancel": f"WITH {_HIT} SELECT {_ROW} FROM b WHERE id NOT IN (SELECT id FROM h)",
    "cancel_messages": f"WITH {_HIT} SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM h) THEN {_q(booking.CANCELLED)} ELSE {_q(booking.NOT_FOUND)} END AS message FROM r",
    "booking_available": f"WITH {_REQ} SELECT request_id, true AS available FROM r",
    "calc_tools": "SELECT o_orderkey, round(o_totalprice + 1.5, 2) AS added, round(sqrt(o_totalprice), 6) AS root FROM orders",
    "search_tool_text": f"WITH {CHILDREN}, {TOOL} SELECT query_id, answer FROM tool",
    "knn_above": _knn_sql(20, 0.7),
    "split_paragraphs": f"SELECT doc_id, ordinal::INT AS ordinal, text FROM {_chunks('documents', 'doc_id', 'source', DEFAULT.child_chars, DEFAULT.child_overlap)}",
    "split_tokens": f"SELECT doc_id, ordinal::INT AS ordinal, text FROM {_chunks('documents', 'doc_id', 'source', DEFAULT.split_tokens, DEFAULT.split_tokens_overlap, _TOKENS)}",
    "chunk_metadata": f"WITH {CHILDREN} SELECT child_id, lang, doc_id::VARCHAR AS doc, parent_id AS parent, source FROM children JOIN documents USING (doc_id)",
    "rerank_partial": f"WITH {HITS} SELECT query_id, rank, chunk_id, score, 'parent' AS kind FROM part3 UNION ALL SELECT query_id, rank, chunk_id, score, kind FROM aug WHERE kind = 'child'",
    "expand_variants": f"SELECT * FROM {_TWO}",
    "rank_variants": f"WITH {HITS2} SELECT query_id, variant, retriever, rank, child_id FROM hits",
    "rrf_variants": f"WITH {HITS2} SELECT query_id, child_id, parent_id, score FROM fused",
    "rrf_variants_top3": f"WITH {HITS2} SELECT query_id, rank, chunk_id, score, kind FROM aug",
    "ask": f"WITH {HITS}, {TOOL}, {_CTX}, {_AGENT}, routed AS {_route('benchmark', 'item_id AS query_id', _CLOSED)} SELECT query_id, route, reason, p AS prompt, '[1] ' || p AS answer FROM (SELECT query_id, route, reason, CASE WHEN route = '{routing.SIMPLE}' THEN ctx.prompt ELSE agent.prompt END AS p FROM routed JOIN ctx USING (query_id) JOIN agent USING (query_id))",
    "ask_without_agent": f"WITH {HITS}, {_CTX} SELECT query_id, '{routing.SIMPLE}' AS route, prompt FROM ctx",
    "ask_agentic": f"WITH {CHILDREN}, {TOOL}, {_AGENT} SELECT query_id, prompt, '[1] ' || prompt AS answer FROM agent",
    "ask_agentic_off": f"SELECT item_id AS query_id, text AS prompt, {_q(engine.DISABLED)} AS answer FROM benchmark",
    "chat_messages": "SELECT conv_id, count(*) + 2 AS n, '[' || (count(*) + 2) || '] 你知道我是谁吗' AS answer FROM conversations GROUP BY conv_id",
    "chat_stream": "WITH a AS (SELECT conv_id, '[' || count(*) || '] ' || last(text ORDER BY turn) FILTER (role = 'user') AS answer FROM conversations GROUP BY conv_id), n AS (SELECT *, unnest(generate_series(0, greatest((length(answer) + 7) // 8, 1) - 1)) AS part FROM a WHERE answer IS NOT NULL) SELECT conv_id, part::INT AS part, substr(answer, part * 8 + 1, 8) AS delta FROM n",
    "route_failed": f"SELECT conv_id, turn, route, reason FROM {_route(_CASES, 'conv_id, turn', _FAILED)}",
    "memory_shared": f"WITH s AS (SELECT * FROM conversations WHERE role = 'system' ORDER BY turn DESC, conv_id DESC LIMIT 1), o AS (SELECT * FROM conversations WHERE role <> 'system' ORDER BY turn DESC, conv_id DESC LIMIT {DEFAULT.memory_small - 1}) SELECT conv_id, turn, role, text FROM s UNION ALL SELECT conv_id, turn, role, text FROM o",
    "stats_merge": "SELECT conv_id, (CASE WHEN u > 1 THEN u ELSE 0 END)::INT AS n_user, (n + 1)::INT AS n_all, u::INT AS n_more, 0 AS n_none FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) AS n FROM conversations GROUP BY conv_id)",
    "prompt_dated": "SELECT conv_id, turn, text || ' （今天是 2025-04-14）' AS prompt FROM conversations",
    "delta_suffix": "SELECT conv_id, turn, text AS delta FROM conversations",
    "stream_memory_state": _window(4),
    "stream_memory_timed": _window(4),
    "stream_ingest": f"WITH {CHILDREN} SELECT child_id, parent_id, doc_id, ordinal, text FROM children",
    "prompt_render": "SELECT conv_id, turn, replace(replace(replace(" + _q(fixtures.TEMPLATE) + ", '{{username}}', '用户' || conv_id), '{{age}}', (turn + 18)::VARCHAR), '{{message}}', text) AS prompt FROM conversations",
    "context_prompt": f"WITH {HITS}, {_CTX} SELECT query_id, prompt FROM ctx",
    "conv_id_from_uuid": "SELECT page_id, ('0x' || substr(md5(url), 1, 6))::BIGINT % 1000000 AS conv_id FROM pages",
    "delta_text": "SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations",
    "recall_at_3": f"WITH {HITS}, truth AS (SELECT item_id AS query_id, doc_id::VARCHAR AS want FROM documents, benchmark WHERE contains(documents.text, benchmark.text)), hit AS (SELECT DISTINCT query_id FROM (SELECT query_id, split_part(chunk_id, '#', 1) AS want FROM top3) JOIN truth USING (query_id, want)) SELECT count(*) AS cases, round(avg((query_id IN (SELECT query_id FROM hit))::INT), 6) AS recall FROM (SELECT DISTINCT query_id FROM truth)",
    "scan_text_dir": "SELECT doc_id, length(text)::INT AS n_chars, md5(text) AS text_md5, 'txt' AS suffix FROM documents",
    "scan_binary_dir": "SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, sum(length(doc_id::VARCHAR) + 1 + coalesce(length(base64(encode(text))) + 1, 0))::BIGINT AS bytes FROM documents GROUP BY 1",
    "put_last_write": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
}
