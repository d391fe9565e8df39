"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from vellum.functions.text import FAMILIES, STOPWORDS, VARIANT_STOPWORDS

CHUNKS = """
chunks AS (
  SELECT id, id // 5 AS note, 'v' || ((id // 5) % 4) AS vault, 'm' || (((id // 5) % 4) // 2) AS model, 'note-' || (id // 5) || '.md' AS path, CAST(id % 5 AS INT) AS idx, heading, text, label, v
  FROM (SELECT coalesce(e.vec_id, d.doc_id) AS id, d.lang AS heading, d.text, e.label, e.embedding::DOUBLE[] AS v FROM embeddings e FULL JOIN documents d ON e.vec_id = d.doc_id))"""
SELF = "asked AS (SELECT id AS qid, id AS own, v FROM chunks WHERE id % 20 = 0 AND v IS NOT NULL)"
TEXTS = "asked AS (SELECT b.item_id AS qid, b.text AS query, c.id AS own, c.v FROM benchmark b LEFT JOIN chunks c ON c.id = 20 * b.item_id)"


def leg(by: str = "qid", k: int = 40) -> str:
    return f"""
pairs AS (SELECT a.qid, c.id, c.model, c.vault, list_cosine_similarity(a.v, c.v) AS sim FROM asked a JOIN chunks c ON a.v IS NOT NULL AND c.v IS NOT NULL AND c.id IS DISTINCT FROM a.own),
leg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY sim DESC, id) AS rn FROM pairs WHERE sim >= 0.2) WHERE rn <= {k})"""


def band(ratio: float = 0.75, by: str = "qid", leg: str = "leg") -> str:
    return f"banded AS (SELECT * FROM (SELECT *, first_value(sim) OVER (PARTITION BY {by} ORDER BY rn) AS best FROM {leg}) WHERE sim >= greatest(best * {ratio}, 0.2) OR rn <= 3)"


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def usable(query: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace({query}, '\s+', ' ', 'g')), ' '), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))"


TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


def keywords(stop: list[str] = STOPWORDS, test: str = "lower(t)", weights=(2.0, 1.5, 1.0), chunks: str = "chunks", every: bool = False, by: str = "") -> str:
    """CTEs ending in kw(qid, id, score, rn); by: a scope column of chunks, each scope an index of its own."""
    scope, same, using = (f"{by}, ", f"AND p.{by} = d.{by} ", f", {by}") if by else ("", "", "")
    tokens = TOKENS.replace("{{", "{").replace("}}", "}")
    return rf"""
words AS (SELECT qid, {usable('query')} AS u FROM asked),
kept AS (SELECT qid, list_filter(u, lambda t: NOT list_contains({quoted(stop)}, {test})) AS k, u FROM words),
listed AS (SELECT qid, unnest(list_transform(CASE WHEN len(k) > 0 THEN k ELSE u END, lambda t: {tokens.replace('{}', 't')})) AS terms FROM kept),
phrases AS (SELECT qid, array_to_string(terms, ' ') AS phrase, terms, count(*) AS n FROM listed WHERE len(terms) > 0 GROUP BY ALL),
cols AS (SELECT {scope}id, 0 AS col, {tokens.replace('{}', 'path')} AS t FROM {chunks} UNION ALL SELECT {scope}id, 1, {tokens.replace('{}', 'heading')} FROM {chunks} UNION ALL SELECT {scope}id, 2, {tokens.replace('{}', 'text')} FROM {chunks}),
posted AS (SELECT {scope}id, col, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM cols),
sizes AS (SELECT {scope}id, count(*) AS len FROM posted GROUP BY ALL),
totals AS (SELECT {scope}count(*) AS n FROM {chunks} {'GROUP BY ' + by if by else ''}),
lengths AS (SELECT {scope}sum(len) AS s FROM sizes {'GROUP BY ' + by if by else ''}),
parts AS (SELECT phrase, len(terms) AS size, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS off FROM (SELECT DISTINCT phrase, terms FROM phrases)),
met AS (SELECT {scope}phrase, id, col, pos - off AS start FROM posted JOIN parts USING (term) GROUP BY {scope}phrase, size, id, col, pos - off HAVING count(*) = size),
tf AS (SELECT {scope}phrase, id, sum(CASE col WHEN 0 THEN {weights[0]} WHEN 1 THEN {weights[1]} ELSE {weights[2]} END) AS wtf FROM met GROUP BY ALL),
df AS (SELECT {scope}phrase, count(*) AS df FROM tf GROUP BY ALL),
part AS (SELECT {'tf.' + by + ', ' if by else ''}tf.phrase, tf.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * len / (s / n))) AS p
         FROM tf JOIN df USING (phrase{using}) JOIN sizes USING (id{using}) {'JOIN totals USING (' + by + ') JOIN lengths USING (' + by + ')' if by else 'CROSS JOIN totals CROSS JOIN lengths'}),
scored AS (SELECT qid, {scope}id, sum(p * n) AS score, count(*) AS found FROM part JOIN phrases USING (phrase) GROUP BY ALL),
{'want AS (SELECT qid, count(*) AS want FROM phrases GROUP BY qid),' if every else ''}
kw AS (SELECT * FROM (SELECT s.qid, {'s.' + by + ', ' if by else ''}s.id, score, row_number() OVER (PARTITION BY s.qid{', s.' + by if by else ''} ORDER BY round(score, 9) DESC, path, idx) AS rn
       FROM scored s JOIN chunks c USING (id) {'JOIN want USING (qid) WHERE found = want' if every else ''}) WHERE rn <= 40)"""


def fused(by: str = "qid", vw: float = 1.0, kw: float = 1.0, rrf: int = 60, more: str = "") -> str:
    extra = "".join(f", {c}" for c in by.split(", ")[1:])
    order = "vault, " if more else ""
    return f"""
merge_ AS (SELECT qid{extra}, id, b.sim, b.rn AS vr, k.rn AS fr FROM banded b FULL JOIN kw k USING (qid{extra}, id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, share DESC, sim DESC, {order}path, idx) AS pos FROM (
  SELECT m.qid{''.join(f', m.{c}' for c in by.split(', ')[1:])} , m.id, path, idx, c.vault, coalesce(sim, 0) AS sim, coalesce(vr, 0) AS vec_rank, coalesce(fr, 0) AS fts_rank,
         coalesce({kw} / ({rrf} + fr), 0) AS share, coalesce({vw} / ({rrf} + vr), 0) + coalesce({kw} / ({rrf} + fr), 0) AS score FROM merge_ m JOIN chunks c ON c.id = m.id))"""


def greedy(source: str, by: str = "qid", note: str = "path") -> str:
    """CTEs ending in final(by, id, pos, final): greedy removal of neighbours in rank order."""
    keys = by.split(", ")
    same = " AND ".join(f"w.{c} = r.{c}" for c in keys)
    wk = ", ".join(f"w.{c}" for c in keys)
    at = lambda i: f"r.note || '#' || (r.idx{i})"
    return f"""
rows_ AS (SELECT {by}, pos, id, idx, {note} AS note FROM {source}),
walk AS (
  SELECT DISTINCT {by}, 0::BIGINT AS pos, []::VARCHAR[] AS kept FROM rows_
  UNION ALL
  SELECT {wk}, w.pos + 1, CASE WHEN list_has_any(w.kept, [{at(' - 1')}, {at('')}, {at(' + 1')}]) THEN w.kept ELSE list_append(w.kept, {at('')}) END
  FROM walk w JOIN rows_ r ON {same} AND r.pos = w.pos + 1),
ends AS (SELECT {by}, arg_max(kept, pos) AS kept FROM walk GROUP BY {by}),
final AS (SELECT {', '.join('r.' + c for c in keys)}, r.id, r.pos, row_number() OVER (PARTITION BY {', '.join('r.' + c for c in keys)} ORDER BY r.pos) AS final
          FROM rows_ r JOIN ends USING ({by}) WHERE list_contains(kept, {at('')}))"""


def hybrid(columns: str, asked: str = TEXTS, **how) -> str:
    return f"WITH RECURSIVE {CHUNKS}, {asked}, {leg()}, {band()}, {keywords()}, {fused(**how)}, {greedy('ranked')} SELECT qid, CAST(final AS INT) AS pos, id, {columns} FROM final JOIN ranked USING (qid, id) WHERE final <= 10"


GRADES = """
hits AS (SELECT qid, note, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rn FROM (SELECT b.qid, c.note, min(b.rn) AS pos FROM banded b JOIN chunks c ON c.id = b.id GROUP BY ALL)),
grades AS (SELECT DISTINCT a.id AS qid, o.note, CASE WHEN o.note = a.note THEN 3 ELSE 2 END AS grade FROM chunks a JOIN chunks o ON o.label = a.label WHERE a.id % 20 = 0),
got AS (SELECT h.qid, sum(CASE WHEN rn <= 10 THEN coalesce(grade, 0) / log2(rn + 1) ELSE 0 END) AS dcg, min(CASE WHEN grade >= 2 AND rn <= 10 THEN rn END) AS first,
        count(*) FILTER (grade >= 2 AND rn <= 5) AS in5, count(*) FILTER (grade >= 2 AND rn <= 10) AS in10 FROM hits h LEFT JOIN grades g USING (qid, note) GROUP BY h.qid),
ideal AS (SELECT qid, sum(CASE WHEN rn <= 10 THEN grade / log2(rn + 1) ELSE 0 END) AS idcg, count(*) FILTER (grade >= 2) AS alls FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, note) AS rn FROM grades) GROUP BY qid),
scores AS (SELECT qid, coalesce(dcg, 0) / idcg AS ndcg10, coalesce(1.0 / first, 0) AS mrr10, coalesce(in5, 0) / alls AS recall5, coalesce(in10, 0) / alls AS recall10 FROM ideal LEFT JOIN got USING (qid))"""
MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("ndcg10", "mrr10", "recall5", "recall10"))


def evaluated(select: str, ratio: float = 0.75) -> str:
    return f"WITH {CHUNKS}, {SELF}, {leg()}, {band(ratio)}, {GRADES} {select}"


NOTES = "notes AS (SELECT doc_id, lang AS vault, source || '/doc-' || doc_id || '.md' AS path, text AS body, sha256(text) AS doc_hash FROM documents)"
STORED = """
stored AS (SELECT path, CASE WHEN q = 1 THEN doc_hash ELSE 'old' END AS doc_hash FROM notes JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) USING (doc_id)
           UNION ALL SELECT 'gone/page-' || page_id || '.md', 'x' FROM pages)"""
PLAN = f"""WITH {NOTES}, {STORED},
plan AS (SELECT path, CASE WHEN n.doc_hash IS NULL THEN 'prune' WHEN n.doc_hash = s.doc_hash THEN 'skip' ELSE 'index' END AS action FROM notes n FULL JOIN stored s USING (path))"""
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role AS kind, text AS query, conv_id * 100 + turn AS created_at FROM conversations)"
HEADS = "heads AS (SELECT session_id AS id, arg_min(query, id) AS first, min(created_at) AS created_at FROM turns GROUP BY 1)"
RUNS = "runs AS (SELECT event_id, 'u' || user_id || '/n.md' AS note_path, sha256(coalesce(props, '')) AS block_hash, event_type, value, ts FROM events)"
TRASH = "trash AS (SELECT strftime(ts, '%Y%m%dT%H%M%S') || '-' || event_id AS trash_id, event_type || '/u' || user_id || '/n.md' AS rel, ts FROM events)"
GRAPH = f"""WITH {CHUNKS},
dims AS (SELECT note AS id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM chunks),
means AS (SELECT id, i, avg(x) AS x FROM dims GROUP BY ALL),
units AS (SELECT id, list(x ORDER BY i) AS v FROM means GROUP BY id HAVING sum(x * x) > 0),
pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM units a JOIN units b ON a.id <> b.id),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM pairs WHERE sim >= 0.2) WHERE rn <= 6),
edges AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS weight FROM picks GROUP BY ALL)"""
SECTION_BODY = "'# ' || source || chr(10) || chr(10) || link || chr(10) || chr(10) || '```' || lang || ' kernel=\"k\"' || chr(10) || '# no heading [[none]]' || chr(10) || 'print(1)' || chr(10) || '```' || chr(10) || chr(10) || '## Text' || chr(10) || chr(10) || text"
MARKED = f"""marked AS (SELECT *, {SECTION_BODY} AS body FROM (SELECT doc_id, lang, source, text, source || '/doc-' || doc_id || '.md' AS path,
  '[[doc-' || (doc_id * 7) % 100 || '#part|see]] and [[' || source || '/doc-' || (doc_id + 1) || ']]' AS link FROM documents))"""
LINKS = f"""WITH {MARKED},
links AS (SELECT doc_id, 0 AS n, 'doc-' || (doc_id * 7) % 100 AS target, 'part' AS heading, 'see' AS label FROM marked
          UNION ALL SELECT doc_id, 1, source || '/doc-' || (doc_id + 1), '', '' FROM marked)"""


def prefix_sql(at: int) -> str:
    cases = " ".join(f"WHEN contains(lower(name), '{f[0]}') THEN '{f[at]}'" for f in FAMILIES)
    return f"CASE {cases} ELSE '' END"


def suffix(name: str, n: str, first: int, label: str) -> str:
    stem, ext = f"regexp_replace({name}, '\\.[^./]*$', '')", f"regexp_extract({name}, '(\\.[^./]*)$', 1)"
    one = f"WHEN {n} = {first} THEN {stem} || ' ({label})' || {ext} " if label else ""
    return f"CASE WHEN {n} < {first} THEN {name} {one}ELSE {stem} || ' ({label + ' ' if label else ''}' || {n} || ')' || {ext} END"


BASE_MODELS = "['Qwen3-Embedding-0.6B', 'nomic-embed', 'multilingual-E5', 'bge-m3', 'other']"
ALL_SCOPES = "scopes AS (SELECT DISTINCT vault, model FROM chunks)"
MERGED = f"""{leg('a.qid, c.model, c.vault').replace('PARTITION BY a.qid, c.model, c.vault', 'PARTITION BY qid, model, vault').replace('leg AS', 'legs AS')},
merged AS (SELECT qid, model, vault, id, sim, row_number() OVER (PARTITION BY qid, model ORDER BY sim DESC, vault, id) AS rn FROM legs), {band(by='qid, model', leg='merged')}"""
INTERLEAVED = "kw AS (SELECT qid, model, vault, id, row_number() OVER (PARTITION BY qid, model ORDER BY kw0.rn, vault) AS rn FROM kw0 JOIN (SELECT DISTINCT vault, model FROM chunks) USING (vault))"
DATE = "CASE WHEN year(ts) = year(now) THEN strftime(ts, '%b ') || day(ts) ELSE strftime(ts, '%b ') || day(ts) || strftime(ts, ', %Y') END"

_ONE_MODEL = CHUNKS.replace("'m' || (((id // 5) % 4) // 2) AS model", "'v' || ((id // 5) % 4) AS model")
_EVERY = CHUNKS.replace("chunks AS", "every AS")
_ALONE = " UNION ALL ".join(
    f"SELECT 'v{v}' AS vault, qid, pos, id FROM ({hybrid('score').replace(CHUNKS, _EVERY + f', chunks AS (SELECT * FROM every WHERE vault = {chr(39)}v{v}{chr(39)})').replace(TEXTS, TEXTS.replace('chunks c', 'every c'))})" for v in range(4)
)
_FUSED = f"WITH RECURSIVE {_ONE_MODEL}, {TEXTS}, {MERGED}, {keywords(by='vault').replace('kw AS (SELECT', 'kw0 AS (SELECT')}, {INTERLEAVED}, {fused('qid, model', more='vault')}, {greedy('ranked', 'qid, model', "vault || '/' || path")} SELECT model AS vault, qid, final AS pos, id FROM final WHERE final <= 10"
PARITY = f"""WITH a AS ({_ALONE}), b AS ({_FUSED}), la AS (SELECT vault, qid, list(id ORDER BY pos) AS l FROM a GROUP BY ALL), lb AS (SELECT vault, qid, list(id ORDER BY pos) AS l FROM b GROUP BY ALL)
SELECT vault, qid, coalesce(la.l = lb.l, false) AS same FROM la FULL JOIN lb USING (vault, qid)"""

_OTHER = "'doc-' || (doc_id * 7) % 100"
_LINE = r"regexp_extract(text, '^[^\n\[\]|#]*', 0)"
_BODY = "{head} || 'See {a} and {b}' || e'\n\n- a\n    - nested ' || {c} || e'\n\nText\n\n    [[code]]\n\n`[[span]]` ' || {d} || e'\n```\n[[kept]]\n```'"


def _linked_sql(link) -> str:
    """The body with its links shown by link(label, target, heading)."""
    shown, part, lost = "coalesce(title, other)", "'Part ' || lang", "'no such ' || source || '/x'"
    parts = [link(shown, "other", None), link("'alias'", "other", part), link(f"{shown} || ' › ' || {part}", "other", part), link(lost, lost, None)]
    text = _BODY.replace("'See {a} and {b}'", "'See ' || {a} || ' and ' || {b}").format(head="head", a=parts[0], b=parts[1], c=parts[2], d=parts[3])
    return text


_HREF = lambda label, target, heading: f"'[' || {label} || '](note:' || replace(replace({target}, ' ', '%20'), '/', '%2F') || " + (f"'#' || replace({heading}, ' ', '%20') || " if heading else "") + "')'"
LINKED = f"""WITH notes AS (SELECT doc_id, lang, source, {_OTHER} AS other, CASE WHEN doc_id % 3 > 0 THEN '# ' || {_LINE} || e'\\n\\n' ELSE '' END AS head, trim({_LINE}, ' ' || chr(9) || chr(13)) AS line FROM documents),
titles AS (SELECT 'doc-' || doc_id AS other, CASE WHEN doc_id % 3 > 0 AND line <> '' THEN line ELSE 'doc-' || doc_id END AS title FROM notes)
SELECT doc_id, {_linked_sql(_HREF)} AS linked, {_linked_sql(lambda label, target, heading: label)} AS flat FROM notes LEFT JOIN titles USING (other)"""
MOVES = """WITH notes AS (SELECT doc_id, source, source || '/doc-' || doc_id || '.md' AS path FROM documents),
moves AS (SELECT path, CASE doc_id % 5 WHEN 0 THEN source || '/doc-' || (doc_id + 5) || '.md' WHEN 1 THEN path WHEN 2 THEN 'all/' || doc_id // 10 || '.md' ELSE 'new/' || doc_id || '.md' END AS target FROM notes WHERE doc_id % 5 < 4
          UNION ALL SELECT 'gone/' || page_id, 'x.md' FROM pages),
placed AS (SELECT *, row_number() OVER (PARTITION BY target, here AND path <> target ORDER BY path) AS nth FROM (
  SELECT *, path IN (SELECT path FROM notes) AS here, target IN (SELECT path FROM notes) AS there FROM moves))"""

PACKAGES = """WITH p AS (SELECT 'f' || p_partkey % 40 AS family, p_partkey % 3 AS a, p_partkey % 7 AS b, p_partkey % 11 AS c, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 13 ELSE 99 END AS rc, p_partkey % 5 AS kind FROM part WHERE p_partkey % 6 > 0),
versions AS (SELECT DISTINCT *, a || '.' || b || '.' || c || CASE WHEN rc < 99 THEN '-rc.' || rc ELSE '' END AS version FROM p),
asked AS (SELECT DISTINCT 'f' || s_suppkey % 42 AS family, CASE WHEN s_suppkey % 9 > 1 THEN s_suppkey % 2 + 1 END AS x, s_suppkey % 4 AS y, s_suppkey % 3 AS z,
  CASE s_suppkey % 9 WHEN 0 THEN 'dev' WHEN 1 THEN 'v1.2.0-3-gabc' ELSE (s_suppkey % 2 + 1) || '.' || s_suppkey % 4 || '.' || s_suppkey % 3 END AS core,
  CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 || '.' || s_suppkey % 7 || '.' || s_suppkey % 11 END AS pin FROM supplier),
met AS (SELECT q.family, core, pin, version, row_number() OVER (PARTITION BY q.family, core, pin ORDER BY a DESC, b DESC, c DESC, rc DESC) AS n FROM asked q JOIN versions v USING (family)
  WHERE x IS NOT NULL AND (pin IS NULL OR pin = version) AND CASE kind WHEN 0 THEN x = 1 AND y >= 2 WHEN 1 THEN x = 1 AND y >= 1 WHEN 2 THEN x = 1 AND y = 2 WHEN 3 THEN x = 1 OR x = 2 AND y = 1 ELSE NOT (x = 1 AND y = 3 AND z = 1) END),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY a DESC, b DESC, c DESC, rc DESC) AS n FROM versions) WHERE n = 1),
got AS (SELECT family, core, pin, version FROM met WHERE n = 1 UNION ALL SELECT q.family, core, pin, version FROM asked q JOIN newest USING (family) WHERE x IS NULL AND (pin IS NULL OR pin = version))
SELECT DISTINCT q.family, q.core, q.pin, g.version, CASE WHEN g.version IS NOT NULL THEN NULL WHEN q.family NOT IN (SELECT 'f' || p_partkey % 40 FROM part) THEN 'no such package' WHEN q.pin IS NOT NULL THEN 'no such version' ELSE 'no installable version' END AS reason
FROM asked q LEFT JOIN got g ON g.family = q.family AND g.core = q.core AND g.pin IS NOT DISTINCT FROM q.pin"""
RUN_STATES = """WITH e AS (SELECT 'u' || user_id % 40 AS note_path, 'h' || event_type AS block_hash, event_id AS ord, ['run', 'save', 'run', 'discard', 'run', 'delete', 'run'][event_id % 7 + 1] AS type, 'r' || event_id AS result FROM events),
l AS (SELECT *, sum((type = 'delete')::INT) OVER (PARTITION BY note_path, block_hash ORDER BY ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS later FROM e),
a AS (SELECT * FROM l WHERE later = 0),
first AS (SELECT note_path, block_hash, min(ord) AS ord FROM a WHERE type = 'run' GROUP BY ALL),
saves AS (SELECT s.note_path, s.block_hash, s.ord, max(p.ord) AS before FROM a s JOIN a p ON p.note_path = s.note_path AND p.block_hash = s.block_hash AND p.ord < s.ord WHERE s.type = 'save' GROUP BY ALL),
kept AS (SELECT s.note_path, s.block_hash, max(s.before) AS ord FROM saves s JOIN a r ON r.note_path = s.note_path AND r.block_hash = s.block_hash AND r.ord = s.before AND r.type = 'run' GROUP BY ALL),
saved AS (SELECT f.note_path, f.block_hash, greatest(f.ord, coalesce(k.ord, f.ord)) AS ord, f.ord AS first FROM first f LEFT JOIN kept k USING (note_path, block_hash)),
tail AS (SELECT note_path, block_hash, max(ord) AS ord, arg_max(type, ord) AS type FROM a GROUP BY ALL)
SELECT s.note_path, s.block_hash, 'r' || s.ord AS saved, CASE WHEN t.type = 'run' AND t.ord > s.first THEN 'r' || t.ord END AS pending FROM saved s JOIN tail t USING (note_path, block_hash)"""

SQL: dict[str, str] = {
    "vector_topk": f"WITH {CHUNKS}, {SELF}, {leg()} SELECT qid, CAST(rn AS INT) AS rn, id, round(sim, 6) AS sim FROM leg WHERE rn <= 10",
    "vector_band": f"WITH {CHUNKS}, {SELF}, {leg()}, {band()} SELECT qid, CAST(rn AS INT) AS rn, id, round(sim, 6) AS sim FROM banded",
    "vector_dedup_adjacent": f"WITH RECURSIVE {CHUNKS}, {SELF}, {leg()}, {band()}, hits AS (SELECT b.qid, b.rn AS pos, b.id, path, idx FROM banded b JOIN chunks c ON c.id = b.id), {greedy('hits')} SELECT qid, CAST(final AS INT) AS final, id, CAST(pos AS INT) AS pos FROM final WHERE final <= 10",
    "tokens_df": f"WITH {CHUNKS}, cols AS (SELECT id, {TOKENS.format('path')} AS t FROM chunks UNION ALL SELECT id, {TOKENS.format('heading')} FROM chunks UNION ALL SELECT id, {TOKENS.format('text')} FROM chunks), posted AS (SELECT id, unnest(t) AS term FROM cols) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM posted GROUP BY term",
    "sanitize_query": f"WITH words AS (SELECT conv_id, turn, {usable('text')} AS u FROM conversations), kept AS (SELECT *, list_filter(u, lambda t: NOT list_contains({quoted(STOPWORDS)}, lower(t))) AS k FROM words) SELECT conv_id, turn, array_to_string(list_transform(CASE WHEN len(k) > 0 THEN k ELSE u END, lambda t: '\"' || replace(t, '\"', '\"\"') || '\"'), ' OR ') AS expression FROM kept",
    "bm25_topk": f"WITH {CHUNKS}, {TEXTS}, {keywords(weights=(1.0, 1.0, 1.0))} SELECT qid, id, CAST(rn AS INT) AS rn, round(score, 6) AS score FROM kw",
    "bm25_weighted": f"WITH {CHUNKS}, {TEXTS}, {keywords()} SELECT qid, id, CAST(rn AS INT) AS rn, round(score, 6) AS score FROM kw",
    "stopdrop_variant": f"WITH {CHUNKS}, {TEXTS}, {keywords(VARIANT_STOPWORDS, test="lower(trim(t, '.,;:!?" + chr(34) + "''()[]'))")} SELECT qid, id, CAST(rn AS INT) AS rn, round(score, 6) AS score FROM kw",
    "and_or_variant": f"WITH {CHUNKS}, {TEXTS}, {keywords()}, anys AS (SELECT qid, id, 1 AS tier, rn FROM kw), want AS (SELECT qid, count(*) AS want FROM phrases GROUP BY qid), alls AS (SELECT * FROM (SELECT s.qid, s.id, 0 AS tier, row_number() OVER (PARTITION BY s.qid ORDER BY round(score, 9) DESC, path, idx) AS rn FROM scored s JOIN want USING (qid) JOIN chunks c USING (id) WHERE found = want) WHERE rn <= 40), once AS (SELECT qid, id, min({{'tier': tier, 'rn': rn}}) AS r FROM (SELECT * FROM alls UNION ALL SELECT * FROM anys) GROUP BY ALL) SELECT * FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY r) AS INT) AS rn FROM once) WHERE rn <= 40",
    "phrase_match": rf"WITH {CHUNKS}, firsts AS (SELECT DISTINCT {TOKENS.format("text")} AS terms FROM benchmark), phrases AS (SELECT array_to_string(terms, ' ') AS phrase FROM firsts WHERE len(terms) > 0), cols AS (SELECT id, ' ' || array_to_string({TOKENS.format('path')}, ' ') || ' ' AS t FROM chunks UNION ALL SELECT id, ' ' || array_to_string({TOKENS.format('heading')}, ' ') || ' ' FROM chunks UNION ALL SELECT id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' FROM chunks) SELECT phrase, id, sum((length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' ' || replace(phrase, ' ', '  ') || ' ', ''))) // (length(replace(phrase, ' ', '  ')) + 2))::BIGINT AS places FROM cols JOIN phrases ON contains(t, ' ' || phrase || ' ') GROUP BY ALL",
    "rrf_hybrid": hybrid("path, idx, CAST(vec_rank AS INT) AS vec_rank, CAST(fts_rank AS INT) AS fts_rank, round(score, 6) AS score, round(sim, 6) AS sim"),
    "rrf_weighted": hybrid("CAST(vec_rank AS INT) AS vec_rank, CAST(fts_rank AS INT) AS fts_rank, round(score, 6) AS score", vw=2.0, kw=0.5, rrf=20),
    "keyword_only_degrade": hybrid("CAST(vec_rank AS INT) AS vec_rank, CAST(fts_rank AS INT) AS fts_rank, round(score, 6) AS score, round(sim, 6) AS sim", TEXTS.replace("c.id AS own, c.v", "NULL::BIGINT AS own, NULL::DOUBLE[] AS v")),
    "multi_vector_merge": f"WITH {CHUNKS}, {SELF}, {MERGED} SELECT qid, model, CAST(rn AS INT) AS rn, vault, id, round(sim, 6) AS sim FROM banded",
    "keyword_interleave": f"WITH {CHUNKS}, {TEXTS}, {keywords(by='vault').replace('kw AS (SELECT', 'kw0 AS (SELECT')}, {INTERLEAVED} SELECT qid, model, CAST(rn AS INT) AS rn, vault, id FROM kw",
    "model_groups": f"WITH RECURSIVE {CHUNKS}, {TEXTS}, {MERGED}, {keywords(by='vault').replace('kw AS (SELECT', 'kw0 AS (SELECT')}, {INTERLEAVED}, {fused('qid, model', more='vault')}, {greedy('ranked', 'qid, model', "vault || '/' || path")}, hits AS (SELECT final.qid, final.model, final, ranked.vault, ranked.id, path, idx, score, max(score) OVER (PARTITION BY final.qid, final.model) AS best FROM final JOIN ranked USING (qid, model, id) WHERE final <= 10) SELECT qid, CAST(dense_rank() OVER (PARTITION BY qid ORDER BY best DESC, model) AS INT) AS group_pos, model, CAST(final AS INT) AS pos, vault, id, round(score, 6) AS score FROM hits",
    "group_runs": "WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS run FROM s) SELECT user_id, run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY ALL",
    "note_centroids": f"{GRAPH} SELECT id, CAST(i AS INT) AS i, round(x, 6) AS x FROM (SELECT id, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x, generate_subscripts(v, 1) - 1 AS i FROM units)",
    "knn_edges": f"{GRAPH} SELECT a, b, round(weight, 6) AS weight FROM edges",
    "knn_degrees": f"{GRAPH}, ends AS (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) SELECT u.id, count(e.id) AS degree FROM units u LEFT JOIN ends e ON e.id = u.id GROUP BY u.id",
    "layout_step": f"""{GRAPH}, ends AS (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges),
deg AS (SELECT u.id, count(e.id) AS degree, row_number() OVER (ORDER BY u.id) - 1 AS i, count(*) OVER () AS n FROM units u LEFT JOIN ends e ON e.id = u.id GROUP BY u.id),
pos AS (SELECT id, degree, cos(i / n * 2 * pi()) * 240 AS x, sin(i / n * 2 * pi()) * 240 AS y FROM deg),
charge AS (SELECT p.id, sum((q.x - p.x) * -800 / greatest((q.x - p.x) ** 2 + (q.y - p.y) ** 2, 25)) AS vx, sum((q.y - p.y) * -800 / greatest((q.x - p.x) ** 2 + (q.y - p.y) ** 2, 25)) AS vy FROM pos p JOIN pos q ON p.id <> q.id GROUP BY p.id),
l AS (SELECT a, b, weight, q.x - p.x AS dx, q.y - p.y AS dy, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d, q.degree / (p.degree + q.degree) AS share FROM edges JOIN pos p ON p.id = a JOIN pos q ON q.id = b),
f AS (SELECT *, (d - 55) / d * 0.5 * (0.5 + 0.5 * weight) AS f FROM l),
pull AS (SELECT id, sum(mx) AS mx, sum(my) AS my FROM (SELECT a AS id, dx * f * share AS mx, dy * f * share AS my FROM f UNION ALL SELECT b, -dx * f * (1 - share), -dy * f * (1 - share) FROM f) GROUP BY id),
moved AS (SELECT id, x + coalesce(mx, 0) + coalesce(vx, 0) * 0.6 AS x, y + coalesce(my, 0) + coalesce(vy, 0) * 0.6 AS y FROM pos LEFT JOIN charge USING (id) LEFT JOIN pull USING (id))
SELECT id, round(x - avg(x) OVER (), 4) AS x, round(y - avg(y) OVER (), 4) AS y FROM moved""",
    "title_filter": f"WITH {NOTES} SELECT doc_id, path FROM notes WHERE contains(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') || ' ' || vault), 'en') AND contains(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') || ' ' || vault), 'doc-1')",
    "ndcg_mrr_recall": evaluated("SELECT qid, round(ndcg10, 6) AS ndcg10, round(mrr10, 6) AS mrr10, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10 FROM scores"),
    "metrics_by_kind": evaluated(f"SELECT label, count(*) AS queries, {MEANS} FROM scores JOIN chunks ON id = qid GROUP BY label"),
    "param_sweep": " UNION ALL ".join(f"SELECT * FROM ({evaluated(f'SELECT {r}::DOUBLE AS top_ratio, count(*) AS queries, {MEANS} FROM scores', r)})" for r in (0.6, 0.75, 0.9)),
    "parity_check": PARITY,
    "sync_plan": f"{PLAN} SELECT path, action FROM plan",
    "sync_prune": f"{PLAN} SELECT path FROM plan WHERE action = 'prune'",
    "sync_stats": f"{PLAN} SELECT count(*) FILTER (action = 'index') AS indexed, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'prune') AS pruned FROM plan",
    "sync_forced": f"{PLAN} SELECT count(*) FILTER (action <> 'prune') AS indexed, 0::BIGINT AS skipped, count(*) FILTER (action = 'prune') AS pruned FROM plan",
    "replace_note": f"{PLAN} SELECT path, doc_hash FROM stored WHERE path IN (SELECT path FROM plan WHERE action = 'skip') UNION ALL SELECT path, doc_hash FROM notes WHERE path IN (SELECT path FROM plan WHERE action = 'index')",
    "error_sample": "WITH f AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS path, 'toxic ' || toxic AS error FROM labels WHERE quality = 0), s AS (SELECT * FROM f ORDER BY path LIMIT 10) SELECT (SELECT count(*) FROM f) AS n, string_agg(path || ': ' || error, '; ' ORDER BY path) || CASE WHEN (SELECT count(*) FROM f) > 10 THEN ' and ' || ((SELECT count(*) FROM f) - 10) || ' more' ELSE '' END AS sample FROM s",
    "sessions_recent": rf"WITH {TURNS}, {HEADS}, clean AS (SELECT id, trim(regexp_replace(first, '\s+', ' ', 'g')) AS t FROM heads) SELECT c.id, u.m AS updated_at, CASE WHEN t = '' THEN 'New session' WHEN length(t) > 48 THEN trim(t[1:48]) || '…' ELSE t END AS title FROM clean c JOIN (SELECT session_id, max(created_at) AS m FROM turns GROUP BY 1) u ON u.session_id = c.id",
    "add_turn_bump": f"WITH {TURNS}, {HEADS} SELECT h.id, h.created_at, greatest(h.created_at, coalesce(m, h.created_at)) AS updated_at FROM heads h LEFT JOIN (SELECT session_id, max(created_at) AS m FROM turns WHERE kind = 'user' GROUP BY 1) u ON u.session_id = h.id",
    "cascade_delete": "SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) >= 4",
    "run_upsert": f"WITH {RUNS} SELECT note_path, block_hash, event_id FROM (SELECT *, row_number() OVER (PARTITION BY note_path, block_hash ORDER BY ts DESC, event_id DESC) AS n FROM runs) WHERE n = 1",
    "run_insert_if_absent": f"WITH {RUNS} SELECT note_path, event_type, min(event_id) AS event_id FROM runs WHERE event_type = 'view' GROUP BY ALL",
    "run_prune_not_in": f"WITH {RUNS} SELECT note_path, event_type, event_id FROM runs WHERE NOT (note_path IN (SELECT note_path FROM runs WHERE value > 50) AND event_type NOT IN ('click', 'purchase'))",
    "folder_prefix_rename": f"WITH {NOTES}, r AS (SELECT path, max(doc_id) AS doc_id FROM (SELECT path, doc_id FROM notes UNION ALL SELECT regexp_replace(path, '^src1/', 'moved/'), -doc_id - 1 FROM notes) GROUP BY path), m AS (SELECT starts_with(path, 'src1/') AS moved, CASE WHEN starts_with(path, 'src1/') THEN 'moved' || path[5:] ELSE path END AS path, doc_id FROM r) SELECT path, arg_max(doc_id, moved::INT) AS doc_id FROM m GROUP BY path",
    "trash_listing": f"WITH {TRASH} SELECT trash_id, rel AS original_path, '.trash/' || trash_id || '/' || rel AS trash_path, 'n.md' AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS deleted_at FROM trash",
    "restore_names": f"WITH {TRASH}, n AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY trash_id) - 1 + CASE WHEN starts_with(rel, 'view/') THEN 1 ELSE 0 END AS n FROM trash) SELECT trash_id, {suffix('rel', 'n', 1, 'restored')} AS target FROM n",
    "collision_suffix": f"WITH i AS (SELECT event_id AS ord, event_type || '-' || user_id % 50 AS stem, CASE WHEN event_id % 2 = 0 THEN '.md' ELSE '.markdown' END AS ext FROM events), n AS (SELECT ord, stem || ext AS name, stem || '.md' AS base, row_number() OVER (PARTITION BY stem ORDER BY ord) - 1 + CASE WHEN starts_with(stem, 'click-') THEN 1 ELSE 0 END AS n FROM i) SELECT ord, name, {suffix('base', 'n', 1, '')} AS target FROM n",
    "untitled_names": "WITH n AS (SELECT event_id AS ord, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 1 ELSE 0 END AS n FROM events) SELECT ord, 'u' || user_id || '/Untitled' || CASE WHEN n > 0 THEN ' ' || n ELSE '' END || '.md' AS target FROM n",
    "unique_anchor_edit": "WITH c AS (SELECT doc_id, text, (length(text) - length(replace(text, 'ing.', ''))) // 4 AS n FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'ambiguous' ELSE 'edited' END AS status, sha256(CASE WHEN n = 1 THEN replace(text, 'ing.', '[edited]') ELSE text END) AS body_hash FROM c",
    "vault_status": f"WITH {CHUNKS}, live AS (SELECT heading AS vault, count(*) AS chunks FROM chunks WHERE v IS NOT NULL GROUP BY 1) SELECT lang AS vault, count(*) AS notes, coalesce(any_value(chunks), 0) AS chunks, any_value(chunks) IS NOT NULL AS available FROM documents LEFT JOIN live ON live.vault = lang GROUP BY lang",
    "frontmatter_split": f"WITH {MARKED} SELECT doc_id, 'tags: [a, ' || lang || ']' || chr(10) || 'source: ' || source || chr(10) AS block, sha256(body) AS body_hash FROM marked",
    "frontmatter_props": "SELECT doc_id, 'a,' || lang AS tags, source FROM documents",
    "wikilinks": f"{LINKS} SELECT doc_id, CAST(n AS INT) AS n, target, heading, label FROM links",
    "resolve_links": f"{LINKS}, keys AS (SELECT path, string_split(path, '/') AS walk, unnest(list_distinct([lower(regexp_replace(path, '\\.md$', '')), 'doc-' || doc_id])) AS key FROM marked), firsts AS (SELECT key, arg_min(path, walk) AS path FROM keys GROUP BY key), tried AS (SELECT doc_id * 10 + n AS link_id, target, unnest(list_distinct([lower(target), regexp_extract(lower(target), '[^/]*$')])) AS key FROM links) SELECT link_id, target, arg_min(path, string_split(path, '/')) AS path FROM tried LEFT JOIN firsts USING (key) GROUP BY link_id, target",
    "code_blocks": "SELECT doc_id, CAST(0 AS INT) AS idx, lower(lang) AS lang, 'k' AS kernel, sha256('# no heading [[none]]' || chr(10) || 'print(1)') AS block_hash FROM documents",
    "block_hash": "SELECT doc_id, sha256(text) AS block_hash FROM documents",
    "first_heading": "WITH l AS (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ' || chr(9) || chr(13)) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 'Later' ELSE t END AS heading FROM l",
    "tree_listing": f"WITH {NOTES} SELECT path, regexp_extract(path, '^[^/]*') AS parent, CAST(2 AS INT) AS depth, false AS is_dir FROM notes UNION SELECT regexp_extract(path, '^[^/]*'), '', 1, true FROM notes",
    "html_headings": r"WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-5]\b[^>]*>.*?</h[1-5]>') AS l FROM pages) SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS heading FROM h",
    "office_markers": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), t AS (SELECT *, ltrim(line) AS lt FROM l) SELECT doc_id, CAST(n AS INT) AS n, CASE n % 4 WHEN 0 THEN 'bullet' WHEN 1 THEN 'number' WHEN 2 THEN 'letter' ELSE CASE WHEN regexp_matches(lt, '^[•◦▪‣·–*\-][ \t]+') THEN 'bullet' WHEN regexp_matches(lt, '^\d{1,3}[.)][ \t]+') THEN 'number' WHEN regexp_matches(lt, '^[a-z][.)][ \t]+') THEN 'letter' ELSE 'none' END END AS kind, sha256(trim(CASE WHEN n % 4 < 3 THEN line ELSE CASE WHEN regexp_matches(lt, '^[•◦▪‣·–*\-][ \t]+') THEN regexp_replace(lt, '^[•◦▪‣·–*\-][ \t]+', '') WHEN regexp_matches(lt, '^\d{1,3}[.)][ \t]+') THEN regexp_replace(lt, '^\d{1,3}[.)][ \t]+', '') WHEN regexp_matches(lt, '^[a-z][.)][ \t]+') THEN regexp_replace(lt, '^[a-z][.)][ \t]+', '') ELSE line END END)) AS rest_hash, trim(line) <> '' AND strlen(trim(line)) <= 50 AND NOT contains(trim(line), ':') AND NOT ends_with(trim(line), '.') AS is_heading, CAST(greatest(1, (n * 200) // 360) AS INT) AS level FROM t",
    "pdf_line_join": "WITH r AS (SELECT user_id AS doc, event_id AS ord, event_type AS s, (event_id % 10) * 30.0 AS x, event_id // 3 AS y, CASE WHEN event_id % 2 = 0 THEN 30.0 ELSE 20.0 END AS w FROM events), g AS (SELECT *, CASE WHEN lag(y) OVER o IS NULL THEN '' WHEN abs(y - lag(y) OVER o) > 12 THEN chr(10) WHEN x - (lag(x) OVER o + lag(w) OVER o) >= 12.0 / 5 THEN ' ' ELSE '' END || s AS t FROM r WINDOW o AS (PARTITION BY doc ORDER BY ord)) SELECT doc, CAST(1 AS INT) AS page, sha256(string_agg(t, '' ORDER BY ord)) AS text_hash FROM g GROUP BY doc",
    "import_router": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' WHEN 2 THEN 'docx' WHEN 3 THEN 'odt' WHEN 4 THEN 'pdf' WHEN 5 THEN '' ELSE 'text' END AS converter, CASE WHEN page_id % 7 = 5 THEN 'unsupported' WHEN strlen(html) > 2000 THEN 'too-large' WHEN page_id % 7 = 4 THEN 'no-convert-model' ELSE '' END AS code FROM pages",
    "image_paths": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/a.png' WHEN 1 THEN 'b.png' WHEN 2 THEN NULL ELSE 'x/d.png' END AS path FROM documents",
    "debounce_sessions": "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT user_id AS path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM g GROUP BY user_id, run",
    "event_classes": "WITH e AS (SELECT event_id, ['create', 'remove', 'write'][event_id % 3 + 1] AS op, user_id % 2 = 0 AS md, user_id % 5 = 0 AS dir FROM events) SELECT event_id, CASE WHEN op = 'create' AND dir THEN 'vault' WHEN op = 'remove' AND (dir OR NOT md) THEN 'vault' WHEN md THEN 'note' ELSE 'ignore' END AS kind FROM e",
    "run_events_complete": "WITH l AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id AS run_id, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (turn < last), '')) AS text_hash, CAST(0 AS INT) AS exit_code, max(last) * 10 AS dur_ms FROM l WHERE conv_id % 3 <> 0 GROUP BY conv_id",
    "relative_dates": f"WITH n AS (SELECT event_id, ts, max(ts) OVER () AS now FROM events), s AS (SELECT *, epoch(date_trunc('second', now))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS s FROM n) SELECT event_id, CASE WHEN s < 0 THEN {DATE} WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE {DATE} END AS label FROM s",
    "any_order_filter": "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')",
    "version_order": "WITH v AS (SELECT p_partkey, p_partkey % 3 AS a, p_partkey % 12 AS b, p_partkey % 101 AS c FROM part) SELECT p_partkey, a || '.' || b || '.' || c AS version, CAST(rank() OVER (PARTITION BY p_partkey % 64 ORDER BY a DESC, b DESC, c DESC) AS INT) AS place FROM v",
    "snippets": "WITH l AS (SELECT doc_id, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1] AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN t[1:120] || '…' ELSE t END AS snippet FROM l",
    "percent_encode": "SELECT doc_id, source || '/ein%20s%C3%BC%C3%9Fer%20text/' || lang || '%20%C3%A9.md' AS encoded FROM documents",
    "embed_prefixes": f"WITH n AS (SELECT doc_id, {BASE_MODELS}[doc_id % 5 + 1] AS name FROM documents) SELECT doc_id, {prefix_sql(1)} AS query_prefix, {prefix_sql(2)} AS doc_prefix FROM n",
    "settings_parse": "WITH e AS (SELECT *, event_id % 11 > 0 AND event_id % 13 > 0 AS ok FROM events) SELECT event_id, CAST(CASE WHEN ok AND event_id % 40 BETWEEN 1 AND 30 THEN event_id % 40 ELSE 10 END AS INT) AS k, round(CASE WHEN ok AND event_id % 3 > 0 AND value / 100 BETWEEN 0 AND 0.95 THEN value / 100 ELSE 0.2 END, 6) AS min_sim, CAST(CASE WHEN ok AND event_id % 50 > 5 THEN least(event_id % 50 - 5, 32) ELSE 6 END AS INT) AS concurrency, CASE WHEN ok AND event_id * 997 % 9000000 > 0 THEN least(greatest(event_id * 997 % 9000000, 100000), 8000000) ELSE 2500000 END AS pixels, CASE WHEN ok AND event_id % 5 > 0 AND event_id % 9000 > 0 THEN least(greatest(event_id % 9000, 30), 7200) ELSE 600 END AS timeout FROM e",
    "packages_resolved": PACKAGES,
    "run_states": RUN_STATES,
    "run_states_stream": RUN_STATES,
    "vault_notes": "SELECT CASE WHEN doc_id % 4 = 0 THEN '_in/' ELSE '' END || source || '/doc-' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS doc_hash FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 10 <> 3",
    "links_rewritten": LINKED,
    "source_labels": "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang || ' › ' ELSE '' END || source || '/doc-' || doc_id || '.md' || CASE WHEN doc_id % 3 > 0 THEN ' › Part ' || doc_id % 3 ELSE '' END AS label FROM documents",
    "group_vault_names": "WITH f AS (SELECT source, lang, min(doc_id) FILTER (doc_id % 4 > 0) AS first FROM documents GROUP BY ALL) SELECT source, coalesce(string_agg(lang, ', ' ORDER BY first) FILTER (first IS NOT NULL), '') AS names FROM f GROUP BY source",
    "image_chips": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN event_type || '.png' ELSE 'image' END AS label FROM events",
    "find_in_note": "WITH p AS (SELECT doc_id, string_split(lower(text), 'the') AS s FROM documents), l AS (SELECT doc_id, unnest(s) AS part, generate_subscripts(s, 1) - 1 AS n, len(s) - 1 AS hits FROM p), a AS (SELECT doc_id, n, hits, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY n) + 3 * n AS start FROM l) SELECT doc_id, CAST(n AS INT) AS n, CAST(start AS INT) AS start, CAST((n + 1) % hits AS INT) AS next FROM a WHERE n < hits",
    "properties_write": f"WITH {MARKED} SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN 'source: ' || source || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'tags: ' || lang || chr(10) WHEN 1 THEN 'tags:' || chr(10) || '    - ' || lang || chr(10) || '    - ' || source || chr(10) ELSE 'tags:' || chr(10) END ELSE '' END AS block, sha256(body) AS body_hash FROM marked",
    "markdown_names": "WITH n AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '.' ELSE '' END || event_type AS stem, ['', '.md', '.MD', '.Markdown', '.txt'][event_id % 5 + 1] AS ext FROM events) SELECT event_id, stem || ext || CASE WHEN ext IN ('', '.txt') THEN '.md' ELSE '' END AS ensured, CASE WHEN ext = '.txt' THEN stem || ext ELSE stem END AS trimmed, stem[1] = '.' AS hidden FROM n",
    "property_assignments": "SELECT event_id, event_id % 7 > 1 AS ok, CASE WHEN event_id % 7 > 1 THEN CASE WHEN event_id % 2 = 0 THEN 'a:' || event_id ELSE 'a:' || event_type || '+x;b:' || event_id END || ';c:' END AS props FROM events",
    "kernel_names": "SELECT event_id, event_type || CASE WHEN event_id % 3 = 2 THEN '@x' ELSE '' END AS name, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '1.' || event_id % 10 ELSE '2' END AS version FROM events",
    "utc_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    "turns_ordered": f"WITH {TURNS} SELECT session_id, id, kind, CAST(row_number() OVER (PARTITION BY session_id ORDER BY id) AS INT) AS place FROM turns",
    "folders_visible": "WITH s AS (SELECT lang, source FROM documents WHERE doc_id % 97 = 3) SELECT lang AS path FROM s UNION SELECT lang || '/' || source FROM s",
    "note_tree": "WITH f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'pics' ELSE source END AS folder FROM documents), t AS (SELECT lang || '/' || source || '/doc-' || doc_id || '.md' AS path, lang || '/' || source AS parent, 'doc-' || doc_id || '.md' AS name, false AS is_dir FROM f WHERE doc_id % 3 > 0 UNION ALL SELECT DISTINCT lang || '/' || folder, lang, folder, true FROM f UNION ALL SELECT DISTINCT lang, '', lang, true FROM f) SELECT path, is_dir, CAST(row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, name) AS INT) AS place FROM t",
    "public_hits": f"WITH {CHUNKS}, {SELF}, {leg()}, {band()} SELECT b.qid, c.path, c.heading, c.vault, round(b.sim, 6) AS score FROM banded b JOIN chunks c ON b.id = c.id",
    "live_edges": "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0)",
    "layout_bounds": "SELECT max(o_custkey) AS most, min(o_totalprice)::DOUBLE AS min_x, max(o_totalprice)::DOUBLE AS max_x, min(-o_orderkey)::DOUBLE AS min_y, max(-o_orderkey)::DOUBLE AS max_y FROM orders",
    "hits_of_json": "SELECT event_id, CAST(0 AS INT) AS n, event_type AS path, 'h' AS heading, 'v' AS vault, 'm' AS model, event_id % 8 / 4 AS score FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 0, event_type, 'h', '', '', 0 FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 1, 'second', '', '', '', 0 FROM events WHERE event_id % 4 = 1",
    "image_names": "WITH f AS (SELECT user_id AS image, min(event_id) AS ord FROM events GROUP BY 1), n AS (SELECT image, row_number() OVER (PARTITION BY image % 7 ORDER BY ord) AS n FROM f) SELECT image, 'pic' || image % 7 || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.png' AS name FROM n",
    "letter_ordinals": "WITH p AS (SELECT p_partkey, p_partkey - 1 AS z FROM part), l AS (SELECT *, chr(CAST(97 + greatest(z, 0) % 26 AS INT)) AS c1, CASE WHEN z >= 26 THEN chr(CAST(97 + (z // 26 - 1) % 26 AS INT)) ELSE '' END AS c2, CASE WHEN z >= 702 THEN chr(CAST(97 + ((z // 26 - 1) // 26 - 1) % 26 AS INT)) ELSE '' END AS c3, CASE WHEN z >= 18278 THEN chr(CAST(97 + (((z // 26 - 1) // 26 - 1) // 26 - 1) % 26 AS INT)) ELSE '' END AS c4 FROM p) SELECT p_partkey, CASE WHEN z < 0 THEN '' ELSE c4 || c3 || c2 || c1 END AS letters, CAST(least(greatest(p_partkey % 11 - 2, 1), 6) AS INT) AS level FROM l",
    "folder_delete": "SELECT source || '/doc-' || doc_id || '.md' AS path FROM documents WHERE source <> 'src1'",
    "folder_move": "WITH p AS (SELECT source, source || '/doc-' || doc_id || '.md' AS path FROM documents), o AS (SELECT count(*) > 0 AS there FROM p WHERE source = 'src3') SELECT path, 'moved' || path[5:] AS target, 'moved' AS status FROM p WHERE source = 'src1' UNION ALL SELECT path, CASE WHEN there THEN path ELSE 'src3' || path[5:] END, CASE WHEN there THEN 'refused' ELSE 'moved' END FROM p, o WHERE source = 'src2'",
    "note_moves": f"{MOVES} SELECT path, CASE WHEN status = 'moved' THEN target ELSE path END AS target, status FROM (SELECT *, CASE WHEN NOT here THEN 'missing' WHEN path = target THEN 'skipped' WHEN there OR nth > 1 THEN 'refused' ELSE 'moved' END AS status FROM placed)",
    "note_moves_over": f"{MOVES}, told AS (SELECT *, CASE WHEN NOT here THEN 'missing' WHEN path = target THEN 'skipped' WHEN nth > 1 THEN 'refused' ELSE 'moved' END AS status FROM placed) SELECT path, CASE WHEN status = 'moved' THEN target ELSE path END AS target, status FROM told UNION ALL SELECT target, '.trash/20240101T000000/' || target, 'trashed' FROM told WHERE status = 'moved' AND there",
    "trash_moves": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '.trash/20240101T000000/' ELSE '' END || source || '/doc-' || doc_id || '.md' AS path FROM documents WHERE doc_id % 7 > 0 OR doc_id % 2 = 0",
    "sql_note_tables": f"{LINKS} SELECT doc_id, 'link' AS kind, CAST(n AS INT) AS n, target AS value FROM links UNION ALL SELECT doc_id, 'code', 0, lower(lang) FROM documents",
}
