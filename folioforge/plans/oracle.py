"""SQL for DuckDB with the rows of the registered queries.

Written from the queries' meaning, with other means where the dialects differ:
folds are recursive queries here, windows are correlated subqueries and the like.
"""

from __future__ import annotations

DOCS = "docs AS (SELECT doc_id, text, 'doc_' || doc_id AS doc_name FROM documents)"
TURNS = "turns AS (SELECT conv_id AS doc_id, turn + 1 AS page, text AS content, role FROM conversations)"

# Pages of 100 words: a walk over the lines, one page number each.
PAGES = (
    DOCS
    + r""",
ln AS (SELECT doc_id, i, l[i] AS line, len(list_filter(string_split_regex(l[i], '\s+'), lambda w: w <> '')) AS w
       FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
walk AS (SELECT doc_id, i, 1 AS pg, w AS acc FROM ln WHERE i = 1
         UNION ALL
         SELECT l.doc_id, l.i, CASE WHEN k.acc >= 100 THEN k.pg + 1 ELSE k.pg END, CASE WHEN k.acc >= 100 THEN l.w ELSE k.acc + l.w END
         FROM walk k JOIN ln l ON l.doc_id = k.doc_id AND l.i = k.i + 1),
pages AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pg) AS page, content FROM (
            SELECT k.doc_id, k.pg, regexp_replace(string_agg(l.line, chr(10) ORDER BY k.i), '^\s+|\s+$', '', 'g') AS content
            FROM walk k JOIN ln l USING (doc_id, i) GROUP BY 1, 2) WHERE content <> ''),
tok AS (SELECT doc_id, page, content, 2 * len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS tokens FROM pages),
totals AS (SELECT doc_id, max(page) AS total_pages FROM pages GROUP BY 1)"""
)

# Group ranges by a walk over pages; the state is the first page and the tokens of the current group.
GROUPS = r""",
tgt AS (SELECT doc_id, sum(tokens) AS total, ceil((sum(tokens) / ceil(sum(tokens) / 600) + 600) / 2) AS target, max(page) AS last FROM tok GROUP BY 1),
g AS (SELECT t.doc_id, t.page, 1 AS s, t.tokens::BIGINT AS n, NULL::BIGINT AS fs, NULL::BIGINT AS fe, 0 AS no FROM tok t WHERE page = 1
      UNION ALL
      SELECT t.doc_id, t.page,
        CASE WHEN c THEN greatest(t.page - 1, 1) ELSE g.s END,
        CASE WHEN c THEN (p.tokens + t.tokens)::BIGINT ELSE g.n + t.tokens END,
        CASE WHEN c THEN g.s END, CASE WHEN c THEN t.page - 1 END, CASE WHEN c THEN g.no + 1 ELSE g.no END
      FROM g JOIN tok t ON t.doc_id = g.doc_id AND t.page = g.page + 1 JOIN tok p ON p.doc_id = g.doc_id AND p.page = g.page
        JOIN tgt x ON x.doc_id = g.doc_id, LATERAL (SELECT x.total > 600 AND g.n + t.tokens > x.target AS c)),
ranges AS (SELECT doc_id, no - 1 AS group_no, fs AS first_page, fe AS last_page FROM g WHERE fe IS NOT NULL
           UNION ALL SELECT g.doc_id, no, s, page FROM g JOIN tgt ON tgt.doc_id = g.doc_id AND page = last)"""


def flat(ranges: str = "SELECT doc_id, 0 AS group_no, 1 AS first_page, total_pages AS last_page FROM totals") -> str:
    """Sections by the short-line rule (the fixtures have no Markdown or numbered headings)."""
    return rf""",
rng AS ({ranges}),
hd AS (SELECT doc_id, page, i, t FROM (SELECT doc_id, page, i, trim(l[i]) AS t FROM (SELECT doc_id, page, string_split(content, chr(10)) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM pages))
       WHERE len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 6),
flat AS (SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY group_no, page, i) AS ord,
         (row_number() OVER (PARTITION BY r.doc_id, group_no ORDER BY page, i))::VARCHAR AS structure, t AS title, page AS physical_index
         FROM rng r JOIN hd ON hd.doc_id = r.doc_id AND page BETWEEN first_page AND last_page),
fb AS (SELECT * FROM flat UNION ALL SELECT doc_id, 1, '1', doc_name, 1 FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM flat)),
sec AS (SELECT * FROM fb UNION ALL SELECT doc_id, ord - 1, '0', 'Preface', 1 FROM fb f WHERE ord = (SELECT min(ord) FROM fb WHERE doc_id = f.doc_id) AND physical_index > 1)"""


# Tree of sec (doc_id, ord, structure, title, physical_index) and totals.
TREE = r""",
e0 AS (SELECT sec.*, greatest(physical_index, coalesce(lead(physical_index) OVER (PARTITION BY sec.doc_id ORDER BY ord) - 1, total_pages)) AS e,
       CASE WHEN contains(structure, '.') THEN nullif(regexp_replace(structure, '\.[^.]*$', ''), '') END AS pk FROM sec JOIN totals USING (doc_id)),
par AS (SELECT c.*, (SELECT max(p.ord) FROM e0 p WHERE p.doc_id = c.doc_id AND p.structure = c.pk AND p.ord < c.ord) AS parent_ord FROM e0 c),
up AS (SELECT doc_id, ord, [ord] AS path, parent_ord AS nxt FROM par
       UNION ALL SELECT u.doc_id, u.ord, list_prepend(p.ord, u.path), p.parent_ord FROM up u JOIN par p ON p.doc_id = u.doc_id AND p.ord = u.nxt),
pth AS (SELECT doc_id, ord, path FROM up WHERE nxt IS NULL),
low AS (SELECT a.doc_id, a.ord, max(par.e) AS e FROM (SELECT doc_id, ord AS d, unnest(path) AS ord FROM pth) a JOIN par ON par.doc_id = a.doc_id AND par.ord = a.d GROUP BY 1, 2),
nodes AS (SELECT par.doc_id, par.ord, path, array_to_string(path, '/') AS ps, len(path) AS tree_depth, (length(structure) - length(replace(structure, '.', '')))::BIGINT AS depth,
          structure, title, physical_index AS start_index, low.e AS end_index FROM par JOIN pth USING (doc_id, ord) JOIN low USING (doc_id, ord))"""


def chapters(shift: int = 1) -> str:
    """Sections of conversations."""
    return (
        TURNS
        + rf""",
k AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY doc_id ORDER BY page) AS k FROM turns),
sec AS (SELECT doc_id, page AS ord, CASE WHEN role = 'user' THEN k::VARCHAR ELSE k || '.' || sum((role <> 'user')::INT) OVER (PARTITION BY doc_id, k ORDER BY page) END AS structure,
        array_to_string(string_split(content, ' ')[1:4], ' ') AS title, (page + page % {shift})::BIGINT AS physical_index FROM k),
totals AS (SELECT doc_id, max(page) AS total_pages FROM turns GROUP BY 1)"""
    )


def norm(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


CHECKED = f", c0 AS (SELECT sec.doc_id, ord, title, physical_index, coalesce(contains({norm('content')}, {norm('title')}), false) AS ok FROM sec LEFT JOIN turns ON turns.doc_id = sec.doc_id AND page = physical_index)"


def window(n: int, radius: int) -> str:
    """Search windows of state ``c{n}``."""
    return f""", w{n} AS (SELECT c.*, greatest(coalesce((SELECT arg_max(physical_index, ord) FROM c{n} p WHERE p.doc_id = c.doc_id AND p.ok AND p.ord < c.ord), 1), physical_index - {radius}, 1) AS win_start,
least(coalesce((SELECT arg_min(physical_index, ord) FROM c{n} p WHERE p.doc_id = c.doc_id AND p.ok AND p.ord > c.ord), total_pages), physical_index + {radius}, total_pages) AS win_end
FROM c{n} c JOIN totals USING (doc_id))"""


def passes(n: int, radius: int) -> str:
    out = ""
    for i in range(n):
        out += window(i, radius)
        out += f""", c{i + 1} AS (SELECT doc_id, ord, title, CASE WHEN ok THEN physical_index ELSE coalesce(f, physical_index) END AS physical_index, ok OR f IS NOT NULL AS ok FROM (
SELECT w.*, (SELECT min(page) FROM turns t WHERE t.doc_id = w.doc_id AND page BETWEEN win_start AND win_end AND contains({norm('content')}, {norm('title')})) AS f FROM w{i} w))"""
    return out


def sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def first(x: str, n: int) -> str:
    return f"array_to_string(({sentences(x)})[1:{n}], ' ')"


def section_text(limit: int) -> str:
    return f""", stext AS (SELECT n.doc_id, n.path, n.ps, n.title, tree_depth, start_index, end_index, coalesce(substring((SELECT string_agg(content, ' ' ORDER BY page) FROM pages p WHERE p.doc_id = n.doc_id AND page BETWEEN start_index AND end_index), 1, {limit}), '') AS text FROM nodes n)"""


SUMMARIES = section_text(8000) + f""", summ AS (SELECT *, {first("text", 2)} AS summary FROM stext),
descr AS (SELECT doc_id, doc_name, coalesce(array_to_string(f[1:5], ' '), '') AS description FROM docs LEFT JOIN (SELECT doc_id, list({first("summary", 1)} ORDER BY path) AS f FROM summ WHERE tree_depth = 1 AND summary <> '' GROUP BY 1) USING (doc_id))"""

PLAN = r""", tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM docs) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM (SELECT doc_id, term, tf, round(tf * ln(((SELECT count(*) FROM docs) + 1.0) / (df + 1.0)), 6) AS score FROM tf JOIN df USING (term))),
fst AS (SELECT term, min(doc_id) AS first_doc FROM rk WHERE rank <= 5 GROUP BY 1),
act AS (SELECT doc_id, term, tf, rank, CASE WHEN rank <= 5 AND first_doc >= doc_id THEN 'create' WHEN rank <= 5 THEN 'update' WHEN rank <= 20 AND first_doc < doc_id THEN 'related' END AS action FROM rk JOIN fst USING (term)),
plan AS (SELECT doc_id, doc_name, action, row_number() OVER (PARTITION BY doc_id, action ORDER BY rank) AS pos, term AS name, upper(term[1]) || term[2:] AS title, tf FROM act JOIN docs USING (doc_id) WHERE action IS NOT NULL)"""

CONCEPTS = (
    PLAN
    + f""", sent AS (SELECT doc_id, {sentences("text")} AS s FROM docs),
rel AS (SELECT doc_id, string_agg(CASE WHEN name IN (SELECT name FROM plan q WHERE q.doc_id = plan.doc_id AND action <> 'related') THEN '[[concepts/' || name || ']]' ELSE 'concepts/' || name END, ', ' ORDER BY pos) AS see FROM plan WHERE action = 'related' GROUP BY 1),
cp AS (SELECT p.doc_id, doc_name, row_number() OVER (PARTITION BY p.doc_id ORDER BY action, pos) AS gen_ord, name AS slug, title || ': ' || tf || ' mentions in ' || doc_name AS brief,
  '# ' || title || chr(10) || chr(10) || array_to_string(list_filter(s, lambda x: contains(lower(x), name))[1:3], ' ') || chr(10) || chr(10) || '[[summaries/' || doc_name || ']]' || coalesce(', ' || see, '') AS content, action = 'update' AS is_update
  FROM plan p JOIN sent USING (doc_id) LEFT JOIN rel USING (doc_id) WHERE action <> 'related'),
fw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id, gen_ord) AS n FROM cp) WHERE n = 1),
want AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) AS pos, slug FROM (
  SELECT doc_id, gen_ord AS k, slug, 0 AS part FROM cp UNION ALL
  SELECT doc_id, pos, name, 1 FROM plan WHERE action = 'related' AND (doc_id, name) NOT IN (SELECT (doc_id, slug) FROM cp)))"""
)

REQUESTS = r"""req AS (SELECT doc_id AS q_id, doc_name, CASE doc_id % 4 WHEN 0 THEN (doc_id % 3 + 1) || '-4, 2,x,5-3' WHEN 1 THEN '1,' || (doc_id % 3 + 1) WHEN 2 THEN '900, -2' ELSE '2-3,+1' END AS pages FROM docs)"""


def page_numbers(spec: str) -> str:
    part = r"""CASE WHEN contains(p, '-') THEN (CASE WHEN regexp_full_match(p, '\s*\+?\d+\s*-\s*\+?\d+\s*') THEN range(trim(split_part(p, '-', 1))::INT, trim(split_part(p, '-', 2))::INT + 1) ELSE [] END)
WHEN regexp_full_match(p, '\s*\+?\d+\s*') THEN [trim(p)::BIGINT] ELSE [] END"""
    return f"list_sort(list_distinct(list_filter(flatten(list_transform(string_split({spec}, ','), lambda p: {part})), lambda n: n > 0)))"


NUMBERS = f", num AS (SELECT q_id, doc_name, pages, {page_numbers('pages')} AS n FROM req)"

CITES = r""", ans AS (SELECT doc_id AS q_id, doc_id AS n FROM docs),
cites AS (SELECT q_id, 0::BIGINT AS cite_pos, 'doc_' || n AS doc_name, [n % 5 + 1] AS ps FROM ans
          UNION ALL SELECT q_id, 1, 'doc_' || (n + n % 2), CASE WHEN n % 7 = 0 THEN [1, 2] ELSE [1, 2, n % 7] END FROM ans),
cited AS (SELECT q_id, cite_pos, doc_name, i - 1 AS pos, ps[i] AS page FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM cites)),
fetched AS (SELECT DISTINCT q_id, doc_name, unnest(n) AS page FROM num)"""

TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}'))"
RANKED = f""", qs AS (SELECT item_id AS q_id, text AS question FROM benchmark),
qt AS (SELECT q_id, unnest({TERMS.format("question")}) AS term FROM qs),
st AS (SELECT doc_id, path, ps, unnest({TERMS.format("text")}) AS term FROM stext),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY overlap DESC, doc_id, path) AS rank FROM (SELECT q_id, doc_id, path, ps, count(*) AS overlap FROM qt JOIN st USING (term) GROUP BY 1, 2, 3, 4)) WHERE rank <= 3)"""


def dash(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN ' — ' || {x} ELSE '' END"


RENDERED = """, body AS (SELECT doc_id, string_agg(repeat('#', least(tree_depth, 6)::INT) || ' ' || title || ' (pages ' || start_index || '–' || end_index || ')' || chr(10) || CASE WHEN summary <> '' THEN chr(10) || 'Summary: ' || summary || chr(10) ELSE '' END, chr(10) ORDER BY path) AS body FROM summ GROUP BY 1),
smd AS (SELECT doc_id, doc_name, '---' || chr(10) || 'doc_type: pageindex' || chr(10) || 'full_text: sources/' || doc_name || '.json' || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '') AS summary_md FROM docs LEFT JOIN body USING (doc_id))"""
SOURCES = """, src AS (SELECT doc_id, '[' || string_agg('{"page":' || page || ',"content":' || to_json(content) || ',"images":[]}', ',' ORDER BY page) || ']' AS sources FROM pages GROUP BY 1)"""
UNIFIED = f""", uni AS (SELECT '# Knowledge Base Index' || chr(10) || chr(10) || '## Documents' || chr(10) || chr(10) || (SELECT string_agg('- [[summaries/' || doc_name || ']] (pageindex)' || {dash("description")}, chr(10) ORDER BY doc_id) FROM descr) || chr(10) || chr(10) || '## Concepts' || chr(10) || chr(10) || (SELECT string_agg('- [[concepts/' || slug || ']]' || {dash("brief")}, chr(10) ORDER BY slug) FROM fw) AS index)"""


def linked(content: str, heading: str, bullets: str) -> str:
    """Bullets below a heading that the text doesn't have yet."""
    return f"CASE WHEN {bullets} IS NULL THEN {content} ELSE (CASE WHEN rtrim({content}, chr(10)) = '' THEN '' ELSE rtrim({content}, chr(10)) || chr(10) || chr(10) END) || '{heading}' || chr(10) || {bullets} || chr(10) END"


def concept_file(sources: str) -> str:
    return f"""'---' || chr(10) || 'sources: [' || {sources} || ']' || chr(10) || 'brief: ' || to_json(brief) || chr(10) || '---' || chr(10) || chr(10) || content"""


def rec(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_TREE = PAGES + flat() + TREE
_SUMM = _TREE + SUMMARIES
_CONV = chapters() + TREE
_ALL = _SUMM + CONCEPTS

ORACLE_SQL: dict[str, str] = {
    "split_pages": rec(PAGES, "SELECT doc_id, page, content FROM pages"),
    "token_counts": rec(PAGES, "SELECT doc_id, page, tokens FROM tok"),
    "page_texts": f"WITH {TURNS} SELECT doc_id, page, CASE WHEN role = 'user' THEN content ELSE replace(content, chr(10), ' ') END AS content FROM turns",
    "texts_as_pages": f"WITH {TURNS} SELECT doc_id, page, content FROM turns",
    "tag_pages": rec(PAGES, "SELECT doc_id, page, '<physical_index_' || page || '>' || chr(10) || content || chr(10) || '<physical_index_' || page || '>' AS tagged FROM pages"),
    "group_pages": rec(PAGES + GROUPS, "SELECT doc_id, group_no::BIGINT AS group_no, first_page, last_page FROM ranges"),
    "group_texts": rec(PAGES + GROUPS, "SELECT r.doc_id, group_no::BIGINT AS group_no, string_agg('<physical_index_' || page || '>' || chr(10) || content || chr(10) || '<physical_index_' || page || '>', chr(10) || chr(10) ORDER BY page) AS text FROM ranges r JOIN pages p ON p.doc_id = r.doc_id AND page BETWEEN first_page AND last_page GROUP BY 1, 2"),
    "section_budget": rec(PAGES + GROUPS, "SELECT doc_id, count(*) AS groups, ceil(20 / count(*))::BIGINT AS budget FROM ranges GROUP BY 1"),
    "flat_sections": rec(PAGES + flat(), "SELECT * FROM flat"),
    "flat_sections_grouped": rec(PAGES + GROUPS + flat("SELECT * FROM ranges"), "SELECT * FROM flat"),
    "fallback_sections": rec(PAGES + flat(), "SELECT * FROM fb"),
    "preface": rec(PAGES + flat(), "SELECT * FROM sec"),
    "verify_sections": rec(chapters(3) + CHECKED, "SELECT doc_id, ord, physical_index, ok FROM c0"),
    "search_window": rec(chapters(3) + CHECKED + window(0, 2), "SELECT doc_id, ord, physical_index, win_start, win_end FROM w0 WHERE NOT ok"),
    "fix_sections": rec(chapters(3) + CHECKED + passes(3, 5), "SELECT doc_id, ord, physical_index, ok FROM c3"),
    "end_index_lead": rec(_CONV, "SELECT doc_id, ord, physical_index AS start_index, e AS end_index FROM e0"),
    "tree_parent": rec(_CONV, "SELECT doc_id, ord, structure, parent_ord FROM par"),
    "tree_parent_three_levels": """WITH r AS (
SELECT r_regionkey::BIGINT AS doc_id, 0::BIGINT AS a, 0::BIGINT AS b, '1' AS structure FROM region
UNION ALL SELECT n_regionkey, n_nationkey + 1, 0, '1.' || n_nationkey FROM nation
UNION ALL SELECT n_regionkey, n_nationkey + 1, c_custkey + 1, '1.' || n_nationkey || '.' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS ord, structure FROM r)
SELECT doc_id, ord, structure, (SELECT max(p.ord) FROM o p WHERE p.doc_id = o.doc_id AND p.ord < o.ord AND p.structure = regexp_replace(o.structure, '\\.[^.]*$', '') AND contains(o.structure, '.')) AS parent_ord FROM o""",
    "tree_end_index": rec(_CONV, "SELECT doc_id, ord, depth, tree_depth, start_index, end_index FROM nodes"),
    "tree_preorder": rec(_CONV, "SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS pre, ps AS path FROM nodes"),
    "tree_text": rec(_CONV, "SELECT doc_id, string_agg(repeat('  ', (tree_depth - 1)::INT) || repeat('#', (depth + 1)::INT) || ' ' || title || ' (pages ' || start_index || '–' || end_index || ')', chr(10) ORDER BY path) AS text FROM nodes GROUP BY 1"),
    # chapters and the turns below them: two levels
    "tree_json": rec(
        _CONV,
        """, leaf AS (SELECT doc_id, path[1] AS top, string_agg('{"title":' || to_json(title) || ',"start_index":' || start_index || ',"end_index":' || end_index || ',"depth":' || depth || ',"children":[]}', ',' ORDER BY path) AS below FROM nodes WHERE tree_depth = 2 GROUP BY 1, 2)
SELECT n.doc_id, '[' || string_agg('{"title":' || to_json(title) || ',"start_index":' || start_index || ',"end_index":' || end_index || ',"depth":' || depth || ',"children":[' || coalesce(below, '') || ']}', ',' ORDER BY path) || ']' AS json FROM nodes n LEFT JOIN leaf ON leaf.doc_id = n.doc_id AND leaf.top = n.ord WHERE tree_depth = 1 GROUP BY 1""",
    ),
    # composed letters are all that the names have for the compatibility form to change
    "slug_unicode": rf"WITH {TURNS}, n AS (SELECT doc_id, page, array_to_string(string_split(content, ' ')[1:3], ' ') AS name FROM turns) SELECT doc_id, page, name, coalesce(nullif(regexp_replace(regexp_replace(nfc_normalize(name), '[^\p{{L}}\p{{N}}_\-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed-concept') AS slug FROM n",
    "large_nodes": rec(PAGES, "SELECT doc_id, '1' AS path, 1::BIGINT AS start_index, total_pages AS end_index FROM totals JOIN (SELECT doc_id, sum(tokens) AS n FROM tok GROUP BY 1) USING (doc_id) WHERE total_pages > 2 AND n >= 300"),
    "section_text": rec(_TREE + section_text(300), "SELECT doc_id, ps AS path, text FROM stext"),
    "section_summaries": rec(_SUMM, "SELECT doc_id, ps AS path, title, summary FROM summ"),
    "doc_description": rec(_SUMM, "SELECT doc_id, description FROM descr"),
    "overview": rec(_SUMM, f"SELECT doc_id, array_to_string(list_filter(f[1:5], lambda x: x <> ''), ' ') AS overview FROM (SELECT doc_id, list({first('summary', 1)} ORDER BY path) AS f FROM summ WHERE tree_depth = 1 GROUP BY 1)"),
    "outline": rec(
        _SUMM,
        """, items AS (SELECT doc_id, string_agg(repeat(' ', (2 * tree_depth - 2)::INT) || '- **' || title || '** (' || CASE WHEN start_index = end_index THEN 'p. ' || start_index ELSE 'pp. ' || start_index || '–' || end_index END || ')'
  || CASE WHEN summary = '' THEN '' WHEN length(summary) > 120 THEN ': ' || rtrim(substring(summary, 1, 120), ' ') || '…' ELSE ': ' || summary END, chr(10) ORDER BY path) AS l FROM summ GROUP BY 1)
SELECT d.doc_id, '# ' || doc_name || ' (' || total_pages || ' pages)' || CASE WHEN description <> '' THEN chr(10) || chr(10) || description ELSE '' END || coalesce(chr(10) || chr(10) || l, '') AS outline FROM descr d JOIN totals USING (doc_id) LEFT JOIN items USING (doc_id)""",
    ),
    "sources_json": rec(PAGES + SOURCES, "SELECT * FROM src"),
    "summary_md": rec(_SUMM + RENDERED, "SELECT * FROM smd"),
    "concept_plan": rec(DOCS + PLAN, "SELECT doc_id, doc_name, action, pos, name, title FROM plan"),
    "known_targets": rec(DOCS + PLAN, "SELECT doc_id, string_agg('- ' || t, chr(10) ORDER BY t) AS targets FROM (SELECT doc_id, 'concepts/' || name AS t FROM plan WHERE action <> 'related' UNION SELECT doc_id, 'summaries/' || doc_name FROM plan) GROUP BY 1"),
    "strip_ghost_links": f"WITH {DOCS} SELECT doc_id, 'see concepts/' || doc_name || ' and ' || CASE WHEN doc_id % 2 = 0 THEN '[[concepts/b]]' ELSE 'concepts/b' END || ' or a|b and [[summaries/' || doc_name || ']]' AS text FROM docs",
    "strip_ghosts": f"WITH {DOCS}, x AS (SELECT *, 'concepts/x' || doc_id % 5 AS a, 'concepts/x' || doc_id % 7 AS b FROM docs) SELECT doc_id, 1::BIGINT AS gen_ord, CASE WHEN doc_id % 5 < 3 THEN '[[' || a || ']]' ELSE a END || ' ' || CASE WHEN doc_id % 7 < 3 THEN '[[' || b || ']]' ELSE b END || ' [[summaries/' || doc_name || ']]' AS content FROM x",
    "concept_pages": rec(DOCS + CONCEPTS, "SELECT * FROM cp"),
    "concept_last_wins": f"WITH {TURNS} SELECT doc_id, 'conv_' || doc_id AS doc_name, role AS slug, min(page) AS place, arg_max(content, page) AS brief, arg_max(content, page) AS content FROM turns GROUP BY doc_id, role",
    "concept_first_wins": rec(DOCS + CONCEPTS, "SELECT slug, doc_id, brief FROM fw"),
    "related_minus_concepts": rec(DOCS + CONCEPTS, "SELECT doc_id, pos, slug FROM want"),
    "document_index": rec(_ALL, f"SELECT doc_id, '# Knowledge Base Index' || chr(10) || chr(10) || '## Documents' || chr(10) || chr(10) || '- [[summaries/' || doc_name || ']] (pageindex) — ' || description || chr(10) || chr(10) || '## Concepts' || chr(10) || coalesce(l, '') AS index FROM descr LEFT JOIN (SELECT doc_id, chr(10) || string_agg('- [[concepts/' || slug || ']]' || {dash('brief')}, chr(10) ORDER BY slug) AS l FROM cp GROUP BY 1) USING (doc_id)"),
    "concept_briefs": rec(DOCS + CONCEPTS, "SELECT slug, '- ' || slug || ': ' || arg_max(brief, (doc_id, gen_ord)) AS line FROM cp GROUP BY 1"),
    # the first document with a slug creates it and is last in the list
    "concept_sources_upsert": rec(DOCS + CONCEPTS, "SELECT slug, string_agg('summaries/' || doc_name || '.md', ' ' ORDER BY doc_id DESC) AS sources, arg_max(brief, doc_id) AS brief FROM cp GROUP BY 1"),
    "wiki_targets": rec(DOCS + CONCEPTS, "SELECT DISTINCT 'concepts/' || slug AS target FROM cp UNION SELECT 'summaries/' || doc_name FROM docs"),
    "backlink_summary_missing": rec(DOCS + CONCEPTS, "SELECT doc_id, pos, slug FROM want WHERE NOT (doc_id % 2 = 0 AND slug = 'that')"),
    "backlink_concepts_missing": rec(DOCS + CONCEPTS, "SELECT DISTINCT w.slug, w.doc_id, d.doc_name FROM want w JOIN docs d USING (doc_id) JOIN fw f ON f.slug = w.slug WHERE NOT contains(f.content, '[[summaries/' || d.doc_name || ']]')"),
    "related_links": f"""WITH {DOCS}, x AS (SELECT doc_id AS d, 'summaries/doc_' || doc_id AS n, doc_id % 2 = 0 AS even, (SELECT 'summaries/' || doc_name FROM docs e WHERE e.doc_id = docs.doc_id + 1) AS n1, (SELECT 'summaries/' || doc_name FROM docs e WHERE e.doc_id = docs.doc_id + 2) AS n2 FROM docs),
y AS (SELECT d, CASE WHEN even THEN list_filter([n2, n], lambda v: v IS NOT NULL) ELSE list_filter([n2, n1], lambda v: v IS NOT NULL) END AS src, CASE WHEN even THEN list_filter([n2], lambda v: v IS NOT NULL) ELSE list_filter([n1, n2], lambda v: v IS NOT NULL) END AS see,
  CASE WHEN even THEN 'body [[summaries/doc_' || (d + 1) || ']]' ELSE 'plain body' END AS body, even FROM x)
SELECT 'c' || d AS slug, CASE WHEN len(src) = 0 THEN '' ELSE '---' || chr(10) || 'sources: [' || array_to_string(list_transform(src, lambda v: '"' || v || '.md"'), ', ') || ']' || chr(10) || CASE WHEN even THEN 'brief: "b"' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) END || body || array_to_string(list_transform(see, lambda v: chr(10) || chr(10) || 'See also: [[' || v || ']]'), '') AS content FROM y""",
    "index_upsert": "SELECT 'user_' || user_id AS key, min(event_id) AS first_seq, coalesce(max(event_id) FILTER (WHERE TRUE), 0) AS last_seq, arg_max(event_type, event_id) AS brief FROM events GROUP BY 1",
    "index_text": rec(_ALL, f"SELECT '# Knowledge Base Index' || chr(10) || chr(10) || '## Documents' || chr(10) || (SELECT string_agg('- [[summaries/' || doc_name || ']] (pageindex)' || {dash('description')} || chr(10), '' ORDER BY doc_id DESC) FROM descr) || chr(10) || '## Concepts' || chr(10) || (SELECT string_agg('- [[concepts/' || slug || ']]' || {dash('brief')} || chr(10), '' ORDER BY doc_id * 100 + gen_ord DESC) FROM fw) || chr(10) || '## Explorations' || chr(10) AS index"),
    "unified_entries": rec(_ALL, f"SELECT 0::BIGINT AS part, 0::BIGINT AS o, '' AS s, '# Knowledge Base Index' || chr(10) || chr(10) || '## Documents' || chr(10) AS line UNION ALL SELECT 2, 0, '', chr(10) || '## Concepts' || chr(10) UNION ALL SELECT 1, doc_id, '', '- [[summaries/' || doc_name || ']] (pageindex)' || {dash('description')} FROM descr UNION ALL SELECT 3, 0, slug, '- [[concepts/' || slug || ']]' || {dash('brief')} FROM fw"),
    "unified_index": rec(_ALL + UNIFIED, "SELECT index FROM uni"),
    "linked_concepts": rec(DOCS + CONCEPTS, f"SELECT f.slug, {linked('brief', '## Related Documents', 'b')} AS content FROM fw f LEFT JOIN (SELECT slug, string_agg('- [[summaries/doc_' || doc_id || ']]', chr(10) ORDER BY doc_id DESC) AS b FROM want GROUP BY 1) USING (slug)"),
    "wiki_files": rec(
        _ALL + RENDERED + SOURCES + UNIFIED,
        f"""SELECT 'sources/' || doc_name || '.json' AS path, sources AS content FROM docs JOIN src USING (doc_id)
UNION ALL SELECT 'summaries/' || doc_name || '.md', {linked('summary_md', '## Related Concepts', 'b')} FROM smd LEFT JOIN (SELECT doc_id, string_agg('- [[concepts/' || slug || ']]', chr(10) ORDER BY pos) AS b FROM want GROUP BY 1) USING (doc_id)
UNION ALL SELECT 'concepts/' || slug || '.md', {linked('f', '## Related Documents', 'b')} FROM (SELECT slug, {concept_file("to_json('summaries/' || doc_name || '.md')")} AS f FROM fw) LEFT JOIN (
  SELECT w.slug, string_agg('- [[summaries/doc_' || w.doc_id || ']]', chr(10) ORDER BY w.doc_id DESC) AS b FROM want w JOIN fw f ON f.slug = w.slug WHERE NOT contains(f.content, '[[summaries/doc_' || w.doc_id || ']]') GROUP BY 1) USING (slug)
UNION ALL SELECT 'index.md', index FROM uni""",
    ),
    "parse_pages": rec(DOCS + ", " + REQUESTS + NUMBERS, "SELECT q_id, pages, array_to_string(n, ',') AS numbers FROM num"),
    "page_content": rec(
        PAGES + ", " + REQUESTS + NUMBERS,
        """SELECT q_id, CASE WHEN q_id % 10 = 9 THEN 'nowhere' ELSE doc_name END AS doc_name, num.pages, CASE WHEN q_id % 10 = 9 THEN 'File not found: sources/nowhere.json' ELSE coalesce(t, 'No content found for pages ' || num.pages || ' in ' || doc_name || '.') END AS result
FROM num LEFT JOIN (SELECT q_id, string_agg('[Page ' || page || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY page) || chr(10) || chr(10) AS t FROM (SELECT q_id, unnest(n) AS page FROM num) r JOIN pages p ON p.doc_id = r.q_id AND p.page = r.page GROUP BY 1) USING (q_id)""".replace("ORDER BY page", "ORDER BY p.page").replace("'[Page ' || page", "'[Page ' || p.page"),
    ),
    "read_file": f"WITH {DOCS} SELECT doc_id AS q_id, CASE doc_id % 3 WHEN 0 THEN 'summaries/' || doc_name || '.md' WHEN 1 THEN '../' || doc_name ELSE 'concepts/' || doc_name || '.md' END AS path, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Access denied: path escapes wiki root.' ELSE 'File not found: concepts/' || doc_name || '.md' END AS result FROM docs",
    "list_files": f"WITH {DOCS}, n AS (SELECT doc_id % 5 AS k, string_agg(doc_name || '.md', chr(10) ORDER BY doc_name || '.md') AS names FROM docs WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id AS q_id, CASE WHEN doc_id % 7 = 6 THEN '../d6' ELSE 'd' || doc_id % 7 END AS directory, CASE WHEN doc_id % 7 = 6 THEN 'Access denied: path escapes wiki root.' ELSE coalesce(names, 'No files found.') END AS result FROM docs LEFT JOIN n ON k = doc_id % 7",
    "fetched_pages": rec(DOCS + ", " + REQUESTS + NUMBERS + CITES, "SELECT * FROM fetched"),
    "cited_pages": rec(DOCS + ", " + REQUESTS + NUMBERS + CITES, "SELECT * FROM cited"),
    "unfetched_citations": rec(DOCS + ", " + REQUESTS + NUMBERS + CITES, "SELECT q_id, cite_pos, doc_name || ' p.' || string_agg(page::VARCHAR, ',' ORDER BY pos) AS citation FROM cited c WHERE NOT EXISTS (FROM fetched f WHERE f.q_id = c.q_id AND f.doc_name = c.doc_name AND f.page = c.page) GROUP BY q_id, cite_pos, doc_name"),
    "rank_sections": rec(_TREE + section_text(8000) + RANKED, "SELECT q_id, rank, doc_id, ps AS path, overlap FROM ranked"),
    "answer": rec(
        _TREE + section_text(8000) + RANKED,
        f""", best AS (SELECT q_id, doc_name, content, page, row_number() OVER (PARTITION BY q_id ORDER BY len(list_intersect({TERMS.format('question')}, {TERMS.format('content')})) DESC, page) AS n
FROM ranked r JOIN nodes USING (doc_id, path) JOIN pages p ON p.doc_id = r.doc_id AND page BETWEEN start_index AND end_index JOIN qs USING (q_id) JOIN docs d ON d.doc_id = r.doc_id WHERE rank = 1)
SELECT q_id, coalesce({first('content', 1)} || ' \\source{{' || doc_name || ', p.' || page || '}}', 'The wiki does not cover this.') AS answer FROM qs LEFT JOIN best USING (q_id) WHERE n = 1 OR n IS NULL""",
    ),
    "slug_ascii": r"SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(' ' || p_name || '! ', '[^A-Za-z0-9_\-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed-concept') AS slug FROM part",
    "normalized_text": rf"WITH {TURNS} SELECT doc_id, page, {norm('content')} AS text FROM turns",
}
