"""The registered queries in another engine's SQL, bindings included, for row-by-row comparison."""

from __future__ import annotations

DOCS = """docs AS (
  SELECT source AS repo, ['proposals/', 'docs/reference/', 'docs/wiki/', 'meetings/', 'docs/release-notes/'][(doc_id % 5)::INT + 1] || lang || '/' || doc_id || '.md' AS path, text FROM documents),
lines AS (SELECT repo, path, n::INT AS line_no, line FROM docs, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n))"""
TIER = """CASE WHEN regexp_matches(lower(path), '(^|/)(proposals|spec)/') THEN 0 WHEN regexp_matches(lower(path), 'meetings/|docs/release-notes/|docs/archive/') THEN 3
  WHEN regexp_matches(lower(path), 'docs/(api|concepts|consume-packages|create-packages|guides|hosting-packages|nuget-org|policies|quickstart|reference|visual-studio-extensibility)/') THEN 1 ELSE 2 END"""


def line_search(predicate: str, limit: int, offset: int) -> str:
    return f"""WITH {DOCS},
r AS (SELECT repo, path, line_no, left(line, 300) AS text, length(line) > 300 AS is_truncated,
  row_number() OVER (ORDER BY {TIER}, CASE WHEN ltrim(line) LIKE '#%' THEN 0 ELSE 1 END, path, line_no, repo)::INT AS position
  FROM lines WHERE {predicate})
SELECT * FROM r WHERE position > {offset} AND position <= {offset + limit}"""


def talks(front_matter: bool = False) -> str:
    head = "CASE WHEN conv_id % 2 = 0 THEN '---' || chr(10) || 'id: ' || conv_id || chr(10) || 'role: user' || chr(10) || '---' || chr(10) || chr(10) ELSE '' END ||" if front_matter else ""
    skip = "CASE WHEN lines[1] = '---' THEN 5 ELSE 1 END" if front_matter else "1"
    return f"""docs AS (
  SELECT 'talks' AS repo, 'spec/' || conv_id || '.md' AS path, {head} '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg(
    '## ' || role || chr(10) || chr(10) || '### Turn ' || turn || chr(10) || chr(10) || text ||
    CASE WHEN role = 'assistant' THEN chr(10) || chr(10) || '```' || chr(10) || '# not a heading ' || turn || chr(10) || '```' ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id),
split AS (SELECT repo, path, string_split(text, chr(10)) AS lines FROM docs),
l AS (SELECT repo, path, len(lines)::INT AS n_lines, {skip} AS body_start, n::INT AS line_no, line FROM split, unnest(lines) WITH ORDINALITY AS u(line, n)),
f AS (SELECT *, count(*) FILTER (line LIKE '```%') OVER (PARTITION BY path ORDER BY line_no) AS fences FROM l),
h AS (SELECT repo, path, n_lines, line_no AS start_line, length(regexp_extract(line, '^(#+) ', 1))::INT AS level, regexp_replace(line, '^#+ ', '') AS text
  FROM f WHERE fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}} ') AND line_no >= body_start),
base AS (
  SELECT h.*, coalesce((SELECT string_agg(a.text, ' > ' ORDER BY a.start_line) FROM h a WHERE a.path = h.path AND a.start_line < h.start_line AND a.level < h.level
    AND NOT EXISTS (SELECT 1 FROM h b WHERE b.path = h.path AND b.start_line > a.start_line AND b.start_line < h.start_line AND b.level <= a.level)) || ' > ', '') || h.text AS base_path,
  coalesce((SELECT min(b.start_line) FROM h b WHERE b.path = h.path AND b.start_line > h.start_line AND b.level <= h.level), n_lines + 1)::INT AS end_line
  FROM h),
sections AS (
  SELECT repo, path, level, text, start_line, end_line, CASE WHEN k > 1 THEN base_path || ' (' || k || ')' ELSE base_path END AS section_path
  FROM (SELECT *, row_number() OVER (PARTITION BY path, base_path ORDER BY start_line) AS k FROM base))"""


def section_search(term: str, limit: int, front_matter: bool) -> str:
    return f"""WITH {talks(front_matter)},
r AS (SELECT l.repo, l.path, l.line_no, left(line, 300) AS text, length(line) > 300 AS is_truncated,
  row_number() OVER (ORDER BY {TIER.replace('path', 'l.path')}, CASE WHEN ltrim(line) LIKE '#%' THEN 0 ELSE 1 END, l.path, line_no, l.repo)::INT AS position
  FROM l WHERE contains(line, '{term}') AND line_no >= body_start)
SELECT r.*, coalesce((SELECT arg_max(s.section_path, s.start_line) FROM sections s WHERE s.path = r.path AND s.start_line <= r.line_no AND r.line_no < s.end_line), '') AS section_path
FROM r WHERE position <= {limit}"""


TYPES = """types AS (
  SELECT s_suppkey, 'Corp.' || replace(r_name, ' ', '') || '.' || n_name AS namespace, 'Supplier' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 THEN '`1' ELSE '' END AS type_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

MEMBERS = TYPES + """,
m AS (
  SELECT unnest(list_filter([CASE WHEN p_partkey % 3 <> 0 THEN 'git' END, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 'nuget' END], lambda o: o IS NOT NULL)) AS origin,
    ['net8.0', 'net9.0', 'net10.0', 'netstandard2.0'][p_size % 4 + 1] AS framework, namespace || '.' || type_name AS full_name, type_name, p_partkey, p_type, p_brand, p_name,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS name
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN types ON l_suppkey = s_suppkey),
members AS (
  SELECT origin, CASE WHEN origin = 'git' THEN 0 ELSE 1 END AS priority, framework, full_name, type_name, name, 'M:' || full_name || '.' || name || '(' || p_partkey || ')' AS declaration_id,
    'public ' || p_type || ' ' || name || '(' || p_brand || ')' AS signature, origin || ' ' || p_name AS summary
  FROM m)"""

USES = """u AS (
  SELECT CASE WHEN l_partkey % 3 = 0 THEN 'nuget' ELSE 'git' END AS origin, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS priority,
    'M:Order' || l_orderkey || '.Line' || l_linenumber AS declaration_id, 'Order' || l_orderkey || '.Line' || l_linenumber AS symbol,
    ['parameter', 'return', 'base', 'interface', 'constraint', 'attribute'][l_linenumber % 6 + 1] AS kind,
    CASE p_size % 5 WHEN 0 THEN 'System.' || p_type WHEN 1 THEN 'System.' || p_type || '[]' WHEN 2 THEN 'System.' || p_type || '&'
      WHEN 3 THEN 'System.Collections.Generic.IEnumerable<System.' || p_type || '>' ELSE 'System.' || p_type || 'Comparer' END AS type_expression,
    'System.' || CASE WHEN l_orderkey % 50 = 0 THEN p_type ELSE 'Order' || l_orderkey END AS owner
  FROM lineitem JOIN part ON l_partkey = p_partkey),
hits AS (
  SELECT *, CASE WHEN kind = 'parameter' THEN 'value' END AS parameter_name, type_expression = 'System.ECONOMY' AS is_exact FROM u
  WHERE regexp_matches(type_expression, '(^|[^\\p{L}\\p{Nd}_.+])System\\.ECONOMY($|[^\\p{L}\\p{Nd}_.+])') AND owner <> 'System.ECONOMY'
  QUALIFY row_number() OVER (PARTITION BY declaration_id, kind, type_expression ORDER BY priority, symbol) = 1)"""

HISTOGRAM = """n AS (
  SELECT 'package' || (user_id % 3) AS package_id, 'The accessor ''<>'' has incompatible ' || event_type || ' level ' || (event_id % 4) AS reason, count(*) AS n FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY n DESC, reason) AS rn, (sum(n) OVER (PARTITION BY package_id))::BIGINT AS total, count(*) OVER (PARTITION BY package_id) > 10 AS partial FROM n),
histogram AS (SELECT package_id, reason, n, total, partial FROM k WHERE rn <= 10)"""

BACKENDS = TYPES + """,
st AS (SELECT s_suppkey, namespace, type_name, namespace || '.' || type_name AS stored, 'T:' || namespace || '.' || type_name AS type_id FROM types),
b AS (
  SELECT 0 AS priority, 'git:app' AS revision, 'git' AS origin, stored AS full_name, * FROM st WHERE false UNION ALL
  SELECT 1, 'git:lib', 'git', stored, * FROM st WHERE s_suppkey % 4 <> 1 UNION ALL
  SELECT 2, 'nuget:Pack.Even', 'nuget', replace(stored, '`1', '<T>'), * FROM st WHERE s_suppkey % 2 = 0 UNION ALL
  SELECT 3, 'nuget:Pack.Odd', 'nuget', replace(stored, '`1', '<T>'), * FROM st WHERE s_suppkey % 2 = 1),
parts AS (
  SELECT b.*, p.*, 'Part' || (p_partkey // 10) % 10 || CASE WHEN (p_partkey // 10) % 20 >= 10 THEN '<T>' ELSE '' END AS name, ['net8.0', 'net9.0', 'net10.0', 'netstandard2.0'][p_size % 4 + 1] AS framework
  FROM b JOIN part p ON s_suppkey = p_partkey % 10 + 1
  WHERE CASE origin WHEN 'git' THEN p_partkey % 3 <> 0 ELSE p_partkey % 3 = 0 OR p_partkey % 2 = 0 END),
mm AS (
  SELECT *, 'M:' || stored || '.Part' || (p_partkey // 10) % 10 || '(' || p_partkey || ')' AS member_id, 'public ' || p_type || ' ' || name || '(' || p_brand || ' ' || p_partkey || ')' AS signature,
    origin || ' ' || p_name AS summary, 'a size of ' || p_size AS returns FROM parts)"""


def looked_up(framework: str, member: str | None) -> str:
    named = f"WHERE name = '{member}' OR name LIKE '{member}<%'" if member else ""
    return f"""{BACKENDS},
found AS (SELECT * FROM b WHERE type_name = 'Supplier7' OR starts_with(type_name, 'Supplier7`')),
held AS (SELECT mm.* FROM mm JOIN found USING (priority, type_id) WHERE mm.origin = 'git' OR framework = '{framework}'),
chosen AS (SELECT * FROM held {named}),
first AS (SELECT type_id, arg_min(full_name, priority) AS full_name, arg_min(revision, priority) AS revision FROM found {"WHERE type_id IN (SELECT type_id FROM chosen)" if member else ""} GROUP BY type_id),
merged AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY type_id, member_id ORDER BY priority) = 1),
r AS (
  SELECT f.full_name, f.revision, m.name, m.signature, m.origin AS member_origin, m.summary, m.returns,
    row_number() OVER (ORDER BY f.full_name, f.revision, f.type_id, coalesce(m.name, ''), coalesce(m.signature, ''), m.member_id)::INT AS position, count(*) OVER () AS n
  FROM first f LEFT JOIN merged m USING (type_id))"""


COMPOSED_USES = """WITH u AS (
  SELECT CASE WHEN l_partkey % 3 = 0 THEN 3 ELSE 1 END AS priority, CASE WHEN l_partkey % 3 = 0 THEN 'nuget:Pack.Odd' ELSE 'git:lib' END AS revision, 'M:Order' || l_orderkey || '.Line' || l_linenumber AS declaration_id,
    'Order' || l_orderkey || '.Line' || l_linenumber AS symbol, ['parameter', 'return', 'base', 'interface', 'constraint', 'attribute'][l_linenumber % 6 + 1] AS kind,
    CASE p_size % 5 WHEN 0 THEN 'System.' || p_type WHEN 1 THEN 'System.' || p_type || '[]' WHEN 2 THEN 'System.' || p_type || '&'
      WHEN 3 THEN 'System.Collections.Generic.IEnumerable<System.' || p_type || '>' ELSE 'System.' || p_type || 'Comparer' END AS type_expression,
    'System.' || CASE WHEN l_orderkey % 50 = 0 THEN p_type ELSE 'Order' || l_orderkey END AS owner
  FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (
  SELECT *, CASE WHEN kind = 'attribute' THEN CASE WHEN priority = 1 AND applied = 'System.ECONOMY' THEN 'System.ECONOMYAttribute' ELSE applied END END AS attribute_type,
    kind = 'attribute' AND priority = 1 AND applied = 'System.ECONOMY' AS is_sibling
  FROM (SELECT *, replace(type_expression, '[]', '') AS applied FROM u)
  WHERE owner <> 'System.ECONOMY' AND regexp_matches(type_expression, '(^|[^\\pL\\p{Nd}_.+])System\\.ECONOMY($|[^\\pL\\p{Nd}_.+])')
  QUALIFY row_number() OVER (PARTITION BY declaration_id, kind, type_expression ORDER BY priority) = 1)"""

XML = """WITH x AS (
  SELECT *, 'Corp.' || replace(r_name, ' ', '') AS namespace, replace(n_name, ' ', '_') AS type_name, n_name LIKE 'U%' AS broken
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
y AS (
  SELECT *, namespace || '.' || type_name AS full_name, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS ord, 'M:' || namespace || '.' || type_name || '.S' || s_suppkey || '(System.Int32)' AS id,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'public string S' || s_suppkey || ' (int index);' END AS signature FROM x WHERE NOT broken),
z AS (SELECT *, full_name || '.S' || s_suppkey AS symbol FROM y WHERE s_suppkey % 7 <> 0)"""

ORACLES = {
    "doc_line_search_literal": line_search("contains(line, 'the')", 50, 10),
    "doc_line_search_regex": line_search("regexp_matches(line, '(?i)\\b(th|qu)[a-z]+ (de|of|the) ')", 40, 0),
    "doc_search_with_section": section_search("e", 60, False),
    "doc_search_frontmatter_excluded": section_search("user", 60, True),
    "doc_outline": f"WITH {talks()} SELECT repo, path, level, text, start_line, end_line, section_path FROM sections",
    "doc_atomic_blocks": f"""WITH {talks(True)},
q AS (SELECT path, line_no, fences FROM f WHERE line LIKE '```%')
SELECT 'talks' AS repo, a.path, 'fence' AS kind, a.line_no AS start_line, (b.line_no + 1)::INT AS end_line FROM q a JOIN q b ON a.path = b.path AND b.fences = a.fences + 1 WHERE a.fences % 2 = 1
UNION ALL SELECT repo, path, 'front_matter', 1, 5 FROM split WHERE lines[1] = '---'""",
    "doc_pages_by_budget": f"""WITH RECURSIVE {DOCS},
c AS (SELECT repo, path, line_no, length(line) + 1 AS cost FROM lines),
w AS (
  SELECT repo, path, line_no, cost AS used, 1 AS page FROM c WHERE line_no = 1
  UNION ALL
  SELECT c.repo, c.path, c.line_no, CASE WHEN w.used + c.cost > 1000 THEN c.cost ELSE w.used + c.cost END, CASE WHEN w.used + c.cost > 1000 THEN w.page + 1 ELSE w.page END
  FROM w JOIN c ON c.repo = w.repo AND c.path = w.path AND c.line_no = w.line_no + 1)
SELECT repo, path, page, min(line_no)::INT AS start_line, (max(line_no) + 1)::INT AS end_line FROM w GROUP BY repo, path, page""",
    "doc_line_normalization": """SELECT doc_id, n::INT AS line_no, line FROM documents,
unnest(string_split(replace(text, ' ', chr(10)), chr(10))) WITH ORDINALITY AS u(line, n)""",
    "faq_render": """WITH q AS (SELECT conv_id, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || CASE WHEN trim(text) = '' THEN '' ELSE regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) END, '' ORDER BY turn) AS body
  FROM conversations GROUP BY conv_id)
SELECT 'talks' AS repo, 'talks/' || conv_id || '.yml' AS path, CASE WHEN conv_id % 11 <> 0 THEN 'A talk.' || chr(10) || chr(10) || '# Conversation ' || conv_id || chr(10) || chr(10) || body END AS text, 'FAQ' AS rendered_from,
  CASE WHEN conv_id % 11 = 0 THEN 'FAQ section ' || chr(39) || 'Conversation  ' || conv_id || chr(39) || ' has no questions' END AS skipped
FROM q WHERE conv_id % 10 <> 0""",
    "input_repair": """SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&') AS html FROM pages""",
    "api_name_search": f"""WITH {TYPES},
t AS (SELECT *, namespace || '.' || type_name AS name, string_split(lower(namespace || '.' || type_name), '.') AS seg FROM types),
r AS (SELECT *, list_filter(range(1, len(seg) + 1), lambda i: seg[i] = 'nation_1')[1] AS run FROM t),
k AS (SELECT name, CASE WHEN contains(lower(type_name), 'nation_1') THEN 'type' WHEN run IS NOT NULL AND run < len(seg) THEN 'namespace' END AS matched_on, len(seg) - 1 - run AS d FROM r)
SELECT name, matched_on, CASE WHEN matched_on = 'namespace' THEN d END::INT AS namespace_depth,
  row_number() OVER (ORDER BY CASE matched_on WHEN 'type' THEN 1 ELSE 2 END, coalesce(CASE WHEN matched_on = 'namespace' THEN d END, 0), length(name) - length(replace(name, '.', '')), name)::INT AS position
FROM k WHERE matched_on IS NOT NULL QUALIFY position <= 100""",
    "api_type_search": f"""WITH {TYPES}, t AS (SELECT namespace || '.' || type_name AS name, lower(regexp_replace(type_name, '`[0-9]+$', '')) AS simple FROM types WHERE contains(lower(type_name), 'supplier1')),
k AS (SELECT name, 'type' AS matched_on, CASE WHEN simple = 'supplier1' THEN 0 WHEN starts_with(simple, 'supplier1') THEN 1 ELSE 2 END AS tier FROM t),
r AS (SELECT name, matched_on, NULL::INT AS namespace_depth, row_number() OVER (ORDER BY tier, length(name) - length(replace(name, '.', '')), name)::INT AS position FROM k)
SELECT * FROM r WHERE position <= 20""",
    "api_text_search": """WITH p AS (
  SELECT CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS priority, 'M:' || source || '.' || d.doc_id AS declaration_id, source || '.' || (d.doc_id % 50) AS symbol,
    ['summary', 'returns', 'remarks', 'param:x', 'exception'][((n - 1) % 5 + 1)::INT] AS element, n AS ord, line AS text
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, n)),
h AS (SELECT priority, declaration_id, symbol, element, ord, left(text, 300) AS text, length(text) > 300 AS is_truncated FROM p WHERE contains(lower(text), 'tion')),
d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY declaration_id, element, trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY priority, ord) = 1),
r AS (SELECT *, CASE WHEN element = 'summary' THEN 0 WHEN element = 'returns' THEN 1 WHEN element = 'remarks' THEN 2 WHEN element LIKE 'param%' THEN 4 ELSE 5 END AS er,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{Nd}])tion($|[^\\p{L}\\p{Nd}])') THEN 0 ELSE 1 END AS wr FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY er, wr, symbol, element, text, declaration_id) AS k, count(*) OVER (PARTITION BY symbol) AS total FROM r)
SELECT symbol, declaration_id, element, text, is_truncated, CASE WHEN k = 2 AND total > 2 THEN total - 2 END AS more_from_symbol,
  row_number() OVER (ORDER BY er, wr, symbol, element, text, declaration_id)::INT AS position FROM c WHERE k <= 2 QUALIFY position <= 100""",
    "prose_normalize": """WITH p AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) || ' see ' || source || '.' || lang AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\\n[ \\t]*\\n\\s*'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM p""",
    "api_reference_hits": f"""WITH {USES},
r AS (SELECT symbol, kind, parameter_name, type_expression, is_exact, row_number() OVER (ORDER BY symbol, kind, coalesce(parameter_name, ''), type_expression)::INT AS position FROM hits WHERE kind = 'parameter')
SELECT * FROM r WHERE position <= 100""",
    "api_reference_totals": f"WITH {USES} SELECT "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("parameter", "return", "base", "interface", "constraint", "attribute"))
    + " FROM hits",
    "api_attribute_siblings": """WITH t AS (SELECT 'Corp.' || n_name || 'Attribute' AS full_name FROM nation UNION SELECT 'Corp.' || n_name FROM nation WHERE n_nationkey % 2 = 1),
a AS (SELECT 'T:Supplier' || s_suppkey AS declaration_id, CASE s_suppkey % 3 WHEN 0 THEN '[Corp.' || n_name || ']' WHEN 1 THEN '[Corp.' || n_name || '(' || s_suppkey || ')]' ELSE '[return: Corp.' || n_name || 'Attribute(typeof(int))]' END AS application,
  CASE WHEN s_suppkey % 3 = 2 THEN 'Corp.' || n_name || 'Attribute' ELSE 'Corp.' || n_name END AS applied FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT declaration_id, application, CASE WHEN x.full_name IS NOT NULL THEN x.full_name ELSE applied END AS attribute_type, CASE WHEN x.full_name IS NOT NULL THEN y.full_name END AS sibling
FROM a LEFT JOIN t x ON x.full_name = applied || 'Attribute' LEFT JOIN t y ON y.full_name = applied""",
    "api_lookup_merged": f"""WITH {MEMBERS},
w AS (SELECT * FROM members WHERE regexp_replace(type_name, '`[0-9]+$', '') IN ('Supplier7') QUALIFY row_number() OVER (PARTITION BY declaration_id ORDER BY priority, framework, signature) = 1)
SELECT full_name, name, signature, origin, declaration_id, row_number() OVER (ORDER BY full_name, name, signature, declaration_id)::INT AS position FROM w QUALIFY position <= 100""",
    "api_members_merged": f"""WITH {MEMBERS},
w AS (SELECT * FROM members WHERE origin = 'git' OR framework = 'net9.0' QUALIFY row_number() OVER (PARTITION BY declaration_id ORDER BY priority, framework, signature) = 1)
SELECT full_name, origin, count(*) AS n_members, count(DISTINCT name) AS n_names, min(signature) AS first_signature FROM w GROUP BY 1, 2""",
    "api_container_namespace": f"""WITH {TYPES},
t AS (SELECT namespace, namespace || '.' || type_name AS full_name FROM types UNION ALL SELECT namespace || '.' || type_name, namespace || '.' || type_name || '.Nested' FROM types WHERE s_suppkey % 2 = 0)
SELECT a.full_name, coalesce(arg_min(b.full_name, length(b.full_name)), any_value(a.namespace)) AS container FROM t a LEFT JOIN t b ON starts_with(a.full_name, b.full_name || '.') GROUP BY a.full_name""",
    "docs_left_join": f"""WITH {MEMBERS},
d AS (SELECT 'M:' || full_name || '.' || name || substr(declaration_id, strpos(declaration_id, '(')) AS declaration_id, max(summary) AS text FROM members WHERE origin = 'nuget' GROUP BY 1)
SELECT m.declaration_id, m.origin, coalesce(d.text, '') AS doc FROM members m LEFT JOIN d USING (declaration_id)""",
    "skip_histogram": f"WITH {HISTOGRAM} SELECT * FROM histogram",
    "skip_histogram_merged": f"WITH {HISTOGRAM} SELECT reason, sum(n)::BIGINT AS n, (SELECT bool_or(partial) FROM histogram) AS partial FROM histogram GROUP BY reason",
    "page_cursor_round_trip": f"""WITH {DOCS}, r AS (SELECT repo, path, line_no, left(line, 300) AS text, length(line) > 300 AS is_truncated,
  row_number() OVER (ORDER BY {TIER}, CASE WHEN ltrim(line) LIKE '#%' THEN 0 ELSE 1 END, path, line_no, repo)::INT AS position FROM lines WHERE contains(line, 'tion'))
SELECT * FROM r WHERE position > 20 AND position <= 40""",
    "api_lookup_nested": f"""WITH {looked_up('net9.0', None)}
SELECT full_name, revision, 'signatures' AS detail, to_json(list({{'name': name, 'signature': signature}} ORDER BY position)) AS members, any_value(n) > 10 AS is_partial
FROM r WHERE position > 5 AND position <= 10 GROUP BY full_name, revision""",
    "api_lookup_member": f"""WITH {looked_up('net8.0', 'Part4')}
SELECT full_name, revision, 'full' AS detail, name, signature, member_origin, summary, returns, position, n > 50 AS is_partial FROM r WHERE position <= 50""",
    "api_lookup_outcomes": f"""WITH {BACKENDS},
q AS (SELECT * FROM (VALUES ('Supplier7<T>', 'Supplier7<T>', NULL), ('Supplier7.Part4', 'Supplier7', 'Part4'), ('Supplier7.Part77', 'Supplier7', 'Part77'), ('Nothing.Such', 'Nothing', 'Such')) v(symbol, head, member)),
found AS (SELECT q.symbol, q.member, b.* FROM q JOIN b ON CASE b.origin WHEN 'git' THEN type_name = head OR starts_with(type_name, head || '`') ELSE head IN (type_name, replace(type_name, '`1', ''), replace(type_name, '`1', '<T>')) END),
hit AS (SELECT f.symbol FROM found f WHERE member IS NULL UNION SELECT f.symbol FROM found f JOIN mm USING (priority, type_id) WHERE (mm.origin = 'git' OR framework = 'net8.0') AND (name = member OR name LIKE member || '<%'))
SELECT q.symbol, CASE WHEN q.symbol IN (SELECT symbol FROM hit) THEN 'found' WHEN count(f.type_id) > 0 THEN 'member_not_found' ELSE 'not_found' END AS outcome,
  coalesce(array_to_string(list_sort(list(DISTINCT f.full_name) FILTER (f.full_name IS NOT NULL)), ' '), '') AS resolved_types
FROM q LEFT JOIN found f USING (symbol) GROUP BY q.symbol""",
    "api_search_composed": f"""WITH {BACKENDS},
f AS (SELECT stored AS name, 'type' AS matched_on, NULL::INT AS namespace_depth, revision, lower(replace(type_name, '`1', '')) AS simple FROM b WHERE contains(lower(type_name), 'supplier')
  QUALIFY row_number() OVER (PARTITION BY stored ORDER BY priority) = 1),
r AS (SELECT name, matched_on, namespace_depth, revision, count(*) OVER () > 8 AS is_partial,
  row_number() OVER (ORDER BY CASE WHEN simple = 'supplier' THEN 0 ELSE 1 END, length(name) - length(replace(name, '.', '')), name, revision)::INT AS position FROM f)
SELECT * FROM r WHERE position > 4 AND position <= 8""",
    "api_text_composed": """WITH p AS (
  SELECT CASE WHEN l.doc_id IS NULL THEN 0 ELSE 3 END AS priority, CASE WHEN l.doc_id IS NULL THEN 'git:app' ELSE 'nuget:Pack.Odd' END AS revision, 'M:' || source || '.' || d.doc_id AS declaration_id,
    source || '.' || d.doc_id % 50 AS symbol, ['summary', 'returns', 'remarks', 'param:x', 'exception'][((n - 1) % 5)::INT + 1] AS element, n - 1 AS ord, line
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)),
f AS (
  SELECT *, left(line, 300) AS text, length(line) > 300 AS is_truncated FROM p WHERE (priority = 3 OR ord % 2 = 1) AND contains(lower(line), 'tion')
  QUALIFY row_number() OVER (PARTITION BY declaration_id, element, trim(regexp_replace(left(line, 300), '\\s+', ' ', 'g')) ORDER BY priority, ord) = 1),
o AS (
  SELECT *, CASE element WHEN 'summary' THEN 0 WHEN 'returns' THEN 1 WHEN 'remarks' THEN 2 WHEN 'exception' THEN 5 ELSE 4 END AS er,
    CASE WHEN regexp_matches(text, '(?i)(^|[^\\pL\\p{Nd}])tion($|[^\\pL\\p{Nd}])') THEN 0 ELSE 1 END AS wr FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY er, wr, symbol, element, text, declaration_id) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM o QUALIFY k <= 2),
r AS (SELECT symbol, element, text, is_truncated, CASE WHEN k = 2 AND n > 2 THEN n - 2 END AS more_from_symbol, revision, count(*) OVER () > 40 AS is_partial,
  row_number() OVER (ORDER BY er, wr, symbol, element, text, revision, declaration_id)::INT AS position FROM c)
SELECT * FROM r WHERE position <= 40""",
    "api_references_composed": f"""{COMPOSED_USES},
r AS (SELECT symbol, kind, type_expression, attribute_type, attribute_type = 'System.ECONOMY' AS is_exact, revision, count(*) OVER () > 60 AS is_partial,
  row_number() OVER (ORDER BY symbol, kind, type_expression, revision, declaration_id)::INT AS position FROM f WHERE kind = 'attribute' AND NOT is_sibling)
SELECT * FROM r WHERE position <= 60""",
    "api_references_summary": f"""{COMPOSED_USES}
SELECT {', '.join(f"count(*) FILTER (kind = '{k}' AND NOT is_sibling) AS n_{k}" for k in ('parameter', 'return', 'base', 'interface', 'constraint', 'attribute'))},
  count(*) FILTER (is_sibling) AS sibling_applications, 'System.ECONOMYAttribute' AS sibling_type FROM f""",
    "api_skipped_composed": f"WITH {HISTOGRAM}, h AS (SELECT * FROM histogram WHERE package_id IN ('package0', 'package2')) SELECT reason, sum(n)::BIGINT AS n, (SELECT bool_or(partial) FROM h) AS partial FROM h GROUP BY reason",
    "source_xml_members": f"""{XML}
SELECT 'T:' || full_name AS type_id, id AS declaration_id, 'S' || s_suppkey AS name, 'Method' AS kind, signature, ord::INT AS ord, to_json([{{'name': 'index', 'description': 'Balance ' || s_acctbal}}]) AS parameters,
  'Supplier ' || full_name || ' at index.' AS summary, NULL::VARCHAR AS returns, NULL::VARCHAR AS remarks, namespace, type_name, full_name FROM z WHERE signature IS NOT NULL""",
    "source_xml_uses": f"""{XML}
SELECT id AS declaration_id, symbol, kind, parameter_name, type_expression, full_name AS owner, signature FROM z, (VALUES ('parameter', 'index', 'System.Int32'), ('return', NULL, 'System.String')) v(kind, parameter_name, type_expression)
UNION ALL SELECT id, symbol, 'attribute', NULL, '[Corp.Marked(' || s_suppkey || ')]', full_name, signature FROM z
UNION ALL SELECT DISTINCT 'T:' || full_name, full_name, 'base', NULL, 'System.Object', full_name, NULL FROM y""",
    "source_xml_prose": f"""{XML}
SELECT id AS declaration_id, symbol, 'summary' AS element, 'Supplier ' || full_name || ' at index.' AS text, 0 AS ord FROM z
UNION ALL SELECT id, symbol, 'param:index', 'Balance ' || s_acctbal, 1 FROM z
UNION ALL SELECT DISTINCT 'T:' || full_name, full_name, 'summary', 'Of ' || n_name || ' & others.', 0 FROM y""",
    "source_xml_skipped": f"""{XML}
SELECT namespace || '/' || type_name || '.xml' AS path, count(*) AS n FROM y WHERE s_suppkey % 7 = 0 GROUP BY ALL UNION ALL SELECT DISTINCT namespace || '/' || type_name || '.xml', 1 FROM x WHERE broken""",
    "source_assembly_members": """WITH s AS (SELECT *, 'Supplier' || s_suppkey AS name FROM supplier), g AS (SELECT * FROM s WHERE s_suppkey % 7 <> 0)
SELECT name || '.dll' AS path, 'T:Corp.' || name || '`1' AS type_id, 'Corp.' || name || '<T>' AS full_name, 'M:Corp.' || name || '`1.Run' || s_nationkey || '``1(System.Int32,Corp.' || name || '{``0})' AS declaration_id,
  'Run' || s_nationkey AS name, 'method' AS kind, 'public virtual string[] Run' || s_nationkey || '<K>(int index, Corp.' || name || '<K> other);' AS signature, 'string[]' AS return_type, false AS is_skipped, false AS is_refused FROM g WHERE s_suppkey % 3 <> 0
UNION ALL SELECT name || '.dll', 'T:Corp.' || name || '`1', 'Corp.' || name || '<T>', 'F:Corp.' || name || '`1.Nation', 'Nation', 'field', 'public const int Nation;', 'int', false, false FROM g
UNION ALL SELECT name || '.dll', NULL, 'Corp.' || name || '`1', NULL, 'Skewed', 'field', NULL, NULL, true, false FROM g
UNION ALL SELECT name || '.dll', NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, true FROM s WHERE s_suppkey % 7 = 0""",
    "source_package_docs": """
SELECT 'region' || r_regionkey || '.nupkg|' || f AS path, 'M:Corp.' || replace(n_name, ' ', '_') || '.Run' AS id, 'Runs ' || n_nationkey AS summary, 1 AS n_parameters, false AS refused
FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('net8.0'), ('netstandard2.0')) v(f) WHERE r_regionkey % 3 <> 2
UNION ALL SELECT 'region' || r_regionkey || '.nupkg', NULL, NULL, 0, true FROM region WHERE r_regionkey % 3 = 2""",
    "doc_pages_atomic": f"""WITH RECURSIVE {talks(True)},
c AS (SELECT path, line_no, body_start, n_lines, line, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no) AS cost FROM l),
k AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS i FROM c WHERE line LIKE '```%'),
blocks AS (SELECT a.path, a.line_no AS a, b.line_no + 1 AS b FROM k a JOIN k b ON a.path = b.path AND b.i = a.i + 1 WHERE a.i % 2 = 1 UNION ALL SELECT DISTINCT path, 1, body_start FROM c WHERE body_start > 1),
p AS (
  SELECT DISTINCT path, 1 AS page, body_start AS start_line, n_lines FROM c
  UNION ALL
  SELECT path, page + 1, end_line, n_lines FROM (
    SELECT p.path, p.page, p.n_lines, (SELECT coalesce(max(b.b), e.e) FROM blocks b WHERE b.path = p.path AND b.a < e.e AND e.e < b.b AND b.b <= p.n_lines + 1) AS end_line
    FROM p, LATERAL (SELECT greatest(p.start_line + 1, (SELECT count(*) FROM c WHERE c.path = p.path AND c.cost <= 400 + coalesce((SELECT d.cost FROM c d WHERE d.path = p.path AND d.line_no = p.start_line - 1), 0)) + 1) AS e) e)
  WHERE end_line <= n_lines)
SELECT 'talks' AS repo, path, page::INT AS page, start_line::INT AS start_line, coalesce(lead(start_line) OVER (PARTITION BY path ORDER BY page), n_lines + 1)::INT AS end_line FROM p""",
}

_PAGES = ORACLES["doc_pages_atomic"]
ORACLES["doc_slice"] = f"WITH g AS ({_PAGES}), {talks(True)} SELECT l.path, l.line_no, l.line FROM l JOIN g ON g.path = l.path WHERE g.page = 2 AND l.line_no >= g.start_line AND l.line_no < g.end_line"
ORACLES["doc_search_stored"] = line_search("contains(line, 'tionle')", 50, 0)
ORACLES["doc_pattern_search_stored"] = line_search("regexp_matches(line, '[Tt]ion[a-z]*\\.')", 50, 0)
ORACLES["search_filters_keep_all"] = "SELECT needle, count(doc_id) AS n, count(doc_id) AS n_read FROM unnest(['tion', 'tionle', 'ouè', 'benchmark', 'zzzz', 'e, l']) v(needle) LEFT JOIN documents ON contains(text, needle) GROUP BY needle"
ORACLES["api_references_canonical"] = f"""WITH {USES.replace("hits AS (", "old AS (")},
c AS (
  SELECT *, CASE WHEN kind = 'parameter' THEN 'value' END AS parameter_name, 'System.' || regexp_extract(type_expression, 'System\\.([A-Z]{{2,}})', 1) AS first FROM u WHERE owner <> 'System.ECONOMY'),
found AS (
  SELECT * FROM c WHERE CASE origin WHEN 'nuget' THEN first = 'System.ECONOMY' AND type_expression NOT LIKE '%Comparer' ELSE regexp_matches(type_expression, '(^|[^\\p{{L}}\\p{{Nd}}_.+])System\\.ECONOMY($|[^\\p{{L}}\\p{{Nd}}_.+])') END
  QUALIFY row_number() OVER (PARTITION BY declaration_id, kind, type_expression ORDER BY priority, symbol) = 1),
r AS (
  SELECT origin, symbol, kind, parameter_name, type_expression, false AS is_exact, row_number() OVER (ORDER BY symbol, kind, coalesce(parameter_name, ''), type_expression)::INT AS position
  FROM found WHERE type_expression <> 'System.ECONOMY' AND NOT (origin = 'git' AND kind = 'attribute' AND type_expression = 'System.ECONOMY[]'))
SELECT * FROM r WHERE position <= 100"""
