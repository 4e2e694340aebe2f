"""SQL counterparts of queries whose operators other modules register."""

from __future__ import annotations

from quarrylight.functions import paths, text
from quarrylight.plans.analytics import _CATEGORY, _P, _has, _layer_sql, _list
from quarrylight.plans.answers import _BACKWARD
from quarrylight.plans.graphs import _DEG, E_SQL
from quarrylight.operators import scoring


def _low(column: str) -> str:
    return f"lower(replace({column}, '\\', '/'))"


def _tokens(column: str) -> str:
    """The token set of a text."""
    found = f"list_distinct(regexp_extract_all(lower({column}), '[a-z_][a-z0-9_]*'))"
    return f"list_filter({found}, lambda w: len(w) > 1 and not list_contains({_list(text.STOP_WORDS)}, w))"


def _components(column: str) -> str:
    tags = ", ".join(f"case when regexp_matches(lower({column}), '{r}') then '{k}' end" for k, r in paths.COMPONENTS.items())
    return f"list_sort(list_filter([{tags}], lambda x: x is not null))"


_PATTERN_CASES = []
for _name, _in_path, _in_text in paths.PATTERNS:
    _hits = ([_has("p", _in_path)] if _in_path else []) + ([_has("t", _in_text)] if _in_text else [])
    _PATTERN_CASES.append(f"case when {' or '.join(_hits)} then '{_name}' end")
_CLEAN = "contains(p, 'domain') and contains(p, 'infrastructure')"
_PATTERN_CASES += [f"case when {_CLEAN} then 'Clean Architecture' end", f"case when {_CLEAN} then 'Hexagonal' end"]

_RULES = f"""lay as (select g, src, dst, {_layer_sql(_low('src'))} as a, {_layer_sql(_low('dst'))} as b, lower(dst) as t from e)"""
_SCORES = """x as (select c.*, max(fan_in) over (partition by c.g) as top, so.start is not null as entry from cen c left join so on so.g = c.g and so.start = c.node),
sc as (select g, node, entry, case when entry then 100.0 else 0.0 end + 50 * centrality + case when top > 0 then 30 * fan_in / top else 0.0 end
 + case when regexp_matches(node, '(^|[/:])(core|src|lib|app|services?|domain)/') then 15.0 else 0.0 end - case when regexp_matches(node, '(^|[/:])(tests?|docs?|examples?|scripts|benchmarks)/') then 40.0 else 0.0 end as score from x)"""
_FOLD = "case when regexp_matches(node, '(^|[/:])tests?/') then 'tests/' when regexp_matches(node, '(^|[/:])docs?/') then 'docs/' when regexp_matches(node, '(^|[/:])examples?/') then 'examples/' else node end"
_UNITS = f"u as (select distinct repository_id as g, path, size_bytes from ria_file_unit), {_P}, k as (select path, {_CATEGORY} as category from x)"
_LINES = "len(body) - len(replace(body, chr(10), ''))"
_CYCLES = " + ".join(f"trunc((len(content) - len(replace(content, '{w}', ''))) / {len(w)})::int" for w in scoring.DECISIONS)

ORACLES = {
    "p03_patterns": f"""with b as (select distinct s.repository_id, s.content_hash, u.path, {_low('u.path')} as p, lower(s.content) as t from source_files s
      join (select distinct repository_id, content_hash, path from ria_file_unit where path is not null) u using (repository_id, content_hash) where s.content is not null),
      c as (select repository_id, content_hash, list_filter([{', '.join(_PATTERN_CASES)}], lambda x: x is not null) as found from b)
      select pattern, count(*) as bodies from (select unnest(case when len(found) > 0 then found else ['Facade'] end) as pattern from c) group by 1""",
    "v05_overlap": f"""with q as (select {_tokens("'which files does the frozen scanner of the token index change'")} as q)
      select doc_id, round(len(list_intersect(q, {_tokens('text')})) / len(q), 6) as overlap from documents, q where text is not null""",
    "w16_keyword_files": "with f as (select distinct path, translate(lower(path), '_.', '--') as p, replace(regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\\.[^.]*$', ''), '_', '-') as base from ria_file_unit where path is not null), s as (select path, "
    + " + ".join(f"case when contains(p, '{w}') then {len(w)} when len(base) >= 4 and contains('{w}', base) then len(base) else 0 end + case when contains(lower(path), '{w}') then {len(w) // 2} else 0 end" for w in ("scanner", "token", "frozen"))
    + " as score from f) select path, score from s where score > 0 order by score desc, path limit 10",
    "p19_layer_rules": f"""with {E_SQL}, {_RULES}, r as (select g, src, dst, 'ARCH-001' as rule, 'CRITICAL' as severity from lay where a = 'Domain' and b in ('Presentation', 'Infrastructure')
      union all select g, src, dst, 'ARCH-002', 'MAJOR' from lay where a = 'Presentation' and (b in ('Data', 'Infrastructure') or contains(t, 'db') or contains(t, 'repository'))
      union all select g, src, dst, 'ARCH-003', 'CRITICAL' from lay where a = 'Infrastructure' and b = 'Presentation') select * from r""",
    "j30_boundaries": f"""with {E_SQL}, c as (select g, {_components('src')}[1] as src_component, {_components('dst')}[1] as dst_component from e)
      select g, src_component, dst_component, count(*) as edges from c where src_component <> dst_component group by all""",
    "w03_reading_tiers": f"""with {E_SQL}, {_DEG}, {_SCORES} select g, node, score, row_number() over (partition by g order by score desc, node) as rank,
      case when entry then 'entry' when score > 20 then 'core' when contains(lower(node), 'service') then 'service' when contains(lower(node), 'util') or contains(lower(node), 'helper') then 'utility' else 'other' end as tier from sc""",
    "w11_graph_sample": f"""with {E_SQL}, {_DEG}, f as (select g, {_FOLD} as node, max(centrality) as centrality, sum(fan_in + fan_out)::bigint as degree from cen group by all)
      select * from (select *, row_number() over (partition by g order by centrality desc, degree desc, node) as rank from f) where rank <= 50""",
    "g13_caller_closure": f"""{_BACKWARD}, h as (select p.* from p join si on si.g = p.g and si.start = p.start where p.depth > 0),
      l as (select *, list_transform(path, lambda n: {_layer_sql(_low('n'))}) as ls from h)
      select g, start, node, depth, array_to_string(path, ' > ') as path, case depth when 1 then 'HIGH' else 'MEDIUM' end as tier,
      len(list_filter(range(1, len(ls)), lambda i: ls[i] <> ls[i + 1]))::int as transitions, len(path) - 1 as distance from l""",
    "g26_architecture_findings": f"""with {E_SQL}, {_DEG}, {_RULES} select g, 'violation' as finding, src || ' -> ' || dst as subject from lay where a = 'Infrastructure' and b = 'Application'
      union all select g, 'orphan', node from deg where fan_in = 0 union all select g, 'hotspot', node from deg where fan_in + fan_out > 10""",
    "r18_recommendations": f"""with {_UNITS}, fi as (select g, 'performance' as category, 10.0 as base, path as subject from u where size_bytes > 100000
      union select g, 'documentation', 20.0, 'README' from u group by g having count(*) filter (starts_with(lower(regexp_extract(path, '[^/]*$')), 'readme')) = 0
      union select g, 'testing', case when count(distinct u.path) filter (category = 'test') = 0 then 40.0 else 20.0 end, count(distinct u.path) filter (category = 'test') || ' test files' from u left join k using (path) group by g having count(distinct u.path) filter (category = 'test') < 3),
      a as (select g, category, count(*) as n, count(distinct subject) as en, max(base) as base from fi group by all),
      b as (select *, round((base + 5.0 + least(5 * (n - 1), 25) + least(2 * en, 20)) * 0.9, 2) as score from a),
      c as (select *, case when score >= 100 then 'critical' when score >= 60 then 'high' when score >= 30 then 'medium' else 'low' end as label from b),
      e2 as (select g, category, n, score::double as score, label, round((case category when 'testing' then 6.0 else 2.0 end) * (1 + 0.1 * least(en, 20)), 2)::double as hours, case when label = 'critical' then 1 when category = 'testing' then 3 else 4 end as phase from c)
      select *, row_number() over (partition by g order by phase, score desc, category) as step from e2""",
    "a12_module_metrics": rf"""with b as (select repository_id || '@' || content_hash as path, content, regexp_replace(content, '\r\n|\r', chr(10), 'g') as body from source_files where content is not null),
      m as (select path, greatest(1, {_LINES} + case when ends_with(body, chr(10)) or body = '' then 0 else 1 end) as lines, 1 + {_CYCLES} as complexity,
        len(regexp_extract_all(content, '\b(class|interface|struct|enum)\s+\w+')) as classes, len(regexp_extract_all(content, '\b(ABC|abstractclass|interface|abstract)\b')) as abs_, len(regexp_extract_all(content, '(?m)^[ \t]*(#|//|/\*|\*)')) as comments from b)
      select path, lines, complexity, classes, 0.0::double as instability, case when classes > 0 then round(abs_ / classes, 3) else 0.0 end::double as abstractness,
        round(abs(case when classes > 0 then round(abs_ / classes, 3) else 0.0 end - 1.0), 3)::double as distance,
        greatest(0.0, least(100.0, round((171 - 5.2 * ln(greatest(lines * 5.0, 1.0)) - 0.23 * complexity - 16.2 * ln(lines)) * 100 / 171, 1)))::double as maintainability, round(comments / lines * 100, 1)::double as comment_density from m""",
    "v22_greedy_budget": """with recursive i as (select o_custkey as grp, o_orderkey as id, round(o_totalprice / 1000)::bigint as tokens, substr(o_orderpriority, 1, 1)::int as priority from orders),
      r as (select *, row_number() over (partition by grp order by priority, id::varchar, tokens) as n from i),
      f as (select grp, n, case when tokens <= 500 or priority = 1 then tokens else 0 end as used, tokens <= 500 or priority = 1 as chosen, id from r where n = 1
        union all select r.grp, r.n, case when f.used + r.tokens <= 500 or (f.used = 0 and r.priority = 1) then f.used + r.tokens else f.used end, f.used + r.tokens <= 500 or (f.used = 0 and r.priority = 1), r.id from f join r on r.grp = f.grp and r.n = f.n + 1)
      select grp, id::varchar as id from f where chosen""",
    "v26_citations": r"""with a as (select doc_id as answer_id, regexp_replace(text, '(?:Line|Zeile|ligne|línea) ([0-9]+) (?:of|in|de) ([A-Za-z0-9_./-]+)', '\2:\1', 'g') as text from documents where text is not null),
      c as (select answer_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_./-]+\.[A-Za-z0-9_]+:[0-9]+(?:-[0-9]+)?'))) as c from a),
      p as (select answer_id, regexp_extract(c, '^(.*):([0-9]+)', 1) as path, regexp_extract(c, ':([0-9]+)', 1)::int as first, case when regexp_matches(c, '-[0-9]+$') then regexp_extract(c, '-([0-9]+)$', 1)::int end as l from c),
      k as (select path, max(line_count) as lines from ria_file_unit group by 1)
      select answer_id, path, first, coalesce(l, first) as last, coalesce(first >= 1 and first <= coalesce(l, first) and coalesce(l, first) <= lines, false) as valid from p left join k using (path)""",
    "v01_hashed_vectors": "select doc_id as id, 64 as dims from documents where text is not null",
}
ORACLES["a21_efforts"] = f"""with r as ({ORACLES['r18_recommendations']}), h as (select g, count(*) as items, round(sum(hours), 2) as hours from r group by 1)
  select *, case when hours < 2 then 'under 2 hours' when hours < 8 then 'half a day' when hours < 24 then '1-3 days' when hours < 80 then '1-2 weeks' else 'over 2 weeks' end as label from h"""
ORACLES["v19_novelty"] = f"""with t as (select task_id, change_description as a, lag(change_description) over (partition by repository order by task_id) as b from impact_tasks),
  k as (select task_id, {_tokens('a')} as a, {_tokens('b')} as b from t where b is not null),
  j as (select task_id, len(list_intersect(a, b)) as i, len(list_distinct(list_concat(a, b))) as u from k)
  select task_id, case when u > 0 and i / u > 0.65 then -80 else 60 end as novelty from j"""
