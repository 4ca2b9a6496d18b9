"""DuckDB SQL of the queries in problems.py, written independently of the operators."""

from __future__ import annotations

_KEY = "nullif(nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '\\.json$', ''), '^.*/', '')), ''), 'null')"


def key(column: str) -> str:
    return _KEY.format(column)


_CHAIN = f"""
with recursive latest as (
  select id, superseded_by from (select *, row_number() over (partition by id order by generated_at desc nulls last, arrived_at desc nulls last) rn from mechanism_instances where id is not null) where rn = 1
), named as (select {key('id')} k, min(id) id, min(struct_pack(a := id, p := {key('superseded_by')})).p p from latest group by 1),
node as (select n.k, n.id, m.k p from named n left join named m on n.p = m.k),
walk(start, cur, seen, steps) as (
  select k, p, [k], 1 from node where p is not null
  union all
  select w.start, n.p, list_append(w.seen, w.cur), w.steps + 1 from walk w join node n on n.k = w.cur where n.p is not null and not list_contains(w.seen, w.cur)
), last as (select start, arg_max(cur, steps) cur, arg_max(seen, steps) seen, max(steps) steps from walk group by start)
"""

P1_FOUND = _CHAIN + """
select s.id, case when list_contains(l.seen, l.cur) then (select min(m.id) from node m where list_contains(l.seen[list_position(l.seen, l.cur):], m.k)) else r.id end root_id,
  cast(case when list_contains(l.seen, l.cur) then -1 else l.steps end as bigint) depth
from last l join node s on s.k = l.start join node r on r.k = l.cur
"""

P1_PATHS = _CHAIN + """
, closed as (select start, cur, seen, steps, list_contains(seen, cur) looped from last)
select s.id, case when c.start is null then s.id when looped then (select min(m.id) from node m where list_contains(c.seen[list_position(c.seen, c.cur):], m.k)) else r.id end root_id,
  cast(case when c.start is null then 0 when looped then -1 else c.steps end as bigint) depth,
  case when c.start is null then s.id when looped then null else (select string_agg(m.id, ' > ' order by u.i) from (select unnest(list_append(c.seen, c.cur)) k, generate_subscripts(list_append(c.seen, c.cur), 1) i) u join node m on m.k = u.k) end path
from node s left join closed c on c.start = s.k left join node r on r.k = c.cur
"""

P1_DESCENDANTS = _CHAIN + """
, whole as (select start, unnest(list_append(seen, cur)) k, generate_subscripts(list_append(seen, cur), 1) - 1 i, list_contains(seen, cur) looped from last)
select a.id ancestor_id, s.id, cast(w.i as bigint) distance from whole w join node a on a.k = w.k join node s on s.k = w.start where not looped and w.i > 0
"""

_CELLS = r"""
with raw as (select distinct * from metrics), long as (
  select feed, load_no, 'solve_rate' column_name, cast(solve_rate as varchar) v, solve_rate x, false bad_pattern from raw
  union all select feed, load_no, 'regulations_confirmed', cast(regulations_confirmed as varchar), cast(regulations_confirmed as double), false from raw
  union all select feed, load_no, 'atom_count', nullif(trim(atom_count), ''), case when regexp_full_match(trim(atom_count), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(atom_count) as double) end, coalesce(trim(atom_count) <> '' and not regexp_full_match(atom_count, '[+-]?[0-9]+'), false) from raw
), judged as (select *, coalesce(isnan(x) or x < 0 or (column_name = 'solve_rate' and x > 1), false) bad_range from long),
ok as (select *, v is not null and not bad_pattern and not bad_range good from judged)
"""

P2_FOUND = _CELLS + """
, s as (select feed, load_no, column_name, count(*) n, count(*) - count(v) nulls, count(*) filter (good) valid, count(distinct x) filter (good) d, max(bad_pattern) bp, max(bad_range) br from ok group by all),
c as (select a.*, b.n n0, b.nulls nulls0, b.valid valid0, b.d d0 from s a left join s b on a.feed = b.feed and a.column_name = b.column_name and b.load_no = a.load_no - 1),
pts as (select c.feed, c.load_no, c.column_name, o.x from c join ok o on o.feed = c.feed and o.column_name = c.column_name and o.load_no in (c.load_no, c.load_no - 1) where good and c.valid >= 20 and c.valid0 >= 20 group by all),
gap as (select p.feed, p.load_no, p.column_name, p.x, count(*) filter (o.load_no = p.load_no and o.x <= p.x) le, count(*) filter (o.load_no = p.load_no - 1 and o.x <= p.x) le0 from pts p join ok o on o.feed = p.feed and o.column_name = p.column_name and o.load_no in (p.load_no, p.load_no - 1) where o.good group by all),
shift as (select distinct g.feed, g.load_no, g.column_name from gap g join c using (feed, load_no, column_name) where abs(g.le * c.valid0 - g.le0 * c.valid) >= 0.35 * c.valid * c.valid0 - 1e-6)
select feed, cast(load_no as bigint) load_no, column_name, 'pattern' issue from c where bp
union all select feed, load_no, column_name, 'range' from c where br
union all select feed, load_no, column_name, 'null_rate' from c where abs(nulls / n - nulls0 / n0) >= 0.2 - 1e-12
union all select feed, load_no, column_name, 'distinct' from c where n0 is not null and (case when valid > 0 then d / valid else 0 end) < 0.5 * (case when valid0 > 0 then d0 / valid0 else 0 end) - 1e-12
union all select feed, load_no, column_name, 'shift' from shift
"""

P2_PROFILE = _CELLS + """
, h as (select feed, load_no, column_name, x, count(*) n from ok where good group by all),
e as (select feed, load_no, column_name, greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) entropy, count(*) d, min(x) low, max(x) high, sum(x * n) total from h group by all)
select o.feed, cast(o.load_no as bigint) load_no, o.column_name, count(*) row_count, count(*) - count(v) nulls, count(*) filter (good) valid, coalesce(max(e.d), 0) distinct_valid,
  count(*) filter (bad_pattern) pattern_violations, count(*) filter (bad_range) range_violations, max(e.low) low, max(e.high) high, round(max(e.total), 6) total, round(max(e.entropy), 6) entropy
from ok o left join e on e.feed = o.feed and e.load_no = o.load_no and e.column_name = o.column_name group by o.feed, o.load_no, o.column_name
"""

_P3 = r"""
with f as (select observation_id, unnest(facts) f from observations where observation_id is not null), t as (
  select observation_id, lower(trim(f.pred)) pred, trim(f.value) v from f where f.pred is not null and f.value is not null and trim(f.value) <> 'null'
), typed as (
  select t.*, coalesce(p.value_type, 'text') kind, json_type(v) jt, trim(case when json_type(v) = 'VARCHAR' then cast(v as json) ->> '$' else v end) s
  from t left join (select lower(trim(pred)) pred, min(value_type) value_type from predicates group by 1) p on p.pred = t.pred
), fit as (
  select observation_id, pred, case kind
    when 'number' then case when jt <> 'BOOLEAN' and regexp_full_match(s, '[+-]?(([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then cast(cast(replace(s, ',', '') as double) as varchar) end
    when 'boolean' then case when jt in ('BIGINT', 'UBIGINT', 'DOUBLE') then case cast(v as double) when 1 then 'true' when 0 then 'false' end
      when lower(s) in ('true', 'yes', 'on', 't', 'y', '1') then 'true' when lower(s) in ('false', 'no', 'off', 'f', 'n', '0') then 'false' end
    else s end c from typed
)
"""

P3_FOUND = _P3 + """
select observation_id, pred, 'untyped' issue from fit where c is null group by all
union all select observation_id, pred, 'conflict' from fit group by all having count(distinct c) > 1
"""

P3_CELLS = _P3 + """
, filled as (select f.observation_id, f.pred, max(f.c) c, any_value(t.kind) kind from fit f join (select distinct pred, kind from typed) t using (pred) group by 1, 2 having count(distinct f.c) = 1)
select observation_id, pred, case when kind = 'number' then cast(cast(c as double) as varchar) else c end "value" from filled
"""

_LINKS = (("prediction_errors", "outcome_record_id", "outcome_records"), ("prediction_errors", "caused_by_action_execution_id", "action_executions"), ("action_executions", "based_on_experiment_design_id", "experiment_designs"), ("mechanism_instances", "episode_id", "stories"))


def _orphan_part(table: str, field: str, target: str) -> str:
    return f"""
select distinct '{table}' record_table, c.id record_id, '{field}' field, case when p.k is null then 'missing' when p.deleted_at <= c.arr then 'deleted' when p.arr > c.arr then 'late' end reason, strftime(c.arr at time zone 'UTC', '%Y-%m') period
from (select id, min(arrived_at) over (partition by id) arr, {key(field)} k from {table} where id is not null) c
left join (select {key('id')} k, min(arrived_at) arr, min(deleted_at) deleted_at from {target} group by 1) p on p.k = c.k
where c.k is not null"""


P5_FOUND = "select * from (" + " union all ".join(_orphan_part(*x) for x in _LINKS) + ") where reason is not null"
P5_BY_PERIOD = f"select record_table, field, period, reason, count(*) orphans from ({P5_FOUND}) group by all"

P7_FOUND = r"""
with recursive latest as (
  select regulation_id, data from (select *, row_number() over (partition by regulation_id order by updated_at desc nulls last, arrived_at desc nulls last, data desc) rn from regulations where regulation_id is not null) where rn = 1 and json_valid(data)
), pat as (
  select regulation_id, case when json_type(json_extract(data, '$.pattern')) = 'VARCHAR' then case when json_valid(json_extract_string(data, '$.pattern')) then json_extract_string(data, '$.pattern') end else cast(json_extract(data, '$.pattern') as varchar) end p from latest
), pre as (
  select regulation_id, case when json_type(json_extract(p, '$.pre')) = 'VARCHAR' then case when json_valid(json_extract_string(p, '$.pre')) then json_extract_string(p, '$.pre') end else cast(json_extract(p, '$.pre') as varchar) end x from pat where p is not null
), tree as (
  select regulation_id, t.id, json_extract_string(t.value, '$.pred') pred from pre, json_tree(pre.x) t where x is not null and t.type = 'OBJECT' and json_type(json_extract(t.value, '$.pred')) = 'VARCHAR'
)
select distinct 'observations' record_table, observation_id record_id, 'facts' path, cast(i - 1 as bigint) ord, f.pred leaf from (select observation_id, unnest(facts) f, generate_subscripts(facts, 1) i from observations) where f is not null and observation_id is not null
union all select distinct 'observations', observation_id, 'context.env.os', 0, coalesce(context.env.os, context.extra['env.os']) from observations where coalesce(context.env.os, context.extra['env.os']) is not null and observation_id is not null
union all select 'regulations', regulation_id, 'pattern.pre', row_number() over (partition by regulation_id order by id) - 1, pred from tree
"""


# members of the files with the canonical path of each, by a walk through the parsed bodies
_MEMBERS = r"""
with recursive names as (select artifact_kind, s, min(f) f from (select artifact_kind, regexp_replace(lower(accepted_name), '[^a-z0-9]', '', 'g') s, canonical_field f from contract_fields union all select artifact_kind, regexp_replace(lower(canonical_field), '[^a-z0-9]', '', 'g'), canonical_field from contract_fields) group by 1, 2),
files as (select distinct export_line, artifact_kind, cast(batch_no as bigint) batch_no, body from raw_artifacts where export_line is not null and artifact_kind is not null and batch_no is not null),
tree as (select f.export_line, f.artifact_kind, f.batch_no, f.body, t.id, t.parent, t.key k, t.type ty, t.value from files f, json_tree(f.body) t where json_valid(f.body)),
member as (
  select t.export_line, t.artifact_kind, t.batch_no, t.body, t.id, t.parent, t.ty, p.ty pty, case when p.ty = 'OBJECT' then t.k end k from tree t left join tree p on p.body = t.body and p.export_line = t.export_line and p.artifact_kind = t.artifact_kind and p.batch_no = t.batch_no and p.id = t.parent
),
path as (
  select export_line, artifact_kind, batch_no, body, id, cast('' as varchar) path, cast(null as varchar) k, ty from member where parent is null
  union all
  select m.export_line, m.artifact_kind, m.batch_no, m.body, m.id, case when m.k is null then p.path else case when p.path = '' then '' else p.path || '.' end || coalesce(n.f, regexp_replace(lower(m.k), '[^a-z0-9]', '', 'g')) end, m.k, m.ty
  from path p join member m on m.body = p.body and m.export_line = p.export_line and m.artifact_kind = p.artifact_kind and m.batch_no = p.batch_no and m.parent = p.id
    left join names n on n.artifact_kind = m.artifact_kind and n.s = regexp_replace(lower(m.k), '[^a-z0-9]', '', 'g')
),
trait as (select distinct export_line, artifact_kind, batch_no, path field, k, case ty when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end ty from path where k is not null),
batch as (select distinct export_line, artifact_kind, batch_no from files),
field as (select export_line, artifact_kind, batch_no, field, list_sort(list(distinct k)) ks, coalesce(list_sort(list(distinct ty) filter (ty is not null)), []) ts from trait group by 1, 2, 3, 4),
pair as (select b.export_line, b.artifact_kind, b.batch_no from batch b join batch a on a.export_line = b.export_line and a.artifact_kind = b.artifact_kind and a.batch_no = b.batch_no - 1),
step as (
  select p.*, coalesce(n.field, o.field) field, n.ks nk, o.ks ok, n.ts nt, o.ts ot from pair p join (
    select export_line, artifact_kind, batch_no, field from field union select export_line, artifact_kind, batch_no + 1, field from field
  ) f using (export_line, artifact_kind, batch_no) left join field n on n.export_line = p.export_line and n.artifact_kind = p.artifact_kind and n.batch_no = p.batch_no and n.field = f.field
    left join field o on o.export_line = p.export_line and o.artifact_kind = p.artifact_kind and o.batch_no = p.batch_no - 1 and o.field = f.field
),
change as (
  select *, 'added' change from step where ok is null union all select *, 'removed' from step where nk is null
  union all select *, 'renamed' from step where nk <> ok union all select *, 'retyped' from step where nt <> ot and len(nt) > 0 and len(ot) > 0
)
"""

P6_FOUND = _MEMBERS + "select distinct export_line, artifact_kind, batch_no, field, change from change"
P6_STEPS = _MEMBERS + "select export_line, artifact_kind, batch_no, field, change, ok[1] old_key, nk[1] new_key, ot[1] old_type, case when len(nt) = 1 then nt[1] end new_type from change"

P6_CELLS = r"""
with names as (select artifact_kind, s, min(f) f from (select artifact_kind, regexp_replace(lower(accepted_name), '[^a-z0-9]', '', 'g') s, canonical_field f from contract_fields union all select artifact_kind, regexp_replace(lower(canonical_field), '[^a-z0-9]', '', 'g'), canonical_field from contract_fields) group by 1, 2),
kind as (select artifact_kind, canonical_field f, min(json_type) jt from contract_fields group by 1, 2),
files as (select distinct artifact_kind, file_name, export_line, batch_no, captured_at, body from raw_artifacts where json_valid(body) and json_type(body) = 'OBJECT'),
keyed as (select *, unnest(json_keys(body)) k, generate_subscripts(json_keys(body), 1) i from files),
cell as (
  select * from (select x.artifact_kind, file_name, export_line, x.batch_no, captured_at, n.f, jt, json_extract(body, '$."' || k || '"') v, row_number() over (partition by x.artifact_kind, file_name, export_line, x.batch_no, captured_at, body, n.f order by json_type(json_extract(body, '$."' || k || '"')) <> 'NULL' desc, i desc) rn
    from keyed x join names n on n.artifact_kind = x.artifact_kind and n.s = regexp_replace(lower(k), '[^a-z0-9]', '', 'g') join kind on kind.artifact_kind = x.artifact_kind and kind.f = n.f) where rn = 1 and json_type(v) <> 'NULL'
),
typed as (
  select artifact_kind, file_name, cast(batch_no as bigint) batch_no, epoch_us(captured_at) captured, f field, case when jt = 'string' then case when json_type(v) = 'VARCHAR' then v ->> '$' else cast(v as varchar) end end as text,
    case when jt = 'number' then case when json_type(v) = 'BOOLEAN' then case when cast(v as varchar) = 'true' then 1.0 else 0.0 end when json_type(v) = 'VARCHAR' then case when regexp_full_match(trim(v ->> '$'), '[+-]?(([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then cast(replace(trim(v ->> '$'), ',', '') as double) end when json_type(v) not in ('ARRAY', 'OBJECT') then cast(v as double) end end number,
    case when jt = 'array' then case when json_type(v) = 'ARRAY' then json_array_length(v) else 1 end end items from cell
)
select artifact_kind, file_name, batch_no, captured, field, text, number, cast(items as bigint) items from typed where text is not null or number is not null or items is not null
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p1_paths": P1_PATHS, "p1_descendants": P1_DESCENDANTS,
        "p2_found": P2_FOUND, "p2_profile": P2_PROFILE, "p3_found": P3_FOUND, "p3_cells": P3_CELLS,
        "p5_found": P5_FOUND, "p5_by_period": P5_BY_PERIOD, "p6_found": P6_FOUND, "p6_steps": P6_STEPS, "p6_cells": P6_CELLS, "p7_found": P7_FOUND,
    }
