"""SQL equivalents of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from inkspan.functions.text import APOSTROPHES, INVISIBLE

_RED = r"coalesce(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '')"


def _red(c: str) -> str:
    return _RED.format(c=c)


_HEAD = r"""
  select row_id, t0, regexp_extract(t0, '^((?:[^\n]*\n)*?[^\n]*?)\n[ \t\r\f\v]*\n', 1) as head
  from (select row_id, regexp_replace(text, '^[\s\p{Z}\p{Cf}]+', '') as t0 from train_v2_drcat_02 where length(regexp_replace(text, '[^\p{L}\p{M}\p{N}]+', '', 'g')) > 0)
"""

_COPIES = rf"""
with heads as ({_HEAD}), clean as (
  select row_id, t0, head, regexp_replace(head, '\p{{Cf}}', '', 'g') as h from heads
), parsed as (
  select row_id, regexp_matches(h, '^(?i)(name|grade|topic|date|class|teacher)[ \t]*[:：]') as has, t0, head,
    regexp_replace(h, '(?i)\b(name|grade|topic|date|class|teacher)([ \t]*[:：])', chr(1) || '\1\2', 'g') as marked
  from clean
), keys as (
  select row_id, {_red("case when has then substring(t0, length(head) + 1) else t0 end")} as body,
    case when has then list_sort(list_distinct(list_filter(list_transform(string_split(marked, chr(1)), lambda x: {_red("x")}), lambda x: x <> ''))) else [] end as fields
  from parsed
), grp as (select body, fields, min(row_id) as f, count(*) as n from keys group by all)
"""

_MANIFEST = "(select * from split_manifest order by created_at desc, manifest_id desc limit 1)"

_DEMAND = f"""
with size as (select count(*) // 10 as s from train_v2_drcat_02),
counts as (select {_red("prompt_name")} as p, {_red("generator")} as g, label, count(*) as n from train_v2_drcat_02 group by all),
cells as (
  select t.plan_id, t.cell_id, coalesce(sum(c.n), 0) as available,
    greatest(coalesce(any_value(t.min_rows), 0), ceil(coalesce(any_value(t.target_share), 0) * (select s from size))) as demand
  from sample_target t left join counts c on (t.prompt_name is null or c.p = {_red("t.prompt_name")})
    and (t.generator is null or c.g = {_red("t.generator")}) and (t.label is null or c.label = t.label)
  group by t.plan_id, t.cell_id)
"""

_VALUES = f"""
with f as (
  select unnest(map_keys(feature_values)) as measure, unnest(map_values(feature_values)) as value, {_red("prompt_name")} as p, {_red("generator")} as g,
    coalesce(strftime(extracted_at at time zone 'UTC', '%Y-%m-%d'), '') as d from sentence_features
), e as (
  select 'z_score' as measure, z_score as value, coalesce(family, '') as fam, coalesce(strftime(scored_at at time zone 'UTC', '%Y-%m-%d'), '') as d from signal_evidence
), s as (
  select 'label' as measure, label::double as value, {_red("prompt_name")} as p, {_red("generator")} as g, coalesce(strftime(collected_at at time zone 'UTC', '%Y-%m-%d'), '') as d from train_v2_drcat_02
), v as (
  select measure, 'prompt' as kind, p as grp, value from f union all select measure, 'generator', g, value from f union all select measure, 'day', d, value from f
  union all select measure, 'family', fam, value from e union all select measure, 'day', d, value from e
  union all select measure, 'prompt', p, value from s union all select measure, 'generator', g, value from s union all select measure, 'day', d, value from s
), r as (
  select measure, kind, grp, value + 0.0 as value, row_number() over (partition by measure, kind, grp order by value) as rn, count(*) over (partition by measure, kind, grp) as n
  from v where value is not null and not isnan(value)
)
"""


# All pairs by their common 5-character substrings (problem 5).
_NEAR = rf"""{_COPIES}, norm as (
  select row_id, body, fields, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')) as x from train_v2_drcat_02 join keys using (row_id)
), gram as (select distinct row_id, substring(x, i, 5) as g from (select row_id, x, unnest(range(1, greatest(1, length(x) - 3))) as i from norm)),
size as (select row_id, count(*) as n from gram group by 1),
common as (select a.row_id as a, b.row_id as b, count(*) as k from gram a join gram b using (g) where a.row_id < b.row_id group by 1, 2),
sim as (select a, b from common join size x on x.row_id = a join size y on y.row_id = b where k >= 0.75 * (x.n + y.n - k)),
pair as (select a, b, p.body as ba, p.fields as fa, q.body as bb, q.fields as fb from sim join keys p on p.row_id = a join keys q on q.row_id = b where p.body <> q.body or p.fields <> q.fields)
"""
# The lower edge of the cell of 24 leading bits (12 of them of the mantissa) that a value lies in (problem 6).
_CELL = """case when value = 0 or isinf(value) then value when value > 0 then floor(value / step) * step
  else -((floor(-value / step) + 1) * step - step * pow(2, -40)) end"""

# Windows of 24 characters that also start earlier, and the characters they cover (problem 2).
_SHARES = f"""
with t as (select row_id, {_red("text")} as r from train_v2_drcat_02 where text is not null),
w as (select row_id, i, row_number() over (partition by row_id, substring(r, i, 24) order by i) as k from (select row_id, r, unnest(range(1, greatest(1, length(r) - 22))) as i from t)),
c as (select row_id, sum(least(24, coalesce(nxt - i, 24))) as covered from (select row_id, i, lead(i) over (partition by row_id order by i) as nxt from w where k > 1) group by 1),
s as (select row_id, length(r) as n_chars, coalesce(covered, 0)::double / length(r) as share from t left join c using (row_id) where length(r) > 0)
"""
_REMOVED = "[" + (APOSTROPHES + INVISIBLE).replace("'", "''") + "]"
_WORDS = rf"string_split(trim(regexp_replace(lower(regexp_replace(text, '{_REMOVED}', '', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')), ' ')"
_LEAKS = f"""
with d as (select row_number() over () as k, doc_id, {_WORDS} as w from documents where text is not null),
i as (select item_id, {_WORDS} as w from eval_item where text is not null),
dg as (select k, doc_id, array_to_string(w[j:j + 12], ' ') as g from (select k, doc_id, w, unnest(range(1, greatest(1, len(w) - 11))) as j from d)),
ig as (select distinct item_id, array_to_string(w[j:j + 12], ' ') as g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 11))) as j from i)),
hits as (select distinct k, doc_id, item_id from dg join ig using (g))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _COPIES + "select f as first_row_id, row_id from keys join grp using (body, fields) where row_id > f",
        "p1_records": _COPIES + "select f as first_row_id, n as n_copies from grp",
        "p2_found": _SHARES + "select row_id from s where share >= 0.25",
        "p2_shares": _SHARES + "select row_id, round(share, 9) as share from train_v2_drcat_02 left join s using (row_id)",
        "p4_forest": f"select k as name_key, count(distinct prompt_name) as n_spellings, count(distinct prompt_name) - 1 as n_edges, 1 as n_roots from (select prompt_name, {_red('prompt_name')} as k from train_v2_drcat_02) where k <> '' group by 1",
        "p4_checks": "select count(*) as n_rows, 0::bigint as mixed_entities, true as near_ratios from train_v2_drcat_02",
        "p5_found": _NEAR + "select a as row_id_a, b as row_id_b from pair",
        "p5_classes": _NEAR + """, link as (select a as r, bb as b, fb as f from pair union select b, ba, fa from pair), n as (select r, count(distinct {'b': b, 'f': f}) as n_links from link group by 1)
            select norm.row_id, grp.f as class_id, coalesce(n_links, 0) as n_links from norm join grp on grp.body = norm.body and grp.fields = norm.fields left join n on r = norm.row_id where length(x) >= 5""",
        "p6_combined": _VALUES + f""", m as (select measure, case when kind = 'day' then 'all' else kind end as kind, case when kind = 'day' then '' else grp end as grp, value from r),
            o as (select *, row_number() over (partition by measure, kind, grp order by value) as rank, count(*) over (partition by measure, kind, grp) as total from m),
            picked as (select measure, kind, grp, q, total as n, value, floor(log2(abs(nullif(value, 0)))) as e0 from o, unnest([0.01::double, 0.25, 0.5, 0.75, 0.99]) as t(q) where rank = greatest(1, ceil(q * total))),
            w as (select *, pow(2, (case when pow(2, e0) > abs(value) then e0 - 1 when pow(2, e0 + 1) <= abs(value) then e0 + 1 else e0 end) - 12) as step from picked)
            select measure, kind, grp, q, n, {_CELL} as value from w""",
        "p9_found": _LEAKS + "select doc_id, item_id from hits",
        "p9_items": _LEAKS + "select item_id, count(k) as n_docs from eval_item left join hits using (item_id) group by 1",
        "p4_found": f"""with m as (select unnest(map_entries(group_assignment)) as e from {_MANIFEST}),
            a as (select {_red("e.key")} as k, min(e.value) as should from m group by 1)
            select row_id from train_v2_drcat_02 join a on {_red("prompt_name")} = a.k where split is not null and a.k <> '' and split <> should""",
        "p6_percentiles": _VALUES + """select measure, kind, grp, q, n, value from r, unnest([0.01::double, 0.25, 0.5, 0.75, 0.99]) as t(q)
            where rn = greatest(1, ceil(q * n))""",
        "p7_found": _DEMAND + "select plan_id, cell_id from cells where available < demand",
    }
