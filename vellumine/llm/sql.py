"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

OP8 = r"""
with said as (select conv_id, turn, min(text) as s from conversations group by all),
units as (
  select conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as u from conversations
  union all
  select conv_id, turn, u from (
    select conv_id, turn, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g')) as u from conversations
  ) where len(string_split(u, ' ')) >= 5),
firsts as (select conv_id, u, min(turn) as po from units where u <> '' group by all),
quoted as (
  select m.conv_id, m.turn, l.level, trim(regexp_replace(lower(p.s), '\s+', ' ', 'g')) as u
  from (select distinct conv_id, turn from conversations) m cross join (select unnest([1, 2]) as level) l
  join said p on p.conv_id = m.conv_id and p.turn = m.turn - l.level),
found as (
  select q.conv_id, q.turn, count(*) as n, arg_min(f.po, q.level) as po
  from quoted q join firsts f on f.conv_id = q.conv_id and f.u = q.u where q.u <> '' group by all)
select c.conv_id, c.turn, c.role, regexp_replace(regexp_replace(coalesce(c.text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text,
  c.conv_id as conversation_id, row_number() over (partition by c.conv_id order by c.turn) - 1 as position,
  case when f.po is not null then c.conv_id end as parent_thread, f.po as parent_order,
  cast(coalesce(f.n, 0) as int) as n_quoted, cast(coalesce(f.n, 0) as int) as n_linked
from conversations c left join found f on f.conv_id = c.conv_id and f.turn = c.turn
"""

ORACLE_SQL: dict[str, str] = {"op8_chat_formatting": OP8}
