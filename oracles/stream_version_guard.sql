-- uses: page_versions
with attempts as (
  select page_id, version n, client, event_id, lag(version) over (partition by page_id, client order by version) previous
  from page_versions),
judged as (
  select page_id, n, event_id, client, true accepted, n last_accepted, cast(1 as integer) current, cast(0 as integer) seen_before
  from attempts where n = 1
  union all
  select a.page_id, a.n, a.event_id, a.client, a.previous is null or a.previous >= j.last_accepted,
    case when a.previous is null or a.previous >= j.last_accepted then a.n else j.last_accepted end,
    j.current + cast(a.previous is null or a.previous >= j.last_accepted as integer), 0
  from attempts a join judged j on j.page_id = a.page_id and a.n = j.n + 1)
select j.page_id, j.event_id, j.client, coalesce(p.current, 0) seen, j.current as version, j.accepted
from judged j join attempts a on a.page_id = j.page_id and a.n = j.n
left join judged p on p.page_id = a.page_id and p.n = a.previous
