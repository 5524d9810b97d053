-- uses: turns, wiki_saved
with saved as (
  select 'saved/' || rel_path || '.md' doc_id, page_id, title,
    '<p>Next: <a href="/pages/viewpage.action?pageId=' || (cast(page_id as bigint) + 1) || '">next</a> and <a href="./' || slug || '.md">file</a>.</p>' storage,
    cast(page_id as bigint) % 2 = 0 fresh
  from wiki_saved),
facts as (
  select package, conv_id, bool_and(inlined) dropped, bool_or(inlined) anything, bool_or(inlined and turn = 0) start
  from turns group by package, conv_id),
rows as (
  select t.*, inlined and anything split, start, lag(inlined) over (partition by t.package order by turn) before,
    lead(inlined) over (partition by t.package order by turn) after
  from turns t join facts f on f.package = t.package),
listed as (
  select package, string_agg(case when inlined then '<h2>Turn ' || turn || '</h2>' || chr(10) || '<p>' || text || '</p>' || chr(10)
      || '<p>Back to ' || case when start then '<ac:link ac:anchor="Turn 0"><ac:link-body>start</ac:link-body></ac:link>'
          else '<a href="0.md">start</a>' end || '.</p>' || chr(10)
    else case when coalesce(before, true) then '<ol>' || chr(10) else '' end
      || '<li><a href="' || path || '">Turn ' || turn || '</a></li>' || chr(10)
      || case when coalesce(after, true) then '</ol>' || chr(10) else '' end end, '' order by turn) body
  from rows group by package),
texts as (
  select f.package || '/index.md' doc_id, 'Conversation ' || conv_id title,
    case when dropped then '' else '<h2>Contents</h2>' || chr(10) end || body || '<h2>Notes</h2>' || chr(10) || '<p>See '
      || case when start then '<ac:link ac:anchor="Turn 0"><ac:link-body>first</ac:link-body></ac:link>'
           else '<a href="parts/0.md">first</a>' end || '.</p>' storage
  from facts f join listed l on l.package = f.package
  union all
  select package || '/' || path, cast(turn as varchar), '<h2>Turn ' || turn || '</h2>' || chr(10) || '<p>' || text || '</p>' || chr(10)
    || '<p>Back to <a href="0.md">start</a>.</p>'
  from turns where present and not inlined)
select doc_id, case when fresh then 'updated' else 'conflict' end as action, page_id, cast(null as varchar) parent_id,
  cast(null as varchar) space_key, cast(case when fresh then 2 end as integer) as version,
  'https://wiki.example.com/pages/viewpage.action?pageId=' || page_id url, title,
  case when fresh then '{"id":"' || page_id || '","type":"page","title":' || to_json(title) || ',"version":{"number":2},"body":{"storage":{"value":'
    || to_json(storage) || ',"representation":"storage"}}}' end payload
from saved
union all
select doc_id, 'created', null, cast(1000000 + r_regionkey as varchar), 'GEO', cast(1 as integer), null, title,
  '{"type":"page","title":' || to_json(title) || ',"space":{"key":"GEO"},"body":{"storage":{"value":' || to_json(storage)
    || ',"representation":"storage"}},"ancestors":[{"id":"' || (1000000 + r_regionkey) || '"}]}'
from texts, region where r_name = 'EUROPE'
