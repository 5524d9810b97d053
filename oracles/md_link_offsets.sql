-- uses: wiki_saved
with docs as (
  select page_id doc_id, true bound, text || 'See [it](confluence:CAT/' || slug || ').' || chr(10) text from wiki_saved),
every as (
  select * from docs union all
  select 'unbound-' || doc_id, false, substr(text, strpos(text, chr(10) || '---' || chr(10)) + 5) from docs),
targets as (
  select doc_id, bound, text, regexp_extract(text, '\]\((/pages/viewpage[^)]*)\) and', 1) target, 'site' kind from every where bound
  union all select doc_id, bound, text, regexp_extract(text, '\]\((confluence:CAT/[^)]*)\)', 1), 'corpus' from every)
select doc_id, cast(strpos(text, '](' || target) + 1 as integer) start,
  cast(strpos(text, '](' || target) + 1 + length(target) as integer) as "end", target, kind,
  case when kind = 'site' then 'https://wiki.example.com' || target end url
from targets
