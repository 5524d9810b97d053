-- uses: run_placed, wiki_saved
with targets as (
  select page_id, path from run_placed
  union all select page_id, rel_path from wiki_saved where page_id not in (select page_id from run_placed)),
linked as (select *, regexp_extract(text, '\]\((/pages/viewpage[^)]*)\)', 1) href from wiki_saved)
select s.rel_path, replace(s.text, '](' || href || ')', '](' ||
    case when t.path like dir || '/%' then './' || substr(t.path, length(dir) + 2) else '../' || t.path end || '.md)') text
from linked s join targets t on t.page_id = regexp_extract(href, 'pageId=([0-9]+)', 1)
where s.rel_path not in (select path from run_placed)
