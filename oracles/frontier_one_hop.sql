-- uses: picked, wiki_pages, wiki_links_html
with found as (
  select source_id, pos, want_id page_id from picked where want_id in (select page_id from wiki_pages)
  union all
  select source_id, pos, cast(min(cast(p.page_id as bigint)) as varchar)
  from picked join wiki_pages p on p.space_key = want_space and p.title = want_title group by source_id, pos),
numbered as (
  select *, row_number() over (partition by page_id order by cast(source_id as bigint), pos) rn,
    count(*) over (partition by page_id) links from found)
select p.page_id, space_key, title, source_id via_id, pos via_pos, links
from numbered n join wiki_pages p on p.page_id = n.page_id
where rn = 1 and p.page_id not in (select page_id from wiki_links_html)
