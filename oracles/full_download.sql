-- uses: picked, wiki_pages, wiki_links_html, wiki_saved, saved, anchors
with found as (
  select want_id page_id from picked where want_id in (select page_id from wiki_pages)
  union
  select cast(min(cast(p.page_id as bigint)) as varchar)
  from picked join wiki_pages p on p.space_key = want_space and p.title = want_title group by p.space_key, p.title),
fetched as (
  select p.*, 0 hop from wiki_pages p where page_id in (select page_id from wiki_links_html)
  union all
  select p.*, 1 from wiki_pages p where page_id in (select page_id from found)
    and page_id not in (select page_id from wiki_links_html)),
based as (
  select f.*, s.rel_path, coalesce(s.slug, trim(regexp_replace(lower(f.title), '[^a-z0-9]+', '-', 'g'), '-')) base,
    row_number() over (order by hop, cast(f.page_id as bigint)) turn
  from fetched f left join wiki_saved s on s.page_id = f.page_id),
slugged as (
  select *, case when coalesce((select max_by(s.page_id, s.ord) from saved s where s.slug = b.base),
      first_value(page_id) over (partition by base order by turn)) <> page_id
    then base || '-' || page_id else base end slug
  from based b),
region_path as (select page_id region_id, rel_path region_dir from wiki_saved where dir = 'geo'),
placed as (
  select s.*, case
    when s.rel_path is not null then s.rel_path
    when space_key = 'CRM' then region_dir || '/' || slug
    when space_key = 'ORD' then region_dir || '/' || (select c.slug from slugged c where c.page_id = s.ancestors[3]) || '/' || slug
    else slug end path
  from slugged s left join region_path on region_id = s.ancestors[1]),
by_title as (
  select title, max_by(path, turn) path from placed group by title
  union all
  select title, max_by(rel_path, ord) from saved where title not in (select title from placed) group by title),
by_id as (
  select page_id, path, space_key from placed
  union all select page_id, rel_path, 'CAT' from wiki_saved where page_id not in (select page_id from placed)),
linked as (
  select source_id, pos, label, href, case when i.path is not null and i.space_key = 'CRM' then '../' || regexp_extract(i.path, '[^/]*$')
      when i.path is not null then '../../../' || i.path when t.path is not null then '../../../' || t.path end target
  from anchors a left join by_id i on i.page_id = a.page_id and a.page_id <> ''
    left join by_title t on t.title = a.title and a.title <> '' and i.path is null),
bodies as (
  select source_id, string_agg(case when pos = 0 then '# Order ' || (cast(source_id as bigint) - 10000000) || chr(10) || chr(10) || 'For '
      when pos = 1 then chr(10) || chr(10) || '-   ' else chr(10) || '-   ' end
    || '[' || label || '](' || coalesce(target || '.md', href) || ')', '' order by pos) || chr(10) markdown
  from linked group by source_id)
select page_id, path rel_path, '---' || chr(10) || 'confluence:' || chr(10)
  || '  url: https://wiki.example.com/pages/viewpage.action?pageId=' || page_id || chr(10)
  || '  version: ' || (cast(page_id as bigint) % 2 + 1) || chr(10) || 'type: confluence-page' || chr(10)
  || 'generator: wikiloom@1.0.0' || chr(10) || 'generated: 2024-01-31' || chr(10)
  || 'sourceId: ' || page_id || chr(10) || 'space: ' || space_key || chr(10) || 'managed: true' || chr(10) || '---' || chr(10)
  || chr(10) || '# ' || title || chr(10) || chr(10) || coalesce(markdown, title || chr(10)) as text, cast(0 as integer) samples
from placed left join bodies on source_id = page_id
