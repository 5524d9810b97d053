-- uses: picked, wiki_pages, wiki_links_html, wiki_saved, saved
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
  from slugged s left join region_path on region_id = s.ancestors[1])
select page_id, path, space_key from placed
