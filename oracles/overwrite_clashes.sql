-- uses: wiki_pages, wiki_saved
with files as (select page_id, 'catalogue/' || slug path from (select page_id, ord, title, ancestors, case when owner <> page_id then base || '-' || page_id else base end slug
from (
  select *, coalesce(null, first_value(page_id) over (partition by base order by ord)) owner
  from (
    select page_id, title, ancestors, cast(page_id as bigint) ord, coalesce(null, coalesce(nullif(trim(regexp_replace(lower(strip_accents(replace(replace(title, 'ł', 'l'), 'Ł', 'L'))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'page')) base
    from wiki_pages p) b)))
select page_id, path from files f
where path in (select rel_path from wiki_saved)
  and not exists (select 1 from wiki_saved s where s.page_id = f.page_id and s.rel_path = f.path)
