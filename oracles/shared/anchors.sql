-- uses: wiki_links_html
select source_id, cast(pos as integer) pos, href, label, kind,
  case kind when 'space-page' then regexp_extract(href, '/spaces/([^/]+)/', 1)
            when 'display' then regexp_extract(href, '/display/([^/]+)/', 1)
            when 'pseudo' then regexp_extract(href, '^confluence:([^/]+)/', 1)
            when 'none' then null else '' end space_key,
  case when kind in ('space-page', 'any-page') then regexp_extract(href, '/pages/([0-9]+)', 1)
       when kind = 'page-id' then regexp_extract(href, 'pageId=([0-9]+)', 1)
       when kind <> 'none' then '' end page_id,
  case kind when 'display' then replace(regexp_extract(href, '/display/[^/]+/(.*)$', 1), '+', ' ')
            when 'pseudo' then url_decode(regexp_extract(href, '/(.*)$', 1))
            when 'none' then null else '' end title
from (
  select *, case
    when href like '/wiki/spaces/%' then 'space-page'
    when href like '%pageId=%' then 'page-id'
    when href like '/display/%' then 'display'
    when href like 'https://wiki.example.com/pages/%' then 'any-page'
    when href like 'confluence:%' then 'pseudo'
    else 'none' end kind
  from (
    select page_id source_id, i - 1 pos, regexp_extract(tags[i], 'href="([^"]*)"', 1) href,
      regexp_extract(tags[i], '>([^<]*)<', 1) label
    from (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') tags from wiki_links_html) t,
      unnest(range(1, len(tags) + 1)) u(i)))
