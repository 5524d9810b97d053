-- uses: wiki_pages
select page_id, title, space_key,
  case when cast(page_id as bigint) % 2 = 0 then '<p>' || title || '</p>' else '' end html,
  cast(cast(page_id as bigint) % 5 as integer) as version,
  array_to_string(ancestors, ',') ancestors
from wiki_pages
