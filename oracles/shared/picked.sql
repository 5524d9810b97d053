-- uses: unique_links, wiki_saved
select source_id, pos, title,
  case when page_id <> '' then page_id end want_id,
  case when page_id = '' then coalesce(nullif(space_key, ''), 'ORD') end want_space,
  case when page_id = '' then title end want_title
from unique_links where page_id not in (select page_id from wiki_saved)
