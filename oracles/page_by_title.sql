-- uses: wiki_pages
select space_key, title, cast(min(cast(page_id as bigint)) as varchar) page_id
from wiki_pages group by space_key, title
