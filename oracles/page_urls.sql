-- uses: wiki_pages
select page_id, case when space_key = 'CAT' then 'https://acme.atlassian.net/wiki/spaces/CAT/pages/' || page_id
  else 'https://wiki.example.com/pages/viewpage.action?pageId=' || page_id end url
from wiki_pages
