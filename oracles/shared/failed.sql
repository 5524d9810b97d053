-- uses: wiki_links_html
select page_id source_id, (length(html) - length(replace(html, '<a ', ''))) // 3 + n pos,
  case n when 0 then 'Lost ' || page_id else 'by id' end title, 'not-found' reason
from wiki_links_html, (values (0), (1)) lost(n)
