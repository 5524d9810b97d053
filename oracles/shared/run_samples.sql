-- uses: run_placed, wiki_links_html
select page_id, path rel_path, cast(1 as integer) seq, 'packing-log.txt' as name,
  (select string_agg('box ' || n || ' of ' || page_id, chr(10) order by n) from range(1, 41) r(n)) || chr(10) as content
from run_placed where page_id in (select page_id from wiki_links_html)
