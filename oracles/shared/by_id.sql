-- uses: placed, wiki_saved
select page_id, path from placed
union all select page_id, rel_path from wiki_saved where page_id not in (select page_id from placed)
