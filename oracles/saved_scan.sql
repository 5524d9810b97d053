-- uses: wiki_saved
select page_id, title, dir, slug, rel_path, text from wiki_saved
