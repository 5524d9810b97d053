-- uses: links, wiki_saved
select l.*, page_id <> '' and page_id in (select page_id from wiki_saved) known from links l
