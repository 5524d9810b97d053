-- uses: links
select source_id, pos, kind, space_key, page_id, title from links l
where not exists (select 1 from links e where e.source_id = l.source_id and e.pos < l.pos
  and case when l.page_id <> '' then e.page_id = l.page_id
           else e.page_id = '' and e.space_key = l.space_key and e.title = l.title end)
