-- uses: placed, saved
select title, max_by(path, ord) path from placed group by title
union all select title, max_by(rel_path, ord) from saved
  where title not in (select title from placed) group by title
