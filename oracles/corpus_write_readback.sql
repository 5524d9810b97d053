-- uses: wiki_saved
select page_id, rel_path, text || case when again then 'again' || chr(10) else '' end text, name,
  case when again and name = 'a.txt' then 'second' else 'first' end || chr(10) content
from (select *, cast(page_id as bigint) % 2 = 0 again from wiki_saved), (values ('a.txt'), ('b.txt')) n(name)
