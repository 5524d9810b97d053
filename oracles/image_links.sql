select cast(3000000 + k as varchar) page_id, cast(pos as integer) pos, case pos
  when 0 then '![chart ' || k || '.png](https://wiki.example.com/download/attachments/' || k || '/chart%20' || k || '.png?version=2)'
  else '![chart](https://img.example.com/a.png)' end markdown
from (select distinct o_custkey k from orders), (values (0), (1)) p(pos)
