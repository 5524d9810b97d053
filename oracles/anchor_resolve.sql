-- uses: order_facts
select doc_id, 'Order' || doc_id || '-' || f.fragment fragment, f.pos,
  case when f.pos = 0 then 'lines' when f.pos = 1 and doc_id % 3 = 0 then 'lines-1' end slug
from order_facts, (values (0, 'Lines'), (1, 'Lines.1'), (2, 'Gone')) f(pos, fragment)
