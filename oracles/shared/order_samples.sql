-- uses: order_facts
select doc_id, cast(row_number() over (partition by doc_id order by k) as integer) seq,
  case when k = 3 then 'priority.json'
       when row_number() over (partition by doc_id order by k) = 1 then 'lines.txt' else 'lines-2.txt' end name,
  content
from (
  select doc_id, 1 k, body || chr(10) content from order_facts where n > 4
  union all select doc_id, 2, '```' || chr(10) || body || chr(10) || '```' || chr(10) from order_facts where doc_id % 3 = 0 and n + 2 > 4
  union all select doc_id, 3, '{"p":"' || prio || '"}' || chr(10) from order_facts where doc_id % 4 = 0)
