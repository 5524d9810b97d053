-- uses: order_docs
select doc_id, replace(case when doc_id % 3 = 0 then replace(markdown, '(#Order' || doc_id || '-Lines.1)', '(#lines-1)') else markdown end,
  '(#Order' || doc_id || '-Lines)', '(#lines)') markdown
from order_docs
