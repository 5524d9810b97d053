-- uses: order_facts
select doc_id, cast(0 as integer) line_no, 'Order ' || doc_id as text, 'order' || doc_id as key, 'order-' || doc_id slug from order_facts
union all select doc_id, 6, 'Lines', 'lines', 'lines' from order_facts
union all select doc_id, cast(11 + n as integer), 'Lines', 'lines1', 'lines-1' from order_facts where doc_id % 3 = 0
union all select doc_id, cast(case when doc_id % 3 = 0 then 18 + 2 * n else 11 + n end as integer),
  'Additional Materials', 'additionalmaterials', 'additional-materials' from order_facts where doc_id % 4 = 0
