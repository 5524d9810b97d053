-- uses: order_facts
select doc_id, cast(row_number() over (partition by doc_id order by open_line) as integer) seq,
  cast(open_line as integer) open_line, lang, cast(n_lines as integer) n_lines, body
from (
  select doc_id, 8 open_line, 'csv' lang, n n_lines, body from order_facts
  union all select doc_id, 13 + n, 'md', n + 2, '```' || chr(10) || body || chr(10) || '```' from order_facts where doc_id % 3 = 0
  union all select doc_id, case when doc_id % 3 = 0 then 22 + 2 * n else 15 + n end, 'json', 1, '{"p":"' || prio || '"}'
    from order_facts where doc_id % 4 = 0)
