select 'conv-' || conv_id package, conv_id, turn, role, text, 'parts/' || turn || '.md' path,
  cast(3 + row_number() over (partition by conv_id order by turn) as integer) line_no,
  count(*) over (partition by conv_id) turns,
  (conv_id + turn) % 7 <> 6 present,
  (conv_id + turn) % 7 <> 6 and role in ('user', 'assistant') inlined
from conversations
