-- uses: order_docs
with docs as (select doc_id, markdown from order_docs union all select -1 - doc_id, text from documents),
lines as (
  select doc_id, i - 1 line_no, parts[i] line, regexp_matches(parts[i], '^[ \t]*(```|~~~)') is_fence
  from (select doc_id, string_split(markdown, chr(10)) parts from docs), unnest(range(1, len(parts) + 1)) u(i))
select doc_id, cast(line_no as integer) line_no, line, is_fence,
  sum(cast(is_fence as integer)) over (partition by doc_id order by line_no) % 2 = 1 fenced
from lines
