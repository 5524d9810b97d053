-- uses: order_docs, conv_docs
select cast(doc_id as varchar) doc_id, 'Order ' || doc_id title,
  substr(markdown, length('# Order ' || doc_id) + 2) body
from order_docs
union all
select package || '/' || path, case when path = 'index.md' then 'Conversation ' || substr(package, 6)
    else regexp_extract(path, '([0-9]+)', 1) end,
  case when path = 'index.md' then substr(text, strpos(text, chr(10)) + 1)
    else substr(text, strpos(text, chr(10) || '---' || chr(10)) + 5) end
from conv_docs
