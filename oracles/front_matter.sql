-- uses: wiki_saved, conv_docs
select doc_id, bound, url, v as version, extra_lines, cast(length(head) as integer) raw_length,
  substr(text, length(head) + 1) body
from (
  select page_id doc_id, text, true bound,
    'https://wiki.example.com/pages/viewpage.action?pageId=' || page_id url, 1 v,
    'sourceId: ' || page_id extra_lines,
    split_part(text, chr(10) || '---' || chr(10), 1) || chr(10) || '---' || chr(10) head
  from wiki_saved
  union all
  select package || '/' || path, text, false, null, null,
    case when starts_with(text, '---') then
      replace(substr(split_part(text, chr(10) || '---' || chr(10), 1), 5), chr(10), '|') else '' end,
    case when starts_with(text, '---') then
      split_part(text, chr(10) || '---' || chr(10), 1) || chr(10) || '---' || chr(10) else '' end
  from conv_docs)
