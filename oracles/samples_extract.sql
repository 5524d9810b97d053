-- uses: order_facts, order_samples
with named as (
  select doc_id, string_agg(name, '|' order by seq) names, string_agg(content, '|' order by seq) contents
  from order_samples group by doc_id)
select f.doc_id, '# Order ' || f.doc_id || chr(10) || chr(10) || '- [Lines](#Order' || f.doc_id || '-Lines)' || chr(10)
  || '- [Lines](#Order' || f.doc_id || '-Lines.1)' || chr(10) || '- [Gone](#Order' || f.doc_id || '-Gone)' || chr(10) || chr(10)
  || '## Lines' || chr(10) || chr(10)
  || case when n > 4 then '[lines.txt](samples/lines.txt)' else '```csv' || chr(10) || body || chr(10) || '```' end || chr(10)
  || case when f.doc_id % 3 <> 0 then '' else chr(10) || '## Lines' || chr(10) || chr(10)
     || case when n > 4 then '[lines-2.txt](samples/lines-2.txt)' when n > 2 then '[lines.txt](samples/lines.txt)'
        else '````md' || chr(10) || '```' || chr(10) || body || chr(10) || '```' || chr(10) || '````' end || chr(10) end
  || case when f.doc_id % 4 <> 0 then '' else chr(10) || '## Additional Materials' || chr(10) || chr(10)
     || '<!-- appendix: full-length reference examples, extracted to separate files; open them only when the examples in the main content are not enough -->'
     || chr(10) || chr(10) || '**Priority**' || chr(10) || chr(10) || '[priority.json](samples/priority.json)' || chr(10) end
  || case when f.doc_id % 10 = 7 then chr(10) || '```xml' || chr(10) || 'never closed' || chr(10) else '' end markdown,
  coalesce(names, '') names, coalesce(contents, '') contents
from order_facts f left join named s on s.doc_id = f.doc_id
