-- uses: typed_docs
select cast(doc_id as varchar) page_id, '---' || chr(10) || 'confluence:' || chr(10)
  || '  url: https://wiki.example.com/pages/viewpage.action?pageId=' || doc_id || chr(10) || '  version: 3' || chr(10)
  || 'type: ' || case doc_id % 6 when 0 then 'view-design' when 1 then 'field-mapping' when 2 then 'view-design'
  when 3 then 'field-mapping' when 4 then 'contract' else 'confluence-page' end || chr(10) || 'generator: wikiloom@1.0.0' || chr(10) || 'generated: 2024-01-31' || chr(10)
  || 'sourceId: ' || doc_id || chr(10) || case when doc_id % 2 = 0 then 'space: CAT' || chr(10) else '' end
  || 'managed: true' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || markdown as text
from typed_docs
