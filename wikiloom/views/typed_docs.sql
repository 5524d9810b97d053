select p_partkey doc_id, case when p_partkey%6=0 then 'UI: '||p_name when p_partkey%6=1 then 'Mapping: '||p_name else p_name end title,
 case p_partkey%6 when 0 then '# X'||chr(10)||chr(10)||'- **Name** (`Input`) — required'||chr(10)
  when 1 then 'Plain.'||chr(10)
  when 2 then '## 1. View structure'||chr(10)||chr(10)||'- **Name** (`Input`) — required'||chr(10)
  when 3 then '## Field mappings'||chr(10)
  when 4 then '## Data model'||chr(10)||chr(10)||'## Endpoints'||chr(10)
  else '## 1. View structure'||chr(10)||'## Data model'||chr(10) end markdown
from part
