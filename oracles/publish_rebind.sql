-- uses: wiki_saved
select 'saved/' || rel_path || '.md' doc_id, replace(text, '  version: 1' || chr(10), '  version: 2' || chr(10)) text
from wiki_saved where cast(page_id as bigint) % 2 = 0
