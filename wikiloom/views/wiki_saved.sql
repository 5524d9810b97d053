select page_id, title, dir, slug, dir||'/'||slug rel_path,
 '---'||chr(10)||'confluence:'||chr(10)||'  url: https://wiki.example.com/pages/viewpage.action?pageId='||page_id||chr(10)||'  version: 1'||chr(10)||'sourceId: '||page_id||chr(10)||'---'||chr(10)||chr(10)||'# '||title||chr(10)||chr(10)
 ||'Next: [next](/pages/viewpage.action?pageId='||(cast(page_id as bigint)+1)||') and [file](./'||slug||'.md).'||chr(10) text
from (select page_id, title, dir, case when rn=1 then base else base||'-'||page_id end slug
 from (select *, row_number() over (partition by dir,base order by page_id) rn
  from (select cast(90000000+p_partkey as string) page_id, p_name title, 'catalogue' dir, lower(replace(p_name,' ','-')) base from part where p_partkey%5=0
   union all select cast(1000000+r_regionkey as string), r_name, 'geo', lower(replace(r_name,' ','-')) from region) a) b) c
