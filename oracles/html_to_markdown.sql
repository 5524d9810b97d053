-- uses: raw_blocks, storage_blocks, issue_rows
with raw as (
  select page_id, block_no, case kind when 'item' then '-   ' when 'heading' then '# ' else '' end || line md,
    case when lag(kind) over (partition by page_id order by block_no) = 'item' and kind = 'item' then chr(10) else chr(10) || chr(10) end gap
  from raw_blocks),
storage as (
  select page_id, block_no, case kind when 'heading' then '# ' || text
      when 'code' then '```sql' || chr(10) || text || chr(10) || '```'
      when 'item' then case when done then '- [x] ' else '- [ ] ' end || text
      else case when quote = 1 then '> ' else '' end || text end md,
    case when block_no = 8 then chr(10) else chr(10) || chr(10) end gap
  from storage_blocks)
select 'raw-' || page_id page_id, string_agg(case when block_no = 1 then '' else gap end || md, '' order by block_no) || chr(10) markdown
from raw group by page_id
union all
select 'storage-' || page_id, string_agg(case when block_no = 1 then '' else gap end || md, '' order by block_no) || chr(10)
from storage group by page_id
union all
select 'issue-' || page_id, head || chr(10) || line || chr(10) || chr(10)
  || '![chart ' || o_custkey || '.png](https://wiki.example.com/download/attachments/' || o_custkey || '/chart%20' || o_custkey
  || '.png?version=2)![chart](https://img.example.com/a.png)' || chr(10)
from issue_rows
