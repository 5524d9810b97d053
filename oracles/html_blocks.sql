-- uses: raw_blocks, storage_blocks, issue_rows
select 'raw-' || page_id page_id, cast(block_no as integer) block_no, kind,
  cast(case kind when 'text' then 0 else 1 end as integer) level, cast(0 as bigint) quote, cast(null as varchar) lang, line as text
from raw_blocks
union all
select 'storage-' || page_id, cast(block_no as integer), kind, cast(level as integer), cast(quote as bigint), lang, text from storage_blocks
union all
select 'issue-' || page_id, cast(1 as integer), 'row', cast(0 as integer), cast(0 as bigint), null, head from issue_rows
union all
select 'issue-' || page_id, cast(2 as integer), 'row', cast(0 as integer), cast(0 as bigint), null, line from issue_rows
