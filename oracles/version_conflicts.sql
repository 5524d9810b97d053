-- uses: page_versions
with remote as (select page_id, max(version) remote_version from page_versions group by page_id),
local as (select page_id, max(version) local_version from page_versions where ts < timestamp '2024-01-30 12:00:00' group by page_id)
select page_id, cast(local_version as integer) local_version, cast(remote_version as integer) remote_version,
  case when local_version <> remote_version then 'conflict' else 'current' end state
from local join remote using (page_id)
