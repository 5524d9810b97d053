-- uses: url_samples
select url_id, url, kind,
  case when kind <> 'none' then regexp_extract(url, '^(https?://[^/]+)', 1) end origin,
  case k when 0 then '/wiki' when 3 then '/wiki' when 5 then '/wiki' when 2 then '/confluence'
         when 1 then '' when 4 then '' end base_path,
  case when kind <> 'none' then k in (0, 3, 5) end cloud,
  case when k in (0, 3) then 'CAT' end space_key,
  case when k in (0, 1, 2, 4) then cast(url_id as varchar) end page_id,
  case when k = 3 then p_name || 'ł' end title,
  case when k = 5 then url end tiny_url
from (
  select url_id, url, p_name, url_id % 8 k, case url_id % 8 when 0 then 'space-page' when 1 then 'page-id'
    when 2 then 'page-id' when 3 then 'display' when 4 then 'any-page' when 5 then 'tiny' else 'none' end kind
  from url_samples join part on p_partkey = url_id
  union all select -1 - page_id, url, null, null, 'none' from pages)
