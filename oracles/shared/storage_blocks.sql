select 3000000 + c_custkey page_id, n as block_no, kind, level, quote, lang,
  case n when 1 then 'Account № ' || c_custkey || ' · card'
    when 2 then 'select "A&B" from <a href="/display/GEO/Nowhere">t</a> where k <> ' || c_custkey
    when 3 then c_mktsegment when 4 then 'State `' || c_mktsegment || '`' when 5 then 'pay'
    when 6 then 'See [nation](confluence:GEO/' || replace(n_name, ' ', '%20') || ') by @u' || c_custkey
    when 7 then '| Market | Share \| of all | Since |' || chr(10) || '| --- | --- | --- |'
    else '| ' || rpad(c_mktsegment, cast(greatest(length(c_mktsegment), 3) as integer), ' ') || ' | 7 \| 9 | 2019 |' end as text,
  c_acctbal >= 0 done
from customer join nation on c_nationkey = n_nationkey,
  (values (1, 'heading', 1, null), (2, 'code', 0, 'sql'), (3, 'text', 0, null), (4, 'text', 0, null),
    (5, 'item', 1, null), (6, 'text', 0, null), (7, 'row', 0, null), (8, 'row', 0, null)) b(n, kind, level, lang),
  lateral (select case when n = 3 and c_custkey % 3 < 2 then 1 else 0 end quote) q
