select case p_partkey % 6 when 0 then 'view-design' when 1 then 'field-mapping' when 2 then 'view-design'
  when 3 then 'field-mapping' when 4 then 'contract' else 'confluence-page' end as type, count(*) docs from part group by 1
