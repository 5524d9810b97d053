select l_orderkey doc_id, n, body, any_value(o_orderpriority) prio from (
  select l_orderkey, count(*) n, string_agg(l_partkey || ',' || cast(l_quantity as int), chr(10)
    order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) body
  from lineitem group by l_orderkey) join orders on o_orderkey = l_orderkey group by 1, 2, 3
