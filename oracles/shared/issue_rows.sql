select 3000000 + o_custkey page_id, o_custkey, '| Key | Issues |' || chr(10) || '| --- | --- |' head,
  '| C' || o_custkey || ' Open | ' || string_agg('[O-' || o_orderkey || '](https://tracker.example.com/browse/O-' || o_orderkey || ') — '
    || o_orderpriority, '; ' order by o_orderkey) || ' |' line
from orders group by o_custkey
