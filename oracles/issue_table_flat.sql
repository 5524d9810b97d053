select cast(3000000 + o_custkey as varchar) page_id, cast(0 as integer) pos, '<span>' || string_agg('<a href="https://tracker.example.com/browse/O-' || o_orderkey || '">O-' || o_orderkey || '</a> — ' || o_orderpriority, '; ' order by o_orderkey) || '</span>' line from orders group by o_custkey
