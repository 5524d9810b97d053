select cast(3000000 + o_custkey as varchar) page_id, o_custkey,
  '<table class="wrapped"><tbody><tr><th>Key</th><th>Issues</th></tr><tr><td><span class="s">C' || o_custkey
  || '</span> <span class="jira-status"><span>Open</span></span></td><td>' || '<span>' || string_agg('<a href="https://tracker.example.com/browse/O-' || o_orderkey || '">O-' || o_orderkey || '</a> — ' || o_orderpriority, '; ' order by o_orderkey) || '</span>'
  || '</td></tr></tbody></table><p><img src="/download/attachments/' || o_custkey || '/chart%20' || o_custkey
  || '.png?version=2" alt=""><img src="https://img.example.com/a.png" alt="chart"></p>' html
from orders group by o_custkey
