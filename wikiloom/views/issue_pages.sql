select cast(3000000+o_custkey as string) page_id,
 '<table class="wrapped"><colgroup><col/><col/></colgroup><tbody><tr><th><h5 id="a">Key</h5></th><th><h5>Issues</h5></th></tr><tr><td><style>.x { padding: 0; }</style><span class="s">C'||o_custkey||'</span><span class="jira-status"><span>Open</span></span></td><td><table class="jira-issues"><tbody><tr><th>Key</th><th>Prio</th></tr>'
 ||@AGG('<tr><td><a href="https://tracker.example.com/browse/O-'||o_orderkey||'">O-'||o_orderkey||'</a></td><td> '||o_orderpriority||' </td><td></td></tr>','',o_orderkey)@
 ||'</tbody></table></td></tr></tbody></table><script>track(1);</script><p><img src="/download/attachments/'||o_custkey||'/chart%20'||o_custkey||'.png?version=2" alt=""><img src="https://img.example.com/a.png" alt="chart"></p>' html
from orders group by o_custkey
