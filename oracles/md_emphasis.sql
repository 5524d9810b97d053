-- uses: marked_docs
select c_custkey doc_id, case c_custkey%8 when 0 then '<p><em><strong>'||c_name||'</strong></em></p>' when 1 then '<p><em><strong>'||c_name||'</strong> owes</em></p>'
 when 2 then '<p><strong>a*'||c_mktsegment||'</strong>c*</p>' when 3 then '<p><a href="/c/'||c_custkey||'.md">**'||c_name||'</a>**</p>'
 when 4 then '<ul>'||chr(10)||'<li><a href="/c/'||c_custkey||'.md"> </a></li>'||chr(10)||'<li><a href="/d.md">x</a></li>'||chr(10)||'</ul>'
 when 5 then '<p><em>'||c_name||' <strong>'||c_mktsegment||'</strong></em> '||chr(169)||' &lt;'||c_custkey||'&gt; *n*</p>'
 when 6 then '<p><s>'||c_name||'</s> snake_case_'||c_custkey||' <em>'||c_mktsegment||'</em></p>'
 else repeat('<blockquote>'||chr(10),3)||'<p><strong>'||c_name||'</strong></p>'||repeat(chr(10)||'</blockquote>',3) end storage
from customer join (select distinct doc_id from marked_docs) m on m.doc_id=c_custkey
