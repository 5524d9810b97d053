select c_custkey doc_id, case c_custkey%8 when 0 then '***'||c_name||'***' when 1 then '***'||c_name||'** owes*' when 2 then '**a*'||c_mktsegment||'**c*'
 when 3 then '[**'||c_name||'](/c/'||c_custkey||'.md)**' when 4 then '- [ ](/c/'||c_custkey||'.md)'||chr(10)||'- [x](/d.md)'
 when 5 then '*'||c_name||' **'||c_mktsegment||'*** &copy; &lt;'||c_custkey||'&gt; &#42;n&#42;' when 6 then '~~'||c_name||'~~ snake_case_'||c_custkey||' _'||c_mktsegment||'_'
 else '> > > **'||c_name||'**' end markdown
from customer
