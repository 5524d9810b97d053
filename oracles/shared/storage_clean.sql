select cast(3000000 + c_custkey as varchar) page_id,
  '<h1>Account &#8470; ' || c_custkey || ' &#x0000b7; card</h1><pre data-code-language="sql">select &quot;A&amp;B&quot; from &lt;a href=&quot;/display/GEO/Nowhere&quot;&gt;t&lt;/a&gt; where k &lt;&gt; ' || c_custkey
  || '</pre>'
  || case c_custkey % 3
       when 0 then '<div class="confluence-information-macro confluence-information-macro-info"><p>' || c_mktsegment || '</p></div>'
       when 1 then '<div class="confluence-information-macro confluence-information-macro-warning"><p>' || c_mktsegment || '</p></div>'
       else '<p>' || c_mktsegment || '</p>' end
  || '<p>State <code>' || c_mktsegment || '</code></p><ul class="inline-task-list"><li class="'
  || case when c_acctbal < 0 then '' else 'checked' end || '">pay</li></ul><p>See <a href="confluence:GEO/'
  || replace(n_name, ' ', '%20') || '">nation</a> by @u' || c_custkey || '</p><p><img alt="d.png"></p>'
  || '<table><tbody><tr><th>Market</th><th>Share | of all</th><th>Since</th></tr><tr><td>' || c_mktsegment || '</td><td>7 | 9</td><td>2019</td></tr></tbody></table>' storage
from customer join nation on c_nationkey = n_nationkey
