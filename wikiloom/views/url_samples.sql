select p_partkey url_id, case p_partkey%8
  when 0 then 'https://acme.atlassian.net/wiki/spaces/CAT/pages/'||p_partkey||'/'||replace(p_name,' ','+')||'?focused=true'
  when 1 then 'https://wiki.example.com/pages/viewpage.action?pageId='||p_partkey
  when 2 then 'https://intranet.example.com/confluence/pages/viewpage.action?pageId='||p_partkey
  when 3 then 'https://intranet.example.com/wiki/display/CAT/'||replace(p_name,' ','+')||'%C5%82'
  when 4 then 'https://docs.example.com:8443/pages/'||p_partkey||'/Anything'
  when 5 then 'https://acme.atlassian.net/wiki/x/Ab'||p_partkey
  when 6 then 'https://example.com/anything/'||p_partkey
  else 'not-a-url' end url
from part
