select 'none' kind, cast(sum(n) as bigint) links, count(*) pages
from (select len(regexp_extract_all(html, '(?is)<a\b[^>]*\shref\s*=\s*"[^"]*"[^>]*>.*?</a>')) n from pages)
where n > 0
