with bare as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<script\b[^>]*>.*?</script>', '', 'g'),
    '(?s)<!--.*?-->|<![a-zA-Z][^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g') html from pages),
broken as (
  select page_id, regexp_replace(replace(replace(html, '<li>', chr(10) || '@item '), '<h1>', chr(10) || '@head '),
    '</?(html|head|body|nav|ul|li|div|article|h1|p|footer)\b[^>]*>', chr(10), 'g') text from bare),
lines as (
  select page_id, i, parts[i] line from (select page_id, string_split(text, chr(10)) parts from broken),
    unnest(range(1, len(parts) + 1)) u(i)),
marked as (
  select page_id, i, case when starts_with(line, '@item ') then 'item' when starts_with(line, '@head ') then 'heading' else 'text' end kind,
    case when line like '@____ %' then substr(line, 7) else line end line from lines),
plain as (
  select page_id, i, kind, replace(trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(line,
    '<a href="([^"]*)">(.*?)</a>', '[\2](\1)', 'g'), '<[^>]*>', '', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&')), '*', '\*') line
  from marked)
select page_id, kind, line, row_number() over (partition by page_id order by i) block_no
from plain where line <> ''
