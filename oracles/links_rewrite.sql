-- uses: wiki_links_html, saved
with docs as (
  select page_id doc_id, case cast(page_id as bigint) % 3 when 0 then '' when 1 then 'catalogue' else 'geo/orders' end dir,
    regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g') markdown
  from wiki_links_html),
cut as (
  select doc_id, dir, string_split_regex(markdown, '\]\([^()\s]+\)') parts,
    regexp_extract_all(markdown, '\]\(([^()\s]+)\)', 1) hrefs from docs),
pieces as (
  select doc_id, dir, i, parts[i] piece, hrefs[i] href from cut, unnest(range(1, len(parts) + 1)) u(i)),
wanted as (
  select *, case when href like 'https://other%' then null when href like '%/pages/%' or href like '%pageId=%'
      then regexp_extract(href, '(?:pages/|pageId=)([0-9]+)', 1) end id,
    case when href like '/display/%' then replace(regexp_extract(href, '([^/]*)$', 1), '+', ' ')
         when href like 'confluence:%' then replace(regexp_extract(href, '([^/]*)$', 1), '%20', ' ') end title
  from pieces),
titles as (select title, max_by(rel_path, ord) path from saved group by title),
found as (
  select w.*, coalesce(s.rel_path, t.path) path from wanted w
  left join saved s on s.page_id = w.id left join titles t on t.title = w.title)
select doc_id, dir, string_agg(piece || case when href is null then '' when path is null then '](' || href || ')'
  else '](' || case dir when '' then './' || path when 'catalogue' then './' || substr(path, 11)
    else '../../' || path end || '.md)' end, '' order by i) markdown
from found group by doc_id, dir
