-- uses: issue_clean, storage_clean
select 'issue-' || page_id page_id, html from issue_clean
union all
select 'storage-' || page_id, storage from storage_clean
union all
select 'raw-' || page_id, regexp_replace(regexp_replace(html, '(?is)<style\b[^>]*>.*?</style>', '', 'g'),
  '(?is)<script\b[^>]*>.*?</script>', '', 'g') from pages
