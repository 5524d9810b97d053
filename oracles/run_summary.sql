-- uses: wiki_pages, order_samples, relinked, turns
select (select count(*) from wiki_pages) pages, (select count(*) from order_samples) samples,
  (select count(*) from relinked) relinked, (select count(*) from turns where inlined) parts
