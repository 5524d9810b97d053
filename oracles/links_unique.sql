-- uses: unique_links
select source_id, pos, kind, space_key, page_id, title from unique_links
