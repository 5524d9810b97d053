-- uses: by_id
select page_id, path from by_id
