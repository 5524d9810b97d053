-- uses: slugs
select page_id, slug from slugs
