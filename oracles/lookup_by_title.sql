-- uses: by_title
select title, path from by_title
