-- uses: relinked
select rel_path, text from relinked
