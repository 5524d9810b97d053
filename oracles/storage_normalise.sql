-- uses: storage_clean
select page_id, storage from storage_clean
