-- uses: page_versions
select page_id, cast(version as integer) as version, client, event_id from page_versions v
where version = (select max(version) from page_versions x where x.page_id = v.page_id)
