-- uses: failed
select source_id, pos, title, reason from failed
