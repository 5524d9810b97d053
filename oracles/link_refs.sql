-- uses: anchors
select source_id, pos, href, label, kind, space_key, page_id, title from anchors
