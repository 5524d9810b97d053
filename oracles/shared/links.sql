-- uses: anchors
select source_id, pos, href, label, kind, space_key, page_id,
  case when title = '' then label else title end title
from anchors where kind <> 'none' and not (title = '' and label = '')
