-- uses: failed
select source_id, string_agg(title || ' (' || reason || ')', '; ' order by pos) report, count(*) failures
from failed group by source_id
