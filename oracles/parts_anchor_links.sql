-- uses: turns
with start as (select package from turns where turn = 0 and inlined)
select package, 'index.md' as index, line_no, cast(0 as integer) pos, 'parts/0.md' path, '[start](#Turn%200)' markdown
from turns join start using (package) where inlined
union all
select distinct package, 'index.md', cast(7 + turns as integer), cast(0 as integer), 'parts/0.md', '[first](#Turn%200)'
from turns join start using (package)
