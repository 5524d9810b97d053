-- uses: turns
select package, 'index.md' as index, cast(2 as integer) line_no, '## Contents' as text
from turns group by package having bool_and(inlined)
