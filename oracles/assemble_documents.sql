-- uses: turns
with facts as (
  select package, conv_id, bool_and(inlined) dropped, count(*) filter (inlined) parts,
    bool_or(inlined and turn = 0) start
  from turns group by package, conv_id),
listed as (
  select t.package, string_agg(case when inlined then chr(10) || '## Turn ' || turn || chr(10) || chr(10) || text || chr(10) || chr(10)
      || 'Back to [start](' || case when start then '#Turn%200' else '0.md' end || ').' || chr(10)
    else '1. [Turn ' || turn || '](' || path || ')' end, chr(10) order by turn) body
  from turns t join facts f on f.package = t.package group by t.package)
select package, 'index.md' as index, rtrim(regexp_replace('# Conversation ' || conv_id || chr(10) || chr(10)
    || case when dropped then '' else '## Contents' || chr(10) end || chr(10) || body || chr(10) || chr(10)
    || '## Notes' || chr(10) || chr(10) || 'See [first](' || case when start then '#Turn%200' else 'parts/0.md' end || ').' || chr(10),
  '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) || chr(10) markdown, parts
from facts join listed using (package) where parts > 0
