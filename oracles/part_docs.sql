-- uses: turns
select package, path from turns where inlined
