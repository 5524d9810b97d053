-- uses: turns
select package, 'index.md' as index, path, 'Turn ' || turn title from turns t
where not present and exists (select 1 from turns i where i.package = t.package and i.inlined)
