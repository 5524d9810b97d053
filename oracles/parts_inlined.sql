-- uses: turns
select package, 'index.md' as index, path, 'Turn ' || turn title, line_no from turns where inlined
