-- uses: turns
select package, 'index.md' as index, line_no, 'Turn ' || turn title, path, path full_path from turns
