-- uses: turns
select package, path, 'Turn ' || turn anchor from turns where inlined
