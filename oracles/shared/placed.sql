-- uses: slugs, wiki_saved
with recursive known as (
  select s.page_id, s.slug, s.ancestors chain, w.rel_path from slugs s left join wiki_saved w on w.page_id = s.page_id),
nodes as (select page_id, slug, rel_path, chain[len(chain)] parent from known),
tree as (
  select page_id, coalesce(rel_path, slug) path from nodes where parent is null or rel_path is not null
  union all
  select n.page_id, p.path || '/' || n.slug from nodes n join tree p on n.parent = p.page_id
  where n.rel_path is null)
select t.page_id, s.title, t.path, s.ord from tree t join slugs s on s.page_id = t.page_id
