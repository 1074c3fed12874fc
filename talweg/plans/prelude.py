"""Common table expressions of the SQL oracles."""

CELLS = "cells as (select vec_id as patch_id, label::int as label, (g.i - 1)::int as cell, ((g.i - 1) // 8)::int as r, ((g.i - 1) % 8)::int as c, embedding[g.i]::double as z from embeddings, range(1, 65) g(i))"
DIRS = "dirs as (select * from (values (0, -1, 0, 1.0::double), (1, -1, 1, 1.4142135623730951::double), (2, 0, 1, 1.0::double), (3, 1, 1, 1.4142135623730951::double), (4, 1, 0, 1.0::double), (5, 1, -1, 1.4142135623730951::double), (6, 0, -1, 1.0::double), (7, -1, -1, 1.4142135623730951::double)) t(code, dr, dc, dist))"
FLOW = f"""{CELLS}, {DIRS},
flow as (select patch_id, cell, code, recv from (
  select a.patch_id, a.cell, d.code, b.cell as recv, row_number() over (partition by a.patch_id, a.cell order by (a.z - b.z) / d.dist desc, d.code) as k
  from cells a cross join dirs d join cells b on b.patch_id = a.patch_id and b.r = a.r + d.dr and b.c = a.c + d.dc where a.z > b.z) where k = 1)"""
ACC = f"""{FLOW},
ways as (select patch_id, cell as src, cell as spot from cells union all select w.patch_id, w.src, f.recv from ways w join flow f on f.patch_id = w.patch_id and f.cell = w.spot),
drained as (select patch_id, spot as cell, count(*) as n from ways group by all),
acc as (select a.patch_id, a.cell, case when f.cell is not null or a.n > 1 then a.n else 0 end as acc, f.recv, coalesce(f.code, -1) as code from drained a left join flow f on f.patch_id = a.patch_id and f.cell = a.cell)"""


def tree(tau: int | str = 2, acc: str = ACC) -> str:
    """mask, dn (masked cells with donors), nodes, anc (closure), ord (orders) and rootof."""
    levels = ", ".join(
        f"""s{k} as (select distinct a.patch_id, a.up as node from anc a join (
  select n.patch_id, n.parent from nodes n {'' if k == 2 else f'join s{k - 1} s on s.patch_id = n.patch_id and s.node = n.node'} where n.parent is not null group by 1, 2 having count(*) >= 2) q on q.patch_id = a.patch_id and q.parent = a.node)"""
        for k in range(2, 6)
    )
    return f"""{acc},
mask as (select a.* from acc a where a.acc >= {tau}),
dn as (select m.patch_id, m.cell, m.acc, m.recv, count(d.cell) as donors from mask m left join mask d on d.patch_id = m.patch_id and d.recv = m.cell group by all),
isnode as (select * from dn where donors <> 1),
walk as (select patch_id, cell as node, recv as spot from isnode where recv is not null
  union all select w.patch_id, w.node, d.recv from walk w join dn d on d.patch_id = w.patch_id and d.cell = w.spot where d.donors = 1 and d.recv is not null),
edges as (select w.patch_id, w.node, w.spot as parent from walk w join isnode p on p.patch_id = w.patch_id and p.cell = w.spot),
nodes as (select n.patch_id, n.cell as node, e.parent, n.donors = 0 as is_head, n.acc as birth, p.acc as death
  from isnode n left join edges e on e.patch_id = n.patch_id and e.node = n.cell left join isnode p on p.patch_id = n.patch_id and p.cell = e.parent),
anc as (select patch_id, node, node as up from nodes union all select a.patch_id, a.node, n.parent from anc a join nodes n on n.patch_id = a.patch_id and n.node = a.up where n.parent is not null),
old as (select a.patch_id, a.up as node, min(n.birth) filter (where n.is_head) as oldest, count(*) - 1 as n_below from anc a join nodes n on n.patch_id = a.patch_id and n.node = a.node group by all),
rootof as (select a.patch_id, a.node, a.up as root from anc a join nodes n on n.patch_id = a.patch_id and n.node = a.up where n.parent is null),
{levels},
ord as (select n.patch_id, n.node, 1 + (s2.node is not null)::int + (s3.node is not null)::int + (s4.node is not null)::int + (s5.node is not null)::int as strahler from nodes n
  {' '.join(f'left join s{k} on s{k}.patch_id = n.patch_id and s{k}.node = n.node' for k in range(2, 6))})"""


#: Strahler counts and ratios over the tree: dist (patch_id, strahler, n).
DIST = "dist as (select patch_id, strahler, count(*) as n from ord group by all)"
#: Persistence pairs by the elder rule; death is null for essential classes.
PAIRS = """pairs as (select patch_id, node, oldest as birth, death from (
  select n.patch_id, n.node, o.oldest, n.death, n.parent, row_number() over (partition by n.patch_id, n.parent order by o.oldest, n.node) as k
  from nodes n join old o on o.patch_id = n.patch_id and o.node = n.node) where parent is null or k > 1)"""
