"""SQL for the data-processing problems of the core."""

_UID = r"nullif(upper(regexp_replace({}, '^[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+|[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+$', '', 'g')), '')"


def _uid(c: str) -> str:
    return _UID.format(c)


_WON = f"""
won as (
  select * from (
    select {_uid('uid')} as k, feed_id, deleted_at is not null as dead, mtype,
      row_number() over (partition by {_uid('uid')}
        order by greatest(updated_at, deleted_at) desc nulls last, deleted_at is not null desc, feed_id) as r
    from sync_record where {_uid('uid')} is not null)
  where r = 1)"""

_WALK = """
link as (
  select 'parent_id' as s, id, 'parent_id' as ps, parent_id as pid from node where parent_id is not null
  union select 'superseded_by', id, 'superseded_by', superseded_by from node where superseded_by is not null
  union select 'node', id, 'project', project_id from node where project_id is not null
  union select 'project', id, 'project', project_id from project where project_id is not null),
present as (
  select 'parent_id' as s, id from node union select 'superseded_by', id from node union select 'project', id from project),
hold as (select link.* from link join present on present.s = link.ps and present.id = link.pid),
walk as (
  select s, id, s as cs, id as c, 0 as depth, [id] as path, false as loops from link
  union all
  select w.s, w.id, h.ps, h.pid, w.depth + 1, list_append(w.path, h.pid),
    list_contains(w.path[(case when w.s = 'node' then 2 else 1 end):], h.pid)
  from walk w join hold h on h.s = w.cs and h.id = w.c where not w.loops),
ended as (
  select s, id, arg_max(c, depth) as root_id, max(depth) as depth, bool_or(loops) as loops, arg_max(path, depth) as path
  from walk group by s, id)"""

_P2 = f"""{_WON},
      n as (select id, max(case when deleted_at is not null then 1 else 0 end) as gone, min(created_at) as born, min(parent_id) as parent_id from node group by id),
      er as (select 'edge' as tbl, id as ref_id, 'src' as side, src as k, created_at from edge where src is not null
        union select 'edge', id, 'dst', dst, created_at from edge where dst is not null),
      e as (select tbl, strftime(make_timestamp(er.created_at * 1000000), '%Y-%m') as period, ref_id, side,
        case when n.id is null then 'missing' when n.gone = 1 then 'deleted' when n.born > er.created_at then 'late' end as state
        from er left join n on n.id = er.k),
      born as (select {_uid('uid')} as k, min(received_at) as born from sync_record group by 1),
      sr as (select 'sync_edge' as tbl, seq as ref_id, 'src' as side, coalesce({_uid('src_uid')}, '') as k, received_at, created_at from sync_edge where src_uid is not null
        union select 'sync_edge', seq, 'dst', coalesce({_uid('dst_uid')}, ''), received_at, created_at from sync_edge where dst_uid is not null),
      s as (select tbl, strftime(make_timestamp(sr.created_at * 1000000), '%Y-%m') as period, ref_id, side,
        case when won.k is null then 'missing' when won.dead then 'deleted' when born.born > sr.received_at then 'late' end as state
        from sr left join won on won.k = sr.k left join born on born.k = sr.k),
      found as (select distinct * from (select * from e union all select * from s) where state is not null)"""

_LINK = "case when s in ('node', 'project') then 'project_id' else s end as link, case when s = 'project' then 'project' else 'node' end as \"of\""

SQL = {
    "p6_found": f"with {_WON} select k as uid, feed_id from won where not dead",
    "p6_counts": f"""with {_WON} select coalesce(mtype, 'none') as mtype, count(*) as keys,
      sum(case when dead then 0 else 1 end)::bigint as live, sum(case when dead then 1 else 0 end)::bigint as deleted
      from won group by 1""",
    "p2_found": f"with {_P2} select * from found",
    "p2_report": f"""with recursive {_P2},
      t as (select 'node' as space, id as k, gone, born from n
        union all select 'project', id, max(case when deleted_at is not null then 1 else 0 end), min(created_at) from project group by id),
      kr as (select 'edge' as tbl, id as ref_id, 'src' as side, 'node' as space, src as k, created_at as since from edge
        union select 'edge', id, 'dst', 'node', dst, created_at from edge
        union select 'node', id, 'parent', 'node', parent_id, created_at from node
        union select 'node', id, 'superseded_by', 'node', superseded_by, created_at from node
        union select 'node', id, 'project', 'project', project_id, created_at from node
        union select 'project', id, 'project', 'project', project_id, created_at from project
        union select 'doc_chunk', chunk_id, 'file', 'node', file_id, null from doc_chunk
        union select 'symbol_def', node_id, 'node', 'node', node_id, null from symbol_def
        union select 'symbol_def', node_id, 'file', 'node', file_id, null from symbol_def
        union select 'embedding', node_id, 'node', 'node', node_id, null from embedding),
      j as (select kr.*, strftime(make_timestamp(kr.since * 1000000), '%Y-%m') as period,
          case when t.k is null then 'missing' when t.gone = 1 then 'deleted' when t.born > kr.since then 'late' end as state
        from kr left join t on t.space = kr.space and t.k = kr.k where kr.k is not null and kr.ref_id is not null),
      lost as (select tbl as space, ref_id as k from j where state in ('missing', 'deleted') and tbl in ('node', 'project')
        union select j.tbl, j.ref_id from lost join j on j.space = lost.space and j.k = lost.k where j.state is null and j.tbl in ('node', 'project')),
      rows as (select tbl, side, period, state, 'direct' as how from j where state is not null
        union all select tbl, side, period, 'orphaned', 'inherited' from j where state is null and (space, k) in (select space, k from lost)
        union all select tbl, side, period, state, 'direct' from found where tbl = 'sync_edge')
      select tbl, side, period, state, how, count(*) as refs from rows group by all""",
    "p5_paths": f"""with recursive {_WALK} select {_LINK}, id as node_id, (case when loops then -1 else root_id end)::bigint as root_id,
      (case when loops then -1 else depth end)::bigint as depth, case when not loops then list_reverse(path) end as path from ended""",
    "p5_descendants": f"""with recursive {_WALK}, d as (select {_LINK}, depth, list_reverse(path) as path from ended where not loops and depth > 0),
      u as (select link, "of", unnest(path[1:depth]) as ancestor, depth - unnest(range(0, depth)) as distance from d)
      select link, "of", ancestor, count(*) as descendants, max(distance)::bigint as height from u group by all""",
    "p5_found": f"""with recursive {_WALK}
      select distinct case when s in ('node', 'project') then 'project_id' else s end as link, id as node_id,
        (case when loops then -1 else root_id end)::bigint as root_id, (case when loops then -1 else depth end)::bigint as depth
      from ended""",
}
