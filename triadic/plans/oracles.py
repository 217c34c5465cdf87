"""SQL for DuckDB that gives what the queries give, from the same tables.

Each statement is a chain of common table expressions cut off where it is needed.
The initial partition is unrolled over more rounds than any of the tables needs.
"""

from __future__ import annotations

ROUNDS = 16  # of the initial partition
REFINE = 10  # of refinement
# Fixed values of refinement: rounds without enough gain, and what is enough (a float32 0.01 widened).
RETRIES, THRESHOLD = 5, 0.009999999776482582

_CHAIN: list[tuple[str, str]] = [
    ("items", "select distinct l_orderkey o, l_partkey p from lineitem"),
    ("edges", "select distinct a.p src, b.p dst from items a join items b on a.o = b.o where a.p <> b.p"),
    ("tri", "select x.src a, x.dst b, y.dst c from edges x join edges y on x.dst = y.src join edges z on z.src = x.src and z.dst = y.dst where x.src < x.dst and x.dst < y.dst"),
    ("corners", "select id, count(*) t from (select a id from tri union all select b from tri union all select c from tri) group by id"),
    ("sup", "select src, dst, count(*) support from (select a src, b dst from tri union all select b, a from tri union all select a, c from tri union all select c, a from tri union all select b, c from tri union all select c, b from tri) group by src, dst"),
    ("pv", "select c.id, c.t, v.vt, case when v.vt < 2 then 0.0::double else 2.0::double * c.t / (v.vt * (v.vt - 1)) end cc from corners c join (select src id, count(*) vt from sup group by src) v on v.id = c.id"),
    ("scope", "select (select count(distinct src) from edges) v, (select coalesce(sum(cc), 0) from pv) / (select count(distinct src) from edges) omega"),
    ("up", "select s.src v, s.dst u, q.cc, q.vt from sup s join pv p on p.id = s.src join pv q on q.id = s.dst where (q.cc, q.vt, q.id) > (p.cc, p.vt, p.id)"),
    ("blocked1", "select distinct v id from up"),
    *[(f"blocked{k}", f"select distinct v id from up where u not in (select id from blocked{k - 1})") for k in range(2, ROUNDS + 1)],
    ("joined", f"select v id, u cid from (select v, u, row_number() over (partition by v order by cc desc, vt desc, u desc) k from up where u not in (select id from blocked{ROUNDS})) where k = 1 and v in (select id from blocked{ROUNDS})"),
    ("labels", f"select id, id cid from pv where id not in (select id from blocked{ROUNDS}) union all select id, cid from joined"),
]


def _gain(r: str, a: str, b: str, k: str, o: str, source: str, keep: str) -> str:
    """Rows of source with the insertion gain, as ``gain``."""
    return f"""
      select {keep}, (k * ((((r - 1) * d + 1 + q) * (k - 1) * d) / ((r + q) * ((r - 1) * (r - 2)) * pow(d, 3) + (k - 1) * d + q * (q - 1) * d * w + q * (q - 1) * w + o + w))
        + (r - k) * (-((r - 1) * (r - 2) * pow(d, 3) * ((r - 1) * d + q)) / (((r - 1) * (r - 2) * pow(d, 3) + q * (q - 1) * w + q * (r - 1) * d * w) * (r + q) * (r - 1 + q)))
        + ((k * (k - 1) * d) * (k + o)) / ((k * (k - 1) * d + o * (o - 1) * w + o * k * w + o * k * w) * (r + o))) / v gain
      from (select *, (b - k) / r q, 2.0 * a / (r * r) d from (select {keep}, ({r})::double r, ({a})::double a, ({b})::double b, ({k})::double k, ({o})::double o, omega w, v::double v from {source}, scope))"""


def _state(s: str) -> list[tuple[str, str]]:
    """Statistics and scores of the labels in the table labels<s>."""
    return [
        (f"deg{s}", f"select s.src id, l.cid, count(*) din from sup s join labels{s} l on l.id = s.dst group by s.src, l.cid"),
        (f"own{s}", f"select d.id, l.cid own, sum(case when d.cid = l.cid then din else 0 end)::bigint d_own, sum(din)::bigint d_all from deg{s} d join labels{s} l on l.id = d.id group by d.id, l.cid"),
        (f"ab{s}", f"select own cid, (sum(d_own) // 2)::bigint a, sum(d_all - d_own)::bigint b from own{s} group by own"),
        (f"stats{s}", f"select z.cid, z.r, coalesce(a, 0) a, coalesce(b, 0) b, 2.0::double * coalesce(a, 0) / (z.r * z.r) d from (select cid, count(*) r from labels{s} group by cid) z left join ab{s} ab on ab.cid = z.cid"),
        (f"ctri{s}", f"select id, count(*) tc from (select unnest([a, b, c]) id from tri join labels{s} x on x.id = a join labels{s} y on y.id = b join labels{s} z on z.id = c where x.cid = y.cid and x.cid = z.cid) group by id"),
        (f"score{s}", f"select p.id, case when p.t = 0 then 0 else (coalesce(tc, 0) * vt)::double / (p.t * (r - 1 + vt - coalesce(d_own, 0))::double) end wcc from pv p join labels{s} l on l.id = p.id join stats{s} s on s.cid = l.cid left join own{s} o on o.id = p.id left join ctri{s} c on c.id = p.id"),
    ]


def _movements(s: str) -> list[tuple[str, str]]:
    """What every vertex does, seen from the labels in labels<s>."""
    return [
        (f"leaving{s}", _gain("s.r - 1", "s.a - o.d_own", "s.b + o.d_own - (o.d_all - o.d_own)", "o.d_own", "o.d_all - o.d_own", f"own{s} o join stats{s} s on s.cid = o.own and s.r > 1", "o.id, o.own, o.d_all").replace("select o.id, o.own, o.d_all, (k", "select id, own, d_all, (k")),
        (f"removal{s}", f"select o.id, o.own, o.d_all, case when s.r = 1 then 0 else -l.gain end wcc_r from own{s} o join stats{s} s on s.cid = o.own left join leaving{s} l on l.id = o.id"),
        (f"joining{s}", _gain("s.r", "s.a", "s.b", "d.din", "m.d_all - d.din", f"deg{s} d join removal{s} m on m.id = d.id and m.own <> d.cid join stats{s} s on s.cid = d.cid and s.r > 1", "d.id, d.cid, m.wcc_r").replace("select d.id, d.cid, m.wcc_r, (k", "select id, cid, wcc_r, (k")),
        (f"best{s}", f"select id, gain wcc_t, cid target from (select id, cid, wcc_r + gain gain, row_number() over (partition by id order by wcc_r + gain desc, cid) n from joining{s} where not isnan(wcc_r + gain) and wcc_r + gain > 0) where n = 1"),
        (f"moves{s}", f"select m.id, m.own, case when not isnan(wcc_r) and wcc_r - coalesce(wcc_t, 0) > 1e-5 and wcc_r > 0 then 'REMOVE' when coalesce(wcc_t, 0) > 0 then 'TRANSFER' else 'STAY' end as move, target from removal{s} m left join best{s} b on b.id = m.id"),
        (f"moved{s}", f"select id, move, case move when 'REMOVE' then id when 'TRANSFER' then target else own end cid from moves{s}"),
    ]


_CHAIN += _state("") + _movements("")
_MOVED = "select l.id, coalesce(m.cid, l.cid) cid from labels{0} l left join moved{0} m on m.id = l.id"


def _next(k: int) -> list[tuple[str, str]]:
    """Labels after k rounds, as labels_<k>."""
    return [(f"labels_{k}", _MOVED.format(f"_{k - 1}" if k > 1 else ""))]


def _forced(n: int) -> list[tuple[str, str]]:
    """The chain up to the labels after exactly n rounds."""
    chain = list(_CHAIN)
    for k in range(1, n + 1):
        chain += _next(k)
        if k < n:
            chain += _state(f"_{k}")[:4] + _movements(f"_{k}")
    return chain


def _accepted(n: int) -> list[tuple[str, str]]:
    """The chain up to ``refined``: rounds are taken as long as the global WCC rises and retries are left.

    Unrolled n times, more than any of the tables needs; rounds after the end change nothing.
    """
    total = "(select sum(round(wcc, 12)::decimal(38, 12))::double / (select v from scope) from score{})"
    chain = [*_CHAIN, ("at_0", f"select {total.format('')} best, {RETRIES} retries, true live, 0 pick")]
    for k in range(1, n + 1):
        chain += _next(k) + _state(f"_{k}")
        up = "live and retries > 0 and w > best"
        chain.append((f"at_{k}", f"select case when {up} then w else best end best, case when {up} and (best = 0 or w / best - 1 > {THRESHOLD}) then {RETRIES} else retries - 1 end retries, {up} live, case when {up} then {k} else pick end pick from at_{k - 1}, (select {total.format(f'_{k}')} w)"))
        if k < n:
            chain += _movements(f"_{k}")
    every = " union all ".join(f"select id, cid from labels{f'_{k}' if k else ''}, at_{n} where pick = {k}" for k in range(n + 1))
    return [*chain, ("refined", every)]


_SPLIT = [
    *_CHAIN[:2],
    ("big", "select max(dst) m, floor(max(dst)::float * 0.8::float)::bigint s from edges"),
    ("bulk", "select src, dst from edges, big where src < s and dst < s"),
    ("flow", "select src, dst from edges, big where src >= s or dst >= s"),
]


def _with(last: str, select: str, chain: list[tuple[str, str]] = _CHAIN) -> str:
    names = [n for n, _ in chain]
    return "with " + ", ".join(f"{n} as materialized ({s})" for n, s in chain[: names.index(last) + 1]) + " " + select


def _counts(source: str, p: str) -> list[tuple[str, str]]:
    return [
        (f"{p}tri", f"select x.src a, x.dst b, y.dst c from {source} x join {source} y on x.dst = y.src join {source} z on z.src = x.src and z.dst = y.dst where x.src < x.dst and x.dst < y.dst"),
        (f"{p}c", f"select id, count(*) t from (select unnest([a, b, c]) id from {p}tri) group by id"),
        (f"{p}s", f"select distinct unnest([a, b, a, c, b, c]) src, unnest([b, a, c, a, c, b]) dst from {p}tri"),
        (f"{p}v", f"select c.id, c.t, s.vt from {p}c c join (select src id, count(*) vt from {p}s group by src) s on s.id = c.id"),
    ]


_DELTA = [*_SPLIT, *_counts("bulk", "old"), *_counts("edges", "new")]


def oracle_sql() -> dict[str, str]:
    ends = "(select src id from flow union select dst from flow)"
    return {
        "edges_symmetrized": _with("edges", "select src, dst from edges"),
        "adjacency_list": _with("edges", "select src id, string_agg(dst::varchar, ',' order by dst) adj from edges group by src"),
        "vertex_degree": _with("edges", "select src id, count(*) degree from edges group by src"),
        "triangle_count": _with("corners", "select v.id, coalesce(t, 0)::bigint t from (select distinct src id from edges) v left join corners c on c.id = v.id"),
        "edge_support": _with("sup", "select src, dst, support from sup"),
        "pruned_edges": _with("sup", "select src, dst from sup"),
        "pruned_vertices": _with("pv", "select id, t, vt from pv"),
        "clustering_coefficient": _with("pv", "select id, round(cc, 6) cc from pv"),
        "global_cc": _with("scope", "select round(omega, 6) omega from scope"),
        "initial_partition": _with("labels", "select id, cid from labels"),
        "community_centers": _with(f"blocked{ROUNDS}", f"select id from pv where id not in (select id from blocked{ROUNDS})"),
        "best_center_neighbor": _with("joined", "select id, cid from joined"),
        "community_size": _with("labels", "select cid, count(*) r from labels group by cid"),
        "community_edges": _with("ab", "select cid, a, b from ab"),
        "community_stats": _with("stats", "select cid, r, a, b, round(d, 6) d from stats"),
        "community_add_remove": _with("stats", "select cid, r + 1 r_add, a + b // 2 a_add, b - b // 2 + (b - b // 2) b_add, r - 1 r_remove, a - least(a, b // 2) a_remove, b + least(a, b // 2) - (b - b // 2) b_remove from stats"),
        "vertex_community_degree": _with("deg", "select id, cid, din from deg"),
        "community_neighbors": _with("labels", "select l.id, coalesce(string_agg(s.dst::varchar, ',' order by s.dst) filter (m.cid = l.cid), '') neighbors from labels l left join sup s on s.src = l.id left join labels m on m.id = s.dst group by l.id"),
        "community_triangles": _with("ctri", "select id, tc from ctri"),
        "vertex_wcc": _with("score", "select id, round(wcc, 6) wcc from score"),
        "global_wcc": _with("score", "select round((select sum(wcc) from score) / v, 6) wcc from scope"),
        "wcc_insert_gain": _with("joining", "select id, cid, case when isnan(gain) then null else round(gain * 1e6, 3) end wcc_i_millionths from joining"),
        "wcc_remove_gain": _with("removal", "select id, case when isnan(wcc_r) then null else round(wcc_r * 1e6, 3) + 0.0 end wcc_r_millionths from removal"),
        "best_movement": _with("moved", "select id, move, cid from moved"),
        "movement_round": _with("moved", "select l.id, coalesce(m.cid, l.cid) cid from labels l left join moved m on m.id = l.id"),
        "refined_partition": _with("refined", "select id, cid from refined", _accepted(REFINE)),
        "final_partition": _with("refined", "select e.id, coalesce(r.cid, e.id) cid from (select distinct src id from edges) e left join refined r on r.id = e.id", _accepted(REFINE)),
        "incremental_partition": _with("labels_5", "select e.id, coalesce(r.cid, e.id) cid from (select distinct src id from edges) e left join labels_5 r on r.id = e.id", _forced(5)),
        "stream_split": _with("big", "select src, dst, case when greatest(src, dst) < s then 'bulk' else 'stream' end part from edges, big", _SPLIT),
        "micro_batches": _with("flow", "select src, dst, least(2, (greatest(src, dst) - s) // ((m - s) // 3))::bigint batch from flow, big", _SPLIT),
        "border_vertices": _with("flow", f"select id from {ends} where id in (select src from bulk)", _SPLIT),
        "new_vertices": _with("flow", f"select id from {ends} where id not in (select src from bulk)", _SPLIT),
        "merged_graph": _with("flow", "select src, dst from bulk union select src, dst from flow", _SPLIT),
        "delta_triangle_stats": _with("newv", "select n.id, n.t - coalesce(o.t, 0) dt, n.vt - coalesce(o.vt, 0) dvt from newv n left join oldv o on o.id = n.id where n.t > coalesce(o.t, 0)", _DELTA),
        "updated_vertices": _with("newv", "select e.id, coalesce(n.t, 0)::bigint t, coalesce(n.vt, 0)::bigint vt, round(case when coalesce(n.vt, 0) < 2 then 0.0::double else 2.0::double * n.t / (n.vt * (n.vt - 1)) end, 6) cc, case when n.t > coalesce(o.t, 0) or b.id is null then e.id else e.id - e.id % 10 end cid from (select distinct src id from edges) e left join newv n on n.id = e.id left join oldv o on o.id = e.id left join (select distinct src id from bulk) b on b.id = e.id", _DELTA),
        "edge_list_scan": _with("edges", "select src, dst from edges"),
        "csv_outputs": _with("refined", """select 'pruned_edges' output, src f0, dst f1, null::bigint f2, null::bigint f3 from sup
          union all select 'pruned_vertices', id, id, null, null from pv
          union all select 'triangle_counts', e.id, coalesce(c.t, 0), e.n, null from (select src id, count(*) n from edges group by src) e left join corners c on c.id = e.id
          union all select 'initial_partition', id, cid, null, null from labels
          union all select 'initial_community_stats', cid, r, a, b from stats
          union all select 'final_partition', id, cid, null, null from refined""", _accepted(REFINE)),
        "incremental_output": _with("labels_5", "select e.id, coalesce(r.cid, e.id) cid from (select distinct src id from edges) e left join labels_5 r on r.id = e.id", _forced(5)),
        "vertex_update": _with("corners", "select e.id, e.n + coalesce(c.t, 0) x from (select src id, count(*) n from edges group by src) e left join corners c on c.id = e.id"),
        "edge_attributes": _with("corners", "select e.src, e.dst, s.t src_t, d.t dst_t from edges e left join corners s on s.id = e.src left join corners d on d.id = e.dst"),
        "edge_update": _with("sup", "select e.src, e.dst, coalesce(s.support, 0) w from edges e left join sup s on s.src = e.src and s.dst = e.dst"),
        "subgraph": _with("edges", "select e.src, e.dst from edges e join big s on s.id = e.src join big d on d.id = e.dst where (e.src + e.dst) % 2 = 0").replace(" select e.src, e.dst from", ", n as (select src id, count(*) n from edges group by src), big as (select id from n where n > (select avg(n) from n)) select e.src, e.dst from"),
        "triplets": _with("edges", "select e.src, e.dst, s.n src_degree, d.n dst_degree from edges e join (select src, count(*) n from edges group by src) s on s.src = e.src join (select src, count(*) n from edges group by src) d on d.src = e.dst"),
        "largest_reachable": _with("edges", "select id, best from r4").replace(" select id, best from r4", ", r0 as (select distinct src id, src best from edges), " + ", ".join(f"r{k} as materialized (select p.id, greatest(p.best, max(q.best)) best from r{k - 1} p join edges e on e.dst = p.id join r{k - 1} q on q.id = e.src group by p.id, p.best)" for k in range(1, 5)) + " select id, best from r4"),
    }
