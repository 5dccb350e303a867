"""DuckDB SQL for the queries of ``plans.queries``: plain formulations from the same definitions, composed of named parts."""

from __future__ import annotations

import re

from voxelyard.config import VEHICLES as CLASSES
from voxelyard.config import ClustererConfig, SegmenterConfig
from voxelyard.functions.geometry import ATAN_COEFFICIENTS, HALF_TURN, LABEL_COLOURS, QUARTER_TURN, RING_COLOURS, TWO_PI
from voxelyard.plans.queries import MOST, NEAREST, RADIUS, VEHICLES
from voxelyard.sources.fixtures import POINTS_SQL

CFG, VOX = SegmenterConfig(), ClustererConfig()


def d(x: float) -> str:
    """A literal that is read as a double."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


K = [d(c) for c in ATAN_COEFFICIENTS]
ANGLE = f"""least(abs(x), abs(y)) / greatest(abs(x), abs(y)) as a_, a_ * a_ as s_, s_ * s_ as q_,
  (({K[0]} * q_ + {K[2]}) * s_ + ({K[1]} * q_ + {K[3]})) * (s_ * a_) + a_ as r0_, case when abs(y) > abs(x) then {d(QUARTER_TURN)} - r0_ else r0_ end as r1_,
  case when x < 0 then {d(HALF_TURN)} - r1_ else r1_ end as r2_, case when y < 0 then -r2_ else r2_ end as angle_"""
ROW = (CFG.elevation_up_deg - CFG.elevation_down_deg) / CFG.image_height
STEP, FIRST, THR = d(CFG.elevation_step), d(CFG.first_elevation), d(CFG.ground_height_threshold_m)

#: name: (parts that it reads, SQL of the part)
PARTS: dict[str, tuple[str, str]] = {
    "points": ("", POINTS_SQL.replace("{events}", "events")),
    "objects": ("points", "select * from points where is_obj"),
    "ringed": (
        "points",
        """select *, greatest(63 - sum(p) over (partition by frame_id order by point_index rows unbounded preceding), 0)::int as ring from (
  select *, case when q = 1 and lag(q, 1, 1) over (partition by frame_id order by point_index) = 4 then 1 else 0 end as p from (
  select *, case when x > 0 and y >= 0 then 1 when x <= 0 and y > 0 then 2 when x < 0 and y <= 0 then 3 when x >= 0 and y < 0 then 4 else 1 end as q from points))""",
    ),
    "grid": (
        "points",
        f"""select * from (select frame_id, point_index, x, y, z, sqrt(x * x + y * y) as dist, trunc(dist / {d(CFG.grid_radial_spacing_m)})::int as radial_index, {ANGLE},
  case when angle_ < 0 then angle_ + {d(TWO_PI)} else angle_ end as azimuth, least(trunc(azimuth / {d(CFG.slice_rad)})::int, {CFG.slices - 1}) as azimuth_index,
  trunc((round(degrees(atan2(z, dist)), 9) - {d(CFG.elevation_down_deg)}) / {d(ROW)})::int as height_index, trunc({CFG.image_width - 1} * azimuth / {d(TWO_PI)})::int as width_index
  from points where z between {d(-CFG.sensor_height_m + CFG.z_min_m)} and {d(-CFG.sensor_height_m + CFG.z_max_m)})
  where dist between {d(CFG.min_distance_m)} and {d(CFG.max_distance_m)} and radial_index < {CFG.rings} and height_index between 0 and {CFG.image_height - 1}""",
    ),
    "cells": (
        "grid",
        f"""select frame_id, azimuth_index, radial_index, coalesce(max(case when i <= n // 2 and z - below > {d(CFG.gap_m)} then z end), min(z)) as z_min from (
  select *, lag(z) over w as below, row_number() over w - 1 as i, count(*) over (partition by frame_id, azimuth_index, radial_index) as n from grid
  window w as (partition by frame_id, azimuth_index, radial_index order by z)) group by all""",
    ),
    "elevations": (
        "cells",
        f"""select c.frame_id, c.azimuth_index, c.radial_index,
  coalesce(least(min(k.z_min - k.radial_index * {STEP}), {FIRST}), {FIRST}) + c.radial_index * {STEP} as elevation
  from cells c left join cells k on k.frame_id = c.frame_id and k.azimuth_index = c.azimuth_index and k.radial_index between 1 and c.radial_index
  group by c.frame_id, c.azimuth_index, c.radial_index""",
    ),
    "single_reach": (
        "cells",
        f"""select frame_id, azimuth_index, 0 as radial_index, ({FIRST})::float as elevation from cells group by frame_id, azimuth_index union all
  select e.frame_id, e.azimuth_index, e.radial_index + 1, least(coalesce(c.z_min::float, 'inf'::float), (e.elevation + ({STEP})::float)::float)
  from single_reach e left join cells c on c.frame_id = e.frame_id and c.azimuth_index = e.azimuth_index and c.radial_index = e.radial_index + 1 where e.radial_index < {CFG.rings - 1}""",
    ),
    "labelled": ("grid elevations", f"select *, case when z >= elevation + {THR} then 2 else 1 end as label from grid join elevations using (frame_id, azimuth_index, radial_index)"),
    "candidates": (
        "labelled",
        f"""select frame_id, x, y, z, row_number() over (partition by frame_id order by azimuth_index, radial_index, point_index) - 1 as rank, count(*) over (partition by frame_id) as n
  from labelled where radial_index < 4 and abs(elevation - z) < 2 * {THR}""",
    ),
    "planes": (
        "candidates",
        f"""select frame_id, a, b, c, d, inliers, i as iteration from (select *, row_number() over (partition by frame_id order by inliers desc, i) as best from (
  select p.frame_id, p.i, p.a, p.b, p.c, p.d, count(*) filter (abs(p.a * q.x + p.b * q.y + p.c * q.z - p.d) < {THR}) as inliers from (
    select frame_id, i, nx / size as a, ny / size as b, nz / size as c, -c * {d(CFG.sensor_height_m)} as d from (
      select t.frame_id, t.i, u.x * v.y - u.y * v.x as nz, u.y * (v.z + h) - (u.z + h) * v.y as nx, (u.z + h) * v.x - u.x * (v.z + h) as ny, nx * nx + ny * ny + nz * nz as sq,
        case when nz < 0 then -sqrt(sq) else sqrt(sq) end as size
      from (select frame_id, n, i, {d(CFG.sensor_height_m)} as h, (i * 7919) % n as r2, (i * 104729 + 1) % n as t3, case when r2 = t3 then (t3 + 1) % n else t3 end as r3
        from (select frame_id, max(n) as n from candidates group by frame_id), range({CFG.ransac_iterations}) as r(i) where n >= 2) t
      join candidates u on u.frame_id = t.frame_id and u.rank = t.r2 join candidates v on v.frame_id = t.frame_id and v.rank = t.r3)
    where sq >= 1e-5 and nz / size >= {d(CFG.least_normal_z)}) p
  join candidates q using (frame_id) group by all) where inliers > 0) where best = 1""",
    ),
    "corrected": (
        "labelled planes",
        f"""select l.* replace (case when l.radial_index < 4 and coalesce(p.a * l.x + p.b * l.y + p.c * l.z - p.d < {THR}, false) then 1 else l.label end as label)
  from labelled l left join planes p using (frame_id)""",
    ),
}


def twister(seed: int, n: int) -> list[int]:
    """The first n numbers of the 32-bit Mersenne Twister (Matsumoto and Nishimura, 1998)."""
    state = [seed]
    for i in range(1, 624):
        state.append((1812433253 * (state[-1] ^ state[-1] >> 30) + i) % 2**32)
    out = []
    while len(out) < n:
        for i in range(624):
            y = state[i] & 0x80000000 | state[(i + 1) % 624] & 0x7FFFFFFF
            state[i] = state[(i + 397) % 624] ^ y >> 1 ^ (0x9908B0DF if y & 1 else 0)
        for y in state:
            y ^= y >> 11
            y ^= y << 7 & 0x9D2C5680
            y ^= y << 15 & 0xEFC60000
            out.append(y ^ y >> 18)
    return out[:n]


def _plane_sql(pairs: str) -> str:
    """The best of the planes through pairs of ranks (frame_id, i, r2, r3): the text that both ways of drawing share."""
    head, _, tail = PARTS["planes"][1].partition("from (select frame_id, n, i,")
    return f"{head}from (select frame_id, i, {d(CFG.sensor_height_m)} as h, r2, r3 from {pairs}) t{tail[tail.index(') t') + 3 :]}"


def _extra(at: str) -> str:
    """How many numbers a pair takes from place ``at``: the third point is drawn again while it equals the second."""
    return f"(case when l[{at} + 1] <> l[{at}] then 2 when l[{at} + 2] <> l[{at}] then 3 when l[{at} + 3] <> l[{at}] then 4 else 5 end)"


def _third(at: str) -> str:
    return f"l[{at} + {_extra(at)} - 1]"


_next = f"pos + {_extra('pos')}"
PARTS["drawn_reach"] = (
    "candidates",
    f"""select frame_id, 0 as i, n, 1 as pos, l, l[1] as r2, {_third("1")} as r3 from (
    select frame_id, max(n) as n, list_transform([{", ".join(map(str, twister(42, 4 * CFG.ransac_iterations)))}], lambda r: (r * max(n)) >> 32) as l from candidates group by frame_id having max(n) >= 2)
  union all select frame_id, i + 1, n, {_next}, l, l[{_next}], {_third(f"({_next})")} from drawn_reach where i + 1 < {CFG.ransac_iterations}""",
)
PARTS["drawn_planes"] = ("candidates drawn_reach", _plane_sql("drawn_reach"))
PARTS["drawn_corrected"] = ("labelled drawn_planes", PARTS["corrected"][1].replace("left join planes", "left join drawn_planes"))


def _ordered(name: str, image: str, conflict: str) -> dict[str, tuple[str, str]]:
    """Votes in scan order: each step of the recursion votes one pixel of each frame and appends its label to the frame's list."""
    gap = "sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) + (c.z - n.z) * (c.z - n.z))"
    weight = f"exp(-{d(CFG.amplification_factor)} * {gap})"
    said = lambda k: f"list_sum(list_transform(list_filter(k.earlier, lambda e: s.l[e.m] = {k}), lambda e: e.w))"
    vote = lambda k, own: f"round(k.w{own} + coalesce({said(k)}, 0), 12)"
    return {
        f"{name}_places": (conflict, f"select *, row_number() over (partition by frame_id order by height_index, width_index) as k from {conflict}"),
        f"{name}_prepared": (
            f"{image} {name}_places",
            f"""select c.frame_id, c.k, coalesce(sum({weight}) filter (n.m is null and n.label = 2), 0) as w2, coalesce(sum({weight}) filter (n.m is null and n.label = 1), 0) as w1, coalesce(sum({weight}), 0) as w,
  list(struct_pack(m := n.m, w := {weight})) filter (n.m < c.k) as earlier from {name}_places c left join (select i.*, p.k as m from {image} i left join {name}_places p using (frame_id, height_index, width_index)) n
  on n.frame_id = c.frame_id and abs(n.height_index - c.height_index) <= 2 and abs(n.width_index - c.width_index) <= 2 and (n.height_index, n.width_index) <> (c.height_index, c.width_index)
  and {gap} <= {d(CFG.kernel_threshold_distance_m)} group by c.frame_id, c.k""",
        ),
        f"{name}_reach": (
            f"{name}_prepared",
            f"""select frame_id, 0::bigint as k, []::int[] as l from {name}_prepared group by frame_id union all
  select s.frame_id, s.k + 1, list_append(s.l, case when k.w <= {d(2.0**-23)} then 0 when {vote(2, 2)} > {vote(1, 1)} then 2 else 1 end) from {name}_reach s join {name}_prepared k on k.frame_id = s.frame_id and k.k = s.k + 1""",
        ),
        f"{name}_voted": (
            f"{image} {name}_places {name}_reach",
            f"""select i.* replace (coalesce(v.label, i.label) as label) from {image} i left join (select p.frame_id, p.height_index, p.width_index, t.l[p.k] as label from {name}_places p join (select frame_id, max_by(l, k) as l from {name}_reach group by frame_id) t using (frame_id)) v
  using (frame_id, height_index, width_index)""",
        ),
    }


def _image(source: str) -> str:
    return f"""select frame_id, height_index, width_index, point_index, x, y, z, label from (select *, row_number() over (
  partition by frame_id, height_index, width_index order by x * x + y * y, azimuth_index, radial_index, point_index) as k from {source}) where k = 1"""


def _conflict(image: str) -> str:
    return f"""select * from {image} g where label = 1 and exists (select 1 from {image} o where o.label = 2 and o.frame_id = g.frame_id
  and abs(o.height_index - g.height_index) <= 2 and abs(o.width_index - g.width_index) <= 2)"""


def _voted(image: str, conflict: str) -> str:
    gap = "sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) + (c.z - n.z) * (c.z - n.z))"
    weight = f"exp(-{d(CFG.amplification_factor)} * {gap})"
    free = "not exists_conflict"
    return f"""select i.frame_id, i.height_index, i.width_index, i.point_index, i.x, i.y, i.z, case when v.frame_id is null then i.label else v.voted end as label from {image} i left join (
  select c.frame_id, c.height_index, c.width_index, case when coalesce(sum({weight}), 0) <= {d(2.0**-23)} then 0
    when round(coalesce(sum({weight}) filter ({free} and n.label = 2), 0), 12) > round(coalesce(sum({weight}) filter ({free} and n.label = 1), 0), 12) then 2 else 1 end as voted
  from {conflict} c left join (select m.*, k.frame_id is not null as exists_conflict from {image} m left join {conflict} k using (frame_id, height_index, width_index)) n
    on n.frame_id = c.frame_id and abs(n.height_index - c.height_index) <= 2 and abs(n.width_index - c.width_index) <= 2
    and (n.height_index, n.width_index) <> (c.height_index, c.width_index) and {gap} <= {d(CFG.kernel_threshold_distance_m)}
  group by all) v using (frame_id, height_index, width_index)"""


def _final(image: str) -> str:
    return f"select p.frame_id, p.point_index, p.x, p.y, p.z, coalesce(i.label, 0) as label from points p left join {image} i using (frame_id, point_index)"


def _voxels(source: str) -> str:
    return f"""select frame_id, point_index, x, y, z, floor(round(sqrt(x * x + y * y + z * z), 9) / {d(VOX.voxel_range_m)})::bigint as range_index,
  floor(round(case when atan2(y, x) < 0 then degrees(atan2(y, x)) + 360e0 else degrees(atan2(y, x)) end, 9) / {d(VOX.voxel_azimuth_deg)})::bigint as azimuth_index,
  floor((round(degrees(atan2(z, sqrt(x * x + y * y))), 9) + 90e0) / {d(VOX.voxel_elevation_deg)})::bigint as elevation_index,
  ((frame_id::hugeint * 16777216 + range_index) * 65536 + azimuth_index) * 65536 + elevation_index as node from {source}"""


def _links(voxels: str) -> str:
    return f"""select distinct a.frame_id, a.node as src, b.node as dst from (select distinct frame_id, range_index, azimuth_index, elevation_index, node from {voxels}) a
  join (select distinct frame_id, range_index, azimuth_index, elevation_index, node from {voxels}) b on a.frame_id = b.frame_id
  and abs(a.range_index - b.range_index) <= 1 and abs(a.azimuth_index - b.azimuth_index) <= 1 and abs(a.elevation_index - b.elevation_index) <= 1"""


def _labels(voxels: str, reach: str) -> str:
    return f"""select v.frame_id, v.point_index, v.x, v.y, v.z, coalesce(k.cluster_label, -1)::int as cluster_label from {voxels} v
  join (select n, min(m) as root from {reach} group by n) r on r.n = v.node
  left join (select root, dense_rank() over (partition by frame_id order by first) - 1 as cluster_label from (
    select v.frame_id, r.root, min(v.point_index) as first, count(*) as size from {voxels} v join (select n, min(m) as root from {reach} group by n) r on r.n = v.node group by all)
    where size >= {VOX.min_cluster_size}) k using (root)"""


def _hull(clusters: str) -> str:
    d_ = f"(select distinct frame_id, cluster_label, x, y from {clusters} where cluster_label >= 0)"
    same = "r.frame_id = p.frame_id and r.cluster_label = p.cluster_label"
    turn = "(q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)"
    flat = "1e-12 * (abs(q.x - p.x) + abs(q.y - p.y)) * (abs(r.x - p.x) + abs(r.y - p.y))"
    along = "(r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y)"
    return f"""select p.frame_id, p.cluster_label, p.x, p.y, q.x as x2, q.y as y2 from {d_} p join {d_} q on q.frame_id = p.frame_id and q.cluster_label = p.cluster_label and (p.x, p.y) <> (q.x, q.y)
  where not exists (select 1 from {d_} r where {same} and ({turn} < -{flat} or (abs({turn}) <= {flat} and ({along} < 0 or {along} > (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))))"""


for prefix, source, final in (("raw", "labelled", "raw_image"), ("full", "corrected", "full_voted")):
    PARTS[f"{prefix}_image"] = (source, _image(source))
    PARTS[f"{prefix}_conflict"] = (f"{prefix}_image", _conflict(f"{prefix}_image"))
    PARTS[f"{prefix}_voted"] = (f"{prefix}_image {prefix}_conflict", _voted(f"{prefix}_image", f"{prefix}_conflict"))
    PARTS[f"{prefix}_final"] = (f"points {final}", _final(final))
PARTS["drawn_image"] = ("drawn_corrected", _image("drawn_corrected"))
PARTS["drawn_conflict"] = ("drawn_image", _conflict("drawn_image"))
PARTS |= _ordered("turn", "raw_image", "raw_conflict") | _ordered("both", "drawn_image", "drawn_conflict")
PARTS["drawn_final"] = ("points both_voted", _final("both_voted"))
PARTS["obstacles"] = ("full_final", "select * from full_final where label = 2")
PARTS["drawn_obstacles"] = ("drawn_final", "select * from drawn_final where label = 2")
for prefix, source in (("obj", "objects"), ("obs", "obstacles"), ("dob", "drawn_obstacles")):
    PARTS[f"{prefix}_voxels"] = (source, _voxels(source))
    PARTS[f"{prefix}_links"] = (f"{prefix}_voxels", _links(f"{prefix}_voxels"))
    PARTS[f"{prefix}_reach"] = (f"{prefix}_links", f"select distinct src as n, src as m from {prefix}_links union select e.dst, t.m from {prefix}_reach t join {prefix}_links e on e.src = t.n")
    PARTS[f"{prefix}_clusters"] = (f"{prefix}_voxels {prefix}_reach", _labels(f"{prefix}_voxels", f"{prefix}_reach"))
    PARTS[f"{prefix}_hull"] = (f"{prefix}_clusters", _hull(f"{prefix}_clusters"))
    # two directed edges are a flat cluster, which has no polygon
    PARTS[f"{prefix}_ring"] = (f"{prefix}_hull", f"select * from (select *, count(*) over (partition by frame_id, cluster_label) as n from {prefix}_hull) where n >= 3")
    PARTS[f"{prefix}_extent"] = (f"{prefix}_clusters", f"select frame_id, cluster_label, count(*) as n_points, min(z) as z_min, max(z) as z_max from {prefix}_clusters where cluster_label >= 0 group by all")
    PARTS[f"{prefix}_area"] = (f"{prefix}_ring", f"select frame_id, cluster_label, abs(sum(x * y2 - x2 * y)) / 2 as area, count(*) as n from {prefix}_ring group by all")
for prefix in ("obj", "obs"):
    PARTS[f"{prefix}_boxes"] = (
        f"{prefix}_ring",
        f"""select frame_id, cluster_label, arg_min(struct_pack(area := area, l := greatest(su, sw), s := least(su, sw), px := px, py := py, ux := ux, uy := uy, u0 := u0, u1 := u1, w0 := w0, w1 := w1), (round(area, 9), round(greatest(su, sw), 9))) as b from (
  select e.frame_id, e.cluster_label, e.x as px, e.y as py, any_value(e.ux) as ux, any_value(e.uy) as uy, min(t.u) as u0, max(t.u) as u1, min(t.w) as w0, max(t.w) as w1, u1 - u0 as su, w1 - w0 as sw, su * sw as area from (
    select *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) as len, (x2 - x) / len as ux, (y2 - y) / len as uy from {prefix}_ring) e,
  lateral (select (v.x - e.x) * e.ux + (v.y - e.y) * e.uy as u, (v.y - e.y) * e.ux - (v.x - e.x) * e.uy as w from {prefix}_ring v where v.frame_id = e.frame_id and v.cluster_label = e.cluster_label) t
  where e.len >= 1e-6 group by e.frame_id, e.cluster_label, e.x, e.y) group by all""",
    )
PARTS["pca"] = (
    "obj_clusters",
    """select frame_id, cluster_label, any_value(px) as px, any_value(py) as py, any_value(cos(t)) as ux, any_value(sin(t)) as uy, min(u) as u0, max(u) as u1, min(w) as w0, max(w) as w1 from (
  select c.frame_id, c.cluster_label, m.px, m.py, m.t, (c.x - m.px) * cos(m.t) + (c.y - m.py) * sin(m.t) as u, (c.y - m.py) * cos(m.t) - (c.x - m.px) * sin(m.t) as w from obj_clusters c join (
    select frame_id, cluster_label, avg(x) as px, avg(y) as py, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 as t from obj_clusters where cluster_label >= 0 group by all having count(*) >= 2) m using (frame_id, cluster_label)) group by all""",
)
PARTS["runs"] = (
    "points",
    "select * from (select frame_id, point_index, x, y, "
    + ", ".join(f"lead({k}, {i}) over (partition by frame_id order by point_index) as {k}{i}" for i in (1, 2, 3) for k in "xy")
    + " from points) where x3 is not null",
)


def sql(parts: str, select: str) -> str:
    """A query over the named parts and all that they read."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0].split():
                need(n)
            order.append(name)

    for name in parts.split():
        need(name)
    head = ",\n".join(f"{n} as {'' if n.endswith('reach') else 'materialized '}({PARTS[n][1]})" for n in order)
    return f"with recursive {head}\n{select}"


def _turn(p: str, q: str, r: str) -> str:
    t = f"((y{q} - y{p}) * (x{r} - x{q}) - (x{q} - x{p}) * (y{r} - y{q}))"
    return f"(case when abs({t}) < {d(2.0**-52)} then 0 when {t} > 0 then 1 else 2 end)"


def _on(p: str, q: str, r: str) -> str:
    return f"(x{q} between least(x{p}, x{r}) and greatest(x{p}, x{r}) and y{q} between least(y{p}, y{r}) and greatest(y{p}, y{r}))"


def _colours(values: dict[str, tuple], otherwise: tuple | None = None) -> str:
    return ", ".join("case " + " ".join(f"when {k} then {v[i]}" for k, v in values.items()) + (f" else {otherwise[i]}" if otherwise else "") + f" end as {n}" for i, n in enumerate("rgb"))


def _corners(source: str) -> str:
    """Corners of boxes by origin, axis and spans, with both sides."""
    ends = " union all ".join(f"select *, {u} as u, {w} as w from {source}" for u in ("u0", "u1") for w in ("w0", "w1"))
    place = "round(px + u * ux - w * uy, 6) + 0e0 as x, round(py + u * uy + w * ux, 6) + 0e0 as y"
    return f"select frame_id, cluster_label, {place}, round(greatest(u1 - u0, w1 - w0), 6) + 0e0 as length, round(least(u1 - u0, w1 - w0), 6) + 0e0 as width from ({ends})"


def _single(angle: str) -> str:
    """The polynomial's text with 32-bit coefficients, and none of its steps wider."""
    return re.sub(r"(?<![\w.])(-?\d+\.\d+(?:e0)?)", r"(\1::float)", angle)


def _vehicles(prefix: str = "obj") -> str:
    inside = lambda e, b: f"({e} > {d(b[0])} and {e} < {d(b[1])})"
    likely = f"n_points > {VEHICLES.min_points} and {inside('h', VEHICLES.height_m)} and {inside('area * h', VEHICLES.volume_m3)} and area > {d(VEHICLES.min_fill)} * b.area"
    whens = " ".join(f"when {inside('b.l', v.length)} and {inside('b.s', v.width)} and {inside('h', v.height)} and {inside('area * h', v.volume)} and {inside('area', v.area)} then {i}" for i, v in enumerate(CLASSES))
    return f"select frame_id, cluster_label, case when {likely} then case {whens} end end as vehicle_class from (select *, z_max - z_min as h from {prefix}_extent join {prefix}_area using (frame_id, cluster_label) join {prefix}_boxes using (frame_id, cluster_label))"


RADIUS_PAIRS = f"""(select p.frame_id, p.point_index as q_index, t.point_index as t_index, (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z) as d2
  from objects p join objects t on p.frame_id = t.frame_id where d2 <= {d(RADIUS * RADIUS)})"""
KNN = f"""(select *, row_number() over (partition by q_id order by d2, t_id)::int as rank from (select q.vec_id as q_id, t.vec_id as t_id,
  list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::double - t.embedding[i]::double) * (q.embedding[i]::double - t.embedding[i]::double))) as d2
  from embeddings q, embeddings t where q.vec_id % 20 = 0) qualify rank <= {NEAREST})"""


EVERY = KNN[KNN.index("select q.vec_id") : KNN.index(") qualify")]
SHAPES = "select frame_id, cluster_label, n_points, round(z_min, 6) + 0e0 as z_min, round(z_max, 6) + 0e0 as z_max, round(coalesce(area, 0), 6) + 0e0 as hull_area, coalesce(n, 0) * 6 as n_endpoints from {p}_extent left join {p}_area using (frame_id, cluster_label)"


def oracle_sql() -> dict[str, str]:
    gap = "(p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z)"
    reach = "greatest(sqrt(p.x * p.x + p.y * p.y) * 0.02e0, 0.1e0)"
    rings = {f"ring % 8 = {i}": c for i, c in enumerate(RING_COLOURS)}
    labels = {f"label = {k}": LABEL_COLOURS[k] for k in (1, 2)}
    ring_sql = sql("ringed", "select frame_id, ring, count(*) as n_points from ringed group by all")
    meet = f"(({_turn('', '1', '2')} <> {_turn('', '1', '3')} and {_turn('2', '3', '')} <> {_turn('2', '3', '1')})"
    meet += f" or ({_turn('', '1', '2')} = 0 and {_on('', '2', '1')}) or ({_turn('', '1', '3')} = 0 and {_on('', '3', '1')})"
    meet += f" or ({_turn('2', '3', '')} = 0 and {_on('2', '', '3')}) or ({_turn('2', '3', '1')} = 0 and {_on('2', '1', '3')}))"
    cross = "((x1 - x) * (y2 - y) - (y1 - y) * (x2 - x))"
    return {
        "derived_points": sql("points", "select * from points"),
        "ring_assign": sql("ringed", "select frame_id, point_index, ring from ringed"),
        "ring_histogram": ring_sql,
        "ring_colour": sql("ringed", f"select frame_id, point_index, {_colours(rings)} from ringed"),
        "label_colour": sql("labelled", f"select frame_id, point_index, {_colours(labels, LABEL_COLOURS[0])} from labelled"),
        "polar_grid": sql("grid", "select frame_id, point_index, azimuth_index, radial_index, height_index, width_index from grid"),
        "cell_robust_min": sql("cells", "select frame_id, azimuth_index, radial_index, round(z_min, 6) + 0e0 as z_min from cells"),
        "recm_elevation": sql("elevations", "select frame_id, azimuth_index, radial_index, round(elevation, 6) + 0e0 as elevation from elevations"),
        "recm_elevation_32": sql("cells single_reach", "select frame_id, azimuth_index, radial_index, elevation from cells join single_reach using (frame_id, azimuth_index, radial_index)"),
        "recm_labels": sql("labelled", "select frame_id, point_index, label from labelled"),
        "ransac_plane_ranks": sql("planes", "select frame_id, iteration::int as iteration, inliers, " + ", ".join(f"round({k}, 6) + 0e0 as {k}" for k in "abcd") + " from planes"),
        "ransac_labels": sql("corrected", "select frame_id, point_index, label from corrected"),
        "range_image": sql("raw_image", "select frame_id, height_index, width_index, point_index, label from raw_image"),
        "dilate_conflict": sql("raw_conflict", "select frame_id, height_index, width_index from raw_conflict"),
        "jcp_simultaneous": sql("raw_voted", "select frame_id, height_index, width_index, label from raw_voted"),
        "point_labels": sql("full_final", "select frame_id, point_index, label from full_final"),
        "frame_summary": sql("full_final", "select frame_id, count(*) as n_points, count(*) filter (label = 1) as n_ground, count(*) filter (label = 2) as n_obstacle, count(*) filter (label = 0) as n_unknown from full_final group by all"),
        "label_split_counts": sql("raw_final", "select frame_id, case label when 1 then 'ground' when 2 then 'obstacle' else 'unknown' end as label, count(*) as n_points from raw_final group by all"),
        "spherical_coords": sql("points", "select frame_id, point_index, round(sqrt(x * x + y * y + z * z), 6) + 0e0 as range_m, round(case when atan2(y, x) < 0 then degrees(atan2(y, x)) + 360e0 else degrees(atan2(y, x)) end, 6) + 0e0 as azimuth, round(degrees(atan2(z, sqrt(x * x + y * y))) + 90e0, 6) + 0e0 as elevation from points"),
        "voxel_distinct": sql("obj_voxels", "select distinct frame_id, range_index, azimuth_index, elevation_index from obj_voxels"),
        "voxel_edges": sql("obj_links", "select frame_id, src::varchar as src, dst::varchar as dst from obj_links where src < dst"),
        "cluster_labels": sql("obj_clusters", "select frame_id, point_index, cluster_label from obj_clusters"),
        "cluster_sizes": sql("obj_extent", "select frame_id, cluster_label, n_points from obj_extent"),
        "cluster_extent": sql("obj_extent", "select frame_id, cluster_label, n_points, round(z_min, 6) + 0e0 as z_min, round(z_max, 6) + 0e0 as z_max from obj_extent"),
        "convex_hull_vertices": sql("obj_ring", "select frame_id, cluster_label, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y from obj_ring"),
        "hull_area": sql("obj_area", "select frame_id, cluster_label, round(area, 6) + 0e0 as area from obj_area"),
        "min_area_box": sql("obj_boxes", "select frame_id, cluster_label, round(b.area, 6) + 0e0 as area from obj_boxes"),
        "pca_box": sql(
            "obj_clusters",
            """select frame_id, cluster_label, round((max(u) - min(u)) * (max(w) - min(w)), 6) + 0e0 as area from (
  select c.frame_id, c.cluster_label, (c.x - m.px) * cos(m.t) + (c.y - m.py) * sin(m.t) as u, (c.y - m.py) * cos(m.t) - (c.x - m.px) * sin(m.t) as w from obj_clusters c join (
    select frame_id, cluster_label, avg(x) as px, avg(y) as py, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 as t from obj_clusters where cluster_label >= 0 group by all) m using (frame_id, cluster_label)) group by all""",
        ),
        "vehicle_class": sql("obj_extent obj_area obj_boxes", _vehicles()),
        "outline_segments": sql("obj_ring obj_extent", "select frame_id, cluster_label, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y, round(unnest([z_min, z_max, z_min, z_max, z_min, z_max]), 6) + 0e0 as z from obj_ring join obj_extent using (frame_id, cluster_label)"),
        "noise_dror": sql("points", f"select p.frame_id, p.point_index, case when count(*) filter ({gap} <= {reach} * {reach}) < 4 then 1 else 0 end as noise from points p join points t on p.frame_id = t.frame_id group by all"),
        "radius_search": sql("objects", f"select frame_id, q_index, t_index, round(d2, 6) + 0e0 as d2 from {RADIUS_PAIRS}"),
        "radius_search_capped": sql("objects", f"select frame_id, q_index as point_index, least(count(*), {MOST}) as n from {RADIUS_PAIRS} group by frame_id, q_index"),
        "knn_embeddings": f"select q_id, t_id, rank, round(d2, 6) + 0e0 as d2 from {KNN}",
        "radius_embeddings": f"select q_id, count(*) as n from ({EVERY}) where d2 <= 1.0e0 group by q_id",
        "radius_search_any": sql("objects", f"select frame_id, q_index, t_index, round(d2, 6) + 0e0 as d2 from {RADIUS_PAIRS} qualify row_number() over (partition by frame_id, q_index order by t_index) <= {MOST}"),
        "radius_search_nearest": sql("objects", f"select frame_id, q_index, t_index, round(d2, 6) + 0e0 as d2 from {RADIUS_PAIRS} qualify row_number() over (partition by frame_id, q_index order by d2, t_index) <= {MOST}"),
        "ransac_plane_draws": sql("drawn_planes", "select frame_id, iteration::int as iteration, inliers, " + ", ".join(f"round({k}, 6) + 0e0 as {k}" for k in "abcd") + " from drawn_planes"),
        "jcp_ordered": sql("turn_voted", "select frame_id, height_index, width_index, label from turn_voted"),
        "antipodal_pairs": sql(
            "obj_ring",
            """select distinct e.frame_id, e.cluster_label, round(least((t.x, t.y), (v.x, v.y))[1], 6) + 0e0 as x1, round(least((t.x, t.y), (v.x, v.y))[2], 6) + 0e0 as y1, round(greatest((t.x, t.y), (v.x, v.y))[1], 6) + 0e0 as x2, round(greatest((t.x, t.y), (v.x, v.y))[2], 6) + 0e0 as y2
  from obj_ring e join (select o.*, i.x as x0, i.y as y0 from obj_ring o join obj_ring i on i.frame_id = o.frame_id and i.cluster_label = o.cluster_label and (i.x2, i.y2) = (o.x, o.y)) v using (frame_id, cluster_label),
  lateral (select e.x, e.y union all select e.x2, e.y2) t
  where (e.x2 - e.x) * (v.y - v.y0) - (e.y2 - e.y) * (v.x - v.x0) >= 0 and (e.x2 - e.x) * (v.y2 - v.y) - (e.y2 - e.y) * (v.x2 - v.x) <= 0 and (t.x, t.y) <> (v.x, v.y)""",
        ),
        "hull_centroid": sql("obj_ring", "select frame_id, cluster_label, round(avg(x), 9) + 0e0 as x, round(avg(y), 9) + 0e0 as y from obj_ring group by all"),
        "min_area_corners": sql("obj_boxes", _corners("(select frame_id, cluster_label, unnest(b) from obj_boxes)")),
        "pca_corners": sql("pca", _corners("pca")),
        "max_ring": sql("ringed", "select frame_id, max(ring) as max_ring from ringed group by all"),
        "ring_major_order": sql("ringed", "select frame_id, row_number() over (partition by frame_id order by ring, point_index) - 1 as place, point_index, ring from ringed"),
        "cluster_major_order": sql("obj_clusters", "select frame_id, row_number() over (partition by frame_id order by cluster_label, point_index) - 1 as place, point_index, cluster_label from obj_clusters where cluster_label >= 0"),
        "cluster_colour": sql("obj_clusters", "select frame_id, point_index, " + ", ".join(f"((((cluster_label + 1)::bigint * 2654435761) % 4294967296) >> {k} & 255)::int as {n}" for n, k in (("r", 24), ("g", 16), ("b", 8))) + " from obj_clusters where cluster_label >= 0"),
        "cluster_count": sql("obj_clusters", "select frame_id, count(distinct cluster_label) as n_clusters from obj_clusters where cluster_label >= 0 group by all"),
        "frame_extents": sql("points", "select frame_id, round(max(sqrt(x * x + y * y + z * z)), 6) + 0e0 as max_range, round(max(case when atan2(y, x) < 0 then degrees(atan2(y, x)) + 360e0 else degrees(atan2(y, x)) end), 6) + 0e0 as max_azimuth, round(max(degrees(atan2(z, sqrt(x * x + y * y))) + 90e0), 6) + 0e0 as max_elevation from points group by all"),
        "stamps": "select event_id, epoch_us(make_timestamp((event_id % 100000) * 1000000 + ((event_id * 7919 % 1000000000) // 1000))) as micros from events",
        "atan2_approx_32": sql("points", f"select frame_id, point_index, angle_ as angle from (select frame_id, point_index, {_single(ANGLE)} from (select frame_id, point_index, x::float as x, y::float as y from points))"),
        "pcd_scan": sql("points", "select frame_id, point_index, x, y, z from points"),
        "pointcloud2_roundtrip": sql("ringed", "select frame_id, point_index, x, y, z, ring from ringed"),
        "coloured_cloud": sql("labelled", "select frame_id, point_index, " + "case " + " ".join(f"when label = {k} then {c[0] << 16 | c[1] << 8 | c[2]}" for k, c in LABEL_COLOURS.items()) + " end as rgb from labelled"),
        "stream_labels": sql("points raw_image", "select frame_id, point_index, coalesce(i.label, 0) as label, case i.label when 1 then 'ground' when 2 then 'obstacle' else 'unsegmented' end as cloud from points left join raw_image i using (frame_id, point_index)"),
        "pipeline_default": sql("dob_extent dob_area", SHAPES.format(p="dob")),
        "pipeline_boxes": sql("obs_extent obs_area obs_boxes", f"select e.frame_id, e.cluster_label, v.vehicle_class, case when v.vehicle_class is not null then 24 else coalesce(a.n, 0) * 6 end as n_endpoints from obs_extent e left join obs_area a using (frame_id, cluster_label) left join ({_vehicles('obs')}) v using (frame_id, cluster_label)"),
        "knn_points": sql("objects", f"select frame_id, q_id, rank::int as rank, round(d2, 6) + 0e0 as d2 from (select p.frame_id, p.point_index as q_id, {gap} as d2, row_number() over (partition by p.frame_id, p.point_index order by {gap}, t.point_index) as rank from objects p join objects t on p.frame_id = t.frame_id where p.point_index % 20 = 0) where rank <= 3"),
        "atan2_approx": sql("points", f"select frame_id, point_index, angle_ as angle from (select frame_id, point_index, x, y, {ANGLE} from points)"),
        "orientation": sql("runs", f"select frame_id, point_index, case when {cross} > 0 then 0 when {cross} < 0 then 1 else 2 end as o, {_turn('', '1', '2')} as o_eps from runs"),
        "segments_intersect": sql("runs", f"select frame_id, point_index, {_on('', '1', '2')} as on_box, {meet} as meet from runs"),
        "triangle_rectangle_area": sql("runs", "select frame_id, point_index, round(abs((x * (y1 - y2) + x1 * (y2 - y) + x2 * (y - y1)) * 0.5e0), 9) as triangle, round(sqrt(((x - x1) * (x - x1) + (y - y1) * (y - y1)) * ((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))), 6) + 0e0 as rectangle, round(sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)), 6) + 0e0 as distance from runs"),
        "map_upsert_last_wins": "select user_id as k, max(event_id) as v from events group by user_id",
        "set_contains": "select user_id, bool_or(event_type = 'purchase') as contained from events group by user_id",
        "pipeline_flagship": sql("obs_extent obs_area", SHAPES.format(p="obs")),
    }
