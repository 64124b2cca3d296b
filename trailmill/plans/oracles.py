"""DuckDB SQL for the catalogue's queries, over the driver's tables as views. Written with joins and windows
throughout, apart from how the operators do it."""

from __future__ import annotations

SIDE, BORDER = "(1.0::double/750)", "(1.0::double/111200)"

NODES = """nodes as (select p_partkey node_id, 5.7::double + p_partkey*7919 % 1000 / 100000.0::double lon,
  45.1::double + p_partkey*104729 % 1000 / 100000.0::double lat from part)"""
WAY_NODES = """way_nodes as (select l_orderkey way_id, l_partkey node_id, row_number() over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 seq from lineitem)"""
TRACK = """track as (select user_id track_id, row_number() over (partition by user_id order by ts, event_id) - 1 seq,
  5.7::double + value/100000.0::double lon, 45.1::double + event_id % 1000/100000.0::double lat,
  (props::json->>'$.k')::double ele from events)"""
WAYS = """ways as (select o_orderkey way_id, case o_orderpriority when '1-URGENT' then 'residential' when '2-HIGH' then 'footway'
  when '3-MEDIUM' then 'steps' when '4-NOT SPECIFIED' then 'motorway' when '5-LOW' then 'track' end highway,
  case o_orderstatus when 'O' then 'yes' when 'F' then 'no' end bicycle,
  c_mktsegment || ' ' || (o_custkey % 10)::varchar as name from orders left join customer on c_custkey = o_custkey)"""
SEGMENTS = f"""{NODES}, {WAY_NODES}, segments as (select way_id, seq, x1, y1, x2, y2 from (select way_id, seq, lon x1, lat y1,
  lead(lon) over w x2, lead(lat) over w y2 from way_nodes join nodes using (node_id) window w as (partition by way_id order by seq)) where x2 is not null)"""


def cell(v: str) -> str:
    fine = f"round({v}*255/{SIDE})::bigint"
    return f"floor({fine}/255.0::double)::bigint"


def cut(source: str, key: str) -> str:
    """parts(key, seq, x1, y1, x2, y2): the source's segments cut on the grid."""
    between = lambda a, b: f"generate_series(floor(least({a},{b})/{SIDE})::bigint, ceil(greatest({a},{b})/{SIDE})::bigint)"
    inside = lambda a, b: f"k > least({a},{b})/{SIDE} and k < greatest({a},{b})/{SIDE}"
    return f"""live as (select * from {source} where x1 <> x2 or y1 <> y2),
 spots as (select {key}, seq, 0.0::double d2, x1 x, y1 y from live
  union select {key}, seq, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), x2, y2 from live
  union select {key}, seq, (x-x1)*(x-x1)+(y-y1)*(y-y1), x, y from (select *, k*{SIDE} x, y1+(k*{SIDE}-x1)/(x2-x1)*(y2-y1) y from (select *, unnest({between("x1", "x2")}) k from live) where {inside("x1", "x2")})
  union select {key}, seq, (x-x1)*(x-x1)+(y-y1)*(y-y1), x, y from (select *, k*{SIDE} y, x1+(k*{SIDE}-y1)/(y2-y1)*(x2-x1) x from (select *, unnest({between("y1", "y2")}) k from live) where {inside("y1", "y2")})),
 parts as (select {key}, seq, part, x1, y1, x2, y2 from (select {key}, seq, row_number() over w - 1 part, x x1, y y1, lead(x) over w x2, lead(y) over w y2
  from spots window w as (partition by {key}, seq order by d2, x, y)) where x2 is not null)"""


def tiles(source: str, key: str, x: str, y: str, name: str) -> str:
    """name(key, tx, ty): the tiles that each point belongs to."""
    return f"""{name} as (select {key}, kx+i tx, ky+j ty from (select {key}, {x} x, {y} y, {cell(x)} kx, {cell(y)} ky from {source}),
  (values (-1),(0),(1)) a(i), (values (-1),(0),(1)) b(j)
  where (i = 0 or (i = -1 and x - kx*{SIDE} < {BORDER}) or (i = 1 and (kx+1)*{SIDE} - x < {BORDER}))
    and (j = 0 or (j = -1 and y - ky*{SIDE} < {BORDER}) or (j = 1 and (ky+1)*{SIDE} - y < {BORDER})))"""


def edges(source: str = "segments", key: str = "way_id", name: str = "edges") -> str:
    one, two = tiles("parts", f"{key}, seq, part", "x1", "y1", "t1"), tiles("parts", f"{key}, seq, part", "x2", "y2", "t2")
    on = f"{key}, seq, part"
    return f"""{cut(source, key)}, {one}, {two},
 {name} as (select {on}, tx, ty, x1, y1, x2, y2 from parts join (select {on}, min(row(tx, ty)) t from (select * from t1 intersect select * from t2) group by {on}) using ({on}), lateral (select t[1] tx, t[2] ty))"""


EDGES = f"{SEGMENTS}, {edges()}"
_CODE = ", ".join(f"least(255, greatest(0, round(({v}{n} - t{v}*{SIDE})*255/{SIDE})))::int c{v}{n}" for n in (1, 2) for v in "xy")
QUANT = f"{EDGES}, quant as (select * from (select way_id, seq, part, tx, ty, {_CODE} from edges) where cx1 <> cx2 or cy1 <> cy2)"
MERGED = f"""{QUANT}, ordered as (select tx, ty, case when (cx1,cy1) <= (cx2,cy2) then cx1 else cx2 end ax, case when (cx1,cy1) <= (cx2,cy2) then cy1 else cy2 end ay,
  case when (cx1,cy1) <= (cx2,cy2) then cx2 else cx1 end bx, case when (cx1,cy1) <= (cx2,cy2) then cy2 else cy1 end by_ from quant),
 lines as (select distinct tx, ty, case when bx <> ax then (by_-ay)::double/(bx-ax) end slope,
  case when bx <> ax then ((bx-ax)*ay-(by_-ay)*ax)::double/(bx-ax) else ax::double end height, ax*256+ay b, bx*256+by_ e from ordered),
 swept as (select *, max(e) over (partition by tx, ty, slope, height order by b, e rows between unbounded preceding and 1 preceding) reached from lines),
 islands as (select *, sum(case when reached is null or b > reached then 1 else 0 end) over (partition by tx, ty, slope, height order by b, e rows unbounded preceding) island from swept),
 merged as (select tx, ty, (b//256)::int cx1, (b%256)::int cy1, (e//256)::int cx2, (e%256)::int cy2 from (select tx, ty, min(b) b, max(e) e from islands group by tx, ty, slope, height, island))"""
PER_TILE = "select tx, ty, count(*) n_edges from {} group by tx, ty"
RECT, VIEW = "tx between 4276 and 4279 and ty between 33826 and 33829", "tx between 4277 and 4279 and ty between 33827 and 33829"
INTERESTS = f"""{NODES}, interests as (select case c_mktsegment when 'BUILDING' then 1 when 'FURNITURE' then 2 when 'MACHINERY' then 3 end as type, lon, lat
  from nodes join customer on c_custkey = node_id where c_mktsegment in ('BUILDING','FURNITURE','MACHINERY'))"""
_HAV = "2*6371000.0*atan2(sqrt(a), sqrt(1-a))"
LEGS = f"""{TRACK}, legs as (select *, sqrt((lon-px)*(lon-px)+(lat-py)*(lat-py)) degrees,
  (sin(radians(lat-py)/2)*sin(radians(lat-py)/2)+cos(radians(py))*cos(radians(lat))*sin(radians(lon-px)/2)*sin(radians(lon-px)/2)) a
  from (select *, lag(lon) over w px, lag(lat) over w py, lead(lon) over w nx, lead(lat) over w ny from track window w as (partition by track_id order by seq)))"""
GRAPH = f"""{SEGMENTS}, pairs as (select distinct x1, y1, x2, y2 from segments where x1 <> x2 or y1 <> y2),
 roads as (select *, ((round(x1*100000)::bigint%10000*10000+round(y1*100000)::bigint%10000)*10000+round(x2*100000)::bigint%10000)*10000+round(y2*100000)::bigint%10000 edge_id from pairs),
 ends as (select edge_id, x1 x, y1 y, x2 ox, y2 oy from roads union all select edge_id, x2, y2, x1, y1 from roads)"""


def near(points: str, places: str, reach: str, name: str) -> str:
    """name(x, y, nx, ny): points and places in one tile within reach."""
    a, b = tiles(points, "x, y", "x", "y", f"{name}_a"), tiles(places, "x, y", "x", "y", f"{name}_b")
    return f"""{a}, {b}, {name} as (select distinct p.x, p.y, q.x nx, q.y ny from {name}_a p join {name}_b q using (tx, ty)
  where sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) <= {reach})"""


def bearing(x1: str, y1: str, x2: str, y2: str) -> str:
    angle = f"atan2({y2}-{y1}, {x2}-{x1})"
    return f"(case when {angle} < 0 then {angle} + 2*pi() else {angle} end)"


def between(a: str, b: str) -> str:
    return f"least(abs({b}-{a}), 2*pi()-abs({b}-{a}))"


PLACES = "places as (select distinct x, y from ends)"
LEAVING = f"{GRAPH}, {PLACES}, {near('places', 'places', BORDER, 'nearby')}, leaving as (select n.x, n.y, edge_id, ox, oy from nearby n join ends e on e.x = nx and e.y = ny where sqrt((ox-n.x)*(ox-n.x)+(oy-n.y)*(oy-n.y)) > {BORDER})"
STEPS = f"""{LEAVING}, steps as (select way_id track_id, seq, px, py, x, y, qx, qy from (select way_id, seq, lag(lon) over w px, lag(lat) over w py, lon x, lat y, lead(lon) over w qx, lead(lat) over w qy
  from way_nodes join nodes using (node_id) window w as (partition by way_id order by seq)) where px is not null and qx is not null),
 spots2 as (select distinct x, y from steps), {near('spots2', 'places', '0.0001', 'snapped')},
 exits as (select distinct s.x, s.y, ox, oy from snapped s join leaving l on l.x = nx and l.y = ny)"""


def obvious(steps: str, name: str) -> str:
    ahead = bearing("px", "py", "s.x", "s.y")
    taken, turn = between(ahead, bearing("s.x", "s.y", "qx", "qy")), between(ahead, bearing("s.x", "s.y", "ox", "oy"))
    return f"""{name} as (select track_id, seq, n_exits, n_aligned, n_exits <= 2 or n_aligned = 1 obvious from (select track_id, seq, count(ox) n_exits,
  count(*) filter (where ox is not null and {turn} <= {taken} + pi()/10) n_aligned from {steps} s left join exits e on e.x = s.x and e.y = s.y group by track_id, seq))"""


PATH_SEGMENTS = f"""{TRACK}, walk as (select * from (select track_id, seq, lon x1, lat y1, lead(lon) over w x2, lead(lat) over w y2 from track
  window w as (partition by track_id order by seq)) where x2 is not null)"""
_S2 = "(2.0::double/750)"
CELLS = f"""{PATH_SEGMENTS}, turned as (select track_id, abs(y1-y2) > abs(x1-x2) s, case when abs(y1-y2) > abs(x1-x2) then y1 else x1 end u1, case when abs(y1-y2) > abs(x1-x2) then x1 else y1 end v1,
  case when abs(y1-y2) > abs(x1-x2) then y2 else x2 end u2, case when abs(y1-y2) > abs(x1-x2) then x2 else y2 end v2 from walk),
 stops as (select track_id, s, u1 u, v1 v from turned where u1 <> u2 union select track_id, s, u2, v2 from turned where u1 <> u2
  union select track_id, s, k*{_S2}, v1+(k*{_S2}-u1)/(u2-u1)*(v2-v1) from (select *, unnest(generate_series(floor(least(u1,u2)/{_S2})::bigint, ceil(greatest(u1,u2)/{_S2})::bigint)) k from turned where u1 <> u2) where k > least(u1,u2)/{_S2} and k < greatest(u1,u2)/{_S2}),
 cells as (select distinct track_id, case when s then floor(v/{_S2}) else floor(u/{_S2}) end::bigint + i tx, case when s then floor(u/{_S2}) else floor(v/{_S2}) end::bigint + j ty
  from stops, (values (-1),(0),(1)) a(i), (values (-1),(0),(1)) b(j))"""


BOUNDARY = "s as (select track_id, tx+i bx, ty+j by_, tx+a x1, ty+b y1, tx+c x2, ty+d y2 from cells, (values (-1,0,0,0,0,1),(1,0,1,1,1,0),(0,1,0,1,1,1),(0,-1,1,0,0,0)) v(i,j,a,b,c,d))"


def _metres(x1: str, y1: str, x2: str, y2: str) -> str:
    a = f"(sin(radians({y2}-{y1})/2)**2 + cos(radians({y1}))*cos(radians({y2}))*sin(radians({x2}-{x1})/2)**2)"
    return f"2*6371000.0*atan2(sqrt({a}), sqrt(1-{a}))"


INTEREST_CODES = f"""{INTERESTS}, placed as (select type, lon, lat, {cell('lon')} tx, {cell('lat')} ty from interests),
 codes as (select type, tx, ty, least(255, greatest(0, round((lon-tx*{SIDE})*255/{SIDE})))::int cx, least(255, greatest(0, round((lat-ty*{SIDE})*255/{SIDE})))::int cy from placed)"""


def chords(source: str, epsilon: str, allowed: str = "true") -> str:
    """chords(track_id, i, j): vertices of a track (flagged by w, with the flags up to them in n) between which all
    others lie near the chord."""
    l2 = "((b.lon-a.lon)*(b.lon-a.lon)+(b.lat-a.lat)*(b.lat-a.lat))"
    t = f"least(1.0, greatest(0.0, ((p.lon-a.lon)*(b.lon-a.lon)+(p.lat-a.lat)*(b.lat-a.lat))/{l2}))"
    return f"""chords as (select a.track_id, a.seq i, b.seq j from {source} a join {source} b on a.track_id = b.track_id and b.seq > a.seq and {allowed} where not exists (
  select 1 from {source} p where p.track_id = a.track_id and p.seq > a.seq and p.seq < b.seq and (case when {l2} = 0 then (p.lon-a.lon)*(p.lon-a.lon)+(p.lat-a.lat)*(p.lat-a.lat)
  else (a.lon+(b.lon-a.lon)*{t}-p.lon)**2 + (a.lat+(b.lat-a.lat)*{t}-p.lat)**2 end) > {epsilon}*{epsilon}))"""


#: From starts(track_id, s) over chords to stops(track_id, s, e): the vertices of the ways with the fewest hops.
FEWEST = """hops as (select track_id, s, s v, 0 h from starts union select c.track_id, s, c.j, h + 1 from hops join chords c on c.track_id = hops.track_id and c.i = v where h < 100),
 least_hops as (select track_id, s, v, min(h) h from hops group by track_id, s, v),
 came as (select b.track_id, b.s, b.v, min(c.i) p from chords c join least_hops b on b.track_id = c.track_id and b.v = c.j join least_hops a on a.track_id = c.track_id and a.s = b.s and a.v = c.i where a.h + 1 = b.h group by b.track_id, b.s, b.v),
 walked as (select track_id, s, e v from stops union all select walked.track_id, walked.s, p from walked join came using (track_id, s, v))"""

LINKS = f"""{NODES}, links as (select node_id a, node_id*m+p b, (node_id % q + 1)::double length from nodes, (values (2,0,5),(2,1,7),(3,0,3)) v(m,p,q) where node_id*m+p in (select node_id from nodes))"""
REQUESTS = """requests as (select node_id request_id, node_id node, node_id * 5 % 7 street, lon x, lat y from nodes where node_id between 1 and 40),
 ends as (select request_id, source, n[2] node from (select request_id, any_value(r.node) source, min(row((t.lon-x)*(t.lon-x)+(t.lat-y)*(t.lat-y), t.node_id)) n
  from requests r join nodes t on t.node_id > 40 and t.node_id % 7 = street group by request_id))"""


def oracle_sql() -> dict[str, str]:
    street_ways = f"{WAYS}, street_ways as (select name, way_id from ways where name is not null)"
    streets = f"{street_ways}, names as (select name, count(distinct way_id) n_ways from street_ways group by name), blocks as (select name, n_ways, ((row_number() over (order by name) - 1) // (select ceil(sqrt(count(*)))::bigint from names)) block from names)"
    path_edges = f"{MERGED}, {TRACK}, walk as (select * from (select track_id, seq, lon x1, lat y1, lead(lon) over w x2, lead(lat) over w y2 from track window w as (partition by track_id order by seq)) where x2 is not null)"
    walk_edges = edges("walk", "track_id", "walk_edges")
    for name in ("live", "spots", "parts", "t1", "t2"):
        walk_edges = walk_edges.replace(f"{name} as (", f"w_{name} as (").replace(f" from {name}", f" from w_{name}").replace(f"* from {name} ", f"* from w_{name} ")
    both = f"{STEPS}, back as (select track_id, seq, qx px, qy py, x, y, px qx, py qy from steps), {obvious('steps', 'there')}, {obvious('back', 'again')}"
    crossroads = "crossroads as (select x, y, count(*) exits from (select distinct x, y, ox, oy from ends) group by x, y having count(*) > 2)"
    return {
        "way_filter": f"with {WAYS} select way_id, highway from ways where highway not in ('raceway','steps') and (highway <> 'footway' or coalesce(bicycle = 'yes', false)) and highway not in ('motorway','trunk','trunk_link','motorway_link')",
        "motorway_filter": f"with {WAYS} select way_id, coalesce(highway not in ('motorway','trunk','trunk_link','motorway_link'), false) kept from ways",
        "piste_levels": "select o_orderkey, case when o_orderstatus = 'P' then 4 when o_orderpriority = '1-URGENT' then 3 when o_orderpriority = '2-HIGH' then 1 when o_orderpriority = '3-MEDIUM' then 0 end::int piste from orders",
        "interest_match": f"with {INTERESTS} select type, lon, lat from interests",
        "node_degree": f"with {WAY_NODES} select node_id, count(*) degree from way_nodes group by node_id",
        "used_nodes": f"with {NODES}, {WAY_NODES} select node_id from nodes where node_id in (select node_id from way_nodes)",
        "way_split": f"""with {WAY_NODES}, deg as (select node_id, count(*) d from way_nodes group by node_id),
 c as (select w.*, d > 1 and row_number() over (partition by way_id order by seq) > 1 is_cut from way_nodes w join deg using (node_id)),
 p as (select *, coalesce(sum(is_cut::int) over (partition by way_id order by seq rows between unbounded preceding and 1 preceding), 0)::bigint piece from c),
 q as (select way_id, piece, seq, node_id from p union all select way_id, piece + 1, seq, node_id from p where is_cut)
 select way_id, piece, seq, node_id from (select *, count(*) over (partition by way_id, piece) n from q) where n >= 2""",
        "edges_from_ways": f"with {SEGMENTS} select * from segments",
        "grid_crossings": f"with {SEGMENTS}, {cut('segments', 'way_id')} select way_id, count(*) n_parts, round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))), 9) length from parts group by way_id",
        "tile_assign": f"with p as (select vec_id point_id, embedding[1]::double x, embedding[2]::double y from embeddings) select point_id, {cell('x')} floored, round(x*255/{SIDE})::bigint // 255 truncated, {cell('y')} ty from p",
        "tile_neighbours": f"with {NODES}, {tiles('nodes', 'node_id', 'lon', 'lat', 't')} select * from t",
        "common_tile": f"with {EDGES} select way_id, tx, ty, count(*) n from edges group by way_id, tx, ty",
        "edge_tile_histogram": f"with {EDGES} {PER_TILE.format('edges')}",
        "quantise": f"with {QUANT} select way_id, seq, tx, ty, cx1, cy1, cx2, cy2 from quant",
        "dequantise": f"with {NODES}, c as (select node_id, lon, {cell('lon')} t from nodes), q as (select *, least(255, greatest(0, round((lon-t*{SIDE})*255/{SIDE})))::int code from c) select node_id, code, round(t*{SIDE} + code/255.0::double*{SIDE} - lon, 12) error from q",
        "collinear_merge": f"with {MERGED} select * from merged",
        "tile_prefix": f"with {MERGED}, n as ({PER_TILE.format('merged')}), box as (select min(tx) x0, max(tx) x1, min(ty) y0 from n) select (ty-y0)*(x1-x0+1)+tx-x0 tile_no, tx, ty, n_edges, (sum(n_edges) over (order by ty, tx))::bigint as \"end\" from n, box",
        "map_stats": f"with {MERGED}, n as ({PER_TILE.format('merged')}) select (4*sum(n_edges))::bigint n_bytes, count(*) n_tiles, max(n_edges) max_edges from n",
        "corridor_clip": f"with {path_edges}, {walk_edges}, wanted as (select distinct tx+i tx, ty+j ty from walk_edges, (values (-1),(0),(1)) a(i), (values (-1),(0),(1)) b(j)) select tx, ty, count(*) n_edges from merged semi join wanted using (tx, ty) group by tx, ty",
        "rect_clip": f"with {MERGED} select tx, ty, count(*) n_edges from merged where {RECT} group by tx, ty",
        "viewport_tiles": f"with {MERGED} select * from merged where {VIEW}",
        "fit_bounds": f"with {MERGED} select min(tx) x0, min(ty) y0, max(tx)-min(tx)+1 width, max(ty)-min(ty)+1 height from merged where {RECT}",
        "bbox": f"with {NODES} select min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 from nodes",
        "interests_tiled": f"""with {INTEREST_CODES}, n as (select tx, ty, (sum(count(*)) over (order by ty, tx))::bigint ends from codes group by tx, ty)
 select tx, ty, ends as "end", (row_number() over (partition by tx, ty order by type, cx, cy) - 1)::int number, type, cx, cy from codes join n using (tx, ty)""",
        "kept_streets": f"with {EDGES}, {street_ways} select name, count(distinct way_id)::int n_ways, min(way_id) first_way from street_ways where way_id in (select way_id from edges where {RECT}) group by name",
        "street_blocks": f"with {streets} select * from blocks",
        "street_menu": f"with {streets} select block, min(name) label, count(*) n from blocks group by block",
        "spur_removal": f"""with {TRACK}, b as (select track_id, seq*2 seq, lon, lat from track union all select track_id, seq*2+1, lon, lat from track where seq % 4 = 1),
 w as (select track_id, seq, case when seq % 2 = 1 then lag(lon, 2) over o else lon end lon, case when seq % 2 = 1 then lag(lat, 2) over o else lat end lat from b window o as (partition by track_id order by seq)),
 v as (select * from w where lon is not null),
 m as (select *, lag(lon) over o px, lag(lat) over o py, lead(lon) over o nx, lead(lat) over o ny from v window o as (partition by track_id order by seq))
 select track_id, count(*) n, sum(seq)::bigint sum_seq from m where not coalesce(px = nx and py = ny and sqrt((lon-px)*(lon-px)+(lat-py)*(lat-py)) < 0.002, false) group by track_id""",
        "sharp_turns": f"""with {LEGS}, t as (select track_id, seq, atan2(ny-lat, nx-lon) - atan2(lat-py, lon-px) d from legs where px is not null and nx is not null),
 u as (select track_id, seq, case when d < 0 then d + 2*pi() else d end turn from t) select track_id, seq, round(turn, 9) turn from u where turn > 80*pi()/180 and turn < 2*pi() - 80*pi()/180""",
        "leg_haversine": f"with {LEGS} select track_id, round(coalesce(sum({_HAV}), 0), 3) metres, round(coalesce(sum(degrees), 0), 9) degrees from legs group by track_id",
        "bearing": f"with {LEGS} select track_id, seq, round({bearing('px', 'py', 'lon', 'lat')}, 9) bearing from legs where px is not null",
        "cumulative_distance": f"with {LEGS} select track_id, seq, round(sum(coalesce(degrees, 0)) over (partition by track_id order by seq), 8) travelled from legs",
        "point_segment_distance": f"""with {SEGMENTS}, s as (select *, 5.705::double px, 45.105::double py, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) l2 from segments),
 t as (select *, least(1.0, greatest(0.0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/nullif(l2, 0))) t from s)
 select way_id, round(min(case when l2 = 0 then sqrt((x1-px)*(x1-px)+(y1-py)*(y1-py)) else sqrt((x1+(x2-x1)*t-px)*(x1+(x2-x1)*t-px)+(y1+(y2-y1)*t-py)*(y1+(y2-y1)*t-py)) end), 9) nearest from t group by way_id""",
        "track_ends": f"with {TRACK} select track_id, min(seq) seq from track group by track_id union select track_id, max(seq) from track group by track_id",
        "waypoint_bitset": f"""with {TRACK}, m as (select t.*, exists (select 1 from track w where w.track_id = t.track_id and w.lon = t.lon and w.lat = t.lat and w.seq % 11 = 0) f from track t)
 select track_id, seq // 8 byte_no, sum(case when f then 1 << (seq % 8) else 0 end)::int bits from m group by track_id, seq // 8""",
        "heights_complete": f"""with {TRACK}, e as (select track_id, seq, lon, lat, case when track_id % 3 = 0 and seq = 5 then null else ele end ele from track),
 h as (select track_id, lon, lat, max_by(ele, seq) height from e where ele is not null group by track_id, lon, lat),
 j as (select e.track_id, height, bool_and(height is not null) over (partition by e.track_id) ok from e left join h using (track_id, lon, lat))
 select track_id, count(*) n, sum(trunc(height))::bigint sum_height from j where ok group by track_id""",
        "spaced_waypoints": f"""with recursive {LEGS}, c as (select track_id, seq, sum(coalesce(degrees, 0)) over (partition by track_id order by seq) travelled from legs),
 kept as (select track_id, seq, travelled from c where seq = 0
  union all select track_id, m[2], m[1] from (select c.track_id, min(row(c.travelled, c.seq)) m from kept k join c on c.track_id = k.track_id and c.seq > k.seq and c.travelled - k.travelled > 0.01 group by c.track_id))
 select track_id, seq from kept""",
        "polyline_arrays": f"with {TRACK} select track_id, (2*seq + k)::int place, case k when 0 then lat else lon end as value from track, (values (0),(1)) t(k)",
        "crossroads": f"with {GRAPH}, {crossroads} select * from crossroads",
        "snap_join": f"with {TRACK}, {NODES}, pts as (select distinct lon x, lat y from track), nds as (select distinct lon x, lat y from nodes), {near('pts', 'nds', '0.0001', 'n')} select track_id, seq, nx, ny from track join n on n.x = lon and n.y = lat",
        "adjacency": f"with {LEAVING} select x, y, edge_id, ox, oy from leaving",
        "nearest_node": f"""with {TRACK}, {NODES}, pts as (select distinct lon x, lat y from track), nds as (select distinct lon x, lat y from nodes), {near('pts', 'nds', '1e9', 'n')},
 best as (select x, y, min(row((nx-x)*(nx-x)+(ny-y)*(ny-y), nx, ny)) b from n group by x, y)
 select track_id*100+seq point_id, b[2] nx, b[3] ny, round(sqrt(b[1]), 12) degrees from track join best on best.x = lon and best.y = lat""",
        "obvious_exits": f"with {STEPS}, {obvious('steps', 'there')} select track_id, seq, n_exits, n_aligned, obvious from there",
        "detect_crossroads": f"""with recursive {both}, {crossroads}, {near('spots2', 'crossroads', '0.0001', 'spotted')},
 doubt as (select track_id, seq from there join again using (track_id, seq) join steps using (track_id, seq) semi join spotted on spotted.x = steps.x and spotted.y = steps.y where not (there.obvious and again.obvious)),
 moved as (select way_id track_id, seq, sum(coalesce(d, 0)) over (partition by way_id order by seq) travelled from (select way_id, seq, sqrt((lon-lag(lon) over w)*(lon-lag(lon) over w)+(lat-lag(lat) over w)*(lat-lag(lat) over w)) d from way_nodes join nodes using (node_id) window w as (partition by way_id order by seq))),
 c as (select m.* from moved m semi join doubt using (track_id, seq)),
 kept as (select track_id, b[2] seq, b[1] travelled from (select track_id, min(row(travelled, seq)) b from c group by track_id)
  union all select track_id, b[2], b[1] from (select c.track_id, min(row(c.travelled, c.seq)) b from kept k join c on c.track_id = k.track_id and c.travelled - k.travelled > 0.0003 group by c.track_id))
 select track_id, seq from kept""",
        "shortest_distance": f"""with recursive {NODES}, links as (select node_id a, node_id*m+p b, (node_id % q + 1)::double length from nodes, (values (2,0,5),(2,1,7),(3,0,3)) v(m,p,q) where node_id*m+p in (select node_id from nodes)),
 r as (select node_id source, node_id node, 0.0::double distance from nodes where node_id % 50 = 1 union select source, b, distance + length from r join links on a = node)
 select source, node, min(distance) distance from r group by source, node""",
        "street_route": f"""with recursive {LINKS}, {REQUESTS},
 r as (select node source, node, 0.0::double distance from requests union select source, b, min(distance + length) from r join links on a = node group by source, b),
 best as (select source, node, min(distance) distance from r group by source, node),
 came as (select t.source, t.node, min(a) previous from best t join links on b = t.node join best f on f.source = t.source and f.node = a where f.distance + length = t.distance and t.node <> t.source group by t.source, t.node),
 back as (select request_id, source, node, 0 step from ends semi join best on best.source = ends.source and best.node = ends.node
  union all select request_id, back.source, previous, step + 1 from back join came on came.source = back.source and came.node = back.node)
 select request_id, step, node from back""",
        "street_nearest": f"with {LINKS}, {REQUESTS} select request_id, node from ends",
        "node_dictionary": f"with {GRAPH} select x, y, row_number() over (order by x, y) - 1 node from (select distinct x, y from ends)",
        "street_tiles": f"""with {EDGES}, {street_ways}, t as (select distinct name, tx, ty, x1, y1, x2, y2 from street_ways join edges using (way_id) where {RECT})
 select name, tx, ty, count(*)::int n_edges, arg_min(x1, row(x1, y1, x2, y2)) first_x, arg_max(y2, row(x1, y1, x2, y2)) last_y from t group by name, tx, ty""",
        "ski_filter": "select o_orderkey, o_orderstatus = 'P' or o_orderpriority in ('1-URGENT', '2-HIGH') kept from orders",
        "piste_subset": """select piste::int piste, count(*) n, min(o_orderkey) first_way from (select o_orderkey, case when o_orderstatus = 'P' then 4 when o_orderpriority = '1-URGENT' then 3
  when o_orderpriority = '2-HIGH' then 1 when o_orderpriority = '3-MEDIUM' then 0 end piste from orders) where piste is not null group by piste""",
        "components": f"""with recursive {NODES}, l as (select node_id a, node_id - node_id % 10 + node_id*3 % 10 b from nodes), u as (select a, b from l union select b, a from l),
 r as (select distinct a node, a reach from u union select r.node, u.b from r join u on u.a = r.reach) select node, min(reach) component from r group by node""",
        "corridor_cells": f"with {CELLS} select * from cells",
        "corridor_boundary_segments": f"""with {CELLS}, {BOUNDARY}
 select s.track_id, x1, y1, x2, y2 from s anti join cells k on k.track_id = s.track_id and k.tx = bx and k.ty = by_""",
        "signed_area": f"""with {TRACK}, c as (select track_id, seq, lon, lat from track union all select track_id, 1000000000, lon, lat from track where seq = 0),
 p as (select track_id, lon x1, lat y1, lead(lon) over w x2, lead(lat) over w y2 from c window w as (partition by track_id order by seq)) select track_id, round(sum(x1*y2-x2*y1)/2, 9) area from p where x2 is not null group by track_id""",
        "view_transform": f"""with {NODES}, d as (select node_id, (lon-5.705::double)*20000.0::double dx, (lat-45.105::double)*20000.0::double dy from nodes)
 select node_id, round(88-(dx*cos(pi()/7)-dy*sin(pi()/7)))::int sx, round(88+(dx*sin(pi()/7)+dy*cos(pi()/7)))::int sy from d""",
        "fix_filter": "select user_id device_id, count(*) n from events where event_id % 50 <> 0 group by user_id",
        "simplify_count": f"""with recursive {TRACK}, chords as (select a.track_id, a.seq i, b.seq j from track a join track b on a.track_id = b.track_id and b.seq > a.seq where not exists (
  select 1 from track p where p.track_id = a.track_id and p.seq > a.seq and p.seq < b.seq and (case when (b.lon-a.lon)*(b.lon-a.lon)+(b.lat-a.lat)*(b.lat-a.lat) = 0 then (p.lon-a.lon)*(p.lon-a.lon)+(p.lat-a.lat)*(p.lat-a.lat)
  else (a.lon+(b.lon-a.lon)*least(1.0, greatest(0.0, ((p.lon-a.lon)*(b.lon-a.lon)+(p.lat-a.lat)*(b.lat-a.lat))/((b.lon-a.lon)*(b.lon-a.lon)+(b.lat-a.lat)*(b.lat-a.lat))))-p.lon)**2
     + (a.lat+(b.lat-a.lat)*least(1.0, greatest(0.0, ((p.lon-a.lon)*(b.lon-a.lon)+(p.lat-a.lat)*(b.lat-a.lat))/((b.lon-a.lon)*(b.lon-a.lon)+(b.lat-a.lat)*(b.lat-a.lat))))-p.lat)**2 end) > 0.001::double*0.001::double)),
 hops as (select track_id, 0::bigint v, 0 h from track where seq = 0 union select c.track_id, c.j, h + 1 from hops join chords c on c.track_id = hops.track_id and c.i = v where h < 100),
 last as (select track_id, max(seq) l from track group by track_id)
 select track_id, min(h) + 1::bigint n from hops join last using (track_id) where v = l and l > 0 group by track_id""",
        "noise_gate": f"""with recursive f as (select user_id d, ts, 5.7::double + value/1000000.0::double lon, 45.1::double + event_id % 1000/10000000.0::double lat from events where event_id % 50 <> 0),
 g as (select d, m[1] ts, m[2] lon, m[3] lat, null::double heading, m[2] ox, m[3] oy from (select d, min(row(ts, lon, lat)) m from f group by d)
  union all select d, m[1], m[2], m[3], atan2(m[3]-oy, m[2]-ox), lon, lat from (select g.d, g.lon, g.lat, g.ox, g.oy, min(row(f.ts, f.lon, f.lat)) m from g join f on f.d = g.d and f.ts > g.ts
   where {_metres("g.lon", "g.lat", "f.lon", "f.lat")} >= 4 group by g.d, g.lon, g.lat, g.ox, g.oy))
 select d device_id, epoch_us(ts) ts_us, lon, lat, round(heading, 9) heading from g""",
        "simplify_path": f"""with recursive {TRACK}, {chords("track", "0.001::double")}, starts as (select track_id, 0::bigint s from track where seq = 0), stops as (select track_id, 0::bigint s, max(seq) e from track group by track_id), {FEWEST},
 kept as (select track.track_id, seq, lon, lat from walked join track on track.track_id = walked.track_id and seq = v) select * from kept where track_id in (select track_id from kept group by track_id having count(distinct row(lon, lat)) > 1)""",
        "simplify_around_waypoints": f"""with recursive {TRACK}, flagged as (select t.*, exists (select 1 from track w where w.track_id = t.track_id and w.lon = t.lon and w.lat = t.lat and w.seq % 13 = 0) w from track t),
 counted as (select *, sum(w::int) over (partition by track_id order by seq) n from flagged), {chords("counted", "0.001::double", "b.n - b.w::int = a.n")},
 starts as (select track_id, seq s from counted where w), stops as (select track_id, s, e from (select track_id, seq s, lead(seq) over (partition by track_id order by seq) e from counted where w) where e is not null), {FEWEST},
 kept as (select track_id, v seq from walked union select track_id, seq from counted where n = (select max(n) from counted c where c.track_id = counted.track_id))
 select track_id, seq, lon, lat from track semi join kept using (track_id, seq)""",
        "svg_layers": f"""with {MERGED}, {TRACK},
 ends as (select tx*{SIDE} + cx1/255.0::double*{SIDE} x1, (ty*{SIDE} + cy1/255.0::double*{SIDE})*-1 y1, tx*{SIDE} + cx2/255.0::double*{SIDE} x2, (ty*{SIDE} + cy2/255.0::double*{SIDE})*-1 y2 from merged)
 select 0::int layer, 'black' color, printf('<line x1=''%.7f'' y1=''%.7f'' x2=''%.7f'' y2=''%.7f''/>', x1, y1, x2, y2) shape from ends
 union all select 1, 'red', printf('<rect fill=''none'' x=''%.7f'' y=''%.7f'' width=''%.7f'' height=''%.7f''/>', tx*{SIDE}, -(ty + 1)*{SIDE}, {SIDE}, {SIDE}) from (select distinct tx, ty from merged)
 union all select 2, 'green', '<polyline fill=''none'' points=' || chr(39) || string_agg(printf('%.7f,%.7f', lon, -lat), ' ' order by seq) || chr(39) || '/>' from track group by track_id""",
        "binary_roundtrip": f"""with {PATH_SEGMENTS}, {edges("walk", "track_id", "walk_edges")}, {INTEREST_CODES},
 own as (select distinct track_id, tx, ty, cx1, cy1, cx2, cy2 from (select track_id, tx, ty, {_CODE} from walk_edges) where cx1 <> cx2 or cy1 <> cy2),
 here as (select distinct track_id, kx+i tx, ky+j ty from (select track_id, {cell("lon")} kx, {cell("lat")} ky from track), (values (-1),(0),(1)) a(i), (values (-1),(0),(1)) b(j)),
 flagged as (select t.*, exists (select 1 from track w where w.track_id = t.track_id and w.lon = t.lon and w.lat = t.lat and w.seq % 13 = 0) w from track t),
 whole as (select track_id from track group by track_id having count(ele) = count(*))
 select track_id, 'point' kind, seq::int number, null::bigint tx, null::bigint ty, lon a, lat b, w::int::double c, null::double d, null::varchar as name from flagged
 union all select track_id, 'height', seq::int, null, null, greatest(-32768, least(32767, trunc(ele))), null, null, null, null from track semi join whole using (track_id)
 union all select track_id, 'edge', (row_number() over (partition by track_id, tx, ty order by cx1, cy1, cx2, cy2) - 1)::int, tx, ty, cx1, cy1, cx2, cy2, null from own
 union all select track_id, 'interest', (row_number() over (partition by track_id, tx, ty order by type, cx, cy) - 1)::int, tx, ty, type, cx, cy, null, null from codes join here using (tx, ty)""",
        "corridor_polygon": f"""with recursive {CELLS}, {BOUNDARY}, sides as (select s.track_id, x1, y1, x2, y2 from s anti join cells k on k.track_id = s.track_id and k.tx = bx and k.ty = by_),
 begun as (select track_id, min(row(x1, y1)) p from sides group by track_id),
 ring as (select s.track_id, x1 x, y1 y, x2 nx, y2 ny, x1 sx, y1 sy, 0 step from begun b join sides s on s.track_id = b.track_id and x1 = p[1] and y1 = p[2]
  union all select track_id, nx, ny, m[2], m[3], sx, sy, step + 1 from (select r.track_id, r.nx, r.ny, r.sx, r.sy, step, min(row((nx-x)*(y2-ny)-(ny-y)*(x2-nx), x2, y2)) m
   from ring r join sides e on e.track_id = r.track_id and x1 = nx and y1 = ny where not (nx = sx and ny = sy) group by r.track_id, r.nx, r.ny, r.sx, r.sy, step)),
 vertices as (select *, coalesce(lag(x) over w, last_value(x) over (w rows between unbounded preceding and unbounded following)) px, coalesce(lag(y) over w, last_value(y) over (w rows between unbounded preceding and unbounded following)) py from ring window w as (partition by track_id order by step)),
 bent as (select track_id, x, y, row_number() over (partition by track_id order by step) - 1 k from vertices where not ((px = x and x = nx) or (py = y and y = ny))),
 closed as (select track_id, k, x, y from bent union all select b.track_id, n, x, y from bent b join (select track_id, count(*) n from bent group by track_id) using (track_id) where k = 0)
 select track_id, k::int seq, x*{_S2} lon, y*{_S2} lat from closed""",
        "accent_strip": "select doc_id, strip_accents(text) as name from documents",
    }
