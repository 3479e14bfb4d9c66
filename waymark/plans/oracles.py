"""The registered queries in DuckDB's SQL, built of named common table expressions."""

from __future__ import annotations

from waymark.plans.views import BOX, LABEL, LAT, LON, OTHER_LON, OTHER_NAME, STOP_NAME, TIME


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * 6371000.0 * asin(sqrt(case when {h} > 1 then 1.0 else {h} end))"


def tidied(s: str) -> str:
    s = f"regexp_replace(upper({s}), '[’'']', '', 'g')"
    for pattern, to in ((r"\s*\(\s*", " ("), (r"\s*\)", ")"), (r"\s*,\s*", ", "), (r"\s*&\s*", " & "), (r"\s*/\s*", "/"), (r"\s+", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return rf"trim(regexp_replace(trim({s}, ' ,&-('), '\(\s*\)', '', 'g'))"


KEY = "regexp_replace(upper({}.name), '[^A-Z0-9]', '', 'g')"
#: More than the rounds that linking takes on these tables; a round without a pair changes nothing.
LINK_ROUNDS = 12

#: Name: (SQL, the expressions it reads). `spans` of a label are as in functions.labels.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "labels": (f"select p_partkey as label_id, {LABEL} as name from part", ()),
    "pts": (f"select l_orderkey as route_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq, l_partkey, {LON} as lon, {LAT} as lat from lineitem", ()),
    "sized": ("select route_id, max(seq) as n from pts group by route_id", ("pts",)),
    "paths": ("select route_id, list([lon, lat] order by seq) as pts from pts group by route_id", ("pts",)),
    "routes": (
        "select o_orderkey as feature_ord, coalesce(la.name, ' ') as orgn, coalesce(lb.name, ' ') as dstn, coalesce(s.n, 0) as n, a.lon as lon0, a.lat as lat0, b.lon as lon1, b.lat as lat1, coalesce(p.pts, []) as pts"
        " from orders left join sized s on s.route_id = o_orderkey left join paths p on p.route_id = o_orderkey left join pts a on a.route_id = o_orderkey and a.seq = 1"
        " left join pts b on b.route_id = o_orderkey and b.seq = s.n left join labels la on la.label_id = a.l_partkey left join labels lb on lb.label_id = b.l_partkey",
        ("pts", "sized", "paths", "labels"),
    ),
    "ends": (
        "select orgn as name, 2 * feature_ord as ord, case when n >= 2 then lon0 end as lon, case when n >= 2 then lat0 end as lat from routes union all"
        " select dstn, 2 * feature_ord + 1, case when n >= 2 then lon1 end, case when n >= 2 then lat1 end from routes",
        ("routes",),
    ),
    "names": ("select name, count(*) as cnt, min(ord) as first_ord from ends group by name", ("ends",)),
    "consensus": ("select name, median(lon) as lon, median(lat) as lat from ends where lon is not null group by name", ("ends",)),
    "v1": (r"select *, regexp_extract_all(name, '\(\s*VIA\b([^)]*)\)?', 1, 'i') as a, regexp_replace(name, '\(\s*VIA\b([^)]*)\)?', ' ', 'gi') as s from names", ("names",)),
    "v2": (
        r"select *, case when regexp_matches(s, '^\s*VIA\b(.+?)\s*-\s*(.+)$', 'i') then regexp_extract(s, '^\s*VIA\b(.+?)\s*-\s*(.+)$', 1, 'i')"
        r" when regexp_matches(s, '^\s*VIA\s+(\S+)\s+(.+)$', 'i') then regexp_extract(s, '^\s*VIA\s+(\S+)\s+(.+)$', 1, 'i') end as b,"
        r" case when regexp_matches(s, '^\s*VIA\b(.+?)\s*-\s*(.+)$', 'i') then regexp_extract(s, '^\s*VIA\b(.+?)\s*-\s*(.+)$', 2, 'i')"
        r" when regexp_matches(s, '^\s*VIA\s+(\S+)\s+(.+)$', 'i') then regexp_extract(s, '^\s*VIA\s+(\S+)\s+(.+)$', 2, 'i') else s end as r from v1",
        ("v1",),
    ),
    "v3": (
        r"select *, case when regexp_matches(r, '^(.*?)\s+VIA\s+(.+)$', 'i') then regexp_extract(r, '^(.*?)\s+VIA\s+(.+)$', 2, 'i') end as c,"
        r" case when regexp_matches(r, '^(.*?)\s+VIA\s+(.+)$', 'i') then regexp_extract(r, '^(.*?)\s+VIA\s+(.+)$', 1, 'i') else r end as rest from v2",
        ("v2",),
    ),
    "split": (
        "select name, cnt, first_ord, rest, regexp_replace(nullif(array_to_string(list_filter(list_transform(list_filter(list_concat(a, [b, c]), lambda x: x is not null), lambda x: trim(x, ' ,&-')), lambda x: x <> ''), ', '), ''),"
        r" '\s+VIA\s+', ', ', 'gi') as via from v3",
        ("v3",),
    ),
    "t1": (f"select *, {tidied('rest')} as t from split", ("split",)),
    "tidy": (
        r"select *, trim(regexp_replace(case when length(t) - length(replace(t, '(', '')) > length(t) - length(replace(t, ')', '')) then trim(regexp_replace(t, '\([^(]*$', '')) else t end, '\s+', ' ', 'g'), ' ,&-') as tidied from t1",
        ("t1",),
    ),
    "aliases": ("select distinct upper(p_name) as alias, regexp_replace(upper(p_name), ' .*$', '') || ' RAILWAY STATION' as target from part where length(p_name) % 5 = 0", ()),
    "preferred": ("select distinct regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as key, 'THE ' || upper(p_name) as display from part where length(p_name) % 4 = 0", ()),
    "aliased": (
        r"select tidy.*, nullif(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(target, tidied), '\bRAILWAY\s+STATION\b', 'STATION', 'gi'), '\bSTATIONS\b', 'STATION', 'g'), '\s+', ' ', 'g')), '') as place"
        " from tidy left join aliases on alias = tidied",
        ("tidy", "aliases"),
    ),
    "known": ("select *, regexp_replace(upper(place), '[^A-Z0-9]', '', 'g') as key from aliased", ("aliased",)),
    "weights": ("select key, place, sum(cnt) as weight from known where place is not null group by key, place", ("known",)),
    "votes": ("select key, place from (select *, row_number() over (partition by key order by weight desc, length(place), place) as r from weights) where r = 1", ("weights",)),
    "displays": ("select votes.key, coalesce(display, place) as canonical from votes left join preferred using (key)", ("votes", "preferred")),
    "dict": ("select known.*, canonical from known left join displays using (key)", ("known", "displays")),
    "members": ("select canonical, dict.name, cnt, first_ord, lon, lat from dict left join consensus using (name) where canonical is not null", ("dict", "consensus")),
    "based": (
        "select *, first_value(lon) over w as blon, first_value(lat) over w as blat, count(*) over (partition by canonical) as n from members window w as (partition by canonical order by cnt desc, first_ord)",
        ("members",),
    ),
    "report": (
        f"select canonical, name, cnt, first_ord, {hav('blon', 'blat', 'lon', 'lat')} as dist_m, coalesce(max({hav('blon', 'blat', 'lon', 'lat')}) over (partition by canonical), 0.0) as spread_m from based where n >= 2",
        ("based",),
    ),
    "named": (
        "select feature_ord, orgn, dstn, o.canonical as canonical_origin, d.canonical as canonical_destination, o.via as via_origin, d.via as via_destination from routes left join dict o on o.name = orgn left join dict d on d.name = dstn",
        ("routes", "dict"),
    ),
    "stops": (
        f"select cast(p_partkey as varchar) as stop_id, cast(p_partkey as varchar) as stop_code, {STOP_NAME} as stop_name, 18 + cast(p_partkey % 2000 as double) / cast(1000 as double) as stop_lon, -35 + cast(p_size % 50 as double) / cast(20 as double) as stop_lat, ' ' as stop_desc from part".replace(
            "as string", "as varchar"
        ),
        (),
    ),
    "stop_times": (f"select l_orderkey as trip_id, l_partkey as stop_id, l_linenumber as stop_sequence, l_suppkey as supplier, {TIME} as arrival_time from lineitem".replace("as string", "as varchar"), ()),
    "calendar": (
        "select 's' || cast(k as varchar) as service_id, case k % 4 when 0 then 'weekdays' when 1 then 'saturdays' when 2 then 'sundays' else 'other' end as label, w as monday, w as tuesday, w as thursday,"
        " cast(k % 4 = 0 as int) as wednesday, cast(k % 4 = 0 as int) as friday, cast(k % 4 = 1 as int) as saturday, cast(k % 4 = 2 as int) as sunday, date '1998-01-01' + cast(k % 90 as int) as start_date,"
        " date '1998-01-01' + cast(k % 90 as int) + cast(k % 40 as int) as end_date from (select s_suppkey as k, cast(case when s_suppkey % 4 = 0 then case when s_suppkey % 3 = 0 then 1 else s_suppkey % 2 end else cast(s_suppkey % 8 = 3 as int) end as int) as w from supplier)",
        (),
    ),
    "reports": ("select user_id % 50 as route_id, value as fare, event_type = 'click' as confirmed, ts, event_id as report_id from events where event_type in ('purchase', 'click')", ()),
    "pickups": ("select event_id as request_id, 18 + cast(event_id * 7 % 2000 as double) / cast(1000 as double) as lon, -35 + cast(user_id * 13 % 2000 as double) / cast(1000 as double) as lat from events where event_type = 'signup'", ()),
    "meeting": ("select s_suppkey as point_id, 18 + cast(s_suppkey * 37 % 2000 as double) / cast(1000 as double) as lon, -35 + cast(s_suppkey * 53 % 2000 as double) / cast(1000 as double) as lat from supplier", ()),
    **{
        f"polar_{t}": (
            f"select * from (select {key}, case when lon * 180 - 3400 > 180 then lon * 180 - 3400 - 360 else lon * 180 - 3400 end as lon, lat + 122.9 as lat from {t}) where lat <= 90 and lon between -180 and 180",
            (t,),
        )
        for t, key in (("pickups", "request_id"), ("meeting", "point_id"))
    },
    "feed_a": ("select p_partkey as id, p_name as name, 18 + cast(p_partkey % 2000 as double) / cast(1000 as double) as lon, -35 + cast(p_size % 5 as double) / cast(20 as double) as lat from part", ()),
    "feed_b": (f"select p_partkey + 1000000 as id, {OTHER_NAME} as name, {OTHER_LON} as lon, -35 + cast(p_size % 5 as double) / cast(20 as double) as lat from part where p_partkey % 11 <> 0", ()),
    "met": (
        f"select a_id, b_id, e as edits, round(m, 3) as dist_m from (select a.id as a_id, b.id as b_id, cast(levenshtein({KEY.format('a')}, {KEY.format('b')}) as int) as e, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} as m from feed_a a join feed_b b on a.lat = b.lat and abs(a.lon - b.lon) < 0.02) where m <= 800 and e <= 2",
        ("feed_a", "feed_b"),
    ),
    # every round takes the pairs that are each other's best among those that are left
    "left0": ("select * from met", ("met",)),
    **{
        f"{name}{n}": (text.format(n=n, m=n - 1), reads)
        for n in range(1, LINK_ROUNDS + 1)
        for name, text, reads in (
            ("took", "select a_id, b_id from (select *, row_number() over (partition by a_id order by edits, dist_m, b_id) as x, row_number() over (partition by b_id order by edits, dist_m, a_id) as y from left{m}) where x = 1 and y = 1", (f"left{n - 1}",)),
            ("left", "select * from left{m} where a_id not in (select a_id from took{n}) and b_id not in (select b_id from took{n})", (f"left{n - 1}", f"took{n}")),
        )
    },
    "links": (" union all ".join(f"select * from took{n}" for n in range(1, LINK_ROUNDS + 1)), tuple(f"took{n}" for n in range(1, LINK_ROUNDS + 1))),
    "pairs": ("select a.s as a, b.s as b, cast(levenshtein(a.s, b.s) as int) as distance from (select distinct p_name as s from part) a, (select distinct p_name as s from part) b where a.s < b.s and levenshtein(a.s, b.s) <= 2", ()),
    "spots": ("select p_name as name, median(18 + cast(p_partkey % 2000 as double) / cast(1000 as double)) as lon, median(-35 + cast(p_size % 50 as double) / cast(20 as double)) as lat from part group by p_name", ()),
    "od": ("select distinct canonical_origin as o, canonical_destination as d from named where canonical_origin is not null and canonical_destination is not null", ("named",)),
    "trips": ("select o_orderkey as trip_id, o_custkey as route_id, 's' || cast(o_custkey % 120 as varchar) as service_id from orders", ()),
    "broken": ("select trip_id from (select *, lag(stop_sequence) over (partition by trip_id order by stop_id, supplier, stop_sequence) as before from stop_times) where stop_sequence <= before", ("stop_times",)),
    "doubled": ("select distinct route_id from (select route_id, lon = lag(lon) over w and lat = lag(lat) over w as same from pts window w as (partition by route_id order by seq)) where same", ("pts",)),
    "unlike": (
        "select service_id from calendar where case label when 'weekdays' then monday + tuesday + wednesday + thursday + friday = 5 and saturday = 0 and sunday = 0 when 'saturdays' then monday + tuesday + wednesday + thursday + friday = 0 and saturday = 1 and sunday = 0"
        " when 'sundays' then monday + tuesday + wednesday + thursday + friday = 0 and saturday = 0 and sunday = 1 end = false",
        ("calendar",),
    ),
    "filed": ("select l_orderkey as trip_id, l_linenumber as stop_sequence, row_number() over () - 1 as row from lineitem", ()),
    "shape_points": (
        "select distinct l_partkey as shape_id, -35 + cast(l_linenumber % 2 as double) as lat, 18 + cast(l_suppkey % 3 as double) as lon, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber as seq from lineitem",
        (),
    ),
    "words": ("select distinct unnest(regexp_split_to_array(s, '[^A-Za-z0-9]+')) as s from (select p_type as s from part union all select p_name from part)", ()),
    "network": (
        "select 'P' || lpad(cast(k as varchar), 9, '0') as o, 'P' || lpad(cast(t as varchar), 9, '0') as d from"
        " (select p_partkey as k, p_partkey + 1 as t from part where p_partkey % 40 <> 0 union all select p_partkey, 2 * p_partkey from part where p_partkey % 7 = 0)",
        (),
    ),
    "chain": ("select d, 0 as t, [o, d] as way from network where o = 'P000000001' union all select e.d, t + 1, list_append(way, e.d) from chain c join network e on e.o = c.d", ("network",)),
    "reach": ("select d, 0 as t from od where o = (select min(o) from od) union select od.d, t + 1 from reach join od on od.o = reach.d where t < (select count(distinct d) from od)", ("od",)),
    "w0": ("select d, [o, d] as way from od where o = (select min(o) from od)", ("od",)),
    "w1": ("select od.d, min(list_append(way, od.d)) as way from w0 join od on od.o = w0.d where od.d not in (select d from w0) group by od.d", ("w0", "od")),
    "w2": ("select od.d, min(list_append(way, od.d)) as way from w1 join od on od.o = w1.d where od.d not in (select d from w0) and od.d not in (select d from w1) group by od.d", ("w0", "w1", "od")),
    "h0": ("select distinct d from od where o = (select min(o) from od)", ("od",)),
    "h1": ("select distinct od.d from h0 join od on od.o = h0.d", ("h0", "od")),
    "h2": ("select distinct od.d from h1 join od on od.o = h1.d", ("h1", "od")),
}


def sql(final: str, *reads: str) -> str:
    """final with the expressions it reads, and what those read, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in PARTS[name][1]:
                add(x)
            order.append(name)

    for x in reads:
        add(x)
    return ("with recursive " + ",\n".join(f"{x} as ({PARTS[x][0]})" for x in order) + "\n" if order else "") + final


TITLE = r"regexp_extract(stop_name, '^(\d+_)?', 0) || array_to_string(list_transform(string_split(regexp_replace(stop_name, '^\d+_', ''), ' '), lambda w: case when regexp_matches(w, '^[A-Z]{1,3}$') or regexp_matches(w, '\d') then w else upper(w[1]) || lower(w[2:]) end), ' ')"
DAYS = "[sunday, monday, tuesday, wednesday, thursday, friday, saturday]"
WEEK = "monday + tuesday + wednesday + thursday + friday"

ORACLE_SQL = {
    "via_paren": sql("select name, array_to_string(a, '|') as clauses, s as rest from v1", "v1"),
    "via_leading_dash": sql(r"select name, b as via, r as rest from v2 where regexp_matches(s, '^\s*VIA\b(.+?)\s*-\s*(.+)$', 'i')", "v2"),
    "via_leading_token": sql(r"select name, b as via, r as rest from v2 where b is not null and not regexp_matches(s, '^\s*VIA\b(.+?)\s*-\s*(.+)$', 'i')", "v2"),
    "via_trailing": sql("select name, c as via, rest from v3 where c is not null", "v3"),
    "via_join": sql("select name, rest as place, via from split", "split"),
    "tidy_label": sql("select name, tidied from tidy", "tidy"),
    "alias_apply": sql("select name, tidied, place from aliased", "aliased"),
    "canonical_key": sql("select name, place, key from known", "known"),
    "title_case": sql(
        f"select stop_id, {TITLE} as stop_name from stops",
        "stops",
    ),
    "prefix_split": sql(r"select stop_id, cast(regexp_extract(stop_name, '^(\d+)_(.*)$', 1) as bigint) as number, regexp_extract(stop_name, '^(\d+)_(.*)$', 2) as base from stops", "stops"),
    "edit_distance_pairs": sql("select * from pairs", "pairs"),
    "token_edit_pairs": sql("select a.s as a, b.s as b, cast(levenshtein(a.s, b.s) as int) as distance from (select distinct unnest(string_split(p_name, ' ')) as s from part) a, (select distinct unnest(string_split(p_name, ' ')) as s from part) b where a.s < b.s and levenshtein(a.s, b.s) <= 2"),
    "edit_distance_far": sql("select a.s as a, b.s as b, cast(levenshtein(a.s, b.s) as int) as distance from (select distinct p_name as s from part) a, (select distinct p_name as s from part) b where a.s < b.s and levenshtein(a.s, b.s) <= 4"),
    "token_edit_far": sql("select a.s as a, b.s as b, cast(levenshtein(a.s, b.s) as int) as distance from words a, words b where a.s < b.s and levenshtein(a.s, b.s) <= 3", "words"),
    "compound_flag": sql(r"select name, regexp_matches(name, '\S\s*[&/]\s*\S|\S-\S|\S\s*,\s*\S') as compound from names", "names"),
    "malformed_flag": sql(r"select name, regexp_matches(name, '^\s|\s$|\s\s') or regexp_matches(name, '\(\s*VIA\b[^)]*$', 'i') as malformed from names", "names"),
    "time_format_check": sql(
        r"select arrival_time, count(*) as n, regexp_matches(arrival_time, '^\d{1,2}:[0-5]\d:[0-5]\d$') as well_formed,"
        r" case when regexp_matches(arrival_time, '^\d{1,2}:[0-5]\d:[0-5]\d$') then cast(cast(split_part(arrival_time, ':', 1) as int) * 3600 + cast(split_part(arrival_time, ':', 2) as int) * 60 + cast(split_part(arrival_time, ':', 3) as int) as int) else -1 end as seconds from stop_times group by arrival_time",
        "stop_times",
    ),
    "haversine": sql(f"select feature_ord, round({hav('lon0', 'lat0', 'lon1', 'lat1')}, 3) as length_m from routes where n >= 2", "routes"),
    "coords_flatten": sql("select feature_ord, case when feature_ord % 7 = 0 or feature_ord % 11 <> 0 and feature_ord % 13 <> 0 then cast(n as bigint) else 0 end as n_points, case when feature_ord % 7 = 0 or feature_ord % 11 <> 0 and feature_ord % 13 <> 0 then lon1 end as last_lon from routes", "routes"),
    "round_coords": sql("select feature_ord, round(list_sum(list_transform(pts, lambda p: round(p[1] / 7, 6))), 6) as sum_lon from routes where n > 0", "routes"),
    "service_dates": sql(f"select service_id, cast(d as varchar) as date from (select *, cast(unnest(generate_series(start_date, end_date, interval 1 day)) as date) as d from calendar) where {DAYS}[cast(dayofweek(d) as int) + 1] = 1", "calendar"),
    "calendar_label_check": sql(
        f"select service_id, label, case label when 'weekdays' then {WEEK} = 5 and saturday = 0 and sunday = 0 when 'saturdays' then {WEEK} = 0 and saturday = 1 and sunday = 0 when 'sundays' then {WEEK} = 0 and saturday = 0 and sunday = 1 end as fits from calendar", "calendar"
    ),
    "endpoint_unpivot": sql("select * from ends", "ends"),
    "name_counts": sql("select * from names", "names"),
    "consensus_location": sql("select name, round(lon, 6) as lon, round(lat, 6) as lat from consensus", "consensus"),
    "form_weights": sql("select key, place, cast(weight as bigint) as weight from weights", "weights"),
    "display_vote": sql("select * from displays", "displays"),
    "place_members": sql("select canonical, count(*) as n, string_agg(name, '|' order by name) as members from dict where canonical is not null group by canonical having count(*) >= 2", "dict"),
    "summary_counts": sql("select count(*) as raw_names, count(distinct canonical) as canonical_places, cast(coalesce(sum(cnt) filter (via is not null), 0) as bigint) as via_endpoint_values from dict", "dict"),
    "merge_report": sql("select canonical, name, cnt, first_ord, round(dist_m, 3) as dist_m, round(spread_m, 3) as spread_m, spread_m > 1000.0 as review from report", "report"),
    "merge_reviews": sql("select distinct canonical, round(spread_m, 3) as spread_m from report where spread_m > 1000.0", "report"),
    "normalise_places": sql("select * from named", "named"),
    "geojson_round_trip": sql(
        "select named.feature_ord as objectid, named.orgn, named.dstn, cast(n as bigint) as n_points, canonical_origin, canonical_destination, via_origin, via_destination, 'a \"quote\", {brace] and \\' || named.orgn as note from named join routes using (feature_ord)",
        "named",
        "routes",
    ),
    "clean_routes": sql(
        "select min(feature_ord) as feature_ord, orgn, dstn, orgn = dstn as is_loop, cast(max(n) as bigint) as n_points, round(any_value(pts[1][1]), 6) as first_lon from routes where trim(orgn) <> '' and trim(dstn) <> '' group by orgn, dstn, pts", "routes"
    ),
    "clean_gtfs": sql(rf"select stop_id, {TITLE} as stop_name, stop_lon, round(stop_lat / 7, 6) as stop_lat, 'stop_id,stop_lat,stop_lon,stop_name' as columns from stops", "stops"),
    "drop_blank_labels": sql("select feature_ord, orgn as \"ORGN\", dstn as \"DSTN\" from routes where trim(orgn) <> '' and trim(dstn) <> ''", "routes"),
    "loop_flag": sql("select feature_ord, orgn = dstn as is_loop from routes", "routes"),
    "blank_profile": sql(
        " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) filter (trim(cast({c} as varchar)) <> '') as n_filled from stops" for c in ("stop_id", "stop_code", "stop_name", "stop_lon", "stop_lat", "stop_desc")), "stops"
    ),
    "redundant_columns": sql("select 'stop_code' as \"column\", 'stop_id' as same_as, bool_and(stop_code is not distinct from stop_id) as redundant from stops union all select 'stop_desc', 'stop_name', bool_and(stop_desc is not distinct from stop_name) from stops", "stops"),
    "bbox_check": sql(f"select stop_id from stops where not (stop_lon > {BOX[0]} and stop_lon < {BOX[1]} and stop_lat > {BOX[2]} and stop_lat < {BOX[3]} and not (stop_lon = 0 and stop_lat = 0))", "stops"),
    "fk_orphans": sql("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)"),
    "unused_parents": sql("select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey"),
    "pk_duplicates": sql("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1"),
    "keep_first_dedupe": sql("select min(doc_id) as doc_id, text from documents group by text"),
    "monotonic_sequence": sql(
        "select trip_id, stop_sequence, before from (select *, lag(stop_sequence) over (partition by trip_id order by stop_id, supplier, stop_sequence) as before from stop_times) where stop_sequence <= before", "stop_times"
    ),
    "consecutive_points": sql("select feature_ord, coalesce(bool_or(same), false) as repeats from (select route_id, lon = lag(lon) over w and lat = lag(lat) over w as same from pts window w as (partition by route_id order by seq)) right join (select o_orderkey as feature_ord from orders) on route_id = feature_ord group by feature_ord", "pts"),
    "sequence_in_file": sql("select trip_id, stop_sequence, before, row from (select *, lag(stop_sequence) over (partition by trip_id order by row) as before from filed) where stop_sequence <= before", "filed"),
    "repeated_points": sql("select shape_id, seq as shape_pt_sequence from (select *, lag(lat) over w as a, lag(lon) over w as b from shape_points window w as (partition by shape_id order by seq)) where lat = a and lon = b", "shape_points"),
    "shape_paths": sql(
        f"select shape_id, count(*) as n_points, round(coalesce(sum({hav('b', 'a', 'lon', 'lat')}), 0.0) / 1000, 3) as length_km from (select *, lag(lat) over w as a, lag(lon) over w as b from shape_points window w as (partition by shape_id order by seq)) group by shape_id", "shape_points"
    ),
    "prefix_gaps": sql(
        r"select * from (select base, number, number - lag(number) over (partition by base order by number) - 1 as gap from (select distinct cast(regexp_extract(stop_name, '^(\d+)_(.*)$', 1) as bigint) as number, regexp_extract(stop_name, '^(\d+)_(.*)$', 2) as base from stops)) where gap > 0", "stops"
    ),
    "od_pairs": sql("select distinct canonical_origin, canonical_destination from named", "named"),
    "od_multipath": sql("select orgn as \"ORGN\", dstn as \"DSTN\", count(distinct pts) as n_paths from routes group by all having count(distinct pts) > 1", "routes"),
    "name_own_spread": sql(f"select name, round(max(m), 3) as max_m, round(median(m), 3) as median_m from (select ends.name, {hav('c.lon', 'c.lat', 'ends.lon', 'ends.lat')} as m from ends join consensus c on c.name = ends.name where ends.lon is not null) group by name", "ends", "consensus"),
    "typo_geo_check": sql(f"select a, b, distance, round({hav('x.lon', 'x.lat', 'y.lon', 'y.lat')}, 3) as dist_m from pairs left join spots x on x.name = a left join spots y on y.name = b", "pairs", "spots"),
    "apply_corrections": sql("select p_partkey, coalesce(now, upper(p_name)) as label from part left join (select distinct upper(p_name) as was, upper(p_name) || ' (CORRECTED)' as now from part where length(p_name) % 3 = 0) on was = upper(p_name)"),
    "label_geometry_mismatch": sql(
        f"select ord, name, canonical, round(m, 3) as dist_m from (select ord, e.name, e.canonical, {hav('clon', 'clat', 'lon', 'lat')} as m from (select ends.*, canonical from ends join dict using (name) where canonical is not null and lon is not null) e"
        " join (select canonical, median(lon) as clon, median(lat) as clat from ends join dict using (name) where canonical is not null and lon is not null group by canonical) c using (canonical)) where m > 90000",
        "ends",
        "dict",
    ),
    "common_schema": sql("select 'routes' as source, cast(feature_ord as varchar) as route_id, orgn as origin, dstn as destination, cast(n as bigint) as n_points from routes union all select 'trips', cast(trip_id as varchar), min(arrival_time), max(arrival_time), count(*) from stop_times group by trip_id", "routes", "stop_times"),
    "integrity_report": sql(
        "select 'orders without lines' as \"check\", count(*) as n_bad from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'repeated line keys', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)"
        f" union all select 'stops outside the box', count(*) from stops where not (stop_lon > {BOX[0]} and stop_lon < {BOX[1]} and stop_lat > {BOX[2]} and stop_lat < {BOX[3]})",
        "stops",
    ),
    "feed_report": sql(
        "".join(
            f"select '{a} without {b}' as \"check\", count(*) as n_bad from {x} where {x}.{k} not in (select {j} from {y}) union all "
            for a, b, x, k, y, j in (
                ("trips", "routes", "trips", "route_id", "customer", "c_custkey"),
                ("routes", "trips", "customer", "c_custkey", "trips", "route_id"),
                ("trips", "calendar", "trips", "service_id", "calendar", "service_id"),
                ("calendar", "trips", "calendar", "service_id", "trips", "service_id"),
                ("stop_times", "trips", "stop_times", "trip_id", "trips", "trip_id"),
                ("trips", "stop_times", "trips", "trip_id", "stop_times", "trip_id"),
                ("stop_times", "stops", "stop_times", "stop_id", "part", "p_partkey"),
                ("stops", "stop_times", "part", "p_partkey", "stop_times", "stop_id"),
            )
        )
        + "".join(
            f"select 'repeated keys of {name}', count(*) from (select 1 from {x} group by {k} having count(*) > 1) union all "
            for name, x, k in (("routes", "customer", "c_custkey"), ("trips", "trips", "trip_id"), ("stops", "stops", "stop_id"), ("calendar", "calendar", "service_id"), ("stop_times", "stop_times", "trip_id, stop_sequence"))
        )
        + r"select 'stop_sequence not rising', count(*) from broken union all select 'times not well formed', count(*) from stop_times where not regexp_matches(arrival_time, '^\d{1,2}:[0-5]\d:[0-5]\d$')"
        + f" union all select 'stops outside the box', count(*) from stops where not (stop_lon > {BOX[0]} and stop_lon < {BOX[1]} and stop_lat > {BOX[2]} and stop_lat < {BOX[3]})"
        + " union all select 'shapes that repeat a point', count(*) from doubled union all select 'services unlike their name', count(*) from unlike",
        "trips",
        "stops",
        "stop_times",
        "calendar",
        "broken",
        "doubled",
        "unlike",
    ),
    "trips_per_route": sql("select c_custkey as route_id, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey"),
    "cardinalities": sql(" union all ".join(f"select '{t}' as \"table\", count(*) as n from {x}" for t, x in (("routes", "customer"), ("trips", "orders"), ("stops", "part"), ("stop_times", "lineitem"), ("calendar", "supplier"), ("shapes", "orders")))),
    "report_lines": sql(
        "select canonical, cast(row_number() over (partition by canonical order by cnt desc, first_ord) as int) as nth, cnt, coalesce(lpad(cast(cast(round_even(dist_m, 0) as bigint) as varchar), 8, ' ') || ' m', '        ?') as metres, name, spread_m > 1000.0 as review from report", "report"
    ),
    "review_lines": sql("select distinct canonical, lpad(cast(cast(round_even(spread_m, 0) as bigint) as varchar), 8, ' ') || ' m' as metres from report where spread_m > 1000.0", "report"),
    "od_counts": sql("select (select count(*) from (select distinct orgn, dstn from named)) as before, (select count(*) from (select distinct canonical_origin, canonical_destination from named)) as after", "named"),
    "route_legs": sql("select d as destination, cast(t as int) as transfers, array_to_string(way, ' > ') as places from (select d, 0 as t, way from w0 union all select d, 1, way from w1 union all select d, 2, way from w2)", "w0", "w1", "w2"),
    "route_match": sql("select d as destination, cast(min(t) as int) as transfers from (select d, 0 as t from h0 union all select d, 1 from h1 union all select d, 2 from h2) group by d", "h0", "h1", "h2"),
    "route_reach": sql("select d as destination, cast(min(t) as int) as transfers from reach group by d", "reach"),
    "route_chain": sql("select d as destination, cast(t as int) as transfers, array_to_string(way, '>') as places from (select *, row_number() over (partition by d order by t, way) as r from chain) where r = 1", "chain"),
    "route_pair": sql("select d as destination, cast(t as int) as transfers, array_to_string(way, '>') as places from (select *, row_number() over (partition by d order by t, way) as r from chain) where r = 1 and d = 'P000000040'", "chain"),
    "fare_consensus": sql("select route_id, count(*) as n_reports, count(*) filter (confirmed) as n_confirmed, arg_max(fare, struct_pack(a := ts, b := report_id)) as latest, median(fare) as typical from reports group by route_id", "reports"),
    "fare_windows": sql("select route_id, date_trunc('hour', ts) as start, count(*) as n_reports, count(*) filter (confirmed) as n_confirmed, arg_max(fare, struct_pack(a := ts, b := report_id)) as latest from reports group by all", "reports"),
    "link_candidates": sql("select * from met", "met"),
    "linked_places": sql(
        "select 'stops' as source, cast(id as varchar) as id, name, lon, lat, 'stops:' || cast(id as varchar) as place from feed_a union all"
        " select 'other', cast(id as varchar), name, lon, lat, coalesce('stops:' || cast(a_id as varchar), 'other:' || cast(id as varchar)) from feed_b left join links on b_id = id",
        "feed_a",
        "feed_b",
        "links",
    ),
    "nearest_points": sql(
        f"select request_id, cast(nth as int) as nth, point_id, round(m, 3) as dist_m from (select *, row_number() over (partition by request_id order by m, point_id) as nth from (select request_id, point_id, {hav('p.lon', 'p.lat', 'm.lon', 'm.lat')} as m from pickups p, meeting m)) where nth <= 3",
        "pickups",
        "meeting",
    ),
    "nearby_polar": sql(
        f"select request_id, point_id, round({hav('p.lon', 'p.lat', 'm.lon', 'm.lat')}, 2) as dist_m from polar_pickups p, polar_meeting m where {hav('p.lon', 'p.lat', 'm.lon', 'm.lat')} <= 40000.0", "polar_pickups", "polar_meeting"
    ),
    "nearby_pickups": sql(f"select request_id, point_id, round({hav('p.lon', 'p.lat', 'm.lon', 'm.lat')}, 3) as dist_m from pickups p join meeting m on {hav('p.lon', 'p.lat', 'm.lon', 'm.lat')} <= 5000.0", "pickups", "meeting"),
}
