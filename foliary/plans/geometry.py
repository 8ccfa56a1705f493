"""Geometry (G) and page quality (Q) over the evidence lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE
from foliary.operators import geometry as geo
from foliary.operators import quality as qual
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.registry import query


def _doc():
    return F.col("doc_id")


# ------------------------------------------------------------------ inputs


def drags(ev: Evidence) -> DataFrame:
    return ev.pages.select(
        *PAGE,
        F.lit(30.0).alias("x"),
        (F.lit(40.0) * (_doc() % F.col("n_lines")) + _doc() % 23).alias("y"),
        F.when(_doc() % 2 == 1, 3000.0).otherwise(200.0).alias("w"),
        ((_doc() % 7) * 30.0 + 20).alias("h"),
        (_doc() % 3 != 0).alias("snap"),
    )


add_duck(
    "drg",
    """select run_id, page_index, 30.0::double as x, (40 * (doc_id % n_lines) + doc_id % 23)::double as y,
              (case when doc_id % 2 = 1 then 3000 else 200 end)::double as w, ((doc_id % 7)*30 + 20)::double as h,
              doc_id % 3 <> 0 as snap from pgs""",
    ["pgs"],
)


def zone_boxes(ev: Evidence) -> DataFrame:
    whole = _doc() % 9 == 0
    free = _doc() % 5 == 0
    n = F.col("n_lines")
    return ev.pages.select(
        *PAGE,
        F.when(whole, 0.0).otherwise(40.0).alias("x"),
        F.when(whole, 0.0).otherwise(100.0).alias("y"),
        F.when(whole, F.col("width").cast("double")).otherwise(1000.0 + _doc() % 977).alias("w"),
        F.when(whole, F.col("height").cast("double")).otherwise((_doc() % 37) * 100.0).alias("h"),
        F.when(whole, 0).when(free, -1).otherwise(_doc() % n).cast("int").alias("from_line"),
        F.when(whole, n - 1).when(free, -1).otherwise(_doc() % n + _doc() % 4).cast("int").alias("to_line"),
    )


add_duck(
    "zbx",
    """select run_id, page_index, width, height, source_id, (case when doc_id % 9 = 0 then 0 else 40 end)::double as x,
              (case when doc_id % 9 = 0 then 0 else 100 end)::double as y,
              (case when doc_id % 9 = 0 then width else 1000 + doc_id % 977 end)::double as w,
              (case when doc_id % 9 = 0 then height else (doc_id % 37)*100 end)::double as h,
              (case when doc_id % 9 = 0 then 0 when doc_id % 5 = 0 then -1 else doc_id % n_lines end)::int as from_line,
              (case when doc_id % 9 = 0 then n_lines - 1 when doc_id % 5 = 0 then -1
                    else doc_id % n_lines + doc_id % 4 end)::int as to_line from pgs""",
    ["pgs"],
)


def broken_lines(ev: Evidence) -> DataFrame:
    k = _doc() + F.col("i")
    return ev.lines.select(
        *PAGE,
        F.col("i").alias("pos"),
        (F.col("i") + F.when(k % 89 == 0, 1).otherwise(0)).alias("i"),
        F.when(k % 79 == 0, -5.0).otherwise(F.col("x")).alias("x"),
        F.when(k % 73 == 0, F.col("y") - 100).otherwise(F.col("y")).alias("y"),
        "w",
        F.when(k % 83 == 0, 0.0).otherwise(F.col("h")).alias("h"),
    )


add_duck(
    "bln",
    """select run_id, page_index, i as pos, (i + case when (doc_id+i) % 89 = 0 then 1 else 0 end)::int as i,
              case when (doc_id+i) % 79 = 0 then -5.0::double else x end as x,
              case when (doc_id+i) % 73 = 0 then y - 100 else y end as y, w,
              case when (doc_id+i) % 83 = 0 then 0.0::double else h end as h from lns""",
    ["lns"],
)


def tall_lines(ev: Evidence) -> DataFrame:
    k = _doc() + F.col("i")
    return ev.lines.withColumn("h", F.when(k % 31 == 0, 60.0).otherwise(F.col("h"))).withColumn(
        "origin", F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("origin"))
    )


add_duck(
    "tln",
    r"""select run_id, page_index, i, text, x, y, w, case when (doc_id+i) % 31 = 0 then 60.0::double else h end as h,
               case when (doc_id+i) % 29 = 0 then null else origin end as origin,
               length(regexp_replace(text,'\s+','','g')) as chars from lns""",
    ["lns"],
)


def ink_rows(ev: Evidence) -> DataFrame:
    """Every row of every line, plus stretches nothing was read in on two pages of ten."""
    printed = ev.lines.select(
        *PAGE, F.explode(F.sequence(F.col("y").cast("int"), F.col("y").cast("int") + 23)).alias("y")
    )
    extra = ev.pages.where("doc_id % 10 <= 1").select(
        *PAGE,
        F.explode(F.sequence(F.lit(3000), F.when(_doc() % 10 == 0, 3399).otherwise(3099))).alias("y"),
    )
    return printed.unionByName(extra).distinct()


add_duck(
    "ink",
    """select run_id, page_index, y::int + k::int as y from lns, unnest(range(24)) t(k)
       union select run_id, page_index, 3000 + k::int as y from pgs, unnest(range(400)) t(k)
       where doc_id % 10 <= 1 and (doc_id % 10 = 0 or k < 100)""",
    ["lns", "pgs"],
)

# ------------------------------------------------------------------ G1 - G5


@query(
    "g1_union_boxes",
    duck(
        "select run_id, page_index, min(x) as x, min(y) as y, max(x+w)-min(x) as w, max(y+h)-min(y) as h from lns group by all",
        "lns",
    ),
)
def g1(ev: Evidence) -> DataFrame:
    return geo.union_boxes(ev.lines, PAGE)


@query(
    "g2_pad_boxes",
    duck(
        """select run_id, page_index, i, greatest(0, x-50) as x, greatest(0, y-50) as y,
                  greatest(0, least(width, x+w+50) - greatest(0, x-50)) as w,
                  greatest(0, least(height, y+h+50) - greatest(0, y-50)) as h
           from lns join pgs using (run_id, page_index)""",
        "lns",
        "pgs",
    ),
)
def g2(ev: Evidence) -> DataFrame:
    boxes = ev.lines.select(*PAGE, "i", "x", "y", "w", "h").join(
        ev.pages.select(*PAGE, "width", "height"), PAGE
    )
    return geo.pad_boxes(boxes, 50.0).drop("width", "height")


@query(
    "g3_group_words_into_lines",
    duck(
        r"""select run_id, page_index, i, text, x, y, w, h, n_words::int as n_words from (
              select run_id, page_index, (dense_rank() over (partition by run_id, page_index order by band) - 1)::int as i, * exclude (run_id, page_index)
              from (select run_id, page_index, seq // 100000 as band, string_agg(text, ' ' order by x, y, seq) as text, min(x) as x, min(y) as y,
                           max(x+w)-min(x) as w, max(y+h)-min(y) as h, count(*) as n_words from wds group by all))""",
        "wds",
    ),
)
def g3(ev: Evidence) -> DataFrame:
    return geo.group_words_into_lines(ev.words)


@query(
    "g4_line_violations",
    duck(
        """select run_id, page_index, pos, i, rule from (select *, case when i <> pos then 'number-is-not-position'
                 when w <= 0 or h <= 0 then 'no-area' when x < 0 or y < 0 or x + w > width or y + h > height then 'off-page'
                 when y < prev then 'above-previous' end as rule
           from (select b.*, width, height, lag(y) over (partition by run_id, page_index order by pos) as prev
                 from bln b join pgs using (run_id, page_index))) where rule is not null""",
        "bln",
        "pgs",
    ),
)
def g4(ev: Evidence) -> DataFrame:
    return geo.line_violations(broken_lines(ev), ev.pages)


RANGE_SQL = """
  select z.*, p.width, p.height, p.page_index is not null as known, a.n, a.b_x, a.b_y, a.b_w, a.b_h, a.btext
  from zz z left join pgs p using (run_id, page_index)
  left join (select z2.claim_id, count(*) as n, min(l.x) as b_x, min(l.y) as b_y, max(l.x+l.w) as b_w, max(l.y+l.h) as b_h,
                    string_agg(l.text, chr(10) order by l.i) as btext
             from zz z2 join lns l on l.run_id = z2.run_id and l.page_index = z2.page_index and l.i between z2.from_line and z2.to_line
             group by 1) a using (claim_id)"""

PADDED = """greatest(0, b_x-12) as x, greatest(0, b_y-12) as y, greatest(0, least(width, b_w+12) - greatest(0, b_x-12)) as w,
            greatest(0, least(height, b_h+12) - greatest(0, b_y-12)) as h"""


@query(
    "g5_boxes_for_ranges",
    duck(
        f"""select run_id, claim_id, page_index, from_line, to_line, x, y, w, h, error from (
              select *, {PADDED} from (select * exclude (b_x), case when error is null then b_x end as b_x from (
                 select *, case when not known then 'unknown-page' when from_line > to_line then 'reversed'
                     when coalesce(n,0) <> to_line - from_line + 1 then 'missing-lines' end as error from r)))
            where error is null
            union all
            select run_id, claim_id, page_index, from_line, to_line, null, null, null, null, error from (
                 select *, case when not known then 'unknown-page' when from_line > to_line then 'reversed'
                     when coalesce(n,0) <> to_line - from_line + 1 then 'missing-lines' end as error from r) where error is not null""",
        "clm",
        "pgs",
        "lns",
        zz="select * from clm",
        r=RANGE_SQL,
    ),
)
def g5(ev: Evidence) -> DataFrame:
    return geo.boxes_for_ranges(ev.claims, ev.lines, ev.pages)


# Trim and clamp of a range, as joins and windows.
CLAMP_SQL = """
  select c.*, last_i, (from_line <= last_i and to_line > last_i) as clamped,
         case when from_line <= last_i and to_line > last_i then last_i else to_line end as c_to
  from wide c left join (select run_id, page_index, max(i) as last_i from lns group by all) using (run_id, page_index)"""
TRIM_SQL = """
  select claim_id, max(case when k <= cut then i end) as kept_i, any_value(cut) as cut, any_value(n) as n, any_value(typical) as typical
  from (select *, max(case when pitch >= 16*typical then k end) over (partition by claim_id) as cut
        from (select *, median(pitch) over (partition by claim_id) as typical
              from (select c.claim_id, l.i, row_number() over w as k, count(*) over (partition by c.claim_id) as n,
                           lead(l.y) over w - l.y as pitch
                    from cl c join lns l on l.run_id = c.run_id and l.page_index = c.page_index and l.i between c.from_line and c.c_to
                    window w as (partition by c.claim_id order by l.i))))
  group by claim_id"""
WIDE_SQL = """select run_id, claim_id, page_index, (from_line // 3)::int as from_line, (to_line + claim_id % 60)::int as to_line from clm"""


def wide_claims(ev: Evidence) -> DataFrame:
    return ev.claims.select(
        "run_id",
        "claim_id",
        "page_index",
        F.floor(F.col("from_line") / 3).cast("int").alias("from_line"),
        (F.col("to_line") + F.col("claim_id") % 60).cast("int").alias("to_line"),
    )


@query(
    "g6_trim_running_footer",
    duck(
        """select w.run_id, claim_id, page_index, from_line, to_line, case when n >= 4 and typical > 0 and cut is not null and n - cut <= 4 and cut >= 4
                       then kept_i else to_line end::int as trimmed_to
           from wide w left join tr using (claim_id)""",
        "clm",
        "lns",
        wide=WIDE_SQL,
        cl="select *, to_line as c_to from wide",
        tr=TRIM_SQL,
    ),
)
def g6(ev: Evidence) -> DataFrame:
    z = geo.with_page_lines(wide_claims(ev), ev.lines)
    t = geo.trim_footer(F.col("lines"), F.col("from_line"), F.col("to_line"))
    return z.withColumn("trimmed_to", t.cast("int")).drop("lines")


@query(
    "g7_clamp_range",
    duck(
        "select run_id, claim_id, page_index, from_line, c_to::int as to_line, coalesce(clamped, false) as clamped from cl",
        "clm",
        "lns",
        wide=WIDE_SQL,
        cl=CLAMP_SQL,
    ),
)
def g7(ev: Evidence) -> DataFrame:
    z = geo.with_page_lines(wide_claims(ev), ev.lines)
    c = geo.clamp_range(F.col("lines"), F.col("from_line"), F.col("to_line"))
    return z.withColumn("c", c).select("run_id", "claim_id", "page_index", "from_line", "c.*")


@query(
    "g8_resolve_answers",
    duck(
        f"""
        select run_id, claim_id, page_index, from_line, case when ok then to_line end::int as to_line, case when ok then x end as x,
               case when ok then y end as y, case when ok then w end as w, case when ok then h end as h,
               case when ok then btext end as text, case when ok then case when clamped then 'low' else 'high' end end as confidence,
               case when error is not null then 'error' when found then 'found' else 'none' end as outcome, error
        from (select *, {PADDED}, found and error is null as ok from (select *, case when not found then null when not known then 'not-a-page-offered'
                 when from_line > to_line then 'reversed' when coalesce(n,0) <> to_line - from_line + 1 then 'missing-lines' end as error
              from (select *, (page_index is not null and from_line is not null and raw_to is not null) as found from r)))""",
        "clm",
        "lns",
        "pgs",
        wide=WIDE_SQL,
        cl=CLAMP_SQL,
        tr=TRIM_SQL,
        zz="""select c.run_id, c.claim_id, c.page_index, c.from_line, c.to_line as raw_to, coalesce(c.clamped,false) as clamped,
                     case when n >= 4 and typical > 0 and cut is not null and n - cut <= 4 and cut >= 4 then kept_i else c_to end as to_line
              from cl c left join tr using (claim_id)""",
        r=RANGE_SQL,
    ),
)
def g8(ev: Evidence) -> DataFrame:
    return geo.resolve_ranges(
        wide_claims(ev).withColumn("confidence", F.lit("high")), ev.lines, ev.pages
    )


# ------------------------------------------------------------------ G9 - G12

TOUCH = "l.h > 0 and least(d.y+d.h, l.y+l.h) - greatest(d.y, l.y) >= 0.4*l.h"


@query(
    "g9_lines_touched",
    duck(
        f"select run_id, page_index, l.i from drg d join lns l using (run_id, page_index) where {TOUCH}",
        "drg",
        "lns",
    ),
)
def g9(ev: Evidence) -> DataFrame:
    z = geo.with_page_lines(drags(ev), ev.lines)
    hit = geo.touched_lines(F.col("lines"), F.col("y"), F.col("h"))
    return z.select(*PAGE, F.explode(F.transform(hit, lambda l: l["i"])).alias("i"))


@query(
    "g10_lines_inside",
    duck(
        """select run_id, page_index, l.i from drg d join lns l using (run_id, page_index)
           where l.y >= d.y and l.y+l.h <= d.y+d.h and l.x >= d.x and l.x+l.w <= d.x+d.w""",
        "drg",
        "lns",
    ),
)
def g10(ev: Evidence) -> DataFrame:
    z = geo.with_page_lines(drags(ev), ev.lines)
    hit = geo.lines_inside(F.col("lines"), *[F.col(c) for c in ("x", "y", "w", "h")])
    return z.select(*PAGE, F.explode(F.transform(hit, lambda l: l["i"])).alias("i"))


@query(
    "g11_draw_zones",
    duck(
        """
        select run_id, page_index, mode, case when mode = 'snapped' then tf else coalesce(inf, -1) end::int as from_line,
               case when mode = 'snapped' then tt else coalesce(int_, -1) end::int as to_line,
               case when mode = 'snapped' then greatest(0, b_x-12) else cx end as x,
               case when mode = 'snapped' then greatest(0, b_y-12) else cy end as y,
               case when mode = 'snapped' then greatest(0, least(width, br+12) - greatest(0, b_x-12)) else cr - cx end as w,
               case when mode = 'snapped' then greatest(0, least(height, bb+12) - greatest(0, b_y-12)) else cb - cy end as h
        from (select f.*, case when snap and tf is not null then 'snapped' else 'free' end as mode, tf, tt, inf, int_, b_x, b_y, br, bb
              from free f
              left join t using (run_id, page_index) left join ins using (run_id, page_index) left join b_x using (run_id, page_index))""",
        "drg",
        "lns",
        "pgs",
        t=f"select run_id, page_index, min(l.i) as tf, max(l.i) as tt from drg d join lns l using (run_id, page_index) where {TOUCH} group by all",
        free="""select *, least(width, greatest(x + w, cx)) as cr, least(height, greatest(y + h, cy)) as cb from
                (select d.*, width::double as width, height::double as height, greatest(0, least(d.x, width))::double as cx,
                        greatest(0, least(d.y, height))::double as cy from drg d join pgs using (run_id, page_index))""",
        ins="""select run_id, page_index, min(l.i) as inf, max(l.i) as int_ from free f join lns l using (run_id, page_index)
               where l.y >= cy and l.y+l.h <= cb and l.x >= cx and l.x+l.w <= cr group by all""",
        b_x="""select run_id, page_index, min(l.x) as b_x, min(l.y) as b_y, max(l.x+l.w) as br, max(l.y+l.h) as bb
              from t join lns l using (run_id, page_index) where l.i between tf and tt group by all""",
    ),
)
def g11(ev: Evidence) -> DataFrame:
    return geo.draw_zones(drags(ev), ev.lines, ev.pages)


@query(
    "g12_drag_boxes",
    duck(
        """select run_id, page_index, least(x, x2) as x, least(y, y2) as y, abs(x-x2) as w, abs(y-y2) as h,
                  abs(x-x2) >= 24 and abs(y-y2) >= 24 as meaningful, greatest(0, least(x2, width))::double as cx,
                  (least(width, greatest(x2+w, greatest(0, least(x2, width)))) - greatest(0, least(x2, width)))::double as cw
           from (select d.*, width, x + w * (case when page_index % 2 = 0 then 1 else -1 end) as x2, y + h - 40 as y2
                 from drg d join pgs using (run_id, page_index))""",
        "drg",
        "pgs",
    ),
)
def g12(ev: Evidence) -> DataFrame:
    d = drags(ev).join(ev.pages.select(*PAGE, "width", "height"), PAGE)
    sign = F.when(F.col("page_index") % 2 == 0, 1).otherwise(-1)
    d = d.withColumn("x2", F.col("x") + F.col("w") * sign).withColumn("y2", F.col("y") + F.col("h") - 40)
    d = d.withColumn("b", geo.normalize_drag("x", "y", "x2", "y2"))
    c = geo.clamp_box(*[F.col(k) for k in ("x2", "y2", "w", "h", "width", "height")])
    return d.withColumn("c", c).select(
        *PAGE,
        "b.*",
        geo.is_meaningful_drag(F.col("b.w"), F.col("b.h")).alias("meaningful"),
        F.col("c.x").alias("cx"),
        F.col("c.w").alias("cw"),
    )


# ------------------------------------------------------------------ G13 - G17

PLACE_SQL = """select p.run_id, p.page_index, p.source_id, s.name as source_name, s.page_count as pages_in_doc,
                      (row_number() over (partition by p.run_id, p.source_id order by p.page_index) - 1)::int as place
               from pgs p join srcs s on s.run_id = p.run_id and s.source_id = p.source_id"""


@query(
    "g13_cite_zones",
    duck(
        """
        select run_id, page_index, source_name, place + 1 as page, pages_in_doc, case when cited then from_line end as from_line,
               case when cited then to_line end as to_line, (case when cited then to_line - from_line + 1 else 0 end)::int as line_count,
               (case when cited then coalesce(ip,0) else 0 end)::int as interpolated_lines,
               replace(printf('%.1f', w/300*2.54),'.',',') || ' x ' || replace(printf('%.1f', h/300*2.54),'.',',') || ' cm' as size,
               h / height as height_share, not whole and h / height >= 0.8 as spans_page, whole as whole_page
        from (select z.*, source_name, place, pages_in_doc, from_line >= 0 and to_line >= 0 as cited, ip,
                     x <= 0 and y <= 0 and w >= width and h >= height as whole
              from zbx z join pl using (run_id, page_index) left join
                   (select z.run_id, z.page_index, count(*) as ip from zbx z join lns l on l.run_id = z.run_id and l.page_index = z.page_index
                    and l.i between z.from_line and z.to_line and l.origin = 'interpolated' group by all) using (run_id, page_index))""",
        "zbx",
        "lns",
        "srcs",
        pl=PLACE_SQL,
    ),
)
def g13(ev: Evidence) -> DataFrame:
    return geo.cite_zones(zone_boxes(ev), ev.lines, ev.pages, ev.sources)


@query(
    "g14_cite_ranges",
    duck(
        """
        select z.run_id, z.page_index, z.from_line, z.to_line, source_name, place + 1 as page, pages_in_doc,
               (to_line - from_line + 1)::int as line_count, coalesce(ip, 0)::int as interpolated_lines,
               case when from_line < 0 or to_line < from_line then '' else coalesce(tx, '') end as text
        from zbx z join pl using (run_id, page_index) left join
             (select z.run_id, z.page_index, count(*) filter (where l.origin = 'interpolated') as ip, string_agg(l.text, chr(10) order by l.i) as tx
              from zbx z join lns l on l.run_id = z.run_id and l.page_index = z.page_index and l.i between z.from_line and z.to_line
              group by all) using (run_id, page_index)""",
        "zbx",
        "lns",
        "srcs",
        pl=PLACE_SQL,
    ),
)
def g14(ev: Evidence) -> DataFrame:
    ranges = zone_boxes(ev).select(*PAGE, "from_line", "to_line")
    return geo.cite_ranges(ranges, ev.lines, ev.pages, ev.sources)


@query(
    "g15_resolve_pages",
    duck("select run_id, page_index, source_id, source_name, place, pages_in_doc from pl", "pgs", "srcs", pl=PLACE_SQL),
)
def g15(ev: Evidence) -> DataFrame:
    return geo.resolve_pages(ev.pages.select(*PAGE, "source_id"), ev.sources)


@query(
    "g16_interpolation_of",
    duck(
        """select z.run_id, z.page_index, z.from_line, z.to_line, coalesce(c,0)::int as covered, coalesce(ip,0)::int as interpolated
           from zbx z left join (select z.run_id, z.page_index, count(*) as c, count(*) filter (where l.origin = 'interpolated') as ip
              from zbx z join lns l on l.run_id = z.run_id and l.page_index = z.page_index and l.i between z.from_line and z.to_line
              group by all) using (run_id, page_index)""",
        "zbx",
        "lns",
    ),
)
def g16(ev: Evidence) -> DataFrame:
    return geo.interpolation_of(zone_boxes(ev).select(*PAGE, "from_line", "to_line"), ev.lines)


@query(
    "g17_whole_page_zones",
    duck(
        """select run_id, page_index, 0.0::double as x, 0.0::double as y, width::double as w, height::double as h,
                  case when n is not null then 0 end as from_line, (n - 1)::int as to_line,
                  case when mx <> n - 1 then 'number-is-not-position' end as error
           from pgs left join (select run_id, page_index, count(*) as n, max(i) as mx from bln group by all) using (run_id, page_index)""",
        "pgs",
        "bln",
    ),
)
def g17(ev: Evidence) -> DataFrame:
    return geo.whole_page_zones(ev.pages, broken_lines(ev))


# ------------------------------------------------------------------ Q1 - Q5

Q1_SQL = """
  select p.run_id, p.page_index, coalesce(n,0)::int as lines, coalesce(chars,0)::int as transcribed_chars,
         coalesce(bottom,0) / p.height as vertical_coverage, coalesce(med,0) as median_line_height,
         coalesce(collapsed,0)::int as collapsed_lines, case when ref > 0 then (case when area > 0 then chars/area else 0 end)/ref else 1.0 end as density_ratio,
         concat_ws(',', case when collapsed >= 2 then 'collapsed-lines' end,
           case when n >= 8 and med > 0 and (case when ref > 0 then (case when area > 0 then chars/area else 0 end)/ref else 1.0 end) < 0.7 then 'thin-page' end) as reasons
  from pgs p left join (
     select run_id, page_index, any_value(n) as n, any_value(med) as med, sum(chars) as chars, max(y+h) as bottom, sum(w*h) as area,
            count(*) filter (where origin is not null and ((case when w > 0 and chars > 0 then h*chars/w else 0 end) > 4
                 or (n >= 8 and med > 0 and origin = 'measured' and h > 2*med))) as collapsed,
            median(case when w*h > 0 then chars/(w*h) else 0 end) filter (where h >= 0.6*med and h <= 1.6*med) as ref
     from (select *, count(*) over (partition by run_id, page_index) as n, median(h) over (partition by run_id, page_index) as med from tln)
     group by all) using (run_id, page_index)"""


@query("q1_page_geometry", duck("select * from q1", "pgs", "tln", q1=Q1_SQL))
def q1(ev: Evidence) -> DataFrame:
    return qual.page_geometry(tall_lines(ev), ev.pages)


Q2_SQL = """
  select p.run_id, p.page_index, coalesce(ink_bottom,-1)::int as ink_bottom, coalesce(box_bottom,0) as box_bottom,
         coalesce(box_bottom,0)/(ink_bottom+1) as ink_coverage, coalesce(run,0)::int as uncovered_run, coalesce(run,0)/p.height as uncovered_share
  from pgs p left join (select run_id, page_index, max(y+h) as box_bottom from lns group by all) using (run_id, page_index)
  left join (select run_id, page_index, max(run) as run, max(yb) as ink_bottom from
     (select run_id, page_index, island, count(*) filter (where not cov) as run, max(y) as yb from
        (select *, sum(cov::int) over (partition by run_id, page_index order by y) as island from
           (select k.run_id, k.page_index, k.y, c.y is not null as cov from ink k left join
              (select distinct run_id, page_index, y::int + t.k::int as y from lns, unnest(range(24)) t(k)) c using (run_id, page_index, y)))
      group by all) group by all) using (run_id, page_index)"""


@query(
    "q2_page_completeness",
    duck(
        """select *, not (ink_coverage < 0.9) and not (uncovered_share > 0.06) as complete,
                  concat_ws(',', case when ink_coverage < 0.9 then 'short-reach' end, case when uncovered_share > 0.06 then 'uncovered-ink' end) as shortfalls from q2""",
        "pgs",
        "lns",
        "ink",
        q2=Q2_SQL,
    ),
)
def q2(ev: Evidence) -> DataFrame:
    return qual.page_completeness(ev.lines, ink_rows(ev), ev.pages)


@query(
    "q3_best_attempt",
    duck(
        """
        select run_id, page_index, coalesce(full_a, case when not failed then last_a end)::int as kept_attempt,
               case when full_a is not null then 'complete' when not failed then 'short' else 'refused' end as outcome,
               coalesce(full_a, tried)::int as attempts_used
        from (select run_id, page_index, min(attempt) filter (where error is null and complete) as full_a, max(attempt) filter (where error is null) as last_a,
                     bool_or(error is not null) as failed, max(attempt) as tried
              from (select run_id, page_index, a as attempt, (doc_id + a) % 4 = 0 as complete, case when (doc_id * a) % 7 = 3 then 'unreadable' end as error
                    from pgs, unnest([1,2,3]) t(a)) group by all)""",
        "pgs",
    ),
)
def q3(ev: Evidence) -> DataFrame:
    tries = ev.pages.select(*PAGE, "doc_id", F.explode(F.array(*[F.lit(a) for a in (1, 2, 3)])).alias("attempt"))
    return qual.best_attempt(
        tries.select(
            *PAGE,
            "attempt",
            ((_doc() + F.col("attempt")) % 4 == 0).alias("complete"),
            F.when((_doc() * F.col("attempt")) % 7 == 3, "unreadable").alias("error"),
        )
    )


@query(
    "q4_gap_metrics",
    duck(
        """
        select z.run_id, z.page_index, z.from_line, z.to_line,
               (case when pn >= 4 and ptyp > 0 and pcut is not null then pn - pcut else 0 end)::int as footer_tail_lines,
               case when qn >= 4 and qtyp > 0 then qmax / qtyp end as max_gap_ratio
        from zbx z
        left join (select run_id, page_index, any_value(n) as pn, any_value(typ) as ptyp, max(k) filter (where pitch >= 16*typ) as pcut
           from (select *, median(pitch) over (partition by run_id, page_index) as typ from (select run_id, page_index,
                   row_number() over w as k, count(*) over (partition by run_id, page_index) as n, lead(y) over w - y as pitch
                   from lns window w as (partition by run_id, page_index order by i))) group by all) using (run_id, page_index)
        left join (select run_id, page_index, any_value(n) as qn, median(pitch) as qtyp, max(pitch) as qmax
           from (select z.run_id, z.page_index, count(*) over (partition by z.run_id, z.page_index) as n, lead(l.y) over (partition by z.run_id, z.page_index order by l.i) - l.y as pitch
                 from zbx z join lns l on l.run_id = z.run_id and l.page_index = z.page_index and l.i between z.from_line and z.to_line) group by all) using (run_id, page_index)""",
        "zbx",
        "lns",
    ),
)
def q4(ev: Evidence) -> DataFrame:
    return geo.gap_metrics(zone_boxes(ev).select(*PAGE, "from_line", "to_line"), ev.lines)


def page_metrics(ev: Evidence) -> DataFrame:
    """Q1 and Q2 joined; every sixth page was read before ink was measured."""
    sliced = ev.lines.groupBy(*PAGE).agg(F.count_if(F.col("origin") == "interpolated").alias("interpolated_lines"))
    ink = q2(ev).select(*PAGE, "ink_coverage", "uncovered_share")
    m = q1(ev).join(ink, PAGE, "left").join(sliced, PAGE, "left")
    measured = F.col("page_index") % 6 != 0
    return (
        m.withColumn("ink_coverage", F.when(measured, F.col("ink_coverage")))
        .withColumn("uncovered_share", F.when(measured, F.col("uncovered_share")))
        .withColumn("interpolated_lines", F.coalesce("interpolated_lines", F.lit(0)))
    )


@query(
    "q5_quality_report",
    duck(
        """
        select run_id, count(*) as pages, count(*) filter (where reasons <> '' or coalesce(ic < 0.9, false) or coalesce(us > 0.06, false)) as flagged,
               count(*) filter (where ic < 0.9) as short_pages, count(*) filter (where us > 0.06) as uncovered_pages,
               count(*) filter (where ic is null) as unmeasured, sum(lines)::bigint as lines, sum(il)::bigint as interpolated,
               sum(il)*100.0::double/sum(lines) as interpolated_pct
        from (select q1.run_id, q1.page_index, q1.lines, q1.reasons, case when q1.page_index % 6 <> 0 then ink_coverage end as ic,
                     case when q1.page_index % 6 <> 0 then uncovered_share end as us, coalesce(il,0) as il
              from q1 join q2 using (run_id, page_index) left join
                   (select run_id, page_index, count(*) filter (where origin='interpolated') as il from lns group by all) using (run_id, page_index))
        group by run_id""",
        "pgs",
        "tln",
        "lns",
        "ink",
        q1=Q1_SQL,
        q2=Q2_SQL,
    ),
)
def q5(ev: Evidence) -> DataFrame:
    return qual.quality_report(page_metrics(ev))
