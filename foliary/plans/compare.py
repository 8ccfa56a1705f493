"""Duplicates, run comparison, cached replies, input checks and the gate (U, V22, V29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE
from foliary.operators import compare as cmp
from foliary.operators.geometry import boxes_for_ranges
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.geometry import broken_lines
from foliary.plans.registry import query
from foliary.plans.sources import s10
from foliary.sources.transcripts import digests


def _doc():
    return F.col("doc_id")



def _s(c):
    return c.cast("string")


# ------------------------------------------------------------------ U1, U2


def drops(ev: Evidence) -> tuple[DataFrame, DataFrame]:
    """Even documents are held, odd ones arrive."""
    d = digests(ev.documents.select("run_id", F.concat(F.lit("doc-"), _s(_doc())).alias("name"), _doc().alias("pos"), "text"), "text")
    held = d.where("pos % 2 = 0").withColumn("digest", F.when(F.col("pos") % 10 != 4, F.col("digest")))
    return d.where("pos % 2 = 1"), held


add_duck("dig", "select run_id, 'doc-' || doc_id as name, doc_id as pos, sha256(text) as digest from docs", ["docs"])
add_duck("hld", "select run_id, name, pos, digest from dig where pos % 2 = 0 and pos % 10 <> 4", ["dig"])


@query(
    "u1_screen_digested",
    duck(
        """select c.run_id, c.name, c.digest, c.pos, h.name is null and rn = 1 as accepted, case when not (h.name is null and rn = 1) then coalesce(h.name, own) end as held_as,
                  case when not (h.name is null and rn = 1) then h.name is null end as in_same_drop
           from (select *, row_number() over (partition by run_id, digest order by pos) as rn, first_value(name) over (partition by run_id, digest order by pos) as own from dig where pos % 2 = 1) c
           left join (select run_id, digest, arg_min(name, pos) as name from hld group by all) h on h.run_id = c.run_id and h.digest = c.digest""",
        "dig",
        "hld",
    ),
)
def u1(ev: Evidence) -> DataFrame:
    return cmp.screen_digested(*drops(ev))


@query(
    "u2_find_in_other_runs",
    duck(
        """select c.run_id, c.name, c.digest, c.pos, h.run_id as other_run, h.name as held_as, cast(regexp_extract(h.run_id,'([0-9]+)$',1) as int) * 1000 as created_at
           from dig c join (select run_id, digest, arg_min(name, pos) as name from hld group by all) h on h.digest = c.digest and h.run_id <> c.run_id where c.pos % 2 = 1""",
        "dig",
        "hld",
    ),
)
def u2(ev: Evidence) -> DataFrame:
    candidates, held = drops(ev)
    runs = ev.runs.select("run_id", (F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int") * 1000).alias("created_at"))
    return cmp.find_in_other_runs(candidates, held, runs)


add_duck(
    "lnk",
    """select run_id, digest, name as held_as, created_at, lead(run_id) over w as older_run, row_number() over w = 1 as is_newest
       from (select run_id, digest, arg_min(name, pos) as name, cast(regexp_extract(run_id,'([0-9]+)$',1) as int) * 1000 as created_at from hld group by run_id, digest)
       window w as (partition by digest order by created_at desc, run_id)""",
    ["hld"],
)


def holder_links(ev: Evidence) -> DataFrame:
    runs = ev.runs.select("run_id", (F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int") * 1000).alias("created_at"))
    return cmp.linked_holders(drops(ev)[1], runs)


@query("u2_linked_holders", duck("select * from lnk", "lnk"))
def u2_links(ev: Evidence) -> DataFrame:
    return holder_links(ev)


@query(
    "u2_newest_other_holder",
    duck(
        """select c.run_id, c.name, c.digest, c.pos, arg_max(l.run_id, created_at) as other_run from dig c left join lnk l on l.digest = c.digest and l.run_id <> c.run_id
           where c.pos % 2 = 1 group by c.run_id, c.name, c.digest, c.pos""",
        "dig",
        "lnk",
    ),
)
def u2_newest(ev: Evidence) -> DataFrame:
    return cmp.newest_other_holder(drops(ev)[0], holder_links(ev)).select("run_id", "name", "digest", "pos", "other_run")


# ------------------------------------------------------------------ U5


def readings(ev: Evidence) -> tuple[DataFrame, DataFrame]:
    """Two readings per source; the candidate loses lines on some pages, and each has pages of its own."""
    p = ev.table("documents").select("doc_id", "source", "n_chars")
    n = F.col("n_chars")
    row = lambda lines, chars, col: [
        F.col("source").alias("pair_id"), _s(_doc()).alias("page"), lines.alias("lines"), chars.alias("chars"), (_doc() % 100 / 100.0).alias("cover"), (_doc() % 90 / 100.0).alias("ink"),
        (_doc() % 7 / 10.0).alias("uncovered"), col.alias("collapsed"), (_doc() % 5).alias("interpolated"),
    ]
    base = p.where("doc_id % 19 <> 0").select(*row(_doc() % 40 + 5, n, _doc() % 3))
    cand = p.where("doc_id % 23 <> 0").select(
        *row(_doc() % 40 + 5 - F.when(_doc() % 7 == 0, 3).otherwise(0), n - F.when(_doc() % 7 <= 1, F.floor(n / 4)).otherwise(0), _doc() % 3 + F.when(_doc() % 11 == 0, 4).otherwise(0))
    )
    return base, cand


add_duck(
    "prd",
    """
    select coalesce(b.pair_id, c.pair_id) as pair_id, coalesce(b.page, c.page) as page, b.* exclude (pair_id, page), c.* exclude (pair_id, page), case when b.page is not null and c.page is not null then 'both' when b.page is not null then 'baseline-only' else 'candidate-only' end as side
    from (select source as pair_id, doc_id::varchar as page, doc_id % 40 + 5 as b_lines, n_chars as b_chars, (doc_id % 100)/100.0::double as b_cover, (doc_id % 90)/100.0::double as b_ink, (doc_id % 7)/10.0::double as b_uncovered, doc_id % 3 as b_collapsed,
                 doc_id % 5 as b_interpolated from documents where doc_id % 19 <> 0) b
    full join (select source as pair_id, doc_id::varchar as page, doc_id % 40 + 5 - case when doc_id % 7 = 0 then 3 else 0 end as c_lines, n_chars - case when doc_id % 7 <= 1 then n_chars // 4 else 0 end as c_chars, (doc_id % 100)/100.0::double as c_cover,
                 (doc_id % 90)/100.0::double as c_ink, (doc_id % 7)/10.0::double as c_uncovered, doc_id % 3 + case when doc_id % 11 = 0 then 4 else 0 end as c_collapsed, doc_id % 5 as c_interpolated from documents where doc_id % 23 <> 0) c
      on b.pair_id = c.pair_id and b.page = c.page""",
    [],
)
add_duck(
    "prm",
    """select *, side = 'both' and coalesce(abs(c_lines - b_lines) >= 2 or coalesce(abs((c_chars - b_chars)::double / nullif(b_chars,0) * 100) >= 5, false) or c_collapsed <> b_collapsed, false) as moved from prd""",
    ["prd"],
)


@query("u5_paired_pages", duck("select pair_id, page, side, moved, b_lines, c_lines, b_chars, c_chars from prm", "prm"))
def u5_pairs(ev: Evidence) -> DataFrame:
    return cmp.paired_pages(*readings(ev)).select("pair_id", "page", "side", "moved", "b_lines", "c_lines", "b_chars", "c_chars")


@query(
    "u5_compare_metrics",
    duck(
        " union all ".join(
            f"""select pair_id, '{m}' as metric, round(b,6) as baseline, round(c,6) as candidate, round(c - b,6) as delta, round(case when b = 0 then case when c = 0 then 0.0 end else (c-b)/b*100 end, 6) as relative_pct
                from (select pair_id, avg(b_{m}) as b, avg(c_{m}) as c from prd where side = 'both' group by all)"""
            for m in cmp.METRICS
        ),
        "prd",
    ),
)
def u5_metrics(ev: Evidence) -> DataFrame:
    return cmp.compare_metrics(cmp.paired_pages(*readings(ev)))


@query(
    "u5_compare_runs",
    duck(
        """
        select pair_id, paired, baseline_only, candidate_only, moved, round(lp, 6) as lines_pct, round(cp, 6) as chars_pct, cc - bc as collapsed_rise,
               concat_ws(',', case when cp < -3 then 'fewer-characters' end, case when lp < -5 then 'fewer-lines' end, case when cc > bc*1.5 and cc - bc >= 3 then 'more-collapsed' end, case when sr > 0 then 'short-reads' end) as concerns
        from (select pair_id, count(*) filter (where side='both') as paired, count(*) filter (where side='baseline-only') as baseline_only, count(*) filter (where side='candidate-only') as candidate_only, count(*) filter (where moved) as moved,
                (sum(c_lines) filter (where side='both') - sum(b_lines) filter (where side='both'))::double / sum(b_lines) filter (where side='both') * 100 as lp,
                (sum(c_chars) filter (where side='both') - sum(b_chars) filter (where side='both'))::double / sum(b_chars) filter (where side='both') * 100 as cp,
                (sum(b_collapsed) filter (where side='both'))::bigint as bc, (sum(c_collapsed) filter (where side='both'))::bigint as cc from prm group by all)
        left join (select source_id as pair_id, pos % 4 as sr from srcs) using (pair_id)""",
        "prm",
        "srcs",
    ),
)
def u5(ev: Evidence) -> DataFrame:
    short = ev.sources.select(F.col("source_id").alias("pair_id"), (F.col("pos") % 4).alias("short_reads"))
    return cmp.compare_runs(cmp.paired_pages(*readings(ev)), short)


# ------------------------------------------------------------------ U6


@query(
    "u6_cached_requests",
    """
    with r as (select conv_id, turn, 'gemini-3.5-flash/low/' || case when conv_id % 5 = 0 then '?' else '2048' end || '|' || role || '|' || substr(sha256(text), 1, 16) as request_key from conversations)
    select conv_id, turn, request_key, reply, reply is not null as hit from r left join
      (select request_key, arg_min('reply ' || conv_id || '/' || turn, conv_id*1000 + turn) as reply from r where conv_id % 3 = 0 group by 1) using (request_key)
    """,
)
def u6(ev: Evidence) -> DataFrame:
    c = ev.table("conversations")
    settings = cmp.fingerprint(F.lit("gemini-3.5-flash"), F.lit("low"), F.when(F.col("conv_id") % 5 != 0, F.lit(2048)))
    r = c.select("conv_id", "turn", cmp.request_key(settings, F.col("role"), F.col("text")).alias("request_key"))
    cache = r.where("conv_id % 3 = 0").select(
        "request_key", F.concat(F.lit("reply "), _s(F.col("conv_id")), F.lit("/"), _s(F.col("turn"))).alias("reply"), (F.col("conv_id") * 1000 + F.col("turn")).alias("stored_at")
    )
    return cmp.cached_requests(r, cache)


# ------------------------------------------------------------------ U7 - U9


@query(
    "u7_page_violations",
    duck(
        """
        select run_id, page_index, source_id, rule from (select p.*, case when width <= 0 or height <= 0 then 'size' when page_in_doc < 0 then 'page-in-document' when page_in_doc >= count(*) over (partition by run_id, source_id) then 'beyond-document'
               when b.bad then 'line-geometry' when page_index >= count(*) over (partition by run_id) or count(*) over (partition by run_id, page_index) > 1 then 'not-dense' end as rule
          from (select run_id, (case when doc_id % 43 = 5 then page_index + 900000 else page_index end)::int as page_index, source_id, (case when doc_id % 31 = 3 then page_in_doc + 100000 when doc_id % 37 = 2 then -1 else page_in_doc end)::int as page_in_doc,
                       case when doc_id % 41 = 7 then 0 else width end as width, height from pgs) p
          left join (select distinct run_id, page_index, true as bad from (select b.*, q.width, q.height, lag(y) over (partition by run_id, page_index order by pos) as prev from bln b join
                 (select run_id, (case when doc_id % 43 = 5 then page_index + 900000 else page_index end)::int as page_index, case when doc_id % 41 = 7 then 0 else width end as width, height from pgs) q using (run_id, page_index))
               where i <> pos or w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > width or y + h > height or y < prev) b using (run_id, page_index)) where rule is not null""",
        "pgs",
        "bln",
    ),
)
def u7(ev: Evidence) -> DataFrame:
    p = ev.pages.select(
        "run_id", F.when(_doc() % 43 == 5, F.col("page_index") + 900000).otherwise(F.col("page_index")).cast("int").alias("page_index"), "source_id",
        F.when(_doc() % 31 == 3, F.col("page_in_doc") + 100000).when(_doc() % 37 == 2, -1).otherwise(F.col("page_in_doc")).cast("int").alias("page_in_doc"),
        F.when(_doc() % 41 == 7, 0).otherwise(F.col("width")).alias("width"), "height",
    )
    return cmp.page_violations(p, broken_lines(ev))


@query("u8_cell_violations")
def u8_cells(ev: Evidence) -> DataFrame:
    from foliary.sources.workbook import sheet_extents

    c = s10(ev)
    k = F.col("pos")
    declared = sheet_extents(c).withColumn("rows", F.when(F.col("sheet") == "Sheet3", 1).otherwise(F.col("rows")))
    broken = c.withColumn("row", F.when(k % 101 == 0, 0).otherwise(F.col("row"))).withColumn("kind", F.when(k % 103 == 0, "blob").otherwise(F.col("kind")))
    return cmp.cell_violations(broken, declared)


@query(
    "u8_field_violations",
    duck(
        """select run_id, pos, rule from (select *, case when n > 500 then 'too-many-fields' when id = '' then 'id-missing' when pos > first then 'id-used-twice' when id2 % 17 = 2 then 'label-missing' when id2 % 19 = 3 then 'value-ref' end as rule
           from (select *, count(*) over (partition by run_id) as n, min(pos) over (partition by run_id, id) as first from
             (select 'run-' || (id // 450) as run_id, id as pos, case when id % 29 = 0 then '' when id % 31 = 0 then 'same' else 'f' || id end as id, id as id2 from vals))) where rule is not null""",
        "vals",
    ),
)
def u8_fields(ev: Evidence) -> DataFrame:
    from foliary.plans.text import value_pairs

    i = F.col("id")
    f = value_pairs(ev).select(
        F.concat(F.lit("run-"), _s(F.floor(i / 450))).alias("run_id"), i.alias("pos"), F.when(i % 29 == 0, "").when(i % 31 == 0, "same").otherwise(F.concat(F.lit("f"), _s(i))).alias("id"),
        F.lit("Sheet1").alias("sheet"), F.when(i % 17 == 2, " ").otherwise(F.col("a")).alias("label"), F.lit("A1").alias("label_ref"), F.when(i % 19 == 3, "B0").otherwise("B1").alias("value_ref"), F.col("b").alias("excel_value"),
    )
    return cmp.field_violations(f)


@query(
    "u8_screen_violations",
    duck(
        """select run_id, pos, rule from (select *, case when n > 40 then 'too-many-captures' when pos > first then 'id-used-twice' when tl > 20000 then 'too-many-lines' when page_in_doc % 13 = 4 then 'lines-not-dense' end as rule from
             (select run_id, page_in_doc as pos, page_in_doc, count(*) over (partition by run_id) as n, min(page_in_doc) over (partition by run_id, case when page_in_doc % 17 = 3 then 0 else page_in_doc end) as first, sum(n_lines) over (partition by run_id) as tl
              from (select * replace (case when source_id like '%3' then source_id else source_id || '-' || (page_in_doc // 40) end as run_id) from pgs))) where rule is not null""",
        "pgs",
    ),
)
def u8_screens(ev: Evidence) -> DataFrame:
    """Every source in sets of forty screens; some sources in one set, however long."""
    p = F.col("page_in_doc")
    cid = F.when(p % 17 == 3, 0).otherwise(p)
    sets = F.when(F.col("source_id").like("%3"), F.col("source_id")).otherwise(F.concat("source_id", F.lit("-"), _s(F.floor(p / 40)))).alias("run_id")
    c = ev.pages.select(sets, p.alias("pos"), _s(cid).alias("id"))
    shift = F.when((p % 13 == 4) & (F.col("i") == 0), 7777777).otherwise(F.col("i"))
    return cmp.screen_violations(c, ev.lines.select(sets, p.alias("pos"), shift.alias("i")))


@query(
    "u9_capture_violations",
    duck("select run_id, claim_id as pos, case when claim_id % 53 = 0 then 'key' when page_index is null then 'page' else 'line-range' end as rule from clm where claim_id % 53 = 0 or page_index is null or coalesce(from_line < 0 or to_line < 0, true)", "clm"),
)
def u9(ev: Evidence) -> DataFrame:
    c = ev.claims.select("run_id", F.col("claim_id").alias("pos"), F.when(F.col("claim_id") % 53 != 0, _s(F.col("claim_id"))).alias("key"), "page_index", "from_line", "to_line")
    return cmp.capture_violations(c)


@query(
    "u9_entry_violations",
    duck(
        """select run_id, pos, case when fid is null and lab = '' then 'no-id-or-label' else 'id-used-twice' end as rule from (select *, count(*) over (partition by run_id, eid) as n from
             (select 'run-' || (id % 4) as run_id, id as pos, case when id % 7 <> 0 then 'f' || (id % 900) end as fid, case when id % 21 = 0 then '' else 'L' || (id % 400) end as lab,
                     case when id % 7 <> 0 then 'f:f' || (id % 900) else 'l:l' || case when id % 21 = 0 then '' else (id % 400)::varchar end end as eid from vals)) where (fid is null and lab = '') or n > 1""",
        "vals",
    ).replace("'l:l' || case when id % 21 = 0 then '' else (id % 400)::varchar end", "case when id % 21 = 0 then 'l:' else 'l:l' || (id % 400) end"),
)
def u9_entries(ev: Evidence) -> DataFrame:
    from foliary.operators.decisions import screen_entry_id
    from foliary.plans.text import value_pairs

    i = F.col("id")
    e = value_pairs(ev).select(
        F.concat(F.lit("run-"), _s(i % 4)).alias("run_id"), i.alias("pos"), F.when(i % 7 != 0, F.concat(F.lit("f"), _s(i % 900))).alias("field_id"),
        F.when(i % 21 == 0, "").otherwise(F.concat(F.lit("L"), _s(i % 400))).alias("label"),
    )
    return cmp.entry_violations(e.withColumn("entry_id", screen_entry_id(F.col("field_id"), F.col("label"))))


# ------------------------------------------------------------------ V22, V29, U3, U4


def gold_rows(ev: Evidence) -> DataFrame:
    """A crop per page: two neighbouring printed lines of the page, misread on some pages."""
    n = F.col("n_lines")
    first = (_doc() % F.greatest(n - 2, F.lit(1))).cast("int")
    return ev.pages.select(
        "run_id", "page_index", "doc_id", "n_lines", first.alias("a"), F.least(first + _doc() % 2, n - 1).cast("int").alias("b"), (_doc() % 6 == 0).alias("whole_document")
    )


def crop_lines(ev: Evidence) -> DataFrame:
    g = gold_rows(ev).select("run_id", "page_index", "doc_id", "a", "b")
    l = ev.lines.select(*PAGE, "i", "text").join(g, PAGE).where("i between a and b")
    garbled = F.when(_doc() % 9 == 0, F.regexp_replace("text", "[aeiou]", "zz")).when(_doc() % 9 == 1, F.translate("text", "ae", "ea")).when(_doc() % 9 == 2, "--").otherwise(F.col("text"))
    return l.select(_doc().alias("crop_id"), "i", garbled.alias("text"))


def crop_pairs(ev: Evidence) -> DataFrame:
    return gold_rows(ev).select(_doc().alias("crop_id"), *PAGE)


@query("v22_required_ranges")
def v22(ev: Evidence) -> DataFrame:
    return cmp.required_ranges(crop_pairs(ev), crop_lines(ev), ev.lines)


@query("v29_describe_no_window")
def v29(ev: Evidence) -> DataFrame:
    return cmp.describe_no_window(v22(ev), ev.lines, ev.pages)


def gate_rows(ev: Evidence) -> DataFrame:
    g = gold_rows(ev)
    t = F.when(_doc() % 5 == 0, F.col("n_lines") - 1).when(_doc() % 5 == 1, F.col("b") + 1).otherwise(F.col("b"))
    z = g.select(
        _doc().alias("claim_id"), "run_id", "page_index", F.when(_doc() % 5 == 0, 0).when(_doc() % 5 == 2, F.least(F.col("a") + 1, F.col("b"))).otherwise(F.col("a")).cast("int").alias("from_line"),
        F.least(t, F.col("n_lines") - 1).cast("int").alias("to_line"),
    )
    r = boxes_for_ranges(z, ev.lines, ev.pages)
    d = F.col("claim_id")
    results = r.where("claim_id % 13 <> 0").select(
        d.alias("crop_id"), "run_id", F.when(d % 17 == 0, F.col("page_index") + 1).otherwise(F.col("page_index")).cast("int").alias("page_index"), "from_line", "to_line", "h"
    )
    gold = g.select(_doc().alias("crop_id"), "run_id", F.array("page_index").alias("accepted"), "whole_document")
    return cmp.gate_evaluate(results, gold, crop_lines(ev), ev.lines, ev.pages)


@query("u3_gate_evaluate")
def u3(ev: Evidence) -> DataFrame:
    return gate_rows(ev)


@query("u4_gate_summary")
def u4(ev: Evidence) -> DataFrame:
    return cmp.gate_summary(gate_rows(ev))
