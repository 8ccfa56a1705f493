"""Furniture (F), page heads (H) and page pools (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE
from foliary.operators import furniture as fur
from foliary.operators import pools as pool
from foliary.operators.numbering import global_page_index
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.registry import query
from foliary.plans.text import q_tokens

# ------------------------------------------------------------------ F

TAILS_SQL = rf"""
  select run_id, source_id, page_index, i, tk from
    (select *, {q_tokens('text')} as tk, row_number() over (partition by run_id, page_index order by i desc) as r from lns)
  where r <= 6 and len(tk) > 0 and len(list_filter(tk, lambda t: regexp_matches(t,'\p{{L}}'))) > 0"""
FURN_SQL = """
  select a.run_id, a.source_id, a.page_index, a.i
  from tails a join tails b on a.run_id = b.run_id and a.source_id = b.source_id
       and (a.page_index = b.page_index or len(list_intersect(a.tk, b.tk)) / greatest(len(a.tk), len(b.tk)) >= 0.6)
  join (select run_id, source_id, count(*) as n from pgs group by all having count(*) >= 3) d on d.run_id = a.run_id and d.source_id = a.source_id
  group by a.run_id, a.source_id, a.page_index, a.i, d.n having count(distinct b.page_index) >= 0.5 * d.n"""
BOTTOM_SQL = """
  select p.run_id, p.source_id, p.page_index, lc::int as last_content, ll::int as last_line, coalesce(n,0)::int as n_lines, coalesce(fl,0)::int as furniture_lines,
         least(case when max(coalesce(fl,0)) over (partition by p.run_id, p.source_id) > 0 then max(coalesce(fl,0)) over (partition by p.run_id, p.source_id) else 6 end,
               floor(coalesce(n,0)*0.25))::int as slack
  from pgs p left join (select l.run_id, l.page_index, count(*) as n, max(l.i) as ll, count(f.i) as fl, max(l.i) filter (where f.i is null) as lc
                        from lns l left join furn f using (run_id, source_id, page_index, i) group by all) using (run_id, page_index)"""

add_duck("tails", TAILS_SQL, ["lns"])
add_duck("furn", FURN_SQL, ["tails", "pgs"])
add_duck("bot", BOTTOM_SQL, ["pgs", "lns", "furn"])


@query("f1_running_furniture", duck("select * from furn", "furn"))
def f1(ev: Evidence) -> DataFrame:
    return fur.running_furniture(ev.lines, ev.pages)


@query("f2_page_bottoms", duck("select * from bot", "bot"))
def f2(ev: Evidence) -> DataFrame:
    return fur.page_bottoms(ev.lines, ev.pages)


@query(
    "source_furniture_report",
    duck(
        """select run_id, source_id, name, count(*) as pages, sum(furniture_lines)::bigint as furniture_lines, sum(n_lines)::bigint as n_lines,
                  max(last_content) as deepest_content, count(last_content) as pages_with_content
           from bot join srcs using (run_id, source_id) group by all""",
        "bot",
        "srcs",
    ),
)
def source_furniture_report(ev: Evidence) -> DataFrame:
    """Pages, furniture lines and deepest content line per source."""
    b = fur.page_bottoms(ev.lines, ev.pages)
    g = b.groupBy("run_id", "source_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("furniture_lines").alias("furniture_lines"),
        F.sum("n_lines").alias("n_lines"),
        F.max("last_content").alias("deepest_content"),
        F.count("last_content").alias("pages_with_content"),
    )
    return g.join(ev.sources.select("run_id", "source_id", "name"), ["run_id", "source_id"])


# ------------------------------------------------------------------ H


def spans(ev: Evidence) -> DataFrame:
    """Spans of four pages; of five sources one overlaps, one has holes, one is reversed, one runs
    past its last page."""
    k = F.floor(F.col("page_in_doc") / 4).cast("int")
    g = (
        ev.pages.groupBy("run_id", "source_id", k.alias("k"))
        .agg(
            F.min_by("doc_type", "page_in_doc").alias("doc_type"),
            F.min("page_in_doc").alias("a"),
            F.max("page_in_doc").alias("b"),
        )
        .join(ev.sources.select("run_id", "source_id", "pos", "page_count"), ["run_id", "source_id"])
    )
    p = F.col("pos") % 5
    last = F.col("page_count") - 1
    reversed_ = (p == 3) & (F.col("k") == 0)
    frm = F.when(reversed_, F.col("b") + 1).otherwise(F.col("a"))
    to = (
        F.when(reversed_, F.col("a"))
        .when((p == 1) & (F.col("b") < last) & (F.col("k") % 4 == 0), F.col("b") + 1)
        .when((p == 4) & (F.col("b") == last), F.col("b") + 100)
        .otherwise(F.col("b"))
    )
    return g.where(~((p == 2) & (F.col("k") % 3 == 1))).select(
        "run_id", "source_id", "doc_type", frm.cast("int").alias("from_page"), to.cast("int").alias("to_page")
    )


add_duck(
    "spn",
    """
    select run_id, source_id, doc_type, (case when pos % 5 = 3 and k = 0 then b + 1 else a end)::int as from_page,
           (case when pos % 5 = 3 and k = 0 then a when pos % 5 = 1 and b < page_count - 1 and k % 4 = 0 then b + 1
                 when pos % 5 = 4 and b = page_count - 1 then b + 100 else b end)::int as to_page
    from (select run_id, source_id, page_in_doc // 4 as k, min_by(doc_type, page_in_doc) as doc_type, min(page_in_doc) as a, max(page_in_doc) as b from pgs group by all)
    join srcs using (run_id, source_id) where not (pos % 5 = 2 and k % 3 = 1)""",
    ["pgs", "srcs"],
)
ISSUES_SQL = """
  with sh as (select s.*, n - 1 as last_page, case when from_page > to_page then 'reversed' when to_page > n - 1 then 'past-last-page' end as issue
              from spn s join (select run_id, source_id, count(*) as n from pgs group by all) using (run_id, source_id)),
       bad as (select distinct run_id, source_id from sh where issue is not null)
  select run_id, source_id, to_page as page, issue, 0::int as times from sh where issue is not null
  union all
  select p.run_id, p.source_id, p.page_in_doc, case when count(s.from_page) = 0 then 'not-covered' else 'covered-twice' end, count(s.from_page)::int
  from pgs p left join spn s on s.run_id = p.run_id and s.source_id = p.source_id and p.page_in_doc between s.from_page and s.to_page
  where not exists (select 1 from bad b where b.run_id = p.run_id and b.source_id = p.source_id)
    and exists (select 1 from spn b where b.run_id = p.run_id and b.source_id = p.source_id)
  group by all having count(s.from_page) <> 1"""
add_duck("iss", ISSUES_SQL, ["spn", "pgs"])
add_duck(
    "typ",
    """select distinct p.run_id, p.page_index, p.source_id, s.doc_type from spn s join pgs p on s.run_id = p.run_id and s.source_id = p.source_id
       and p.page_in_doc between s.from_page and s.to_page
       where not exists (select 1 from iss i where i.run_id = s.run_id and i.source_id = s.source_id)""",
    ["iss"],
)


@query(
    "h1_page_heads",
    duck(
        "select run_id, page_index, substr(string_agg(text, ' ' order by i), 1, 400) as head from lns where i < 12 group by all",
        "lns",
    ),
)
def h1(ev: Evidence) -> DataFrame:
    return pool.page_heads(ev.lines)


@query("h2_span_issues", duck("select * from iss", "iss"))
def h2(ev: Evidence) -> DataFrame:
    return pool.span_issues(spans(ev), ev.pages)


@query("h3_pages_by_type", duck("select * from typ", "typ"))
def h3(ev: Evidence) -> DataFrame:
    return pool.pages_by_type(spans(ev), ev.pages)


@query(
    "h4_head_lines",
    duck(
        """select run_id, page_index, i from (select *, coalesce(sum(length(text)+1) over (partition by run_id, page_index order by i
             rows between unbounded preceding and 1 preceding), 0) as shown from lns) where shown < 400""",
        "lns",
    ),
)
def h4(ev: Evidence) -> DataFrame:
    return pool.head_lines(ev.lines).select(*PAGE, "i")


# ------------------------------------------------------------------ P


def wanted_pools(ev: Evidence) -> DataFrame:
    """A pool per document type slots ask for, plus one for slots without a type."""
    t = ev.slots.where("fillable").select("run_id", "doc_type").distinct()
    return t.select("run_id", F.coalesce("doc_type", F.lit("(none)")).alias("pool_id"), "doc_type")


add_duck(
    "wpl",
    "select distinct run_id, coalesce(doc_type, '(none)') as pool_id, doc_type from slots where fillable",
    ["slots"],
)
add_duck(
    "opn",
    "select p.* from pgs p join srcs s on s.run_id = p.run_id and s.source_id = p.source_id where s.ai is distinct from false",
    ["pgs", "srcs"],
)
add_duck(
    "rpl",
    """select run_id, pool_id, page_index, preferred, (row_number() over (partition by run_id, pool_id order by not preferred, page_index) - 1)::int as position
       from (select o.run_id, w.pool_id, o.page_index, exists (select 1 from typ t where t.run_id = o.run_id and t.page_index = o.page_index and t.doc_type = w.doc_type) as preferred
             from opn o join (select run_id, pool_id, any_value(doc_type) as doc_type from wpl group by all) w using (run_id))""",
    ["opn", "wpl", "typ"],
)


def open_pool(ev: Evidence) -> pool.RankedPools:
    return pool.RankedPools(pool.open_pages(ev.pages, ev.sources), h3(ev), wanted_pools(ev))


@query(
    "p1_pool_for_types",
    duck("select distinct run_id, pool_id, page_index from typ join wpl using (run_id, doc_type)", "typ", "wpl"),
)
def p1(ev: Evidence) -> DataFrame:
    return pool.pool_for_types(h3(ev), wanted_pools(ev))


@query("p2_ranked_pool", duck("select * from rpl", "rpl"))
def p2(ev: Evidence) -> DataFrame:
    return open_pool(ev).rows()


@query(
    "p3_remap_positions",
    duck(
        """select c.run_id, c.claim_id, c.pool_id, c.position, r.page_index from
             (select run_id, claim_id, 'KB' as pool_id, (claim_id * 7 % 400)::int as position from clm) c left join rpl r using (run_id, pool_id, position)""",
        "clm",
        "rpl",
    ),
)
def p3(ev: Evidence) -> DataFrame:
    c = ev.claims.select(
        "run_id", "claim_id", F.lit("KB").alias("pool_id"), (F.col("claim_id") * 7 % 400).cast("int").alias("position")
    )
    return open_pool(ev).remap(c)


def form_rows(ev: Evidence) -> DataFrame:
    """Two forms with a field row per part; keys repeat and some are missing."""
    k = F.col("p_partkey")
    key = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("field-"), (F.col("p_size") % 40).cast("string"))
    )
    return ev.table("part").select(
        F.when(k % 2 == 0, "A").otherwise("B").alias("form_id"), key.alias("field_key"), k.cast("int").alias("pos"), "p_name"
    )


add_duck(
    "frw",
    """select case when p_partkey % 2 = 0 then 'A' else 'B' end as form_id, case when p_partkey % 11 <> 0 then 'field-' || (p_size % 40) end as field_key,
              p_partkey::int as pos, p_name from part""",
    [],
)


def special_types(ev: Evidence) -> DataFrame:
    """Types of the keys that are looked for elsewhere."""
    return (
        form_rows(ev)
        .where("field_key like 'field-%1'")
        .select("field_key", F.lit("Email").alias("signature"))
        .distinct()
    )


def never_extracted(ev: Evidence) -> DataFrame:
    return form_rows(ev).where("field_key = 'field-7'").select("field_key").distinct()


add_duck(
    "p4g",
    """
        select form_id, signature, min(pos) as pos, string_agg(field_key, ', ' order by pos, field_key) as keys
        from (select form_id, field_key, min(pos) as pos, case when field_key like 'field-%1' then 'Email' else d.def end as signature
              from frw join (select form_id, string_agg(doc_type, '|' order by pos) as def from
                    (select form_id, doc_type, min(pos) as pos from fsl where layout = 'images' and fillable and doc_type is not null group by all) group by form_id) d using (form_id)
              where field_key is not null and field_key <> '' and field_key <> 'field-7' group by form_id, field_key, d.def)
        group by form_id, signature""",
    ["frw", "fsl"],
)


@query("p4_key_groups", duck("select * from p4g", "p4g"))
def p4(ev: Evidence) -> DataFrame:
    keys = pool.extractable_keys(form_rows(ev), never_extracted(ev))
    return pool.key_groups(keys, special_types(ev), pool.default_types(ev.form_slots))


@query(
    "p5_in_form_order",
    duck(
        """select run_id, key, pos as discovered, coalesce(s.rank, 2147483647)::int as rank from cap join runs using (run_id)
           left join (select form_id, slot_key, pos as rank from fsl) s using (form_id, slot_key) where page_index is not null""",
        "cap",
        "runs",
        "fsl",
    ),
)
def p5(ev: Evidence) -> DataFrame:
    zones = ev.captures.where("page_index is not null").join(ev.runs, "run_id")
    return pool.in_form_order(zones, ev.form_slots).select(
        "run_id", "key", F.col("pos").alias("discovered"), "rank"
    )


@query("p6_searchable_pages", duck("select run_id, count(*) as searchable from opn group by all", "opn"))
def p6(ev: Evidence) -> DataFrame:
    return pool.searchable_page_counts(ev.pages, ev.sources)


def whole_page_wanted(ev: Evidence) -> DataFrame:
    """Every capture of a fillable whole-page slot."""
    s = ev.slots.where("layout = 'images' and fillable").select("run_id", "slot_key", "doc_type", "page_ordinal")
    return ev.captures.select("run_id", "slot_key", "key", "pos").join(s, ["run_id", "slot_key"])


WHOLE_SQL = """
  select run_id, key, slot_key, case when reason is null then 'proposal' else 'outstanding' end as outcome, reason,
         case when reason is null then pi end as page_index, case when reason is null then 0 end as from_line,
         case when reason is null then n - 1 end::int as to_line, case when reason is null then width::double end as w,
         case when reason is null then height::double end as h, case when reason is null then tx end as text
  from (select w.*, t.page_index as pi, p.width, p.height, l.n, l.tx, case when w.doc_type is null then 'no-document-type' when t.page_index is null then 'no-such-page'
               when l.n is null then 'no-readable-text' when w.rk > 1 then 'extra-capture-of-whole-page-slot' end as reason
        from (select c.run_id, c.slot_key, c.key, s.doc_type, s.page_ordinal, row_number() over (partition by c.run_id, c.slot_key order by c.pos) as rk
              from cap c join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key where s.layout = 'images' and s.fillable) w
        left join (select *, row_number() over (partition by run_id, doc_type order by page_index) - 1 as page_ordinal from otyp) t using (run_id, doc_type, page_ordinal)
        left join pgs p on p.run_id = w.run_id and p.page_index = t.page_index
        left join (select run_id, page_index, count(*) as n, string_agg(text, chr(10) order by i) as tx from lns group by all) l on l.run_id = w.run_id and l.page_index = t.page_index)"""
add_duck(
    "otyp",
    "select t.* from typ t join srcs s on s.run_id = t.run_id and s.source_id = t.source_id where s.ai is distinct from false",
    ["typ", "srcs"],
)


def open_typed(ev: Evidence) -> DataFrame:
    return pool.open_pages(h3(ev), ev.sources)


@query("p7_whole_page_proposals", duck(WHOLE_SQL, "cap", "slots", "otyp", "pgs", "lns"))
def p7(ev: Evidence) -> DataFrame:
    return pool.whole_page_proposals(whole_page_wanted(ev), open_typed(ev), ev.pages, ev.lines)


@query(
    "p8_later_round_positions",
    duck(
        """select s.run_id, s.slot_key, s.doc_type, s.page_ordinal, (s.page_ordinal - (select count(*) from w e join sat using (run_id, slot_key)
                   where e.run_id = s.run_id and e.doc_type is not distinct from s.doc_type and e.page_ordinal < s.page_ordinal))::int as position
           from w s where not exists (select 1 from sat x where x.run_id = s.run_id and x.slot_key = s.slot_key)""",
        "cap",
        "slots",
        w="select run_id, slot_key, doc_type, page_ordinal from slots where layout = 'images' and fillable",
        sat="select distinct run_id, slot_key from cap where status = 'confirmed' and page_index is not null and ordinal % 3 = 0",
    ),
)
def p8(ev: Evidence) -> DataFrame:
    s = ev.slots.where("layout = 'images' and fillable").select("run_id", "slot_key", "doc_type", "page_ordinal")
    done = ev.captures.where("status = 'confirmed' and page_index is not null and ordinal % 3 = 0")
    return pool.later_round_positions(s, done)


@query(
    "u10_global_page_index",
    duck("select run_id, source_id, page_in_doc, page_index, doc_id from pgs", "pgs"),
)
def u10(ev: Evidence) -> DataFrame:
    base = ev.pages.select("run_id", "source_id", "page_in_doc", "doc_id")
    return global_page_index(base, ev.sources)
