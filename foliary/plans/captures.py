"""Forms, captures, sources and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE
from foliary.operators import captures as cap
from foliary.operators import overlay as ovl
from foliary.operators import pools as pool
from foliary.plans.citations import v7
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.reconcile import added_pages, proposal_pages
from foliary.plans.registry import query


def _place():
    return F.col("pos")



def _s(c):
    return c.cast("string")


# ------------------------------------------------------------------ D8, D9, D21


def base_form(ev: Evidence) -> DataFrame:
    return ev.slots.withColumn("section_pos", F.regexp_extract("section_id", "([0-9]+)$", 1).cast("int"))


def overlay_tables(ev: Evidence) -> dict[str, DataFrame]:
    s = base_form(ev)
    one = s.select("run_id", "section_id", "section_title", "section_pos").distinct()
    n = F.col("section_pos")
    run = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int")
    sections = one.where((n + run) % 4 != 3).select(
        "run_id", "section_id", F.when((n + run) % 4 == 0, F.concat("section_title", F.lit(" (baru)"))).alias("title"), F.when((n + run) % 4 == 1, F.lit(True)).alias("removed")
    )
    slots = s.where("pos % 3 = 0").select(
        "run_id", "slot_key", F.when(_place() % 2 == 0, F.concat(F.lit("Renamed "), _s(_place()))).alias("label"), F.when(_place() % 9 == 3, F.lit(True)).alias("removed")
    )
    added = s.where("pos % 8 = 2").select(
        "run_id", F.when(_place() % 16 == 10, F.lit("sec-1")).otherwise(F.concat(F.lit("u:"), "section_id")).alias("section_id"), F.concat(F.lit("Added "), "section_title").alias("section_title"),
        F.when(n % 2 == 0, "human").otherwise("llm").alias("origin"), "section_pos", F.concat(F.lit("u:"), "slot_key").alias("slot_key"), F.lit("Page").alias("label"), F.lit(0).alias("pos"),
    )
    order = one.where("section_pos >= 2").select("run_id", "section_id", (F.lit(9) - n).cast("int").alias("place"))
    return {"section_patches": sections, "slot_patches": slots, "added": added, "order": order}


add_duck(
    "bfm",
    "select *, cast(regexp_extract(section_id,'([0-9]+)$',1) as int) as n, cast(regexp_extract(run_id,'([0-9]+)$',1) as int) as r from slots",
    ["slots"],
)
add_duck(
    "rsf",
    """
    select q.*, coalesce(case when n >= 2 and not starts_with(section_id, 'u:') then 9 - n end, n + case when origin is null then 10000000 else 11000000 end)::int as section_order from (
      select run_id, section_id, n, case when (n + r) % 4 = 0 then section_title || ' (baru)' else section_title end as section_title, slot_key, pos,
             case when pos % 3 = 0 and pos % 2 = 0 then 'Renamed ' || pos else label end as label, layout, fillable, page_ordinal, null as origin
      from bfm where (n + r) % 4 <> 1 and not (pos % 9 = 3)
      union all select run_id, 'u:' || section_id, n, 'Added ' || section_title, 'u:' || slot_key, 0, 'Page', 'images', true, 0, case when n % 2 = 0 then 'human' else 'llm' end
      from bfm where pos % 8 = 2 and pos % 16 <> 10) q""",
    ["bfm"],
)


def resolved(ev: Evidence) -> DataFrame:
    return ovl.resolve_form(base_form(ev), **overlay_tables(ev))


@query("d8_resolve_form", duck("select * exclude (n) from rsf", "rsf"))
def d8(ev: Evidence) -> DataFrame:
    return resolved(ev)


@query("d8_id_clashes", duck("select distinct run_id, 'sec-1' as id from bfm where pos % 16 = 10", "bfm"))
def d8_clashes(ev: Evidence) -> DataFrame:
    return ovl.id_clashes(base_form(ev), overlay_tables(ev)["added"])


@query(
    "d9_overlay_violations",
    """
    with nd as (select 'run-' || (k % 3) as run_id, ['sections','slots','added','added-slots','proposed','order'][k % 6 + 1] as list, case k % 23 when 1 then '' when 2 then 'a#' || k when 3 then repeat('x', 201) when 4 then 'twice' else 'n' || k end as id,
                  case when k % 6 = 5 or k % 29 = 1 then null when k % 29 = 2 then '  ' when k % 29 = 3 then repeat('y', 201) else p_name end as label, case k % 7 when 0 then 'human' when 1 then 'bot' else 'llm' end as origin,
                  case when k % 31 = 0 then '{"a":[{"hint" : 1}]}' else '{"label":"' || p_name || '"}' end as raw, k from (select p_partkey as k, p_name from part)),
    c as (select *, count(*) over (partition by run_id, case when list in ('sections','added','proposed') then 1 when list = 'order' then 2 else 3 end, id) as n from nd)
    select run_id, list, id, rule from (select *, case when k % 31 = 0 then 'forbidden-key' when id = '' then 'id-empty' when length(id) > 200 then 'id-too-long' when contains(id,'#') then 'id-has-separator'
       when list in ('added','added-slots','proposed') and label is null then 'label-missing' when label is not null and trim(label) = '' then 'label-empty' when length(label) > 200 then 'label-too-long'
       when list = 'added' and origin not in ('human','llm') then 'origin' when n > 1 then 'id-used-twice' end as rule from c) where rule is not null
    """,
)
def d9(ev: Evidence) -> DataFrame:
    k = F.col("p_partkey")
    lists = F.array(*[F.lit(x) for x in ("sections", "slots", "added", "added-slots", "proposed", "order")])
    nodes = ev.table("part").select(
        F.concat(F.lit("run-"), _s(k % 3)).alias("run_id"),
        F.element_at(lists, (k % 6 + 1).cast("int")).alias("list"),
        F.when(k % 23 == 1, "").when(k % 23 == 2, F.concat(F.lit("a#"), _s(k))).when(k % 23 == 3, "x" * 201).when(k % 23 == 4, "twice").otherwise(F.concat(F.lit("n"), _s(k))).alias("id"),
        F.when((k % 6 == 5) | (k % 29 == 1), F.lit(None).cast("string")).when(k % 29 == 2, "  ").when(k % 29 == 3, "y" * 201).otherwise(F.col("p_name")).alias("label"),
        F.when(k % 7 == 0, "human").when(k % 7 == 1, "bot").otherwise("llm").alias("origin"),
        F.when(k % 31 == 0, '{"a":[{"hint" : 1}]}').otherwise(F.concat(F.lit('{"label":"'), "p_name", F.lit('"}'))).alias("raw"),
    )
    return ovl.overlay_violations(nodes)


@query(
    "d21_hidden_sections",
    duck(
        "select distinct run_id, section_id, case when (n + r) % 4 = 0 then section_title || ' (baru)' else section_title end as title from bfm b where not exists (select 1 from rsf where rsf.run_id = b.run_id and rsf.section_id = b.section_id)",
        "rsf",
    ),
)
def d21_hidden(ev: Evidence) -> DataFrame:
    return ovl.hidden_sections(base_form(ev), resolved(ev), overlay_tables(ev)["section_patches"])


@query(
    "d21_section_rows",
    duck(
        """select run_id, section_id, title, row_number() over (partition by run_id order by o, section_id)::int as place, count(*) over (partition by run_id) as sections, slots,
                  case when origin is not null then origin when was <> title then 'renamed' else 'declared' end as provenance, case when origin is null and was <> title then was end as was_called
           from (select run_id, section_id, any_value(section_title) as title, min(section_order) as o, count(*) as slots, any_value(origin) as origin from rsf group by all)
           left join (select distinct run_id, section_id, section_title as was from bfm) using (run_id, section_id)""",
        "rsf",
    ),
)
def d21(ev: Evidence) -> DataFrame:
    return ovl.section_rows(base_form(ev), resolved(ev))


# ------------------------------------------------------------------ D10, D17


@query("d10_searchable_captures", duck("select c.run_id, c.key, coalesce(not s.added, false) as searchable from cap c left join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key", "cap", "slots"))
def d10(ev: Evidence) -> DataFrame:
    return cap.searchable_captures(ev.captures, ev.slots).select("run_id", "key", "searchable")


@query(
    "d17_wanted_captures",
    duck(
        "select c.run_id, c.key from cap c join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key where not added and page_index is null and status in ('pending','outstanding') and c.ordinal = 1",
        "cap",
        "slots",
    ),
)
def d17(ev: Evidence) -> DataFrame:
    return cap.wanted_captures(ev.captures, ev.slots)


add_duck(
    "wlk",
    """select c.run_id, c.key, c.page_index, from_line, to_line from cap c join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key join opn o on o.run_id = c.run_id and o.page_index = c.page_index
       where not added and status in ('proposed','confirmed') and checked_for is distinct from (c.page_index || ':' || from_line || '-' || to_line)""",
    ["cap", "slots", "opn"],
)


@query("d17_captures_to_walk", duck("select * from wlk", "wlk"))
def d17_walk(ev: Evidence) -> DataFrame:
    return cap.captures_to_walk(ev.captures, ev.slots, ev.pages, ev.sources)


@query("d17_sources_to_discover", duck("select run_id, source_id from srcs where ai and (pos % 2 <> 0 or pos % 3 = 0)", "srcs"))
def d17_sources(ev: Evidence) -> DataFrame:
    s = ev.sources.withColumn("sections_asked", F.when(_place() % 2 == 0, F.lit(True)))
    return cap.sources_to_discover(s, ev.sources.where("pos % 3 = 0"))


# ------------------------------------------------------------------ D13 - D16, D25, V23


def answers(ev: Evidence) -> DataFrame:
    """An answer per capture: proposals, outstanding and out-of-scope keys."""
    m = _place() % 5
    o = F.when(m == 0, "out-of-scope").when(m <= 2, "proposal").otherwise("outstanding")
    return ev.captures.where("pos % 7 <> 0").select(
        "run_id", "key", o.alias("outcome"), _place().alias("page_index"), F.lit(0).alias("from_line"), F.lit(1).alias("to_line"), F.concat(F.lit("t"), _s(_place())).alias("text")
    )


add_duck(
    "apl",
    """select run_id, key, slot_key, ordinal, pos, case when takes then 'proposed' when op and m >= 3 and pos % 7 <> 0 then 'outstanding' else status end as status, case when takes then 'llm' else origin end as origin,
              case when takes then pos else page_index end as page_index, case when takes then 0 else from_line end as from_line, case when takes then 1 else to_line end as to_line, case when takes then 't' || pos end as text, checked_for
       from (select *, pos % 5 as m, status in ('pending','outstanding') and page_index is null and not (pos % 5 = 0 and pos % 7 <> 0) as op,
                    status in ('pending','outstanding') and page_index is null and pos % 7 <> 0 and pos % 5 in (1,2) as takes from cap)""",
    ["cap"],
)


def proposed(ev: Evidence) -> DataFrame:
    return cap.apply_proposals(ev.captures, answers(ev))


@query("d13_apply_proposals", duck("select * from apl", "apl"))
def d13(ev: Evidence) -> DataFrame:
    return proposed(ev)


def found_continuations(ev: Evidence) -> tuple[DataFrame, DataFrame]:
    """Two answers per second capture; some repeat a zone the slot holds."""
    c = ev.captures.where("pos % 2 = 0").select("run_id", F.col("key").alias("after"), "pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("at"))
    same = (_place() % 8 == 0) & (F.col("at") == 0)
    found = c.select(
        "run_id", "after", (_place() * 4 + F.col("at")).alias("seq"), (_place() + 1 + F.when(same, 0).otherwise(F.col("at"))).cast("int").alias("page_index"),
        F.lit(0).alias("from_line"), F.lit(3).alias("to_line"), ((F.col("at") == 0) | (_place() % 3 == 0)).alias("checked"),
    )
    return found, ev.captures.where("pos % 2 = 0").select("run_id", "key")


add_duck(
    "fnd",
    """select run_id, key as after, slot_key, pos*4 + nth as seq, (pos + 1 + case when pos % 8 = 0 and nth = 0 then 0 else nth end)::int as page_index, nth = 0 or pos % 3 = 0 as checked
       from cap, unnest([0,1]) t(nth) where pos % 2 = 0 and page_index is not null and status <> 'unfilled'""",
    ["cap"],
)
add_duck(
    "apc",
    """
    select run_id, key, slot_key, ordinal, pos, status, page_index, from_line, to_line, origin, case when pos % 2 = 0 and page_index is not null then page_index || ':' || from_line || '-' || to_line else checked_for end as checked_for from cap
    union all
    select f.run_id, f.slot_key || '#' || o, f.slot_key, o::int, (last + 1 + row_number() over (partition by f.run_id order by seq) - 1)::int, 'proposed', page_index, 0, 3, 'llm', case when checked then page_index || ':0-3' end
    from (select x.*, greatest(2, top + 1) + row_number() over (partition by x.run_id, x.slot_key order by seq) - 1 as o from
           (select * from fnd where not exists (select 1 from cap c where c.run_id = fnd.run_id and c.slot_key = fnd.slot_key and c.page_index = fnd.page_index and c.from_line = 0 and c.to_line = 3)
            qualify row_number() over (partition by run_id, slot_key, page_index order by seq) = 1) x
         join (select run_id, slot_key, max(ordinal) as top from cap group by all) using (run_id, slot_key)) f
    join (select run_id, max(pos) as last from cap group by all) using (run_id)""",
    ["cap", "fnd"],
)


@query("d14_apply_continuations", duck("select * from apc", "apc"))
def d14(ev: Evidence) -> DataFrame:
    return cap.apply_continuations(ev.captures, *found_continuations(ev))


@query(
    "d25_apply_response",
    duck(
        """select run_id, count(*) as captures, count(*) filter (where status = 'proposed') as proposed, count(page_index) as zoned, count(checked_for) as stamped from
             (select status, a.run_id, case when apl.key is not null then apl.page_index else a.page_index end as page_index,
                     case when apl.key is not null then case when a.pos % 2 = 0 and apl.page_index is not null then 'x' else apl.checked_for end else a.checked_for end as checked_for
              from (select run_id, key, pos, page_index, checked_for, status as s0 from apc) a left join (select run_id, key, status as s1, page_index, checked_for from apl) apl using (run_id, key)
              cross join lateral (select coalesce(s1, s0) as status) z) group by run_id""",
        "apc",
        "apl",
    ),
)
def d25(ev: Evidence) -> DataFrame:
    """Proposals, then continuations of the captures held before."""
    found, checked = found_continuations(ev)
    held = ev.captures.where("page_index is not null and status <> 'unfilled'").select("run_id", F.col("key").alias("after"))
    before = found.join(held, ["run_id", "after"], "left_semi")
    after = cap.apply_continuations(proposed(ev).drop("text"), before, checked)
    return after.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("captures"), F.count_if(F.col("status") == "proposed").alias("proposed"), F.count("page_index").alias("zoned"), F.count("checked_for").alias("stamped")
    )


def drop_targets(ev: Evidence) -> DataFrame:
    """The third capture of every second slot."""
    return ev.captures.where("ordinal = 3").where(F.regexp_extract("slot_key", "([0-9]+)$", 1).cast("int") % 2 == 0).select("run_id", "slot_key", "ordinal")


@query(
    "d15_drop_captures",
    duck(
        """select run_id, key, 'with' as how from cap c where not (ordinal >= 3 and cast(regexp_extract(slot_key,'([0-9]+)$',1) as int) % 2 = 0)
           union all select run_id, key, 'after' from cap c where not (ordinal > 3 and cast(regexp_extract(slot_key,'([0-9]+)$',1) as int) % 2 = 0)""",
        "cap",
    ),
)
def d15(ev: Evidence) -> DataFrame:
    own = cap.drop_captures(ev.captures, drop_targets(ev), True).select("run_id", "key", F.lit("with").alias("how"))
    return own.unionByName(cap.drop_captures(ev.captures, drop_targets(ev), False).select("run_id", "key", F.lit("after").alias("how")))


def removed_sources(ev: Evidence) -> DataFrame:
    return ev.sources.where("pos % 5 = 2").select("run_id", "source_id")


add_duck(
    "mvs",
    """select run_id, page_index, case when pos % 5 <> 2 then (row_number() over (partition by run_id, pos % 5 = 2 order by page_index) - 1)::int end as new_page, pos % 5 = 2 as removed
       from pgs join srcs using (run_id, source_id)""",
    ["pgs", "srcs"],
)
add_duck(
    "rmv",
    """
    with c as (select cap.*, m.new_page, m.removed from cap left join mvs m using (run_id, page_index)),
    k as (select c.*, coalesce(ordinal >= cut, false) as hit, cut from c left join (select run_id, slot_key, min(ordinal) as cut from c where removed group by all) using (run_id, slot_key)),
    s as (select *, case when cut is not null then max(pos) over (partition by run_id, slot_key) end as fin from k where not (hit and ordinal > 1))
    select run_id, key, slot_key, ordinal, pos, case when hit then 'pending' else status end as status, case when not hit then new_page end as page_index, case when not hit then from_line end as from_line,
           case when not hit then to_line end as to_line, case when not hit then origin end as origin,
           case when not hit and pos <> coalesce(fin, -1) then case when page_index is null then checked_for when checked_for = page_index || ':' || from_line || '-' || to_line then new_page || ':' || from_line || '-' || to_line end end as checked_for
    from s""",
    ["cap", "mvs"],
)


@query("d16_page_moves", duck("select * from mvs", "mvs"))
def d16_moves(ev: Evidence) -> DataFrame:
    return cap.page_moves(ev.pages, removed_sources(ev))


@query("d16_remove_sources", duck("select * from rmv", "rmv"))
def d16(ev: Evidence) -> DataFrame:
    return cap.remove_sources(ev.captures, ev.pages, removed_sources(ev))


@query(
    "a13_source_removal_cost",
    duck(
        """select run_id, pages, coalesce(captures,0) as captures, coalesce(confirmed,0) as confirmed from (select run_id, count(*) as pages from mvs where removed group by all)
           left join (select run_id, count(*) as captures, count(*) filter (where status='confirmed') as confirmed from c join cut using (run_id, slot_key) where ordinal >= cut and page_index is not null group by all) using (run_id)""",
        "cap",
        "mvs",
        c="select cap.*, m.removed from cap left join mvs m using (run_id, page_index)",
        cut="select run_id, slot_key, min(ordinal) as cut from c where removed group by all",
    ),
)
def a13(ev: Evidence) -> DataFrame:
    return cap.removal_cost(ev.captures, ev.pages, removed_sources(ev))


@query(
    "v23_remap_citations",
    duck(
        "select c.run_id, claim_id, m.new_page as page_index, case when m.new_page is not null then from_line end as from_line, case when m.new_page is not null then to_line end as to_line from clm c left join mvs m using (run_id, page_index)",
        "clm",
        "mvs",
    ),
)
def v23(ev: Evidence) -> DataFrame:
    return cap.remap_citations(ev.claims, cap.page_moves(ev.pages, removed_sources(ev)))


add_duck("ppg", "select run_id, source_id, source_id || '-' || (page_in_doc // 4) as section_id, page_index, page_in_doc from pgs where page_in_doc // 4 % 2 = 0", ["pgs"])


@query(
    "v23_remap_proposals",
    duck(
        """select p.run_id, p.source_id, p.section_id, case when m.removed then p.page_index else m.new_page end as page_index from ppg p join mvs m using (run_id, page_index)
           where m.removed or p.page_in_doc % 8 <= 3""",
        "ppg",
        "mvs",
    ),
)
def v23_proposals(ev: Evidence) -> DataFrame:
    return cap.remap_proposals(proposal_pages(ev), cap.page_moves(ev.pages, removed_sources(ev)), removed_sources(ev))


# ------------------------------------------------------------------ D12


def wide_sections(ev: Evidence) -> DataFrame:
    """Added sections of eight pages, which hold some proposals of four whole."""
    k = F.floor(F.col("page_in_doc") / 8)
    return ev.pages.where(k % 3 == 0).select("run_id", "source_id", F.concat("source_id", F.lit("+"), _s(k)).alias("section_id"), "page_index")


@query(
    "d12_record_proposals",
    duck(
        """select run_id, source_id, section_id, page_index from ppg p join srcs s using (run_id, source_id) where s.pos % 2 = 1 or page_in_doc // 8 % 3 <> 0""",
        "ppg",
        "srcs",
    ),
)
def d12(ev: Evidence) -> DataFrame:
    p = proposal_pages(ev)
    even = ev.sources.where("pos % 2 = 0").select("run_id", "source_id")
    return cap.record_proposals(p, p.join(even, ["run_id", "source_id"], "left_semi"), wide_sections(ev), even)


@query(
    "d12_accept_proposals",
    duck(
        """select p.run_id, p.section_id, p.page_index, case when r is null then 'proposed' end as status, case when r is null then 0 end as from_line, case when r is null then n - 1 end::int as to_line,
                  case when r is null then tx end as text, r as reason
           from (select ppg.*, case when page_in_doc // 8 % 3 = 0 then 'already-held' end as r from ppg where page_in_doc // 4 % 4 = 2 or page_in_doc // 4 % 3 = 0) p
           join (select run_id, page_index, count(*) as n, string_agg(text, chr(10) order by i) as tx from lns group by all) l using (run_id, page_index)""",
        "ppg",
        "lns",
    ),
)
def d12_accept(ev: Evidence) -> DataFrame:
    k = F.regexp_extract("section_id", "-([0-9]+)$", 1).cast("int")
    chosen = proposal_pages(ev).where((k % 4 == 2) | (k % 3 == 0)).select("run_id", "section_id").distinct()
    return cap.accept_proposals(proposal_pages(ev), chosen, wide_sections(ev), ev.pages, ev.lines)


@query("d12_reject_proposals", duck("select run_id, source_id, section_id, page_index from ppg where page_in_doc // 4 % 3 <> 0", "ppg"))
def d12_reject(ev: Evidence) -> DataFrame:
    k = F.regexp_extract("section_id", "-([0-9]+)$", 1).cast("int")
    return cap.reject_proposals(proposal_pages(ev), proposal_pages(ev).where(k % 3 == 0))


# ------------------------------------------------------------------ D18 - D20, D22, D23


@query(
    "d18_fence_report",
    duck(
        """select run_id, source_id, name, run_id <> 'run-1' as known, case when run_id <> 'run-1' then case when ai then 'now-read' else 'skipped' end else case when ai then 'now-read' else 'skipped' end end as state
           from srcs where (run_id <> 'run-1' and pos % 3 <> 0) or run_id = 'run-1'""",
        "srcs",
    ),
)
def d18(ev: Evidence) -> DataFrame:
    checks = ev.runs.select("run_id", (F.col("run_id") != "run-1").alias("known"))
    return cap.fence_report(ev.sources, ev.sources.where("pos % 3 <> 0"), checks)


@query("d19_usable_extractions", duck("select run_id from runs where run_id <> 'run-2'", "runs"))
def d19(ev: Evidence) -> DataFrame:
    """Signatures taken before one source of run-2 was opened or fenced."""
    moved = (F.col("run_id") == "run-2") & (_place() == 2)
    before = ev.sources.withColumn("ai", F.when(moved, ~F.col("ai")).otherwise(F.col("ai")))
    return cap.usable_extractions(cap.extraction_signature(before), ev.sources).select("run_id")


@query(
    "d20_merge_zones",
    duck(
        "select run_id, slot_key, round, pos, page_index from (select *, (doc_round)::int as round, row_number() over (partition by run_id, slot_key order by doc_round, pos) as r from (select *, pos % 3 as doc_round from cap where page_index is not null)) where r = 1",
        "cap",
    ),
)
def d20(ev: Evidence) -> DataFrame:
    z = ev.captures.where("page_index is not null").select("run_id", "slot_key", (_place() % 3).cast("int").alias("round"), "pos", "page_index")
    return cap.merge_zones(z)


@query(
    "d22_seed_slots",
    duck("select run_id, slot_key as key, label, 'pending' as status from slots s where fillable and pos % 4 <> 0", "slots"),
)
def d22(ev: Evidence) -> DataFrame:
    return cap.seed_slots(ev.slots, ev.slots.where("pos % 4 = 0"))


@query(
    "d23_list_runs",
    duck(
        """select run_id, n as created_at, case when c = 1 then f else f || ' +' || (c - 1) || ' berkas lagi' end as label, c as documents, d as with_digest
           from (select run_id, cast(regexp_extract(run_id,'([0-9]+)$',1) as int) * 1000 as n, arg_min(name, pos) as f, count(*) as c, count(*) filter (where pos % 4 <> 1) as d from srcs group by run_id)""",
        "srcs",
    ),
)
def d23(ev: Evidence) -> DataFrame:
    created = ev.runs.select("run_id", (F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int") * 1000).alias("created_at"))
    return cap.list_runs(ev.sources.withColumn("digest", F.when(_place() % 4 != 1, F.sha2("name", 256))), created)
