"""Request tables (R), reports (W) and arrivals (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators import captures as capt
from foliary.operators import citations as cit
from foliary.operators import continuation as con
from foliary.operators import furniture as fur
from foliary.operators import pools as pool
from foliary.operators import reconcile as rec
from foliary.operators import requests as req
from foliary.operators import sections as sec
from foliary.operators import standing as st
from foliary.plans.citations import context, judged, order_kinds, walk_zones
from foliary.plans.decisions import compared_fields
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.ledger import usage_rows
from foliary.plans.pools import open_pool, p4
from foliary.plans.reconcile import few_captures, reconciled, run_keys
from foliary.plans.registry import query
from foliary.plans.sources import CELLS_SQL, s10
from foliary.session import work_folder
from foliary.sources import sinks
from foliary.sources.transcripts import digests
from foliary.sources.workbook import sheet_extents
from foliary.streaming import arrivals as arr


def _place():
    return F.col("pos")


# ------------------------------------------------------------------ R1 - R6


@query(
    "r1_classify_listing",
    duck(
        """select p.run_id, p.source_id, (p.page_in_doc // 200)::int as part, string_agg('page ' || p.page_in_doc || ': ' || coalesce(head, ''), chr(10) order by p.page_in_doc) as text
           from pgs p left join (select run_id, page_index, substr(string_agg(text, ' ' order by i), 1, 400) as head from lns where i < 12 group by all) using (run_id, page_index) group by p.run_id, p.source_id, part""",
        "pgs",
        "lns",
    ),
)
def r1(ev: Evidence) -> DataFrame:
    return req.classify_listing(ev.lines, ev.pages)


@query(
    "r2_pool_listing",
    duck(
        """select r.run_id, r.pool_id, (r.position // 20)::int as part, string_agg('--- page ' || r.position || ' ---' || chr(10) || coalesce(body, ''), chr(10) || chr(10) order by r.position) as text
           from rpl r left join (select run_id, page_index, string_agg(i || ': ' || text, chr(10) order by i) as body from lns group by all) using (run_id, page_index) group by r.run_id, r.pool_id, part""",
        "rpl",
        "lns",
    ),
)
def r2(ev: Evidence) -> DataFrame:
    return req.pool_listing(open_pool(ev).rows(), ev.lines, pages_per_part=20)


def asked_slots(ev: Evidence) -> DataFrame:
    s = ev.slots.where("fillable and layout = 'table'")
    return s.select(
        "run_id", "slot_key", F.coalesce("doc_type", F.lit("(none)")).alias("pool_id"), "label",
        F.when(_place() % 2 == 0, F.concat(F.lit("hint of "), "label")).alias("hint"), "pos",
    )


add_duck("asl", "select run_id, slot_key, coalesce(doc_type,'(none)') as pool_id, label, case when pos % 2 = 0 then 'hint of ' || label end as hint, pos from slots where fillable and layout = 'table'", ["slots"])


@query(
    "r2_locate_questions",
    duck("""select run_id, slot_key, pool_id, 'field: "' || label || '"' || chr(10) || 'meaning: ' || coalesce(hint,'') as question from asl""", "asl"),
)
def r2_questions(ev: Evidence) -> DataFrame:
    return req.locate_questions(asked_slots(ev))


@query(
    "r3_pool_questions",
    duck(
        """select run_id, pool_id, call, count(*)::int as slots, string_agg('- key: ' || slot_key || chr(10) || '  field: "' || label || '"' || chr(10) || '  meaning: ' || coalesce(hint,''), chr(10) order by pos) as question
           from (select *, ((row_number() over (partition by run_id, pool_id order by pos) - 1) // 3)::int as call from asl) group by run_id, pool_id, call""",
        "asl",
    ),
)
def r3(ev: Evidence) -> DataFrame:
    return req.pool_questions(asked_slots(ev), per_call=3)


@query(
    "r4_field_questions",
    duck(
        """select form_id, signature, case when defs is not null then 'FIELD DEFINITIONS' || chr(10) || defs || chr(10) || chr(10) else '' end || 'Fields: ' || keys as question
           from p4g left join (select form_id, signature, string_agg('  ' || k || ': what ' || k || ' means', chr(10) order by place) as defs
                               from (select form_id, signature, unnest(string_split(keys, ', ')) as k, unnest(range(len(string_split(keys, ', ')))) as place from p4g) where k like '%3' group by all) using (form_id, signature)""",
        "p4g",
    ),
)
def r4(ev: Evidence) -> DataFrame:
    groups = p4(ev)
    keys = groups.select(F.explode(F.split("keys", ", ")).alias("field_key")).distinct()
    hints = keys.where("field_key like '%3'").withColumn("hint", F.concat(F.lit("what "), "field_key", F.lit(" means")))
    return req.field_questions(groups, hints)


@query(
    "r5_sections_listing",
    duck(
        """select p.run_id, p.source_id, (p.page_in_doc // 200)::int as part, string_agg('page ' || p.page_in_doc || ':' || coalesce(body, ' (no text was recognised on this page)'), chr(10) order by p.page_in_doc) as text
           from pgs p left join (select run_id, page_index, string_agg(chr(10) || '  ' || i || ': ' || text, '' order by i) as body from
              (select *, coalesce(sum(length(text)+1) over (partition by run_id, page_index order by i rows between unbounded preceding and 1 preceding), 0) as shown from lns) where shown < 400 group by all) using (run_id, page_index)
           group by p.run_id, p.source_id, part""",
        "pgs",
        "lns",
    ),
)
def r5(ev: Evidence) -> DataFrame:
    return req.sections_listing(ev.lines, ev.pages)


@query(
    "r6_continuation_questions",
    duck(
        """
        select z.run_id, z.key, least(coalesce(n,0), 6)::int as shown, coalesce(tx, '') as tail, '--- next page ---' || chr(10) || body as listing
        from wzn z join pgs p on p.run_id = z.run_id and p.page_index = z.page_index join pgs q on q.run_id = p.run_id and q.source_id = p.source_id and q.page_in_doc = p.page_in_doc + 1
        join (select run_id, page_index, string_agg(i || ': ' || text, chr(10) order by i) as body from lns group by all) b on b.run_id = q.run_id and b.page_index = q.page_index
        left join (select run_id, key, count(*) as n, string_agg(text, chr(10) order by i) filter (where r <= 6) as tx from
            (select z2.run_id, z2.key, l.i, l.text, row_number() over (partition by z2.run_id, z2.key order by l.i desc) as r from wzn z2 join lns l on l.run_id = z2.run_id and l.page_index = z2.page_index and l.i between z2.from_line and z2.to_line
             where not exists (select 1 from furn f where f.run_id = l.run_id and f.page_index = l.page_index and f.i = l.i)) group by all) t on t.run_id = z.run_id and t.key = z.key""",
        "wzn",
        "furn",
        "lns",
    ),
)
def r6(ev: Evidence) -> DataFrame:
    furniture = fur.running_furniture(ev.lines, ev.pages)
    return req.continuation_questions(walk_zones(ev), ev.lines, ev.pages, furniture)


# ------------------------------------------------------------------ R7 - R11


@query(
    "r7_comparison_questions",
    duck(
        """select run_id, chunk, count(*)::int as fields, true as retry, string_agg('- id: f' || id || chr(10) || '  field: "' || a || '"' || case when id % 2 = 0 then chr(10) || '  row: "g' || (id % 5) || '"' else '' end ||
               case when id % 17 = 0 then chr(10) || '  the spreadsheet cell is EMPTY' else chr(10) || '  the spreadsheet says: "' || a || '"' end, chr(10) order by id) as question
           from (select *, 'run-' || (id % 4) as run_id, ((row_number() over (partition by id % 4 order by id) - 1) // 40)::int as chunk from vals) group by run_id, chunk""",
        "vals",
    ),
)
def r7(ev: Evidence) -> DataFrame:
    f = compared_fields(ev).withColumn("group", F.when(_place() % 2 == 0, F.concat(F.lit("g"), (_place() % 5).cast("string"))))
    return req.comparison_questions(f, retry=True)


@query(
    "r8_screen_listing",
    duck(
        """select p.run_id, (p.page_index // 50)::int as part, string_agg('--- capture ' || p.page_index || ' ---' || chr(10) || coalesce(body, '(no text was recognised on this screen capture)'), chr(10) || chr(10) order by p.page_index) as text
           from pgs p left join (select run_id, page_index, string_agg(i || ': ' || text, chr(10) order by i) as body from lns group by all) using (run_id, page_index) group by p.run_id, part""",
        "pgs",
        "lns",
    ),
)
def r8(ev: Evidence) -> DataFrame:
    return req.screen_listing(ev.pages, ev.lines, per_part=50)


def merge_rows(ev: Evidence) -> DataFrame:
    return s10(ev).where("pos % 50 = 0").select("book_id", "sheet", F.concat("ref", F.lit(":Z9")).alias("range"), "pos")


SHEET_ROWS = """
  select book_id, sheet, row, case when row > above + 1 then case when row - 1 = above + 1 then '<row ' || (row-1) || ' empty>' else '<rows ' || (above+1) || '-' || (row-1) || ' empty>' end || chr(10) else '' end
         || 'r' || row || ' | ' || body || case when cols > last then ' | ' || case when cols = last + 1 then '<' || cn(cols) || row || ' empty>' else '<' || cn(last+1) || row || ':' || cn(cols) || row || ' empty>' end else '' end as text
  from (select *, lag(row) over (partition by book_id, sheet order by row) as above from
    (select book_id, sheet, row, max(col) as last, string_agg(case when col > p + 1 then case when col = p + 2 then '<' || cn(p+1) || row || ' empty>' else '<' || cn(p+1) || row || ':' || cn(col-1) || row || ' empty>' end || ' | ' else '' end || item, ' | ' order by col) as body
     from (select *, lag(col) over (partition by book_id, sheet, row order by col) as p, ref || ': ' || case when length(text) <= 120 then text else substr(text,1,120) || '... (+' || (length(text)-120) || ' chars cut)' end || case when kind = 'text' then '' else ' (' || kind || ')' end as item
           from (select *, row_number() over (partition by book_id, sheet order by row, col) as at_ from c where text is not null) where at_ <= 4000) group by all)
    join (select book_id, sheet, max(col) as cols from c where text is not null group by all) using (book_id, sheet))"""
for _v in ("cols", "last+1", "p+1", "col-1"):
    SHEET_ROWS = SHEET_ROWS.replace(f"cn({_v})", f"(case when {_v} > 26 then 'A' || chr((64 + {_v} - 26)::int) else chr((64 + {_v})::int) end)")


@query("r9_sheet_rows", duck(SHEET_ROWS.replace(" where at_ <= 4000", ""), c=CELLS_SQL))
def r9(ev: Evidence) -> DataFrame:
    cells = s10(ev)
    return req.sheet_rows(cells, sheet_extents(cells))


@query(
    "r11_sheet_listings",
    duck(
        """
        select e.book_id, e.sheet, '--- sheet "' || e.sheet || '" ---' || chr(10) || 'dimension ' || dim || ' (' || rows || ' rows x ' || cols || ' columns), ' || n || ' non-empty cells' || chr(10) ||
               case when coalesce(m,0) = 0 then 'merged: none' else 'merged: ' || ranges || case when m > 200 then ' (200 of ' || m || ' shown)' else '' end end || chr(10) || body as listing,
               nullif(concat_ws(', and ', case when n > 4000 then n || ' non-empty cells cut to the first 4000' end, case when m > 200 then m || ' merged ranges cut to the first 200' end), '') as truncation
        from (select book_id, sheet, max(row) as rows, max(col) as cols, count(*) as n, 'A1:' || case when max(col) > 26 then 'A' || chr(64 + max(col) - 26) else chr(64 + max(col)) end || max(row) as dim from c where text is not null group by all) e
        join (select book_id, sheet, string_agg(text, chr(10) order by row) as body from sr group by all) using (book_id, sheet)
        left join (select book_id, sheet, count(*) as m, string_agg(ref || ':Z9', ', ' order by k) filter (where rn <= 200) as ranges from (select *, row_number() over (partition by book_id, sheet order by k) as rn from c where text is not null and k % 50 = 0) group by all) using (book_id, sheet)""",
        c=CELLS_SQL,
        sr=SHEET_ROWS,
    ),
)
def r11(ev: Evidence) -> DataFrame:
    cells = s10(ev)
    return req.sheet_listings(cells, sheet_extents(cells), merge_rows(ev))


@query(
    "r10_work_requests",
    duck(
        """
        select p.run_id, 'page' as kind, page_index::varchar as item, ai as searchable from pgs p join srcs s using (run_id, source_id)
        union all select c.run_id, 'wanted', c.key, true from cap c join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key where not added and page_index is null and status in ('pending','outstanding') and c.ordinal = 1
        union all select run_id, 'walk', key, true from wlk union all select run_id, 'discover', source_id, true from srcs where ai""",
        "pgs",
        "srcs",
        "cap",
        "slots",
        "wlk",
    ),
)
def r10(ev: Evidence) -> DataFrame:
    s = ev.sources.withColumn("sections_asked", F.lit(None).cast("boolean"))
    return req.work_requests(
        capt.wanted_captures(ev.captures, ev.slots),
        capt.captures_to_walk(ev.captures, ev.slots, ev.pages, ev.sources),
        capt.sources_to_discover(s, ev.sources.where("false")),
        ev.pages,
        ev.sources,
    )


# ------------------------------------------------------------------ W1, W2


@query(
    "w1_outstanding_report",
    duck(
        """
        select run_id, 'slot' as kind, slot_key as key, label, section_title as section, 'searched-not-found' as reason from slots s where fillable and layout <> 'images' and not exists (select 1 from fcap c where c.run_id = s.run_id and c.slot_key = s.slot_key)
        union all select c.run_id, 'continuation', c.key, label, section_title, verdict from chk c join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key where verdict in ('past-last-content','at-page-bottom')
        union all select run_id, 'field', field_key, label, null, case when field_key = 'namaProyek' then 'never-extracted' when outcome = 'conflict' then 'documents-disagree' else 'searched-not-found' end
           from (select run_id, field_key, arg_min(label, pos) as label from rky where field_key is not null and field_key <> '' group by all) left join (select run_id, field_key, outcome, value from rcn) using (run_id, field_key)
           where not coalesce(outcome = 'list' or trim(value) <> '', false)
        union all select run_id, 'header', 'jenisOrder', 'JENIS ORDER', null, case when d > 1 then 'conflict' else 'none' end from runs left join (select run_id, count(distinct value) filter (where value <> '') as d from oln group by all) using (run_id) where run_id <> 'run-2' and coalesce(d,0) <> 1
        union all select run_id, 'unmapped', field_key, field_key, null, 'no-form-row' from rcn where (outcome = 'list' or (outcome <> 'conflict' and trim(value) <> '')) and not exists (select 1 from rky where rky.run_id = rcn.run_id and rky.field_key = rcn.field_key)
        union all select run_id, 'manual', slot_key, label, section_title, 'by-hand' from slots s where fillable and added and not exists (select 1 from fcap c where c.run_id = s.run_id and c.slot_key = s.slot_key)""",
        "slots",
        "fcap",
        "chk",
        "rky",
        "rcn",
        "runs",
        "oln",
    ),
)
def w1(ev: Evidence) -> DataFrame:
    z = walk_zones(ev).select("run_id", "key", "slot_key", "page_index", "to_line", "whole_page")
    none = ev.slots.where("false")
    found, keys = reconciled(ev), run_keys(ev)
    return sinks.outstanding_report(
        st.outstanding_slots(ev.slots, few_captures(ev), none.select("run_id", "slot_key", F.col("label").alias("reason")), ev.slots.where("layout = 'images'")),
        rec.outstanding_fields(keys, found),
        con.outstanding_continuations(con.check_zones(z, context(ev)), ev.slots),
        cit.outstanding_headers(order_kinds(ev)),
        rec.unmapped_values(keys, found),
        st.manual_slots(ev.slots, few_captures(ev), none.select("run_id", "section_id")),
    )


@query(
    "w2_proposals_file",
    duck(
        """select run_id, source_id, 'u:' || sha256(run_id || '|' || source_id || '|' || pos) as id, title, from_page, to_page, page_index as cite_page, title_from as cite_from, title_to as cite_to
           from fin where reason is null""",
        "fin",
    ),
)
def w2(ev: Evidence) -> DataFrame:
    """Written as review files and read again."""
    folder = work_folder(ev.spark)
    sinks.write_json(sinks.proposals_file(sec.refuse_overlaps(judged(ev))), folder)
    f = sinks.read_json(ev.spark, folder, sinks.PROPOSALS)
    cite = [F.col(f"cite.{c}").alias(f"cite_{a}") for c, a in (("page_index", "page"), ("from", "from"), ("to", "to"))]
    return f.select("run_id", "source_id", "id", "title", "from_page", "to_page", *cite)


# ------------------------------------------------------------------ X1 - X3


DROPS = 3


def in_drops(ev: Evidence, rows: DataFrame, run) -> None:
    """Lands all rows in three drops, by `drop`, and calls ``run(stream)`` after each: a stream that stops and restarts.

    The rows are cut into drops once; each drop is a batch of many files.
    """
    folder = arr.work_folder(ev.spark)
    rows.write.partitionBy("drop").parquet(f"{folder}/drops")
    schema = rows.drop("drop").schema
    for k in range(DROPS):
        drop = ev.spark.read.schema(rows.schema).parquet(f"{folder}/drops").where(F.col("drop") == k).drop("drop")
        drop.write.mode("append").parquet(f"{folder}/landed")
        run(ev.spark.readStream.schema(schema).parquet(f"{folder}/landed"), folder)


def _drop(c: str):
    return (F.col(c) % DROPS).cast("int").alias("drop")


@query(
    "x1_accept_documents",
    """select run_id, digest, name, pos, r = 1 as accepted, case when r > 1 then held end as held_as, case when r > 1 then drop_no = held_drop end as in_same_drop
       from (select *, row_number() over w as r, first_value(name) over w as held, first_value(drop_no) over w as held_drop
             from (select source as run_id, sha256(text) as digest, 'doc-' || doc_id as name, doc_id as pos, doc_id % 3 as drop_no from documents)
             window w as (partition by run_id, digest order by drop_no, pos))""",
)
def x1(ev: Evidence) -> DataFrame:
    d = ev.table("documents").select(
        F.col("source").alias("run_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("doc_id").alias("pos"), "text", _drop("doc_id")
    )
    out = []

    def run(stream: DataFrame, folder: str) -> None:
        arr.append_available(arr.accept_documents(stream), f"{folder}/out", f"{folder}/checkpoint")
        out.append(f"{folder}/out")

    in_drops(ev, digests(d, "text").select("run_id", "digest", "name", "pos", "drop"), run)
    return arr.stored(ev.spark, out[-1], arr.ANSWERS)


@query(
    "x2_fill_slots",
    """select run_id, slot_key, round, pos, page_index from (select *, row_number() over (partition by run_id, slot_key order by drop_no, round, pos) as r
         from (select 'run-' || (doc_id % 5) as run_id, 'slot-' || (n_chars % 40) as slot_key, (doc_id % 4)::int as round, doc_id as pos, (doc_id % 100)::int as page_index, doc_id % 3 as drop_no from documents)) where r = 1""",
)
def x2(ev: Evidence) -> DataFrame:
    """Rounds come out of order: a drop holds rows of all rounds."""
    d = F.col("doc_id")
    z = ev.table("documents").select(
        F.concat(F.lit("run-"), (d % 5).cast("string")).alias("run_id"), F.concat(F.lit("slot-"), (F.col("n_chars") % 40).cast("string")).alias("slot_key"),
        (d % 4).cast("int").alias("round"), d.alias("pos"), (d % 100).cast("int").alias("page_index"), _drop("doc_id"),
    )
    out = []

    def run(stream: DataFrame, folder: str) -> None:
        arr.append_available(arr.fill_slots(stream), f"{folder}/out", f"{folder}/checkpoint")
        out.append(f"{folder}/out")

    in_drops(ev, z, run)
    return arr.stored(ev.spark, out[-1], arr.ZONES)


@query("x3_running_tallies", duck("select run_id, stage, calls, input, output, thoughts, cached_input, pages, model_id from tly", "tly"))
def x3(ev: Evidence) -> DataFrame:
    tables = []

    def run(stream: DataFrame, folder: str) -> None:
        tables.append(arr.ChangedRows(ev.spark, f"{folder}/out", arr.STAGE, every=2))
        arr.merge_available(arr.running_tallies(stream), tables[-1], f"{folder}/checkpoint")

    in_drops(ev, usage_rows(ev.table("events")).withColumn("drop", _drop("seq")), run)
    return tables[-1].table()
