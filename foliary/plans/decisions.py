"""Workbook checks (V10-V12, V26-V28), decisions and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import key_bucket, number_rows
from foliary.operators import decisions as dec
from foliary.operators import pools as pool
from foliary.operators import workbook_checks as wc
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.registry import query
from foliary.plans.text import value_pairs
from foliary.session import work_folder
from foliary.sources import sinks


def _num():
    return F.col("id")



def _s(c):
    return c.cast("string")


# ------------------------------------------------------------------ V10, V28


def _part():
    return F.col("p_partkey")

def _row_text():
    return _s(_part() + 2)


def named_cells(ev: Evidence) -> DataFrame:
    """A label cell per part, and a value cell for every second one."""
    p = ev.table("part").select(
        F.concat(F.lit("b"), _s(_part() % 4)).alias("book_id"), F.concat(F.lit("S"), _s(_part() % 2)).alias("sheet"), "p_partkey", "p_name", "p_brand"
    )
    label = F.struct(F.concat(F.lit("C"), _row_text()).alias("ref"), (_part() + 2).cast("int").alias("row"), F.lit(3).alias("col"), F.concat("p_name", F.lit("  :")).alias("text"))
    value = F.struct(F.concat(F.lit("E"), _row_text()).alias("ref"), (_part() + 2).cast("int").alias("row"), F.lit(5).alias("col"), F.col("p_brand").alias("text"))
    both = F.when(_part() % 3 == 0, F.array(label, value)).otherwise(F.array(label))
    return p.select("book_id", "sheet", F.explode(both).alias("c")).select("book_id", "sheet", "c.*")


def named_fields(ev: Evidence) -> DataFrame:
    m = _part() % 13
    ref = lambda letter, shift=0: F.concat(F.lit(letter), _s(_part() + 2 + shift))
    return ev.table("part").select(
        F.concat(F.lit("b"), _s(_part() % 4)).alias("book_id"),
        F.concat(F.lit("S"), _s(_part() % 2)).alias("sheet"),
        _part().alias("pos"),
        F.when(m == 7, "  ").when(m == 8, "not there").when(m == 12, "").otherwise(F.col("p_name")).alias("label"),
        F.when(m == 0, "c1").when(m == 2, "C999999").when(m == 3, ref("D")).otherwise(ref("C")).alias("label_ref"),
        F.when(m == 1, "E0").when(m == 4, "ZZ5").when(m == 5, ref("F")).when(m == 6, ref("C")).when(m == 9, ref("E", -12)).when(m == 11, ref("C", 12)).otherwise(ref("E")).alias("value_ref"),
        F.when(_part() % 2 == 0, " row ").alias("group"),
    )


def merged_ranges(ev: Evidence) -> DataFrame:
    return ev.table("part").where("p_partkey % 13 = 5").select(
        F.concat(F.lit("b"), _s(_part() % 4)).alias("book_id"), F.concat(F.lit("S"), _s(_part() % 2)).alias("sheet"),
        (_part() + 2).cast("int").alias("r1"), F.lit(5).alias("c1"), (_part() + 2).cast("int").alias("r2"), F.lit(6).alias("c2"),
    )


def extents(ev: Evidence) -> DataFrame:
    return named_cells(ev).groupBy("book_id", "sheet").agg(
        F.max("row").alias("rows"), F.max("col").alias("cols"), F.count(F.lit(1)).alias("cells")
    )


add_duck(
    "nmf",
    """
    select 'b' || (k % 4) as book_id, 'S' || (k % 2) as sheet, k as pos, p_name, p_brand, case m when 7 then '  ' when 8 then 'not there' when 12 then '' else p_name end as label,
           case m when 0 then 'c1' when 2 then 'C999999' when 3 then 'D' || (k+2) else 'C' || (k+2) end as label_ref,
           case m when 1 then 'E0' when 4 then 'ZZ5' when 5 then 'F' || (k+2) when 6 then 'C' || (k+2) when 9 then 'E' || (k-10) when 11 then 'C' || (k+14) else 'E' || (k+2) end as value_ref,
           case when k % 2 = 0 then 'row' else '' end as "group", m, k
    from (select *, p_partkey as k, p_partkey % 13 as m from part)""",
    [],
)
add_duck(
    "vin",
    """
    with nc as (select book_id, sheet, 'C' || (k+2) as ref, p_name || '  :' as text from nmf union all select book_id, sheet, 'E' || (k+2), p_brand from nmf where k % 3 = 0),
    e as (select n.*, l.text as lt, v.text as vt, x.rows, 5 as cols,
                 case when label = '' then 'not-a-field' when m = 0 then 'label-ref-no-address' when not regexp_matches(value_ref, '^[A-Z]{1,3}[1-9][0-9]*$') then 'value-ref-no-address'
                      when l.text is null and (m = 2 and 999999 > x.rows + 8) then 'label-outside-sheet' when l.text is null then 'label-cell-empty' when m = 4 then 'value-outside-sheet'
                      when m = 11 and v.text is null and k + 14 > x.rows + 8 then 'value-outside-sheet'
                      when m = 5 then 'value-covered-by-merge' when m = 6 then 'value-is-label' when trim(label) = '' then 'label-blank' when not contains(lower(l.text), lower(label)) then 'label-not-in-cell' end as r0
          from nmf n join (select book_id, sheet, max(k) + 2 as rows from nmf group by all) x using (book_id, sheet)
          left join nc l on l.book_id = n.book_id and l.sheet = n.sheet and l.ref = n.label_ref left join nc v on v.book_id = n.book_id and v.sheet = n.sheet and v.ref = n.value_ref),
    cl as (select book_id, sheet, value_ref, min(pos) as claim from e where r0 is null group by all),
    lb as (select distinct e.book_id, e.sheet, e.label_ref from e join cl using (book_id, sheet, value_ref) where r0 is null and pos = claim)
    select e.book_id, e.sheet, e.pos, trim(e.label) as label, e.label_ref, e.value_ref, e."group", coalesce(vt, '') as excel_value,
           coalesce(r0, case when e.pos > claim then 'value-cell-claimed' when lb.label_ref is not null then 'value-is-a-field-name' end) as reason
    from e left join cl using (book_id, sheet, value_ref) left join lb on lb.book_id = e.book_id and lb.sheet = e.sheet and lb.label_ref = e.value_ref""",
    ["nmf"],
)


def interpretation(ev: Evidence) -> DataFrame:
    return wc.validate_interpretation(named_fields(ev), named_cells(ev), extents(ev), merged_ranges(ev))


@query("v10_validate_interpretation", duck("select * from vin", "vin"))
def v10(ev: Evidence) -> DataFrame:
    return interpretation(ev)


@query(
    "v28_interpret_workbooks",
    duck(
        """select book_id, sheet, cells, fields, refused, case when cells = 0 then 'empty-sheet' when fields = 0 and refused = 0 then 'no-field-found' when fields = 0 then 'none-could-be-checked' when refused = 0 then 'all-read' else 'some-refused' end as note
           from (select 'b' || (k % 4) as book_id, 'S' || (k % 2) as sheet, count(*) + count(*) filter (where k % 3 = 0) as cells from nmf group by all
                 union all select distinct 'b' || (k % 4), 'empty', 0 from nmf)
           left join (select book_id, sheet, count(*) filter (where reason is null) as f, count(*) filter (where reason is not null) as r from vin group by all) using (book_id, sheet)
           cross join lateral (select coalesce(f,0) as fields, coalesce(r,0) as refused) z""",
        "vin",
    ),
)
def v28(ev: Evidence) -> DataFrame:
    x = extents(ev).select("book_id", "sheet", "cells")
    blank = x.select("book_id", F.lit("empty").alias("sheet"), F.lit(0).cast("bigint").alias("cells")).distinct()
    return wc.interpret_workbooks(x.unionByName(blank), interpretation(ev))


# ------------------------------------------------------------------ V11, V26


def compared_fields(ev: Evidence) -> DataFrame:
    return value_pairs(ev).select(
        F.concat(F.lit("run-"), _s(_num() % 4)).alias("run_id"), F.concat(F.lit("f"), _s(_num())).alias("field_id"),
        F.when(_num() % 17 == 0, " ").otherwise(F.col("a")).alias("excel_value"), F.col("a").alias("label"), _num().alias("pos"), "b",
    )


def comparison_replies(ev: Evidence) -> DataFrame:
    """Replies of forty fields: matches, differences, silence, repeated and unreadable entries."""
    m = F.col("pos") % 6
    verdict = F.when(m == 0, "cocok").when(m == 2, "tidak-ditemukan").when(m == 5, "ya").otherwise("beda")
    value = F.when(m == 1, F.col("b")).when(m == 3, F.regexp_replace("label", " ", "   "))
    entry = F.struct(
        F.col("field_id").alias("id"), verdict.alias("verdict"), value.alias("documentValue"), (F.col("pos") % 300).alias("page"),
        (F.col("pos") % 5).alias("from"), F.when(F.col("pos") % 9 != 0, F.col("pos") % 5 + F.col("pos") % 3).alias("to"),
    )
    again = F.struct(F.col("field_id").alias("id"), F.lit("cocok").alias("verdict"), value.alias("documentValue"), F.lit(0).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("from"), F.lit(0).cast("bigint").alias("to"))
    f = wc.field_chunks(compared_fields(ev)).where("pos % 11 <> 0")
    rows = f.select("run_id", "chunk", "pos", F.explode(F.array(entry, again)).alias("e"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("e.page") == F.col("pos") % 300, 0).otherwise(1).alias("o"), "e"))), lambda z: z["e"])
    return rows.groupBy("run_id", "chunk").agg(F.to_json(F.struct(ordered.alias("fields"))).alias("reply"))


def open_positions(ev: Evidence) -> DataFrame:
    """Positions of the open pages; every source of one run is fenced off."""
    fenced = ev.sources.withColumn("ai", (F.col("run_id") != "run-3") & F.col("ai"))
    open_ = pool.open_pages(ev.pages, fenced).select("run_id", "page_index")
    return number_rows(open_, ["run_id"], ["page_index"], key_bucket("page_index"), "position")


add_duck("ops", "select run_id, page_index, (row_number() over (partition by run_id order by page_index) - 1)::int as position from opn where run_id <> 'run-3'", ["opn"])
add_duck(
    "cmp",
    r"""
    with f as (select 'run-' || (id % 4) as run_id, 'f' || id as field_id, id, case when id % 17 = 0 then ' ' else a end as excel_value,
                 case when id % 11 <> 0 then case id % 6 when 0 then 'cocok' when 2 then 'tidak-ditemukan' when 5 then 'ya' else 'beda' end end as v,
                 case id % 6 when 1 then trim(b) when 3 then trim(replace(a, ' ', '   ')) else '' end as dv, (id % 5)::int as fl, case when id % 9 <> 0 then (id % 5 + id % 3) end::int as tl, id % 300 as position from vals),
    c as (select f.*, o.page_index, case when tl is not null and o.page_index is not null and (select count(*) from lns l where l.run_id = f.run_id and l.page_index = o.page_index and l.i between fl and tl) = tl - fl + 1
                 then (select string_agg(text, chr(10) order by i) from lns l where l.run_id = f.run_id and l.page_index = o.page_index and l.i between fl and tl) end as tx,
                 case when f.run_id = 'run-3' then 'nothing-searchable' when v is null then 'model-silent' when v = 'ya' then 'answer-unreadable' when v = 'tidak-ditemukan' then 'searched-and-absent'
                      when v = 'cocok' and trim(excel_value) = '' then 'match-on-empty-cell' when v = 'beda' and dv = '' then 'difference-without-value' end as reason
          from f left join ops o on o.run_id = f.run_id and o.position = f.position)
    select run_id, field_id, excel_value, case when reason is not null then 'tidak-ditemukan' when v = 'beda' and regexp_replace(dv,'\s+',' ','g') <> trim(regexp_replace(excel_value,'\s+',' ','g')) then 'beda' else 'cocok' end as verdict, reason,
           case when reason is null and v = 'beda' and regexp_replace(dv,'\s+',' ','g') <> trim(regexp_replace(excel_value,'\s+',' ','g')) then dv end as document_value,
           case when reason is null and tx is not null then page_index end as page_index, case when reason is null and tx is not null then fl end as from_line,
           case when reason is null and tx is not null then tl end as to_line, case when reason is null then tx end as cited_text from c""",
    ["vals", "ops", "lns"],
)


@query(
    "v11_refused_answers",
    duck(
        """select 'run-' || (id % 4) as run_id, 'f' || id as field_id, 'answered-before' as reason from vals where id % 11 <> 0 and id % 10 <> 3
           union all select 'run-' || (id % 4), null, 'no-id' from vals where id % 11 <> 0 and id % 10 = 3
           union all select run_id, null, 'no-json-object' from (select distinct run_id from (select 'run-' || (id % 4) as run_id from vals where id % 11 <> 0))""",
        "vals",
    ),
)
def v11_refused(ev: Evidence) -> DataFrame:
    """Every field's second entry is refused, as its id is taken or cut off; one reply a run is no reply."""
    replies = comparison_replies(ev)
    again = F.regexp_replace("reply", r'"id":"f([0-9]*3)","verdict":"cocok",("documentValue":"[^"]*",)?"page":0,"from":0,"to":0', '"page":0')
    lost = replies.select("run_id").distinct().select("run_id", F.lit(-1).alias("chunk"), F.lit("I cannot").alias("reply"))
    return wc.refused_answers(replies.select("run_id", "chunk", again.alias("reply")).unionByName(lost)).select("run_id", "field_id", "reason")


@query("v11_fold_comparison", duck("select * from cmp", "cmp"))
def v11(ev: Evidence) -> DataFrame:
    answers = wc.compare_answers(comparison_replies(ev))
    return wc.fold_comparison(
        compared_fields(ev).drop("label", "pos", "b"), answers, open_positions(ev), ev.lines, ev.pages
    )


@query(
    "v26_field_chunks",
    duck("select 'run-' || (id % 4) as run_id, 'f' || id as field_id, ((row_number() over (partition by id % 4 order by id) - 1) // 40)::int as chunk from vals", "vals"),
)
def v26(ev: Evidence) -> DataFrame:
    return wc.field_chunks(compared_fields(ev)).select("run_id", "field_id", "chunk")


# ------------------------------------------------------------------ V12, V27


def screen_inputs(ev: Evidence) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fields, answers, extras and captures (pages stand for captures; run-3 has none)."""
    fields = compared_fields(ev).select("run_id", "field_id", F.concat(F.lit("Label "), F.col("field_id")).alias("label"))
    p = F.col("pos")
    answers = compared_fields(ev).where("pos % 4 <> 3").select(
        "run_id", "field_id", "pos",
        F.when(p % 4 == 0, "cocok").when(p % 4 == 1, "beda").otherwise("tidak-ditemukan").alias("verdict"),
        F.when(p % 4 == 1, F.col("b")).alias("value"),
        (p % 300).cast("int").alias("page_index"), (p % 5).cast("int").alias("from_line"), F.when(p % 7 != 0, p % 5 + p % 3).cast("int").alias("to_line"),
    )
    copies = F.when(F.col("run_id") == "run-2", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    extras = ev.slots.select("run_id", "pos", F.explode(copies).alias("copy")).select(
        "run_id", p.alias("pos"), F.when(p % 6 == 0, F.concat(F.lit(" Label f"), _s(p % 4 + 4), F.lit(" : "))).otherwise(F.concat(F.lit("Extra "), _s(F.floor(p / 2)))).alias("label"),
        F.when(p % 5 != 0, F.concat(F.lit("v"), _s(p))).alias("value"), F.lit(0).alias("page_index"), F.lit(0).alias("from_line"), (p % 3 - 1).cast("int").alias("to_line"),
    )
    # the captures of one run have no page
    return fields, answers, extras, ev.pages.withColumn("page_index", F.when(F.col("run_id") != "run-3", F.col("page_index")))


add_duck(
    "scr",
    r"""
    with pg as (select * from pgs where run_id <> 'run-3'),
    fld as (select 'run-' || (id % 4) as run_id, 'f' || id as field_id, 'Label f' || id as label, id, b from vals),
    ans as (select run_id, field_id, case id % 4 when 0 then 'cocok' when 1 then 'beda' else 'tidak-ditemukan' end as verdict, case when id % 4 = 1 then trim(b) else '' end as value,
                   (id % 300)::int as page_index, (id % 5)::int as fl, case when id % 7 <> 0 then id % 5 + id % 3 end::int as tl, 'f' as src, id as pos, label from fld where id % 4 <> 3),
    ext as (select run_id, null as field_id, 'tidak-ada-di-excel' as verdict, value, 0::int as page_index, 0::int as fl, (pos % 3 - 1)::int as tl, 'x' as src, pos, label from
              (select run_id, pos, case when pos % 6 = 0 then 'Label f' || (pos % 4 + 4) || ' :' else 'Extra ' || (pos // 2) end as label, case when pos % 5 <> 0 then 'v' || pos else '' end as value from slots where run_id <> 'run-3')
            where value <> '' and not exists (select 1 from fld where fld.run_id = 'z' ) qualify row_number() over (partition by run_id, lower(label) order by pos) = 1),
    c as (select a.*, case when tl is null then 'incomplete' when p.page_index is null then 'unknown-page' when fl > tl then 'reversed'
                 when (select count(*) from lns l where l.run_id = a.run_id and l.page_index = a.page_index and l.i between fl and tl) <> tl - fl + 1 then 'missing-line' end as cr
          from (select * from ans union all by name select * from ext) a left join pg p on p.run_id = a.run_id and p.page_index = a.page_index)
    select f.run_id, f.field_id, f.label, case when f.run_id = 'run-3' or c.verdict is null or (verdict = 'beda' and value = '') then 'tidak-ditemukan' else verdict end as verdict,
           case when r is null and value <> '' then value end as screen_value, case when r is null and cr is null then c.page_index end as page_index, case when r is null and cr is null then fl end as from_line,
           case when r is null and cr is null then tl end as to_line, coalesce(r, cr) as reason
    from fld f left join (select * from c where src = 'f') c using (run_id, field_id)
    cross join lateral (select case when f.run_id = 'run-3' then 'no-captures' when c.verdict is null then 'model-silent' when verdict = 'beda' and value = '' then 'difference-without-value' when verdict = 'tidak-ditemukan' then 'on-no-capture' end as r) z
    union all select run_id, null, label, verdict, value, case when cr is null then page_index end, case when cr is null then fl end, case when cr is null then tl end, cr from c where src = 'x'
       and not exists (select 1 from fld where fld.run_id = c.run_id and lower(fld.label) = trim(replace(lower(c.label), ' :', '')))""",
    ["vals", "pgs", "lns", "slots"],
)


@query("v12_fold_screens", duck("select * from scr", "scr"))
def v12(ev: Evidence) -> DataFrame:
    fields, answers, extras, captures = screen_inputs(ev)
    return wc.fold_screens(fields, answers, extras, captures, ev.lines)


@query(
    "v27_screens_without_captures",
    duck("select 'run-' || (id % 4) as run_id, 'f' || id as field_id, 'tidak-ditemukan' as verdict, 'no-captures' as reason from vals", "vals"),
)
def v27(ev: Evidence) -> DataFrame:
    fields, answers, extras, captures = screen_inputs(ev)
    none = captures.where("false")
    found = wc.fold_screens(fields, answers, extras, none, ev.lines)
    return found.select("run_id", "field_id", "verdict", "reason")


# ------------------------------------------------------------------ D1 - D7, A11, A17, W3


def entries(ev: Evidence) -> DataFrame:
    """A compared entry per part in every verdict and decision."""
    k5 = _num() % 5
    d = F.when(k5 == 1, "setuju").when(k5 == 2, "tolak").when(k5 == 3, "manual").otherwise("belum")
    v = F.when(_num() % 4 == 0, "cocok").when(_num() % 4 == 2, "tidak-ditemukan").otherwise("beda")
    return value_pairs(ev).select(
        F.concat(F.lit("run-"), _s(_num() % 4)).alias("run_id"), F.concat(F.lit("e"), _s(_num())).alias("entry_id"), F.concat(F.lit("Sheet"), _s(_num() % 3)).alias("sheet"),
        F.concat(F.lit("C"), _s(_num() + 1)).alias("ref"), F.col("a").alias("excel_value"), F.when(_num() % 7 != 0, F.col("b")).alias("document_value"), v.alias("verdict"), d.alias("decision"),
        F.when(k5 == 3, F.when(_num() % 10 == 3, "").otherwise(F.concat(F.lit("M"), _s(_num())))).alias("manual_value"), _num().alias("id"),
    )


add_duck(
    "ets",
    """select 'run-' || (id % 4) as run_id, 'e' || id as entry_id, 'Sheet' || (id % 3) as sheet, 'C' || (id+1) as ref, a as excel_value, case when id % 7 <> 0 then b end as document_value,
              case id % 4 when 0 then 'cocok' when 2 then 'tidak-ditemukan' else 'beda' end as verdict, case id % 5 when 1 then 'setuju' when 2 then 'tolak' when 3 then 'manual' else 'belum' end as decision,
              case when id % 5 = 3 then case when id % 10 = 3 then '' else 'M' || id end end as manual_value, id from vals""",
    ["vals"],
)
EFF = "case decision when 'setuju' then coalesce(document_value, excel_value) when 'manual' then coalesce(manual_value, '') else excel_value end"


@query("d1_effective_fields", duck(f"select run_id, entry_id, {EFF} as effective from ets", "ets"))
def d1(ev: Evidence) -> DataFrame:
    return dec.effective_fields(entries(ev)).select("run_id", "entry_id", "effective")


@query("d1_pending_edits", duck(f"select run_id, sheet, ref, {EFF} as value from ets where {EFF} <> excel_value", "ets"))
def d1_edits(ev: Evidence) -> DataFrame:
    return dec.pending_edits(entries(ev))


def fresh_entries(ev: Evidence) -> DataFrame:
    """A second comparison: some entries new, some gone, nothing decided."""
    e = entries(ev).where("id % 6 <> 1")
    return e.withColumn("entry_id", F.when(_num() % 8 == 0, F.concat(F.lit("n"), _s(_num()))).otherwise(F.col("entry_id"))).withColumn("verdict", F.lit("beda"))


@query(
    "d2_record_comparison",
    duck(
        """select f.run_id, f.entry_id, 'beda' as verdict, coalesce(h.decision, 'belum') as decision, case when h.decision = 'manual' then h.manual_value end as manual_value
           from (select run_id, case when id % 8 = 0 then 'n' || id else entry_id end as entry_id from ets where id % 6 <> 1) f
           left join (select * from ets where decision <> 'belum') h on h.run_id = f.run_id and h.entry_id = f.entry_id""",
        "ets",
    ),
)
def d2(ev: Evidence) -> DataFrame:
    return dec.record_comparison(fresh_entries(ev), entries(ev)).select(
        "run_id", "entry_id", "verdict", "decision", "manual_value"
    )


def decision_log(ev: Evidence) -> DataFrame:
    """Three decisions per entry, some unsound."""
    e = entries(ev).select("run_id", "entry_id", "id", F.explode(F.array(*[F.lit(k) for k in (0, 1, 2)])).alias("k"))
    m = (_num() + F.col("k")) % 5
    return e.select(
        "run_id", F.when(_num() % 50 == 7, "unknown").otherwise(F.col("entry_id")).alias("entry_id"), (_num() * 3 + F.col("k")).alias("seq"),
        F.when(m == 0, "setuju").when(m == 1, "manual").when(m == 2, "manual").when(m == 3, "maybe").otherwise("tolak").alias("decision"),
        F.when(m == 1, F.concat(F.lit("t"), _s(_num()))).when((m == 4) & (_num() % 3 == 0), "stray").alias("manual_value"),
    )


add_duck(
    "dlg",
    """select run_id, case when id % 50 = 7 then 'unknown' else entry_id end as entry_id, id*3 + k as seq, ['setuju','manual','manual','maybe','tolak'][(id + k) % 5 + 1] as decision,
              case when (id + k) % 5 = 1 then 't' || id when (id + k) % 5 = 4 and id % 3 = 0 then 'stray' end as manual_value from ets, unnest([0,1,2]) t(k)""",
    ["ets"],
)


@query(
    "d3_decision_violations",
    duck(
        """select run_id, entry_id, seq, decision, rule from (select d.*, case when decision = 'maybe' then 'not-a-decision' when decision = 'manual' and manual_value is null then 'manual-without-value'
              when decision <> 'manual' and manual_value is not null then 'value-without-manual' when entry_id = 'unknown' then 'no-such-entry' end as rule from dlg d) where rule is not null""",
        "dlg",
    ),
)
def d3_violations(ev: Evidence) -> DataFrame:
    return dec.decision_violations(decision_log(ev), entries(ev))


@query(
    "d3_apply_decisions",
    duck(
        """select e.run_id, e.entry_id, coalesce(l.decision, e.decision) as decision, case when l.decision is not null then l.manual_value else e.manual_value end as manual_value
           from ets e left join (select run_id, entry_id, decision, manual_value from dlg where decision <> 'maybe' and (decision = 'manual') = (manual_value is not null)
                                 qualify row_number() over (partition by run_id, entry_id order by seq desc) = 1) l using (run_id, entry_id)""",
        "ets",
        "dlg",
    ),
)
def d3(ev: Evidence) -> DataFrame:
    return dec.apply_decisions(entries(ev), decision_log(ev)).select("run_id", "entry_id", "decision", "manual_value")


@query(
    "d5_discarded_decisions",
    duck(
        """select s.run_id, s.entry_id, case when coalesce(n.d,'belum') = 'belum' then 'undecided' else 'value-lost' end as loss from ets s
           left join (select run_id, entry_id, case when id % 9 = 0 then 'belum' else decision end as d, case when id % 15 <> 3 then manual_value end as m from ets where id % 10 <> 6) n using (run_id, entry_id)
           where s.decision <> 'belum' and (coalesce(n.d,'belum') = 'belum' or (s.decision = 'manual' and m is null))""",
        "ets",
    ),
)
def d5(ev: Evidence) -> DataFrame:
    nxt = entries(ev).where("id % 10 <> 6")
    nxt = nxt.withColumn("decision", F.when(_num() % 9 == 0, "belum").otherwise(F.col("decision"))).withColumn(
        "manual_value", F.when(_num() % 15 != 3, F.col("manual_value"))
    )
    return dec.discarded_decisions(entries(ev), nxt)


@query(
    "d5_discarded_flags",
    duck("select run_id, 'konfigurasi/researched' as lost_id from runs where run_id in ('run-0','run-1') union all select run_id, 'epic/basis' from runs where run_id = 'run-2'", "runs"),
)
def d5_flags(ev: Evidence) -> DataFrame:
    r = F.col("run_id")
    stored = ev.runs.select("run_id", (r != "run-3").alias("researched"), F.lit("excel").alias("basis"))
    nxt = ev.runs.select("run_id", (r == "run-2").alias("researched"), F.when(r == "run-2", "belum").otherwise("excel").alias("basis"))
    return dec.discarded_flags(stored, nxt)


@query(
    "d6_discarded_authorship",
    duck(
        """select run_id, slot_key as id, 'title' as kind from slots where pos % 3 = 0 and not (pos % 2 = 0)
           union all select run_id, slot_key, 'slot' from slots where (pos % 5 <> 0 and pos % 7 = 0) or (pos % 4 = 0 and pos % 3 = 1)
           union all select run_id, slot_key, 'added' from slots where pos % 6 = 0""",
        "slots",
    ),
)
def d6(ev: Evidence) -> DataFrame:
    s, p = ev.slots, F.col("pos")
    some = lambda c, name: F.when(c, F.col("label")).alias(name)
    sections = s.select("run_id", F.col("slot_key").alias("id"), some(p % 3 == 0, "title"))
    next_sections = s.select("run_id", F.col("slot_key").alias("id"), some(p % 2 == 0, "title"))
    slots = s.select("run_id", F.col("slot_key").alias("id"), some(p % 5 != 0, "label"), some(p % 4 == 0, "note"))
    next_slots = s.select("run_id", F.col("slot_key").alias("id"), some(p % 7 != 0, "label"), some(p % 3 != 1, "note"))
    added = s.select("run_id", F.col("slot_key").alias("id"))
    return dec.discarded_authorship(sections, slots, added, next_sections, next_slots, added.join(s.where("pos % 6 <> 0").select("run_id", F.col("slot_key").alias("id")), ["run_id", "id"]))


@query(
    "d7_snapshot_losses",
    duck(
        """select run_id, 'page' as kind, doc_id::varchar as id from pgs where doc_id % 25 = 3 and doc_id % 50 <> 3
           union all select run_id, 'capture', key from cap where page_index is not null and (pos % 14 = 1 or pos % 15 = 2)""",
        "pgs",
        "cap",
    ),
)
def d7(ev: Evidence) -> DataFrame:
    pages = ev.pages.select("run_id", F.col("doc_id").alias("id"))
    nxt = ev.captures.where("pos % 14 <> 1").withColumn("page_index", F.when(F.col("pos") % 15 != 2, F.col("page_index")))
    allowed = pages.where("id % 50 = 3").select("run_id", F.lit("page").alias("kind"), F.col("id").cast("string").alias("id"))
    return dec.snapshot_losses(pages, pages.where("id % 25 <> 3"), ev.captures, nxt, allowed)


@query(
    "a11_check_summary",
    duck(
        f"""select run_id, count(*) as total, count(*) filter (where verdict='cocok') as matches, count(*) filter (where verdict='beda') as differs, count(*) filter (where verdict='tidak-ditemukan') as not_found,
                   0::bigint as not_in_sheet, count(*) filter (where verdict='beda' and decision='belum') as owed, count(*) filter (where {EFF} <> excel_value) as edits,
                   run_id <> 'run-2' and count(*) filter (where verdict='tidak-ditemukan') > 0 as can_research from ets group by run_id""",
        "ets",
    ),
)
def a11(ev: Evidence) -> DataFrame:
    return dec.check_summary(entries(ev), ev.runs.where("run_id = 'run-2'").select("run_id", F.lit(True).alias("researched")))


@query(
    "a17_download_blocked",
    duck(
        """select run_id, coalesce(owed, 0) as owed, case when run_id = 'run-1' then 'no-workbook' when coalesce(owed,0) > 0 then 'entries-undecided' end as blocked
           from runs left join (select run_id, count(*) as owed from ets where decision = 'belum' and run_id <> 'run-3' group by all) using (run_id)""",
        "runs",
        "ets",
    ),
)
def a17(ev: Evidence) -> DataFrame:
    r = ev.runs.select("run_id", (F.col("run_id") != "run-1").alias("has_workbook"))
    return dec.download_blocked(r, entries(ev).where("run_id <> 'run-3'"))


EDITS_SQL = f"""select run_id, sheet, ref, value from (select *, count(*) over (partition by run_id, sheet, ref) as n from
    (select run_id, sheet, id, case when id % 11 = 0 then 'c' || id when id % 13 = 0 then 'XFE' || id when id % 19 = 0 then 'A1' else ref end as ref,
            case when id % 17 = 0 then 'x' || chr(7) else {EFF} end as value from ets where {EFF} <> excel_value))
  where regexp_full_match(ref, '[A-Z]+[0-9]+') and not ref like 'XFE%' and not contains(value, chr(7)) and n = 1"""


@query("w3_written_edits", duck(EDITS_SQL, "ets"))
def w3_written(ev: Evidence) -> DataFrame:
    """The sound edits, written by run and read again."""
    folder, edits = work_folder(ev.spark), pending_edits(ev)
    sinks.write_edits(edits, dec.edit_violations(edits), folder)
    return ev.spark.read.schema(edits.schema).parquet(folder).select("run_id", "sheet", "ref", "value")


@query(
    "w3_edit_violations",
    duck(
        f"""select run_id, sheet, ref, value, case when id % 11 = 0 then 'not-an-address' when id % 13 = 0 then 'outside-sheet-limits' when id % 17 = 0 then 'control-character' else 'two-edits-for-one-cell' end as rule
            from (select run_id, sheet, id, n, case when id % 11 = 0 then 'c' || id when id % 13 = 0 then 'XFE' || id when id % 19 = 0 then 'A1' else ref end as ref, case when id % 17 = 0 then 'x' || chr(7) else {EFF} end as value
                  from (select *, count(*) over (partition by run_id, sheet, case when id % 11 = 0 then 'c' || id when id % 13 = 0 then 'XFE' || id when id % 19 = 0 then 'A1' else ref end) as n from ets where {EFF} <> excel_value))
            where id % 11 = 0 or id % 13 = 0 or id % 17 = 0 or n > 1""",
        "ets",
    ),
)
def w3(ev: Evidence) -> DataFrame:
    return dec.edit_violations(pending_edits(ev))


def pending_edits(ev: Evidence) -> DataFrame:
    e = entries(ev).select("run_id", "sheet", "ref", "id", "excel_value", dec.effective_value().alias("value")).where("value <> excel_value")
    ref = F.when(_num() % 11 == 0, F.concat(F.lit("c"), _s(_num()))).when(_num() % 13 == 0, F.concat(F.lit("XFE"), _s(_num()))).when(_num() % 19 == 0, "A1").otherwise(F.col("ref"))
    value = F.when(_num() % 17 == 0, F.concat(F.lit("x"), F.chr(F.lit(7)))).otherwise(F.col("value"))
    return e.select("run_id", "sheet", ref.alias("ref"), value.alias("value"))
