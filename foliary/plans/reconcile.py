"""Field values, slots and packets (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE
from foliary.operators import pools as pool
from foliary.operators import reconcile as rec
from foliary.operators import standing as st
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.pools import form_rows, spans
from foliary.plans.registry import query
from foliary.plans.text import entity_parts, q_sig, same_entity_sql

# ------------------------------------------------------------------ inputs


def field_values(ev: Evidence) -> DataFrame:
    """A value per customer: a bank's name per field in eight spellings, some blank, some of
    another bank."""
    k = F.col("c_custkey")
    f = (k % 60).cast("int")
    regions = ev.table("region")
    seg = F.element_at(
        F.array(*[F.lit(s) for s in ("automobile", "building", "furniture", "household", "machinery")]), f % 5 + 1
    )
    rows = ev.table("customer").withColumn("f", f).withColumn("r_regionkey", F.when(f % 10 == 9, F.floor(k / 60) % 5).otherwise(f % 5).cast("int"))
    rows = rows.join(regions, "r_regionkey")
    phrase = F.concat(F.lit("Bank "), seg, F.lit(" "), F.col("r_name"))
    v = k % 8
    initials = F.upper(F.concat(F.lit("B"), F.substring(seg, 1, 1), F.regexp_replace("r_name", r"\B[A-Z]+| ", "")))
    value = (
        F.when(k % 9 == 0, "  ")
        .when(v == 0, F.concat(F.lit("PT "), phrase, F.lit(" Tbk")))
        .when(v == 1, F.upper(phrase))
        .when(v == 2, initials)
        .when(v == 3, F.concat(F.lit(" "), phrase))
        .when(v == 4, F.concat(phrase, F.lit(", CV.")))
        .otherwise(phrase)
    )
    status = F.when(k % 5 == 0, "uncited").when((k % 31 == 0), "invalid").otherwise("cited")
    return rows.select(
        F.concat(F.lit("run-"), (F.col("c_nationkey") % 4).cast("string")).alias("run_id"),
        F.when(F.col("f") == 0, "cc").when(F.col("f") == 1, "namaProyek").otherwise(F.concat(F.lit("field-"), F.col("f").cast("string"))).alias("field_key"),
        k.alias("seq"),
        value.alias("value"),
        status.alias("status"),
        F.when(status == "cited", k % 50).cast("int").alias("page_index"),
        F.when(status == "cited", k % 7).cast("int").alias("from_line"),
        F.when(status == "cited", k % 7 + 2).cast("int").alias("to_line"),
    )


add_duck(
    "fvl",
    r"""
    select 'run-' || (c_nationkey % 4) as run_id, case f when 0 then 'cc' when 1 then 'namaProyek' else 'field-' || f end as field_key, k as seq,
           case when k % 9 = 0 then '  ' else case k % 8 when 0 then 'PT ' || ph || ' Tbk' when 1 then upper(ph)
                when 2 then upper('B' || substr(seg,1,1) || regexp_replace(r_name, '\B[A-Z]+| ', '', 'g')) when 3 then ' ' || ph when 4 then ph || ', CV.' else ph end end as value,
           status, case when status = 'cited' then k % 50 end::int as page_index, case when status = 'cited' then k % 7 end::int as from_line,
           case when status = 'cited' then k % 7 + 2 end::int as to_line
    from (select *, 'Bank ' || seg || ' ' || r_name as ph from (
       select c_nationkey, c_custkey as k, (c_custkey % 60)::int as f, ['automobile','building','furniture','household','machinery'][c_custkey % 60 % 5 + 1] as seg,
              case when c_custkey % 5 = 0 then 'uncited' when c_custkey % 31 = 0 then 'invalid' else 'cited' end as status, r_name
       from customer join region on r_regionkey = case when c_custkey % 60 % 10 = 9 then (c_custkey // 60) % 5 else c_custkey % 60 % 5 end))""",
    [],
)


def list_fields(ev: Evidence) -> DataFrame:
    """Fields that hold a list: every second of those whose documents name several banks."""
    return field_values(ev).where("field_key like 'field-_9' and field_key <> 'field-29'").select("field_key").distinct()


add_duck(
    "spl",
    """select run_id, field_key, trim(value) as spelling, min(seq) as pos, arg_min(status, seq) as status, arg_min(coalesce(page_index,-1), seq) as page_index,
              arg_min(coalesce(from_line,-1), seq) as from_line, arg_min(coalesce(to_line,-1), seq) as to_line from fvl where trim(value) <> '' group by all""",
    ["fvl"],
)
add_duck("prt", entity_parts("spl", ["spelling"]), ["spl"])
REC_SQL = f"""
  with canon as (select run_id, field_key, arg_max(spelling, (len({q_sig('spelling')})::bigint * 1000000 + length(spelling)) * 10000000 - pos) as canonical from spl group by all),
  j as (select s.*, c.canonical, {same_entity_sql('x', 'y')} as same from spl s join canon c using (run_id, field_key) join prt x on x.v = s.spelling join prt y on y.v = c.canonical),
  g as (select run_id, field_key, any_value(canonical) as canonical, bool_and(same) as agree, count(*)::int as spellings,
               max(status) filter (where spelling = canonical) as own_s, max(page_index) filter (where spelling = canonical) as own_p,
               max(from_line) filter (where spelling = canonical) as own_f, max(to_line) filter (where spelling = canonical) as own_t,
               bool_or(status = 'invalid') as inv, bool_and(status = 'cited') as allc,
               arg_min(page_index, pos) filter (where status = 'cited') as c_p, arg_min(from_line, pos) filter (where status = 'cited') as c_f,
               arg_min(to_line, pos) filter (where status = 'cited') as c_t from j group by all),
  o as (select run_id, field_key, arg_min(value, seq) as value, arg_min(status, seq) as s, arg_min(coalesce(page_index,-1), seq) as p, arg_min(coalesce(from_line,-1), seq) as f,
               arg_min(coalesce(to_line,-1), seq) as t from fvl group by all)
  select run_id, field_key, outcome, case outcome when 'settled' then canonical when 'blank' then value else '' end as value, coalesce(spellings, 0) as spellings,
         case outcome when 'settled' then own_s when 'blank' then s when 'list' then case when inv then 'invalid' when allc then 'cited' else 'uncited' end end as status,
         nullif(case outcome when 'settled' then own_p when 'blank' then p when 'list' then c_p end, -1) as page_index,
         nullif(case outcome when 'settled' then own_f when 'blank' then f when 'list' then c_f end, -1) as from_line,
         nullif(case outcome when 'settled' then own_t when 'blank' then t when 'list' then c_t end, -1) as to_line
  from (select o.*, g.* exclude (run_id, field_key), case when canonical is null then 'blank' when agree then 'settled'
               when o.field_key like 'field-_9' and o.field_key <> 'field-29' then 'list' else 'conflict' end as outcome
        from o left join g using (run_id, field_key))"""
add_duck("rcn", REC_SQL, ["fvl", "spl", "prt"])


def reconciled(ev: Evidence) -> DataFrame:
    return rec.reconcile(field_values(ev), list_fields(ev))


def run_keys(ev: Evidence) -> DataFrame:
    """Form keys per run: the form's rows, plus the two keys with rules of their own."""
    k = F.col("pos") % 40
    own = F.when(k == 3, "cc").when(k == 5, "namaProyek").otherwise(F.col("field_key"))
    return ev.runs.join(form_rows(ev).withColumn("field_key", own), "form_id").select(
        "run_id", "field_key", F.col("p_name").alias("label"), "pos"
    )


add_duck(
    "rky",
    "select run_id, case when pos % 40 = 3 then 'cc' when pos % 40 = 5 then 'namaProyek' else field_key end as field_key, p_name as label, pos from runs join frw using (form_id)",
    ["runs", "frw"],
)

# ------------------------------------------------------------------ A1 - A4, A14


@query("a1_reconcile", duck("select * from rcn", "rcn"))
def a1(ev: Evidence) -> DataFrame:
    return reconciled(ev)


@query(
    "a2_spelling_rows",
    duck(
        """select run_id, field_key, r.outcome, (row_number() over (partition by run_id, field_key order by s.pos) - 1)::int as place, s.spelling, s.status,
                  nullif(s.page_index, -1) as page_index, nullif(s.from_line, -1) as from_line, nullif(s.to_line, -1) as to_line
           from spl s join rcn r using (run_id, field_key) where r.outcome in ('list','conflict')""",
        "spl",
        "rcn",
    ),
)
def a2(ev: Evidence) -> DataFrame:
    return rec.spelling_rows(field_values(ev), reconciled(ev))


@query(
    "a2_join_list_value",
    duck(
        """select run_id, field_key, 0 as chunk, string_agg(s.spelling, chr(10) order by s.pos) as text
           from spl s join rcn r using (run_id, field_key) where r.outcome = 'list' group by run_id, field_key""",
        "spl",
        "rcn",
    ),
)
def a2_text(ev: Evidence) -> DataFrame:
    return rec.list_values_text(field_values(ev), reconciled(ev))


@query(
    "a3_dispositions",
    duck(
        """
        select run_id, field_key, disposition, case when disposition in ('cited','citation-invalid','uncited') then value else '' end as value,
               case when disposition = 'cited' and field_key <> 'cc' then 'high' else 'low' end as confidence,
               coalesce(reason, case when field_key = 'cc' and disposition in ('cited','citation-invalid','uncited') then 'never-high' end) as reason,
               case when disposition = 'cited' then page_index end as page_index
        from (select k.run_id, k.field_key, r.value, r.page_index,
                case when field_key = 'namaProyek' then 'never-extracted' when coalesce(np,0) = 0 then 'no-pages' when coalesce(no,0) = 0 then 'nothing-open' end as reason,
                case when field_key = 'namaProyek' or coalesce(np,0) = 0 or coalesce(no,0) = 0 then 'not-searched' when r.outcome is null then 'not-found'
                     when r.outcome = 'conflict' then 'conflict' when r.outcome <> 'list' and trim(r.value) = '' then 'not-found' when r.status = 'cited' then 'cited'
                     when r.status = 'invalid' then 'citation-invalid' else 'uncited' end as disposition
              from (select distinct run_id, field_key from rky where field_key is not null) k left join rcn r using (run_id, field_key)
              left join (select run_id, count(*) as np from pgs group by all) using (run_id) left join (select run_id, count(*) as no from opn group by all) using (run_id))""",
        "rky",
        "rcn",
        "pgs",
        "opn",
    ),
)
def a3(ev: Evidence) -> DataFrame:
    keys = run_keys(ev).where("field_key is not null").select("run_id", "field_key").distinct()
    counts = (
        ev.pages.groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("pages"))
        .join(pool.searchable_page_counts(ev.pages, ev.sources), "run_id", "left")
    )
    return rec.dispositions(keys, reconciled(ev), counts)


@query(
    "a14_field_pages",
    duck(
        """select run_id, page_index, source_id, coalesce(case when s.pos % 3 <> 0 then s.name end, p.source_id) as source_name,
                  coalesce(case when p.doc_id % 2 = 0 then page_in_doc + 1 end, row_number() over (partition by p.run_id, p.source_id order by page_index) - 1)::int as page_in_doc
           from pgs p join srcs s using (run_id, source_id)""",
        "pgs",
        "srcs",
    ),
)
def a14(ev: Evidence) -> DataFrame:
    named = ev.sources.select("run_id", "source_id", F.when(F.col("pos") % 3 != 0, F.col("name")).alias("source_name"))
    p = ev.pages.join(named, ["run_id", "source_id"]).select(
        *PAGE, "source_id", "source_name", F.when(F.col("doc_id") % 2 == 0, F.col("page_in_doc") + 1).alias("page_in_doc")
    )
    return rec.field_pages(p)


@query(
    "a4_outstanding_fields",
    duck(
        """select run_id, field_key, label, case when field_key = 'namaProyek' then 'never-extracted' when outcome = 'conflict' then 'documents-disagree' else 'searched-not-found' end as reason
           from (select run_id, field_key, arg_min(label, pos) as label from rky where field_key is not null and field_key <> '' group by all)
           left join (select run_id, field_key, outcome, value from rcn) using (run_id, field_key)
           where not coalesce(outcome = 'list' or trim(value) <> '', false)""",
        "rky",
        "rcn",
    ),
)
def a4(ev: Evidence) -> DataFrame:
    return rec.outstanding_fields(run_keys(ev), reconciled(ev))


@query(
    "a4_unmapped_values",
    duck(
        """select run_id, field_key, value from rcn where (outcome = 'list' or (outcome <> 'conflict' and trim(value) <> ''))
           and not exists (select 1 from rky where rky.run_id = rcn.run_id and rky.field_key = rcn.field_key)""",
        "rky",
        "rcn",
    ),
)
def a4_unmapped(ev: Evidence) -> DataFrame:
    return rec.unmapped_values(run_keys(ev), reconciled(ev))


# ------------------------------------------------------------------ A5 - A10, A13, A16


@query(
    "a5_satisfied_slots",
    duck("select run_id, slot_key from slots s where fillable and exists (select 1 from cap c where c.run_id = s.run_id and c.slot_key = s.slot_key and c.page_index is not null)", "slots", "cap"),
)
def a5_satisfied(ev: Evidence) -> DataFrame:
    return st.satisfied_slots(ev.slots, ev.captures)


# Captures of two thirds of the slots have no zone here, so that slots are left over.
add_duck("fcap", "select * from cap where page_index is not null and cast(regexp_extract(slot_key, '([0-9]+)$', 1) as int) % 3 = 0", ["cap"])


def few_captures(ev: Evidence) -> DataFrame:
    """All captures; most have lost their zone."""
    zoned = F.regexp_extract("slot_key", "([0-9]+)$", 1).cast("int") % 3 == 0
    return ev.captures.withColumn("page_index", F.when(zoned, F.col("page_index")))


@query(
    "a5_outstanding_slots",
    duck(
        """select s.run_id, s.slot_key, label, section_title, case when pos % 2 = 0 then 'search failed' else 'searched-not-found' end as reason from slots s
           where fillable and layout <> 'images' and not exists (select 1 from fcap c where c.run_id = s.run_id and c.slot_key = s.slot_key)""",
        "slots",
        "fcap",
    ),
)
def a5_outstanding(ev: Evidence) -> DataFrame:
    reasons = ev.slots.where("pos % 2 = 0").select("run_id", "slot_key", F.lit("search failed").alias("reason"))
    never = ev.slots.where("layout = 'images'")
    return st.outstanding_slots(ev.slots, few_captures(ev), reasons, never)


@query(
    "a5_manual_slots",
    duck(
        """select run_id, slot_key, label, section_title from slots s where fillable and added and run_id <> 'run-1'
           and not exists (select 1 from fcap c where c.run_id = s.run_id and c.slot_key = s.slot_key)""",
        "slots",
        "fcap",
    ),
)
def a5_manual(ev: Evidence) -> DataFrame:
    paged = ev.slots.where("added and run_id = 'run-1'").select("run_id", "section_id").distinct()
    return st.manual_slots(ev.slots, few_captures(ev), paged)


STATE_SQL = """
  select s.run_id, s.slot_key, section_id, section_title, label, fillable, pos, coalesce(n,0) as captures, coalesce(mo,1) as max_ordinal, coalesce(found,0) as found,
         coalesce(unch,0) as unchecked, case when n is null then 'pending' when prop then 'proposed' when op > 0 and conf > 0 then 'partial' when op > 0 and outs then 'outstanding'
           when op > 0 then 'pending' when conf > 0 then 'confirmed' else 'unfilled' end as status
  from slots s left join (select run_id, slot_key, count(*) as n, max(ordinal) as mo, count(page_index) as found,
       count(*) filter (where page_index is not null and checked_for is distinct from (page_index || ':' || from_line || '-' || to_line)) as unch,
       count(*) filter (where status = 'confirmed' and page_index is not null) as conf, count(*) filter (where status in ('pending','outstanding','proposed')) as op,
       bool_or(status = 'proposed') as prop, bool_or(status = 'outstanding') as outs from cap group by all) using (run_id, slot_key)"""
add_duck("sst", STATE_SQL, ["slots", "cap"])


def slot_states(ev: Evidence) -> DataFrame:
    return st.slot_status(ev.slots, ev.captures)


@query("a6_slot_status", duck("select * from sst", "sst"))
def a6(ev: Evidence) -> DataFrame:
    return slot_states(ev)


@query(
    "a7_progress",
    duck(
        """select run_id, count(*) as fillable, count(*) filter (where status='pending') as pending, count(*) filter (where status='proposed') as proposed,
                  count(*) filter (where status='confirmed') as confirmed, count(*) filter (where status='outstanding') as outstanding,
                  count(*) filter (where status='unfilled') as unfilled, count(*) filter (where status='partial') as partial, count(*) filter (where unchecked > 0) as unchecked,
                  count(*) filter (where status in ('confirmed','unfilled')) as decided from sst where fillable group by run_id""",
        "sst",
    ),
)
def a7(ev: Evidence) -> DataFrame:
    return st.progress(slot_states(ev))


add_duck(
    "std",
    """select c.*, case when status = 'confirmed' and p.page_index is not null then 'ships' when status = 'confirmed' then 'lost' else status end as standing
       from cap c left join (select run_id, page_index from pgs) p using (run_id, page_index)""",
    ["cap", "pgs"],
)
add_duck(
    "tot",
    """select s.run_id, s.slot_key, section_title, label, fillable, pos, coalesce(mo, 1) as max_ordinal, coalesce(held,0) as held, coalesce(ships,0) as ships,
              case when not fillable then 'extra' when ships > 0 and ships = held then 'complete' when ships > 0 then 'partial' when unf then 'blank-by-choice'
                   when outs then 'blank-not-found' else 'blank-other' end as kind
       from slots s left join (select run_id, slot_key, count(*) as held, count(*) filter (where standing = 'ships') as ships, bool_and(standing = 'unfilled') as unf,
              bool_and(standing = 'outstanding') as outs, max(ordinal) as mo from std group by all) using (run_id, slot_key)""",
    ["slots", "std"],
)


def standings(ev: Evidence) -> DataFrame:
    return st.capture_standings(ev.captures, ev.pages)


def totals(ev: Evidence) -> DataFrame:
    return st.slot_totals(ev.slots, standings(ev))


@query("a8_capture_standings", duck("select run_id, key, standing from std", "std"))
def a8_standings(ev: Evidence) -> DataFrame:
    return standings(ev).select("run_id", "key", "standing")


@query("a8_slot_totals", duck("select * from tot", "tot"))
def a8_totals(ev: Evidence) -> DataFrame:
    return totals(ev)


@query(
    "a8_plan_export",
    duck(
        """select run_id, count(*) filter (where fillable) as fillable_slots, count(*) filter (where kind='complete') as complete, count(*) filter (where kind='partial') as partial,
                  count(*) filter (where kind like 'blank%') as blank, count(*) filter (where kind='blank-by-choice') as blank_by_choice,
                  count(*) filter (where kind='blank-not-found') as blank_not_found, count(*) filter (where kind='blank-other') as blank_other,
                  sum(case when fillable then held else 0 end)::bigint as captures_held, sum(case when fillable then ships else 0 end)::bigint as captures_shipping,
                  sum(case when fillable then 0 else ships end)::bigint as captures_extra from tot group by run_id""",
        "tot",
    ),
)
def a8(ev: Evidence) -> DataFrame:
    return st.export_tally(totals(ev))


@query(
    "a8_blocking_items",
    duck(
        """
        select c.run_id, standing as kind, section_title, label, ordinal, c.pos as capture_pos, s.pos as form_pos from std c join slots s using (run_id, slot_key)
        where fillable and standing in ('proposed','pending','lost')
        union all select s.run_id, 'pending', section_title, label, 1, -1, s.pos from slots s where fillable
             and not exists (select 1 from std c where c.run_id = s.run_id and c.slot_key = s.slot_key)
        union all select c.run_id, 'orphan', null, c.key, c.ordinal, -1, null from std c where page_index is not null
             and not exists (select 1 from slots s where c.run_id = s.run_id and c.slot_key = s.slot_key)""",
        "slots",
        "std",
    ),
)
def a8_blocking(ev: Evidence) -> DataFrame:
    return st.blocking_items(ev.slots, standings(ev))


@query(
    "a16_unmatched_captures",
    duck("select run_id, key, status from cap c where not exists (select 1 from slots s where s.run_id = c.run_id and s.slot_key = c.slot_key)", "cap", "slots"),
)
def a16(ev: Evidence) -> DataFrame:
    return st.unmatched_captures(ev.slots, ev.captures).select("run_id", "key", "status")


@query(
    "a16_reported_positions",
    duck(
        """select run_id, key, pos from (select c.run_id, c.key, c.pos, n, row_number() over (partition by run_id, key order by c.page_index is not null, c.pos) as r
             from (select run_id, 'slot-' || cast(regexp_extract(slot_key, '([0-9]+)$', 1) as int) % 7 || '/' || (ordinal % 40) as key, pos, page_index from cap) c
             join (select run_id, 'slot-' || cast(regexp_extract(slot_key, '([0-9]+)$', 1) as int) % 7 || '/' || (ordinal % 40) as key, count(*) as n from cap where status = 'outstanding' group by all) using (run_id, key)) where r <= n""",
        "cap",
    ),
)
def a16_reported(ev: Evidence) -> DataFrame:
    """Keys folded together, so that several captures share one."""
    n = F.regexp_extract("slot_key", "([0-9]+)$", 1).cast("int") % 7
    c = ev.captures.withColumn(
        "key", F.concat(F.lit("slot-"), n.cast("string"), F.lit("/"), (F.col("ordinal") % 40).cast("string"))
    )
    return st.reported_positions(c, c.where("status = 'outstanding'").select("run_id", "key"))


@query(
    "a16_proposed_positions",
    duck("select run_id, section_id, c.pos from cap c join slots s using (run_id, slot_key) where status = 'proposed'", "cap", "slots"),
)
def a16_proposed(ev: Evidence) -> DataFrame:
    return st.proposed_positions(ev.slots, ev.captures)


@query(
    "a9_empty_reasons",
    duck(
        """select c.run_id, c.key, section_title, coalesce(label, c.key) as label, case when status = 'unfilled' then 'emptied' when s.slot_key is null or added then 'undrawn'
                  when status = 'pending' then 'unsearched' when origin = 'llm' then 'rejected' else 'notfound' end as reason
           from cap c left join (select run_id, slot_key, section_title, label, added from slots) s on s.run_id = c.run_id and s.slot_key = c.slot_key where c.page_index is null""",
        "cap",
        "slots",
    ),
)
def a9(ev: Evidence) -> DataFrame:
    return st.empty_reasons(ev.captures, ev.slots)


def proposal_pages(ev: Evidence) -> DataFrame:
    """Every second block of four pages is proposed as a section."""
    k = F.floor(F.col("page_in_doc") / 4)
    return ev.pages.where(k % 2 == 0).select(
        "run_id", "source_id", F.concat("source_id", F.lit("-"), k.cast("string")).alias("section_id"), "page_index"
    )


def added_pages(ev: Evidence) -> DataFrame:
    """Every fifth block is an added section."""
    k = F.floor(F.col("page_in_doc") / 4)
    return ev.pages.where(k % 5 == 1).select(
        "run_id", "source_id", F.concat("source_id", F.lit("+"), k.cast("string")).alias("section_id"), "page_index"
    )


@query(
    "a10_source_proposals",
    duck(
        """select s.run_id, s.source_id, name, pos % 2 = 0 as asked, not ai as fenced, coalesce(np,0) as proposals, coalesce(nf,0) as unclaimed from srcs s
           left join (select run_id, source_id, count(distinct page_in_doc // 4) filter (where page_in_doc // 4 % 2 = 0) as np,
                             count(*) filter (where page_in_doc // 4 % 2 <> 0 and page_in_doc // 4 % 5 <> 1) as nf from pgs group by all) using (run_id, source_id)""",
        "srcs",
        "pgs",
    ),
)
def a10(ev: Evidence) -> DataFrame:
    asked = F.when(F.col("pos") % 2 == 0, F.lit(True))
    return st.source_proposals(
        ev.sources.withColumn("sections_asked", asked), ev.pages, proposal_pages(ev), added_pages(ev)
    )


@query(
    "a13_section_removal_cost",
    duck(
        "select run_id, section_id, count(*) as captures, count(*) filter (where status = 'confirmed') as confirmed from cap c join slots s using (run_id, slot_key) where page_index is not null group by all",
        "cap",
        "slots",
    ),
)
def a13(ev: Evidence) -> DataFrame:
    return st.section_removal_cost(ev.slots, ev.captures)
