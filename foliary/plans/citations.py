"""Citations, answers, sections and continuations (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import PAGE
from foliary.operators import citations as cit
from foliary.operators import continuation as con
from foliary.operators import pools as pool
from foliary.operators import reconcile as rec
from foliary.operators import sections as sec
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.geometry import CLAMP_SQL, PADDED, RANGE_SQL, TRIM_SQL
from foliary.plans.pools import WHOLE_SQL, open_pool, open_typed
from foliary.plans.registry import query
from foliary.plans.text import q_fold, q_reading_tokens


def _claim():
    return F.col("claim_id")


# ------------------------------------------------------------------ V1 - V3

add_duck(
    "v1t",
    """select c.run_id, c.claim_id, c.page_index, from_line, to_line,
              case when n = 3 then null when n > 0 then 'incomplete' when p.page_index is null then 'unknown-page' when from_line > to_line then 'reversed'
                   when a.i is null then 'missing-first-line' when b.i is null then 'missing-last-line' end as reason, n
       from (select *, (page_index is null)::int + (from_line is null)::int + (to_line is null)::int as n from clm) c
       left join pgs p on p.run_id = c.run_id and p.page_index = c.page_index
       left join lns a on a.run_id = c.run_id and a.page_index = c.page_index and a.i = from_line
       left join lns b on b.run_id = c.run_id and b.page_index = c.page_index and b.i = to_line""",
    ["clm", "pgs", "lns"],
)


@query(
    "v1_citation_outcome",
    duck(
        "select run_id, claim_id, page_index, from_line, to_line, reason, case when n = 3 then 'uncited' when reason is null then 'cited' else 'invalid' end as status from v1t",
        "v1t",
    ),
)
def v1(ev: Evidence) -> DataFrame:
    return cit.citation_outcomes(ev.claims, ev.lines, ev.pages)


add_duck(
    "v2t",
    """select c.run_id, c.claim_id, c.page_index, from_line, to_line, n = 0 and reason is null as cited, case when n = 0 and reason is null then tx end as cited_text, reason,
              case when reason = 'missing-line' then fm end::int as missing_line
       from (select c.*, (c.page_index is null)::int + (from_line is null)::int + (to_line is null)::int as n, tx,
                 (select min(k) from unnest(range(from_line, to_line + 1)) t(k) where k not in (select i from lns l where l.run_id = c.run_id and l.page_index = c.page_index)) as fm,
                 case when c.page_index is null and from_line is null and to_line is null then null when c.page_index is null or from_line is null or to_line is null then 'incomplete'
                      when p.page_index is null then 'unknown-page' when from_line > to_line then 'reversed' when coalesce(cnt,0) <> to_line - from_line + 1 then 'missing-line' end as reason
             from clm c left join pgs p on p.run_id = c.run_id and p.page_index = c.page_index
             left join (select claim_id, count(*) as cnt, string_agg(l.text, chr(10) order by l.i) as tx from clm c2 join lns l on l.run_id = c2.run_id and l.page_index = c2.page_index
                        and l.i between c2.from_line and c2.to_line group by all) using (claim_id)) c""",
    ["clm", "pgs", "lns"],
)


@query(
    "v2_whole_citation",
    duck("select run_id, claim_id, page_index, from_line, to_line, cited, cited_text from v2t", "v2t"),
)
def v2(ev: Evidence) -> DataFrame:
    return cit.whole_citations(ev.claims, ev.lines, ev.pages).drop("reason", "missing_line")


@query(
    "v3_citation_with_reason",
    duck("select run_id, claim_id, page_index, from_line, to_line, cited, cited_text, reason, missing_line from v2t", "v2t"),
)
def v3(ev: Evidence) -> DataFrame:
    return cit.whole_citations(ev.claims, ev.lines, ev.pages)


# ------------------------------------------------------------------ V4, V5


def field_replies(ev: Evidence) -> DataFrame:
    """A reply per claim: a wanted value, an unwanted key and a blank value."""
    position = (_claim() * 7 % 400).cast("int")

    def entry(key, value):
        return F.struct(
            key.alias("fieldKey"),
            value.alias("value"),
            F.when(F.col("page_index").isNotNull(), position).alias("pageIndex"),
            F.col("from_line").alias("from"),
            F.col("to_line").alias("to"),
        )

    values = F.array(
        entry(F.concat(F.lit("field-"), (_claim() % 20).cast("string")), F.concat(F.lit("value "), (_claim() % 3).cast("string"))),
        entry(F.lit("unwanted"), F.lit("x")),
        entry(F.lit("field-1"), F.lit("  ")),
    )
    body = F.to_json(F.struct(values.alias("values")))
    reply = F.when(_claim() % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        _claim() % 41 == 1, "no idea"
    ).otherwise(body)
    return ev.claims.select("run_id", F.lit("KB").alias("pool_id"), "claim_id", reply.alias("reply"))


def wanted_keys(ev: Evidence) -> DataFrame:
    return ev.claims.select("run_id", F.concat(F.lit("field-"), (_claim() % 20).cast("string")).alias("field_key")).distinct()


add_duck(
    "v4t",
    """select run_id, 'KB' as pool_id, 0 as seq, 'field-' || (claim_id % 20) as field_key, 'value ' || (claim_id % 3) as value,
              case when page_index is not null then claim_id*7 % 400 end::int as position, from_line, to_line, claim_id
       from clm where not (claim_id % 3 <> 0 and claim_id % 41 = 1) and not coalesce(from_line < 0 or to_line < 0, false)""",
    ["clm"],
)


@query(
    "v4_refused_replies",
    duck("""select run_id, 'KB' as pool_id, claim_id, case when claim_id % 3 <> 0 and claim_id % 41 = 1 then 'no-json-object' else 'negative-number' end as reason from clm
       where (claim_id % 3 <> 0 and claim_id % 41 = 1) or coalesce(from_line < 0 or to_line < 0, false)""", "clm"),
)
def v4_refused(ev: Evidence) -> DataFrame:
    return cit.refused_field_replies(field_replies(ev)).select("run_id", "pool_id", "claim_id", "reason")


@query(
    "v4_reply_balance",
    duck(
        """select run_id, count(*) as replies, count_if(not ((claim_id % 3 <> 0 and claim_id % 41 = 1) or coalesce(from_line < 0 or to_line < 0, false))) as good,
                  count_if((claim_id % 3 <> 0 and claim_id % 41 = 1) or coalesce(from_line < 0 or to_line < 0, false)) as refused from clm group by run_id""",
        "clm",
    ),
)
def v4_balance(ev: Evidence) -> DataFrame:
    judged_ = cit.judged_field_replies(field_replies(ev))
    good = F.col("reason").isNull()
    return judged_.groupBy("run_id").agg(F.count(F.lit(1)).alias("replies"), F.count_if(good).alias("good"), F.count_if(~good).alias("refused"))


@query("v4_extract_fields", duck("select * exclude (claim_id) from v4t", "v4t"))
def v4(ev: Evidence) -> DataFrame:
    return cit.field_claims(field_replies(ev), wanted_keys(ev))


def pooled(ev: Evidence) -> DataFrame:
    claims = cit.field_claims(field_replies(ev), wanted_keys(ev))
    return cit.pooled_values(claims, open_pool(ev), ev.lines, ev.pages, ev.sources)


V5_SQL = """
  select run_id, field_key, seq, value, case when nn = 3 then 'uncited' when reason is null then 'cited' else 'invalid' end as status, reason,
         case when nn < 3 and reason is null then pi end as page_index, case when nn < 3 and reason is null then from_line end as from_line,
         case when nn < 3 and reason is null then to_line end as to_line, case when nn < 3 and reason is null then name end as source_name,
         case when nn < 3 and reason is null then page_in_doc end as page_in_doc
  from (select v.*, r.page_index as pi, p.page_in_doc, s.name, (position is null)::int + (from_line is null)::int + (to_line is null)::int as nn,
          case when position is null and from_line is null and to_line is null then null when position is null or from_line is null or to_line is null then 'incomplete'
               when r.page_index is null then 'unknown-page' when from_line > to_line then 'reversed' when a.i is null then 'missing-first-line' when b.i is null then 'missing-last-line' end as reason
        from v4t v left join rpl r using (run_id, pool_id, position) left join pgs p on p.run_id = v.run_id and p.page_index = r.page_index
        left join srcs s on s.run_id = p.run_id and s.source_id = p.source_id
        left join lns a on a.run_id = v.run_id and a.page_index = r.page_index and a.i = from_line
        left join lns b on b.run_id = v.run_id and b.page_index = r.page_index and b.i = to_line)"""


@query("v5_pooled_values", duck(V5_SQL, "v4t", "rpl", "pgs", "srcs", "lns"))
def v5(ev: Evidence) -> DataFrame:
    return pooled(ev)


@query("v5_extract_text_fields")
def v5_reconciled(ev: Evidence) -> DataFrame:
    """The whole field extraction: replies to reconciled values."""
    lists = wanted_keys(ev).where("field_key like '%9'").select("field_key").distinct()
    numbered = pooled(ev).withColumn("seq", F.coalesce("page_index", F.lit(10**6)) * 1000 + F.coalesce("from_line", F.lit(0)))
    return rec.reconcile(numbered, lists)


# ------------------------------------------------------------------ V6, V7, V25


def searched_slots(ev: Evidence) -> DataFrame:
    return ev.slots.where("fillable and layout = 'table' and not added").select(
        "run_id", "slot_key", F.coalesce("doc_type", F.lit("(none)")).alias("pool_id")
    )


def slot_answers(ev: Evidence) -> DataFrame:
    """Answers for thirty slot keys, several to a slot, some beyond the pool."""
    return ev.claims.select(
        "run_id",
        F.concat(F.lit("slot-"), (_claim() % 30).cast("string")).alias("slot_key"),
        _claim().alias("pos"),
        F.when(F.col("page_index").isNotNull(), (_claim() * 7 % 600).cast("int")).alias("position"),
        "from_line",
        "to_line",
        F.lit("high").alias("confidence"),
    )


add_duck(
    "ssl",
    "select run_id, slot_key, coalesce(doc_type, '(none)') as pool_id from slots where fillable and layout = 'table' and not added",
    ["slots"],
)
add_duck(
    "v6t",
    f"""
    with wide as (select a.run_id, a.claim_id, a.slot_key, case when a.position is not null then coalesce(r.page_index, -1) end as page_index, a.from_line, a.to_line, a.position
                  from (select s.run_id, s.slot_key, s.pool_id, min(claim_id) as claim_id, arg_min(case when page_index is not null then claim_id*7 % 600 else -5 end, claim_id) as position0,
                               arg_min(coalesce(from_line,-9), claim_id) as f0, arg_min(coalesce(to_line,-9), claim_id) as t0
                        from clm c join ssl s on s.run_id = c.run_id and s.slot_key = 'slot-' || (claim_id % 30) group by all) q
                  cross join lateral (select q.run_id, q.claim_id, q.slot_key, nullif(q.position0,-5)::int as position, nullif(q.f0,-9) as from_line, nullif(q.t0,-9) as to_line) a
                  left join rpl r on r.run_id = q.run_id and r.pool_id = q.pool_id and r.position = a.position),
    cl as ({CLAMP_SQL}), tr as ({TRIM_SQL}),
    zz as (select c.run_id, c.claim_id, c.slot_key, c.page_index, c.from_line, c.to_line as raw_to, coalesce(c.clamped,false) as clamped,
                  case when n >= 4 and typical > 0 and cut is not null and n - cut <= 4 and cut >= 4 then kept_i else c_to end as to_line
           from cl c left join tr using (claim_id)),
    r as ({RANGE_SQL}),
    res as (select *, case when error is not null then 'error' when found then 'found' else 'none' end as outcome from (
              select *, {PADDED}, case when not found then null when not known then 'not-a-page-offered' when from_line > to_line then 'reversed'
                   when coalesce(n,0) <> to_line - from_line + 1 then 'missing-lines' end as error
              from (select *, (page_index is not null and from_line is not null and raw_to is not null) as found from r)))
    select s.run_id, s.slot_key, coalesce(outcome, 'no-answer') as outcome, error, case when outcome = 'found' then page_index end as page_index,
           case when outcome = 'found' then from_line end as from_line, case when outcome = 'found' then to_line end::int as to_line, case when outcome = 'found' then x end as x,
           case when outcome = 'found' then y end as y, case when outcome = 'found' then w end as w, case when outcome = 'found' then h end as h,
           case when outcome = 'found' then btext end as text, case when outcome = 'found' then case when clamped then 'low' else 'high' end end as confidence
    from ssl s left join res using (run_id, slot_key)""",
    ["clm", "ssl", "rpl", "pgs", "lns"],
)


@query("v6_locate_outcomes", duck("select * from v6t", "v6t"))
def v6(ev: Evidence) -> DataFrame:
    return cit.locate_outcomes(searched_slots(ev), slot_answers(ev), open_pool(ev), ev.lines, ev.pages)


add_duck("wcap", "select * from cap where status in ('pending','outstanding') and page_index is null", ["cap"])
add_duck("wwp", WHOLE_SQL.replace("from cap c", "from wcap c"), ["wcap", "slots", "otyp", "pgs", "lns"])


@query(
    "v7_route_wanted",
    duck(
        """
        select run_id, key, outcome, reason, case when outcome = 'proposal' then page_index end as page_index, case when outcome = 'proposal' then from_line end as from_line,
               case when outcome = 'proposal' then to_line end as to_line, case when outcome = 'proposal' then text end as text
        from (select w.run_id, w.key, l.page_index, l.from_line, l.to_line, l.text,
                 case when s.slot_key is null then 'no-such-slot' when added then 'added-by-hand' when not fillable then 'by-hand' when l.outcome is null then 'no-outcome'
                      when l.outcome in ('error','no-answer') then 'search-failed' when l.outcome = 'none' then 'not-found' when w.rk > 1 then 'extra-capture' end as reason,
                 case when s.slot_key is null or added then 'out-of-scope' when fillable and l.outcome = 'found' and w.rk = 1 then 'proposal' else 'outstanding' end as outcome
              from (select *, row_number() over (partition by run_id, slot_key order by pos) as rk from wcap) w left join slots s on s.run_id = w.run_id and s.slot_key = w.slot_key
              left join v6t l on l.run_id = w.run_id and l.slot_key = w.slot_key where not coalesce(s.layout = 'images' and not added, false))
        union all
        select w.run_id, w.key, coalesce(p.outcome, 'outstanding'), case when p.outcome is null then 'by-hand' else p.reason end, p.page_index, p.from_line, p.to_line, p.text
        from wcap w join slots s on s.run_id = w.run_id and s.slot_key = w.slot_key and s.layout = 'images' and not added left join wwp p on p.run_id = w.run_id and p.key = w.key""",
        "wcap",
        "slots",
        "v6t",
        "wwp",
    ),
)
def v7(ev: Evidence) -> DataFrame:
    wanted = ev.captures.where("status in ('pending', 'outstanding') and page_index is null").select(
        "run_id", "key", "slot_key", "pos"
    )
    s = ev.slots.where("layout = 'images' and fillable").select("run_id", "slot_key", "doc_type", "page_ordinal")
    whole = pool.whole_page_proposals(
        wanted.join(s, ["run_id", "slot_key"]), open_typed(ev), ev.pages, ev.lines
    )
    return cit.route_wanted(wanted, ev.slots, v6(ev), whole)


@query(
    "v25_grouped_or_single",
    duck(
        """select run_id, slot_key, case when g then 1 when s then 2 end as position, case when g then 'grouped' when s then 'single' else 'none' end as answered_by
           from (select run_id, slot_key, pos % 3 = 0 as g, pos % 2 = 0 as s from slots)""",
        "slots",
    ),
)
def v25(ev: Evidence) -> DataFrame:
    base = ev.slots.select("run_id", "slot_key", "pos")
    g = base.select("run_id", "slot_key", (F.col("pos") % 3 == 0).alias("usable"), F.lit(1).alias("position"))
    s = base.select("run_id", "slot_key", (F.col("pos") % 2 == 0).alias("usable"), F.lit(2).alias("position"))
    return cit.with_fallback(g, s)


# ------------------------------------------------------------------ V19 - V21


def second_readings(ev: Evidence) -> tuple[DataFrame, DataFrame]:
    key = F.concat(F.lit("f-"), _claim().cast("string"))
    value = F.when(_claim() % 23 == 0, " ").when(_claim() % 29 == 0, "---").otherwise(
        F.concat(F.lit("No. "), _claim().cast("string"), F.lit(" / OIl-10"))
    )
    values = ev.claims.select(
        "run_id",
        key.alias("field_key"),
        value.alias("value"),
        (_claim() % 9 == 0).alias("conflict"),
        "page_index",
        "from_line",
        "to_line",
    )
    reading = F.when(_claim() % 7 == 0, F.lit(None).cast("string")).when(
        _claim() % 5 == 0, F.concat(F.lit("no "), (_claim() + 2).cast("string"))
    ).otherwise(F.concat(F.lit("Ref: NO "), _claim().cast("string"), F.lit(" /  0i1 1o, lampiran")))
    return values, ev.claims.select("run_id", key.alias("field_key"), reading.alias("reading"))


VERIFY_SQL = f"""
  select v.run_id, v.field_key, v.claim_id, value, reading, case when skip then null when page_index is null then 'no-citation' when needle = '' then 'nothing-comparable'
         when reason = 'unknown-page' then 'page-not-in-run' when reason = 'reversed' then 'reversed' when reason = 'missing-line' then 'missing-lines' when reading is null then 'no-reading' end as reason,
         skip, contains(hay, needle) as agree
  from (select c.run_id, 'f-' || c.claim_id as field_key, c.claim_id, c.page_index, t.reason, c.claim_id % 9 = 0 or c.claim_id % 23 = 0 as skip, value, reading,
               array_to_string({q_reading_tokens('value', 1)}, ' ') as needle, array_to_string({q_reading_tokens("coalesce(reading,'')", 1)}, ' ') as hay
        from (select *, case when claim_id % 23 = 0 then ' ' when claim_id % 29 = 0 then '---' else 'No. ' || claim_id || ' / OIl-10' end as value,
                     case when claim_id % 7 = 0 then null when claim_id % 5 = 0 then 'no ' || (claim_id + 2) else 'Ref: NO ' || claim_id || ' /  0i1 1o, lampiran' end as reading from clm) c
        join v2t t using (claim_id)) v"""
add_duck(
    "vfy",
    f"""select run_id, field_key, case when outcome = 'disagreed' then '' else value end as value, outcome, reason, case when outcome = 'disagreed' then value end as page_reading,
               case when outcome = 'disagreed' then reading end as crop_reading
        from (select *, case when skip then 'skipped' when reason is not null then 'unverified' when agree then 'agreed' else 'disagreed' end as outcome from ({VERIFY_SQL}))""",
    ["clm", "v2t"],
)


def verified(ev: Evidence) -> DataFrame:
    values, readings = second_readings(ev)
    # an incomplete citation is no citation
    full = F.col("from_line").isNotNull() & F.col("to_line").isNotNull()
    values = values.withColumn("page_index", F.when(full, F.col("page_index")))
    return cit.verify_values(values, readings, ev.lines, ev.pages)


@query(
    "v19_verify_cited_values",
    duck("select * from vfy", "vfy").replace("when page_index is null then 'no-citation'", "when page_index is null or reason = 'incomplete' then 'no-citation'"),
)
def v19(ev: Evidence) -> DataFrame:
    return verified(ev)


@query(
    "v19_verify_report",
    duck(
        """select run_id, count(*) filter (where outcome='agreed') as agreed, count(*) filter (where outcome='disagreed') as disagreed, count(*) filter (where outcome='unverified') as unverified,
                  count(*) filter (where outcome='skipped') as skipped, count(*) filter (where outcome in ('agreed','disagreed')) as checked from vfy group by run_id""",
        "vfy",
    ).replace("when page_index is null then 'no-citation'", "when page_index is null or reason = 'incomplete' then 'no-citation'"),
)
def v19_report(ev: Evidence) -> DataFrame:
    return cit.verify_report(verified(ev))


def order_lines(ev: Evidence) -> DataFrame:
    """Lines of which some carry an order-kind label."""
    k = (F.col("doc_id") * 3 + F.col("i")) % 50
    text = (
        F.when(k == 0, F.when(F.col("run_id") == "run-1", "Jenis Order : MO").otherwise("Jenis Order : AO (baru)"))
        .when(k == 1, "JENIS ORDER - mutasi layanan")
        .when((k == 2) & (F.col("run_id") == "run-0"), "x Jenis  Order (pilih) DO.")
        .when(k == 3, "jenis order: xy")
        .when(k == 4, "Jenis order")
        .when(k == 5, "JenisOrder: AO lama")
        .otherwise(F.col("text"))
    )
    return ev.lines.withColumn("text", text)


add_duck(
    "oln",
    r"""
    select run_id, page_index, i, raw, case when regexp_matches(raw, '^([A-Za-z]{2,4})\b(.*)$') and regexp_matches(regexp_extract(raw, '^([A-Za-z]{2,4})\b(.*)$', 2), '^[\s:.,;-]*(?:\([^)]*\))?[\s.,;]*$')
             and (upper(pr) in ('AO','MO','DO') or (length(pr) <= 3 and pr = upper(pr))) then upper(pr) else '' end as value
    from (select *, regexp_extract(raw, '^([A-Za-z]{2,4})\b(.*)$', 1) as pr from
      (select run_id, page_index, i, trim(regexp_replace(regexp_extract(text, '(?i)jenis\s*order\s*(?:\([^)]*\))?(.*)$', 1), '^[\s:.\-]+', '')) as raw from
        (select run_id, page_index, i, case when k = 0 then case when run_id = 'run-1' then 'Jenis Order : MO' else 'Jenis Order : AO (baru)' end when k = 1 then 'JENIS ORDER - mutasi layanan'
              when k = 2 and run_id = 'run-0' then 'x Jenis  Order (pilih) DO.' when k = 3 then 'jenis order: xy' when k = 4 then 'Jenis order' when k = 5 then 'JenisOrder: AO lama' else text end as text
         from (select *, (doc_id*3 + i) % 50 as k from lns)) where regexp_matches(text, '(?i)jenis\s*order\s*(?:\([^)]*\))?(.*)$'))) where raw <> ''""",
    ["lns"],
)


@query("v20_order_kind_candidates", duck("select * from oln", "oln"))
def v20(ev: Evidence) -> DataFrame:
    return cit.order_kind_candidates(order_lines(ev))


def order_kinds(ev: Evidence) -> DataFrame:
    runs = ev.runs.select(
        "run_id",
        F.when(F.col("run_id") == "run-2", "  AO   baru ").alias("flag"),
        F.lit(" ").alias("env"),
    )
    return cit.resolve_order_kind(runs, cit.order_kind_candidates(order_lines(ev)))


ORDER_SQL = """
  select run_id, case when run_id = 'run-2' then 'AO baru' when d = 1 then one else '' end as value, case when run_id = 'run-2' then 'flag' when d = 1 then 'documents' when d > 1 then 'conflict' else 'none' end as origin,
         coalesce(c, 0) as candidates from runs left join (select run_id, count(distinct value) filter (where value <> '') as d, max(value) filter (where value <> '') as one, count(*) as c from oln group by all) using (run_id)"""


@query("v21_resolve_order_kind", duck(ORDER_SQL, "runs", "oln"))
def v21(ev: Evidence) -> DataFrame:
    return order_kinds(ev)


@query(
    "v21_outstanding_headers",
    duck(f"select run_id, 'jenisOrder' as key, origin as reason from ({ORDER_SQL}) where value = ''", "runs", "oln"),
)
def v21_out(ev: Evidence) -> DataFrame:
    return cit.outstanding_headers(order_kinds(ev))


# ------------------------------------------------------------------ V8, V9, V24, A12


def discovery_lines(ev: Evidence) -> DataFrame:
    """Lines as offered to discovery."""
    return ev.lines


def section_entries(ev: Evidence) -> DataFrame:
    """About ten headings per source, each broken in one of nine ways or sound."""
    size = F.ceil(F.col("page_count") / 10)
    p = ev.pages.join(ev.sources.select("run_id", "source_id", "pos", "page_count"), ["run_id", "source_id"])
    k = F.floor(F.col("page_in_doc") / size).cast("int")
    g = p.groupBy("run_id", "source_id", "pos", "page_count", k.alias("k")).agg(
        F.min("page_in_doc").alias("a"),
        F.max("page_in_doc").alias("b"),
        F.min_by("page_index", "page_in_doc").alias("page_index"),
    )
    opening = ev.lines.where("i = 0").select(*PAGE, "text")
    g = g.join(opening, PAGE)
    m = (F.col("pos") * 7 + F.col("k")) % 9
    endless = (F.col("pos") % 10 == 9) & (m == 8)
    title = F.when(m == 5, "A heading nobody printed").when(endless, F.repeat(F.lit("x"), 81)).otherwise(F.lower(F.trim(F.substring("text", 1, 30))))
    return g.select(
        "run_id",
        "source_id",
        F.col("k").alias("pos"),
        title.alias("title"),
        F.when(m == 0, F.col("b") + 1).otherwise(F.col("a")).cast("int").alias("from_page"),
        F.when(m == 1, F.col("b") + 1000).when(m == 6, F.col("b") + 1).otherwise(F.col("b")).cast("int").alias("to_page"),
        F.when(m == 2, 1).when(m == 4, 500).otherwise(0).alias("title_from"),
        F.when(m == 3, 6).when(m == 4, 500).when(m == 7, 1).otherwise(0).alias("title_to"),
    )


add_duck("dln", "select * from lns", ["lns"])
add_duck(
    "ent",
    """
    select run_id, source_id, k as pos, case when m = 5 then 'A heading nobody printed' when pos % 10 = 9 and m = 8 then repeat('x', 81) else lower(trim(substr(text,1,30))) end as title, (case when m = 0 then b + 1 else a end)::int as from_page,
           (case when m = 1 then b + 1000 when m = 6 then b + 1 else b end)::int as to_page, (case when m = 2 then 1 when m = 4 then 500 else 0 end)::int as title_from,
           (case when m = 3 then 6 when m = 4 then 500 when m = 7 then 1 else 0 end)::int as title_to
    from (select g.*, l.text, (pos*7 + k) % 9 as m from (select run_id, source_id, pos, (page_in_doc // ceil(page_count/10)::int)::int as k, min(page_in_doc) as a, max(page_in_doc) as b,
             arg_min(page_index, page_in_doc) as page_index from pgs join srcs using (run_id, source_id) group by all) g
          join lns l on l.run_id = g.run_id and l.page_index = g.page_index and l.i = 0)""",
    ["pgs", "srcs", "lns"],
)
add_duck(
    "jdg",
    f"""
    select e.*, p.page_index, case when fault is not null then 'reply-refused-' || fault when from_page > to_page then 'span-reversed' when to_page >= n then 'past-last-page' when bare = from_page then 'first-page-has-no-lines'
             when bare is not null then 'page-in-span-has-no-lines' when title_from > title_to then 'title-lines-reversed' when title_to - title_from + 1 > 4 then 'title-lines-too-wide'
             when coalesce(tc,0) <> title_to - title_from + 1 then 'title-line-missing' when not contains({q_fold('tt')}, {q_fold('title')}) then 'title-not-in-lines' end as reason
    from ent e join (select run_id, source_id, count(*) as n from pgs group by all) using (run_id, source_id)
    left join (select run_id, source_id, case when bool_or(length(title) not between 1 and 80) then 'title-length' when count(*) > 20 then 'too-many-sections' end as fault from ent group by all) rf
         on rf.run_id = e.run_id and rf.source_id = e.source_id
    left join pgs p on p.run_id = e.run_id and p.source_id = e.source_id and p.page_in_doc = e.from_page
    left join (select e2.run_id, e2.source_id, e2.pos, min(p2.page_in_doc) as bare from ent e2 join pgs p2 on p2.run_id = e2.run_id and p2.source_id = e2.source_id and p2.page_in_doc between e2.from_page and e2.to_page
               where not exists (select 1 from dln d where d.run_id = p2.run_id and d.page_index = p2.page_index) group by all) b on b.run_id = e.run_id and b.source_id = e.source_id and b.pos = e.pos
    left join (select e3.run_id, e3.source_id, e3.pos, count(*) as tc, string_agg(l.text, ' ' order by l.i) as tt from ent e3 join pgs p3 on p3.run_id = e3.run_id and p3.source_id = e3.source_id and p3.page_in_doc = e3.from_page
               join dln l on l.run_id = p3.run_id and l.page_index = p3.page_index and l.i between e3.title_from and e3.title_to group by all) t on t.run_id = e.run_id and t.source_id = e.source_id and t.pos = e.pos""",
    ["ent", "pgs", "dln"],
)
add_duck(
    "fin",
    """
    select j.* exclude (reason), coalesce(j.reason, case when o.partner is not null then 'overlaps' end) as reason, case when j.reason is null then o.title end as overlaps_with
    from jdg j left join (select a.run_id, a.source_id, a.pos, max(b.pos) as partner, arg_max(b.title, b.pos) as title from jdg a join jdg b on a.run_id = b.run_id and a.source_id = b.source_id and a.pos <> b.pos
          and a.reason is null and b.reason is null and a.from_page <= b.to_page and b.from_page <= a.to_page group by all) o using (run_id, source_id, pos)""",
    ["jdg"],
)


def judged(ev: Evidence) -> DataFrame:
    return sec.judge_sections(section_entries(ev), ev.pages, discovery_lines(ev))


@query("v8_judge_sections", duck("select * from jdg", "jdg"))
def v8(ev: Evidence) -> DataFrame:
    return judged(ev)


@query("v9_refuse_overlaps", duck("select * from fin", "fin"))
def v9(ev: Evidence) -> DataFrame:
    return sec.refuse_overlaps(judged(ev))


@query(
    "v24_section_pages",
    duck(
        """select f.run_id, f.source_id, f.pos, f.title, p.page_in_doc, p.page_index from fin f join pgs p on p.run_id = f.run_id and p.source_id = f.source_id
           and p.page_in_doc between f.from_page and f.to_page where f.reason is null""",
        "fin",
        "pgs",
    ),
)
def v24(ev: Evidence) -> DataFrame:
    return sec.section_pages(sec.refuse_overlaps(judged(ev)), ev.pages)


@query(
    "a12_section_notes",
    duck(
        """
        select run_id, source_id, pages, sections, refused, case when pages = 0 then 'nothing-to-read' when failed then 'discovery-failed' when sections = 0 and refused = 0 then 'no-heading-found'
               when sections = 0 then 'none-could-be-checked' when refused = 0 then 'all-proposed' else 'some-refused' end as note,
               sections || ' judul proposed across ' || pages || ' page(s); ' || refused || ' refused' as note_text
        from (select s.run_id, s.source_id, coalesce(np,0) as pages, s.pos % 6 = 5 as failed, case when coalesce(np,0) = 0 or s.pos % 6 = 5 then 0 else coalesce(ns,0) end as sections,
                     case when coalesce(np,0) = 0 or s.pos % 6 = 5 then 0 else coalesce(nr,0) end as refused
              from srcs s left join (select run_id, source_id, count(*) as np from opn group by all) using (run_id, source_id)
              left join (select run_id, source_id, count(*) filter (where reason is null) as ns, count(*) filter (where reason is not null) as nr from fin group by all) using (run_id, source_id))""",
        "srcs",
        "opn",
        "fin",
    ),
)
def a12(ev: Evidence) -> DataFrame:
    return sec.section_notes(
        ev.sources,
        pool.open_pages(ev.pages, ev.sources),
        sec.refuse_overlaps(judged(ev)),
        ev.sources.where("pos % 6 = 5"),
    )


# ------------------------------------------------------------------ V13 - V18


def walk_zones(ev: Evidence) -> DataFrame:
    """Zones of captures that may be walked; those of section 0 are whole pages."""
    whole = ev.slots.where("layout = 'images'").select("run_id", "slot_key", F.lit(True).alias("whole_page"))
    z = ev.captures.where("page_index is not null and status in ('proposed', 'confirmed')")
    return z.join(whole, ["run_id", "slot_key"], "left").select(
        "run_id", "key", "slot_key", "page_index", "from_line", "to_line", F.coalesce("whole_page", F.lit(False)).alias("whole_page"), "pos"
    )


add_duck(
    "wzn",
    """select c.run_id, c.key, c.slot_key, c.page_index, c.from_line, c.to_line, coalesce(s.layout = 'images', false) as whole_page, c.pos from cap c left join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key
       where c.page_index is not null and status in ('proposed','confirmed')""",
    ["cap", "slots"],
)
add_duck(
    "ctx",
    """select b.run_id, b.source_id, b.page_index, p.page_in_doc, last_content, last_line, slack, p.page_in_doc < max(p.page_in_doc) over (partition by b.run_id, b.source_id) as has_next
       from bot b join pgs p on p.run_id = b.run_id and p.page_index = b.page_index""",
    ["bot", "pgs"],
)
VERDICT = """case when whole_page then 'whole-page-capture' when not has_next then 'no-next-page' when last_content is null then 'no-content-line'
   when to_line < greatest(0, least(last_content, last_line - slack)) then 'above-last-content' when to_line > last_content then 'past-last-content' else 'at-page-bottom' end"""
add_duck("chk", f"select z.*, {VERDICT} as verdict from wzn z join ctx using (run_id, page_index)", ["wzn", "ctx"])


def context(ev: Evidence) -> DataFrame:
    return con.page_context(ev.lines, ev.pages)


@query(
    "v13_check_for_continuation",
    duck("select run_id, key, page_index, to_line, whole_page, verdict, verdict in ('past-last-content','at-page-bottom') as looks_like_continuation from chk", "chk"),
)
def v13(ev: Evidence) -> DataFrame:
    z = walk_zones(ev).select("run_id", "key", "page_index", "to_line", "whole_page")
    return con.check_zones(z, context(ev))


def continuation_replies(ev: Evidence) -> DataFrame:
    """Up to three replies per zone; some decline, some name lines that are not there."""
    steps = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))
    z = walk_zones(ev).select("run_id", "key", "pos", steps.alias("step"))
    k = F.col("pos") * 5 + F.col("step")
    return z.where((F.col("pos") + F.col("step")) % 8 != 0).select(
        "run_id",
        "key",
        "step",
        (k % 4 != 0).alias("continues"),
        F.when(k % 13 != 0, F.when(k % 11 == 0, 3).otherwise(0)).alias("from_pos"),
        F.when(k % 11 == 0, 1).when(k % 7 == 0, 100000).when(k % 3 == 0, 1000).otherwise(k % 6).cast("int").alias("to_pos"),
        F.lit("high").alias("confidence"),
    ).withColumn("to_pos", F.when(F.col("to_pos") == 1000, 2).otherwise(F.col("to_pos")))


add_duck(
    "crp",
    """select run_id, key, step, k % 4 <> 0 as continues, case when k % 13 <> 0 then case when k % 11 = 0 then 3 else 0 end end::int as from_pos,
              (case when k % 11 = 0 then 1 when k % 7 = 0 then 100000 when k % 3 = 0 then 2 else k % 6 end)::int as to_pos
       from (select run_id, key, pos, step::int as step, pos*5 + step as k from wzn, unnest([1,2,3]) t(step)) where (pos + step) % 8 <> 0""",
    ["wzn"],
)
# Lines are dense, so positions are numbers; footers are cut as in the trim oracle.
add_duck(
    "cfm0",
    """select r.*, q.page_index, q.width, q.height, q.n_lines, row_number() over () as claim_id from crp r join wzn z using (run_id, key) join pgs p on p.run_id = z.run_id and p.page_index = z.page_index
       join pgs q on q.run_id = p.run_id and q.source_id = p.source_id and q.page_in_doc = p.page_in_doc + r.step""",
    ["crp", "pgs"],
)
add_duck(
    "cfm",
    f"""
    with cl as (select run_id, page_index, claim_id, from_pos as from_line, to_pos as c_to from cfm0 where continues and from_pos is not null and to_pos < n_lines and from_pos <= to_pos),
    tr as ({TRIM_SQL})
    select c.run_id, c.key, c.step, c.page_index, case when not continues then 'model-declined' when error is null then 'found' else 'model-error' end as outcome, error,
           case when continues and error is null then from_pos end as from_line,
           case when continues and error is null then case when n >= 4 and typical > 0 and cut is not null and n - cut <= 4 and cut >= 4 then kept_i else to_pos end end::int as to_line
    from (select *, case when not continues then null when from_pos is null then 'null-range' when from_pos > to_pos then 'reversed' when to_pos >= n_lines or from_pos >= n_lines then 'not-on-page' end as error from cfm0) c
    left join tr using (claim_id)""",
    ["cfm0", "lns"],
)


def confirmed(ev: Evidence) -> DataFrame:
    return con.confirm_replies(continuation_replies(ev), walk_zones(ev), ev.lines, ev.pages)


@query("v14_confirm_continuation", duck("select * from cfm", "cfm"))
def v14(ev: Evidence) -> DataFrame:
    return confirmed(ev).select(
        "run_id", "key", "step", "page_index", "outcome", "error", "from_line", "to_line"
    )


add_duck(
    "stp",
    f"""
    select run_id, key, step, page_index as from_page, outcome, case when outcome = 'declined' then verdict end as verdict, case when outcome = 'found' then fp end as found_page,
           case when outcome = 'found' then ff end as found_from, case when outcome = 'found' then ft end as found_to
    from (with recursive walk as (
        select z.run_id, z.key, 1 as step, z.page_index, z.whole_page, {VERDICT} as verdict, c.outcome as reply, c.page_index as fp, c.from_line as ff, c.c_to as ft
        from (select z.*, has_next, last_content, last_line, slack from wzn z join ctx using (run_id, page_index)) z
        left join (select run_id, key, step, outcome, page_index, from_line, to_line as c_to from cfm) c on c.run_id = z.run_id and c.key = z.key and c.step = 1
        union all
        select w.run_id, w.key, w.step + 1, w.page_index, w.whole_page, {VERDICT} as verdict, c.outcome, c.page_index, c.from_line, c.c_to
        from (select run_id, key, step, whole_page, fp as page_index, ft as to_line from walk where verdict in ('past-last-content','at-page-bottom') and reply = 'found' and step <= 12) w
        join ctx using (run_id, page_index) left join (select run_id, key, step, outcome, page_index, from_line, to_line as c_to from cfm) c on c.run_id = w.run_id and c.key = w.key and c.step = w.step + 1)
      select *, case when step > 12 then 'cap' when verdict not in ('past-last-content','at-page-bottom') then 'declined' else coalesce(reply, 'pending') end as outcome from walk)""",
    ["wzn", "ctx", "cfm"],
)


def steps(ev: Evidence) -> DataFrame:
    return con.find_continuations(walk_zones(ev), confirmed(ev), context(ev))


@query("v15_find_continuations", duck("select * from stp", "stp"))
def v15(ev: Evidence) -> DataFrame:
    return steps(ev)


@query(
    "v16_walk_continuations",
    duck(
        """select z.run_id, z.key, case when s.slot_key is not null and p.page_index is not null then coalesce(f,0) else 0 end as found,
                  coalesce(s.slot_key is not null and p.page_index is not null and (o = 'model-declined' or (o = 'declined' and v in ('above-last-content','no-next-page'))), false) as checked,
                  case when s.slot_key is null then 'no-such-slot' when p.page_index is null then 'page-not-supplied' else o end as ended
           from wzn z left join slots s on s.run_id = z.run_id and s.slot_key = z.slot_key left join pgs p on p.run_id = z.run_id and p.page_index = z.page_index
           left join (select run_id, key, count(*) filter (where outcome = 'found') as f, arg_max(outcome, step) as o, arg_max(coalesce(verdict,''), step) as v from stp group by all) e on e.run_id = z.run_id and e.key = z.key""",
        "wzn",
        "slots",
        "stp",
    ),
)
def v16(ev: Evidence) -> DataFrame:
    return con.walk_answers(walk_zones(ev), ev.slots, ev.pages, steps(ev))


@query(
    "v17_outstanding_continuations",
    duck(
        "select c.run_id, c.key, c.page_index, verdict, section_title, label from chk c join slots s on s.run_id = c.run_id and s.slot_key = c.slot_key where verdict in ('past-last-content','at-page-bottom')",
        "chk",
        "slots",
    ),
)
def v17(ev: Evidence) -> DataFrame:
    z = walk_zones(ev).select("run_id", "key", "slot_key", "page_index", "to_line", "whole_page")
    return con.outstanding_continuations(con.check_zones(z, context(ev)), ev.slots).select(
        "run_id", "key", "page_index", "verdict", "section_title", "label"
    )


@query(
    "v18_continuation_hint",
    duck(
        """select c.run_id, c.key, c.page_index, q.page_index as next_page, case when verdict in ('past-last-content','at-page-bottom') then 'runs-on' when verdict = 'above-last-content' then 'stops-short' else 'none' end as hint
           from chk c join pgs p on p.run_id = c.run_id and p.page_index = c.page_index left join pgs q on q.run_id = p.run_id and q.source_id = p.source_id and q.page_in_doc = p.page_in_doc + 1""",
        "chk",
        "pgs",
    ),
)
def v18(ev: Evidence) -> DataFrame:
    z = walk_zones(ev).select("run_id", "key", "page_index", "to_line", "whole_page")
    return con.continuation_hints(con.check_zones(z, context(ev)), ev.pages)
