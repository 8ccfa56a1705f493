"""Usage ledger (L) over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators import ledger as led
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.registry import query

MODELS = ["gemini-3.5-flash", "gemini-3.8-flash", "gemini-3.5-flash-lite", "house-model"]
STAGE_OF = {"click": "ocr", "view": "classify", "purchase": "locate", "signup": "extract", "error": "verify"}


def usage_rows(ev_rows: DataFrame) -> DataFrame:
    """Calls from events; one model has no price, and every third run reads pages by count."""
    stage = F.create_map(*[F.lit(v) for kv in STAGE_OF.items() for v in kv])
    run = (F.col("user_id") % 10).cast("string")
    by_page = (F.col("event_type") == "click") & (F.col("user_id") % 10 % 3 == 0)
    k = F.get_json_object("props", "$.k").cast("bigint")
    tok = lambda m: F.when(by_page, F.lit(0)).otherwise(F.floor(F.col("value") * m)).cast("bigint")
    return ev_rows.select(
        F.concat(F.lit("run-"), run).alias("run_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.try_element_at(stage, "event_type").alias("stage"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 4 + 1).cast("int")).alias("model_id"),
        tok(100).alias("input"),
        tok(10).alias("output"),
        tok(1).alias("thoughts"),
        F.when(by_page, F.lit(0)).otherwise(k * 50).cast("bigint").alias("cached_input"),
        F.when(by_page, F.lit(1)).otherwise(0).cast("bigint").alias("pages"),
        F.when(by_page, F.lit(0.0015)).otherwise(0.0).alias("page_cost_usd"),
        (F.col("user_id") % 10 == 7).alias("batch"),
    )


def usage(ev: Evidence) -> DataFrame:
    return usage_rows(ev.table("events"))


add_duck(
    "usg",
    """
    select 'run-' || (user_id % 10) as run_id, ts, event_id as seq,
           case event_type when 'click' then 'ocr' when 'view' then 'classify' when 'purchase' then 'locate' when 'signup' then 'extract' when 'error' then 'verify' end as stage,
           ['gemini-3.5-flash','gemini-3.8-flash','gemini-3.5-flash-lite','house-model'][user_id % 4 + 1] as model_id,
           (case when bp then 0 else floor(value*100) end)::bigint as input, (case when bp then 0 else floor(value*10) end)::bigint as output,
           (case when bp then 0 else floor(value) end)::bigint as thoughts, (case when bp then 0 else k*50 end)::bigint as cached_input,
           (case when bp then 1 else 0 end)::bigint as pages, case when bp then 0.0015::double else 0 end as page_cost_usd, user_id % 10 = 7 as batch
    from (select *, event_type = 'click' and user_id % 10 % 3 = 0 as bp, cast(json_extract_string(props, '$.k') as bigint) as k from events)""",
    [],
)
add_duck(
    "tly",
    """select run_id, stage, count(*) as calls, sum(input)::bigint as input, sum(output)::bigint as output, sum(thoughts)::bigint as thoughts,
              sum(cached_input)::bigint as cached_input, sum(pages)::bigint as pages, round(sum(page_cost_usd), 9) as page_cost_usd,
              arg_max(model_id, (ts, seq)) as model_id, bool_or(batch) as batch from usg group by all""",
    ["usg"],
)
add_duck(
    "prc",
    """select *, round(case when pages > 0 and input = 0 and output = 0 then page_cost_usd * f
                 else ((input - least(cached_input, input) * 0.9::double) * ip / 1000000 + output * op / 1000000) * f end, 9) as cost_usd
       from (select *, case when batch then 0.5::double else 1.0::double end as f,
                    case model_id when 'gemini-3.5-flash' then 1.5::double when 'gemini-3.8-flash' then 0.75::double when 'gemini-3.5-flash-lite' then 0.3::double end as ip,
                    case model_id when 'gemini-3.5-flash' then 9.0::double when 'gemini-3.8-flash' then 3.75::double when 'gemini-3.5-flash-lite' then 2.5::double end as op from tly)""",
    ["tly"],
)


@query("l1_stage_tallies", duck("select * from tly", "tly"))
def l1(ev: Evidence) -> DataFrame:
    return led.stage_tallies(usage(ev))


@query("l2_priced_tallies", duck("select run_id, stage, model_id, batch, cost_usd from prc", "prc"))
def l2(ev: Evidence) -> DataFrame:
    return led.priced_tallies(usage(ev)).select("run_id", "stage", "model_id", "batch", "cost_usd")


@query(
    "l3_ledger_totals",
    duck(
        """select run_id, round(coalesce(sum(cost_usd), 0), 6) as usd, bool_and(cost_usd is not null) as complete,
                  count(*) filter (where cost_usd is null) as unpriced_stages from prc where calls > 0 group by all""",
        "prc",
    ),
)
def l3(ev: Evidence) -> DataFrame:
    return led.ledger_totals(led.priced_tallies(usage(ev)))


@query(
    "l4_ledger_rows",
    duck(
        """
        select run_id, stage, row_number() over (partition by run_id order by stage = 'TOTAL', raw desc nulls first,
                   list_position(['ocr','classify','sections','locate','extract','verify','continuation','config','epic'], stage))::int as line,
               calls::bigint as calls, input::bigint as input, output::bigint as output, thoughts::bigint as thoughts, cached_input::bigint as cached_input,
               pages::bigint as pages, round(case when stage = 'TOTAL' then coalesce(raw, 0) else raw end, 6) as cost_usd,
               round(case when stage <> 'TOTAL' and total > 0 then raw / total * 100 end, 6) as share_pct, model_id,
               case when stage = 'TOTAL' then unpriced = 0 end as complete,
               case when stage = 'TOTAL' and input > 0 then round(cached_input / input * 100, 6) end as cached_pct
        from (select *, coalesce(max(case when stage = 'TOTAL' then raw end) over (partition by run_id), 0) as total from
             (select run_id, coalesce(stage, 'TOTAL') as stage, sum(calls) as calls, sum(input) as input, sum(output) as output, sum(thoughts) as thoughts,
                     sum(cached_input) as cached_input, sum(pages) as pages, sum(cost_usd) as raw, count(*) filter (where cost_usd is null) as unpriced,
                     case when grouping(stage) = 0 then any_value(model_id) end as model_id
              from prc where calls > 0 group by grouping sets ((run_id, stage), (run_id))))""",
        "prc",
    ),
)
def l4(ev: Evidence) -> DataFrame:
    return led.ledger_rows(led.priced_tallies(usage(ev)))


@query(
    "l5_ledger_cross_check",
    duck(
        """select run_id, 'calls' as counter, n::bigint as by_stage, (n + 1)::bigint as total from (select run_id, count(*) as n from usg group by all)""",
        "usg",
    ),
)
def l5(ev: Evidence) -> DataFrame:
    """Flat totals counted apart, with one call too many."""
    u = usage(ev)
    c = led.COUNTERS
    sums = u.groupBy("run_id").agg(
        (F.count(F.lit(1)) + 1).alias("calls"), *[F.sum(x).alias(x) for x in c[1:]]
    )
    pairs = ", ".join(f"'{x}', {x}" for x in c)
    flat = sums.selectExpr("run_id", f"stack({len(c)}, {pairs}) as (counter, total)")
    return led.ledger_cross_check(u, flat)
