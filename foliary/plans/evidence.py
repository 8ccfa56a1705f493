"""Evidence tables derived from the analytics tables, on both engines.

``Evidence`` builds each table as a lazy DataFrame; ``duck`` gives the same table as a chain of
common table expressions for the oracle engine.  Both use whole tables and whole texts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import is_blank, key_bucket, number_rows
from foliary.operators.numbering import page_in_source
from foliary.session import kept

# Footers start after a wide gap on every fourth page, so that running footers can be trimmed.
FOOTER_GAP = 700

# Characters of page texts that one task takes: their words, with all that is worked out of them, fit its memory several times.
TASK_CHARS = 4_000_000

DOC_TYPES = {"en": "KB", "fr": "SP", "de": "BAPermintaan", "es": "Email"}


def line_top(i: Column, n_lines: Column, doc_id: Column) -> Column:
    """Where line ``i`` of a page stands."""
    gap = F.when((i >= n_lines - 2) & (doc_id % 4 == 0), FOOTER_GAP)
    return F.lit(40.0) + i * 40 + F.coalesce(gap, F.lit(0))


class Evidence:
    """Lazy evidence tables over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
        types = F.create_map(*[F.lit(v) for kv in DOC_TYPES.items() for v in kv])
        return self.table("documents").select(
            F.concat(F.lit("run-"), (number % 4).cast("string")).alias("run_id"),
            F.col("source").alias("source_id"),
            number.alias("pos"),
            "doc_id",
            "lang",
            F.try_element_at(types, "lang").alias("doc_type"),
            "text",
        )

    @cached_property
    def _counted(self) -> DataFrame:
        """Sources with their page count and the run-global number of their first page."""
        g = self.documents.groupBy("run_id", "source_id").agg(
            F.first("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("page_count")
        )
        before = W.partitionBy("run_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
        return g.withColumn("first_page", F.coalesce(F.sum("page_count").over(before), F.lit(0)))

    @cached_property
    def sources(self) -> DataFrame:
        return self._counted.select(
            "run_id",
            "source_id",
            "pos",
            F.concat(F.lit("Berkas "), F.col("source_id"), F.lit(".pdf")).alias("name"),
            "page_count",
            (~F.col("source_id").like("%7")).alias("ai"),
        )

    @cached_property
    def _numbered(self) -> DataFrame:
        """Documents as pages: keys and counts, written once, as most plans read them in several branches."""
        n_lines = (F.size(F.split("text", "\n")) + 2).cast("int").alias("n_lines")
        base = self.documents.select("run_id", "source_id", "doc_id", "doc_type", n_lines, F.length("text").alias("chars"))
        ends = self._counted.select("run_id", "source_id", "page_count", "first_page")
        return kept(
            page_in_source(base, "doc_id")
            .join(ends, ["run_id", "source_id"])
            .withColumn("page_index", (F.col("first_page") + F.col("page_in_doc")).cast("int"))
        )

    @cached_property
    def pages(self) -> DataFrame:
        """One page per document: keys, size, number of lines."""
        return self._numbered.select(
            "run_id",
            "page_index",
            "source_id",
            "page_in_doc",
            "doc_id",
            "doc_type",
            "n_lines",
            F.lit(2480).alias("width"),
            F.greatest(F.lit(3508), F.col("n_lines") * 40 + 40 + FOOTER_GAP + 40).alias("height"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        """The pages' lines as arrays, dealt by page before they are cut: lines and words of a page never move again.

        The number of partitions is stated, as one sized by the texts would be far too large for the words made of them: it grows
        with the texts, as a window over a page finds no memory beside a sort that holds all of its task's.
        """
        footer = F.array(
            F.concat(
                F.lit("Page "),
                (F.col("page_in_doc") + 1).cast("string"),
                F.lit(" of "),
                F.col("page_count").cast("string"),
            ),
            F.concat(F.lit("Ref "), F.col("source_id")),
        )
        texts = self.documents.select("run_id", "source_id", "doc_id", "text")
        chars = self._numbered.agg(F.sum("chars")).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
        dealt = self._numbered.drop("chars").join(texts, ["run_id", "source_id", "doc_id"]).repartition(parts, "run_id", "page_index")
        return dealt.select(
            "run_id",
            "page_index",
            "source_id",
            "page_in_doc",
            "doc_id",
            "n_lines",
            F.concat(F.split("text", "\n"), footer).alias("texts"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        rows = self.texts.select(
            "run_id",
            "page_index",
            "source_id",
            "page_in_doc",
            "doc_id",
            "n_lines",
            F.posexplode("texts").alias("i", "text"),
        )
        return rows.select(
            "run_id",
            "page_index",
            "source_id",
            "page_in_doc",
            "doc_id",
            "i",
            "text",
            F.lit(40.0).alias("x"),
            line_top(F.col("i"), F.col("n_lines"), F.col("doc_id")).alias("y"),
            F.greatest(F.lit(8.0), F.least(F.lit(2400.0), F.length("text") * 8.0)).alias("w"),
            F.lit(24.0).alias("h"),
            F.when((F.col("doc_id") + F.col("i")) % 3 == 0, "interpolated")
            .otherwise("measured")
            .alias("origin"),
        )

    @cached_property
    def words(self) -> DataFrame:
        """Tokens of every line; y wobbles by up to two pixels."""
        toks = self.lines.select(
            "run_id", "page_index", "i", "y", F.posexplode(F.split("text", " ")).alias("k", "text")
        ).where(~is_blank("text"))
        return toks.select(
            "run_id",
            "page_index",
            (F.col("i") * 100000 + F.col("k")).cast("int").alias("seq"),
            "text",
            (F.lit(40.0) + F.col("k") * 90).alias("x"),
            (F.col("y") + F.col("k") % 3).alias("y"),
            (F.length("text") * 8.0).alias("w"),
            F.lit(24.0).alias("h"),
        )

    @cached_property
    def claims(self) -> DataFrame:
        """One cited range per page, with missing, reversed, unknown and over-long ones."""
        d, n = F.col("doc_id"), F.col("n_lines")
        frm = (d % n).cast("int")
        to = (
            F.when(d % 11 == 0, frm - 1)
            .when(d % 17 == 0, F.lit(None))
            .otherwise(frm + (d % 5))
            .cast("int")
        )
        page = F.when(d % 13 == 0, F.col("page_index") + 1_000_000).when(
            d % 19 == 0, F.lit(None)
        ).otherwise(F.col("page_index")).cast("int")
        return self.pages.select(
            "run_id",
            F.col("doc_id").alias("claim_id"),
            page.alias("page_index"),
            F.when(d % 19 == 0, F.lit(None)).otherwise(frm).cast("int").alias("from_line"),
            F.when(d % 19 == 0, F.lit(None)).otherwise(to).cast("int").alias("to_line"),
        )


    # ------------------------------------------------------------------ form and captures

    @cached_property
    def runs(self) -> DataFrame:
        """Runs with the form they use."""
        r = self.documents.select("run_id").distinct()
        even = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int") % 2 == 0
        return r.withColumn("form_id", F.when(even, "A").otherwise("B"))

    @cached_property
    def form_slots(self) -> DataFrame:
        """Two forms of a slot per nation, in a section per region."""
        n = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        k = F.col("n_nationkey")
        types = F.array(*[F.lit(t) for t in DOC_TYPES.values()])
        return n.select(
            F.explode(F.array(F.lit("A"), F.lit("B"))).alias("form_id"),
            F.concat(F.lit("sec-"), F.col("n_regionkey").cast("string")).alias("section_id"),
            F.col("r_name").alias("section_title"),
            F.when(F.col("n_regionkey") == 0, "images").otherwise("table").alias("layout"),
            F.concat(F.lit("slot-"), k.cast("string")).alias("slot_key"),
            F.col("n_name").alias("label"),
            (k % 6 != 5).alias("fillable"),
            F.when(k % 7 != 6, F.element_at(types, (k % 4 + 1).cast("int"))).alias("doc_type"),
            F.when(F.col("n_regionkey") == 0, F.floor(k / 5).cast("int")).alias("page_ordinal"),
            (F.col("n_regionkey") * 100 + k).cast("int").alias("pos"),
            (F.col("n_regionkey") == 4).alias("added"),
        )

    @cached_property
    def slots(self) -> DataFrame:
        """The form's slots per run."""
        return self.runs.join(self.form_slots, "form_id")

    @cached_property
    def captures(self) -> DataFrame:
        """One capture per page; slots 25 and 26 are in no form, some zones name a lost page."""
        d, n = F.col("doc_id"), F.col("n_lines")
        slot = F.concat(F.lit("slot-"), (F.col("page_in_doc") % 27).cast("string"))
        base = self.pages.withColumn("slot_key", slot)
        numbered = number_rows(
            base, ["run_id", "slot_key"], ["page_index"], key_bucket("page_index"), "ordinal", start=1
        )
        status = F.element_at(
            F.array(*[F.lit(v) for v in STATUSES]), (d % len(STATUSES) + 1).cast("int")
        )
        zoned = (d % 7 != 3) & (d % 7 != 5)
        frm = (d % n).cast("int")
        to = F.least(n - 1, frm + d % 6).cast("int")
        page = (F.col("page_index") + F.when(d % 29 == 0, 1_000_000).otherwise(0)).cast("int")
        key = F.when(F.col("ordinal") <= 1, F.col("slot_key")).otherwise(
            F.concat("slot_key", F.lit("#"), F.col("ordinal").cast("string"))
        )
        stamp = F.concat(page.cast("string"), F.lit(":"), frm.cast("string"), F.lit("-"), to.cast("string"))
        return numbered.select(
            "run_id",
            key.alias("key"),
            "slot_key",
            "ordinal",
            F.col("page_index").alias("pos"),
            status.alias("status"),
            F.when(zoned, page).alias("page_index"),
            F.when(zoned, frm).alias("from_line"),
            F.when(zoned, to).alias("to_line"),
            F.when(d % 2 == 0, "llm").otherwise("human").alias("origin"),
            F.when(zoned & (d % 3 == 0), stamp).when(d % 3 == 1, F.lit("0:0-0")).alias("checked_for"),
        )


# The capture states, in the order the evidence cycles through them.
STATUSES = ["confirmed", "confirmed", "proposed", "outstanding", "confirmed", "pending", "unfilled"]


# ---------------------------------------------------------------------------- oracle side

DUCK: dict[str, str] = {
    "docs": """
      select 'run-' || (cast(regexp_extract(source,'([0-9]+)$',1) as int) % 4) as run_id,
             source as source_id, cast(regexp_extract(source,'([0-9]+)$',1) as int) as pos,
             doc_id, lang, text,
             case lang when 'en' then 'KB' when 'fr' then 'SP' when 'de' then 'BAPermintaan'
                       when 'es' then 'Email' end as doc_type
      from documents""",
    "srcs": """
      select run_id, source_id, min(pos) as pos, 'Berkas ' || source_id || '.pdf' as name,
             cast(count(*) as int) as page_count, source_id not like '%7' as ai
      from docs group by run_id, source_id""",
    "pgs": """
      select run_id, cast(row_number() over (partition by run_id order by pos, doc_id) - 1 as int) as page_index,
             source_id, cast(row_number() over (partition by source_id order by doc_id) - 1 as int) as page_in_doc,
             doc_id, doc_type, cast(len(string_split(text, chr(10))) + 2 as int) as n_lines, 2480 as width,
             cast(greatest(3508, (len(string_split(text, chr(10))) + 2)*40 + 780) as int) as height
      from docs""",
    "lns0": """
      select p.run_id, p.page_index, p.source_id, p.page_in_doc, p.doc_id, p.n_lines,
             list_concat(string_split(d.text, chr(10)),
               ['Page ' || (p.page_in_doc+1) || ' of ' || s.page_count, 'Ref ' || p.source_id]) as all_lines
      from pgs p join docs d using (doc_id) join srcs s on s.run_id=p.run_id and s.source_id=p.source_id""",
    "lns1": """
      select run_id, page_index, source_id, page_in_doc, doc_id, n_lines,
             unnest(all_lines) as text, cast(unnest(range(len(all_lines))) as int) as i
      from lns0""",
    "lns": """
      select run_id, page_index, source_id, page_in_doc, doc_id, i, text, 40.0::double as x,
             (40 + i*40 + case when i >= n_lines-2 and doc_id % 4 = 0 then 700 else 0 end)::double as y,
             greatest(8.0::double, least(2400.0::double, length(text)*8.0::double)) as w, 24.0::double as h,
             case when (doc_id + i) % 3 = 0 then 'interpolated' else 'measured' end as origin
      from lns1""",
    "wds0": """
      select run_id, page_index, i, y, unnest(string_split(text,' ')) as text,
             cast(unnest(range(len(string_split(text,' ')))) as int) as k
      from lns""",
    "wds": r"""
      select run_id, page_index, cast(i*100000 + k as int) as seq, text, (40 + k*90)::double as x,
             (y + k % 3)::double as y, length(text)*8.0::double as w, 24.0::double as h
      from wds0 where regexp_replace(text,'\s','','g') <> ''""",
    "clm": """
      select run_id, doc_id as claim_id,
             cast(case when doc_id % 13 = 0 then page_index + 1000000 when doc_id % 19 = 0 then null
                       else page_index end as int) as page_index,
             cast(case when doc_id % 19 = 0 then null else doc_id % n_lines end as int) as from_line,
             cast(case when doc_id % 19 = 0 then null when doc_id % 11 = 0 then doc_id % n_lines - 1
                       when doc_id % 17 = 0 then null else doc_id % n_lines + doc_id % 5 end as int) as to_line
      from pgs""",
    "runs": """
      select distinct run_id, case when cast(regexp_extract(run_id,'([0-9]+)$',1) as int) % 2 = 0 then 'A' else 'B' end as form_id from docs""",
    "fsl": """
      select form_id, 'sec-' || n_regionkey as section_id, r_name as section_title, case when n_regionkey = 0 then 'images' else 'table' end as layout,
             'slot-' || n_nationkey as slot_key, n_name as label, n_nationkey % 6 <> 5 as fillable,
             case when n_nationkey % 7 <> 6 then ['KB','SP','BAPermintaan','Email'][n_nationkey % 4 + 1] end as doc_type,
             case when n_regionkey = 0 then n_nationkey // 5 end as page_ordinal, (n_regionkey*100 + n_nationkey)::int as pos, n_regionkey = 4 as added
      from nation join region on n_regionkey = r_regionkey, unnest(['A','B']) t(form_id)""",
    "slots": "select * from runs join fsl using (form_id)",
    "cap": """
      select run_id, case when ordinal <= 1 then slot_key else slot_key || '#' || ordinal end as key, slot_key, ordinal, page_index as pos, status,
             case when zoned then zp end as page_index, case when zoned then f end as from_line, case when zoned then t end as to_line,
             case when doc_id % 2 = 0 then 'llm' else 'human' end as origin,
             case when zoned and doc_id % 3 = 0 then zp || ':' || f || '-' || t when doc_id % 3 = 1 then '0:0-0' end as checked_for
      from (select *, (row_number() over (partition by run_id, slot_key order by page_index))::int as ordinal,
                   ['confirmed','confirmed','proposed','outstanding','confirmed','pending','unfilled'][doc_id % 7 + 1] as status,
                   doc_id % 7 <> 3 and doc_id % 7 <> 5 as zoned, (page_index + case when doc_id % 29 = 0 then 1000000 else 0 end)::int as zp,
                   (doc_id % n_lines)::int as f, least(n_lines - 1, doc_id % n_lines + doc_id % 6)::int as t
            from (select *, 'slot-' || (page_in_doc % 27) as slot_key from pgs))""",
}

DEPS: dict[str, list[str]] = {
    "docs": [],
    "srcs": ["docs"],
    "pgs": ["docs"],
    "lns0": ["pgs", "docs", "srcs"],
    "lns1": ["lns0"],
    "lns": ["lns1"],
    "wds0": ["lns"],
    "wds": ["wds0"],
    "clm": ["pgs"],
    "runs": ["docs"],
    "fsl": [],
    "slots": ["runs", "fsl"],
    "cap": ["pgs"],
}


def add_duck(name: str, sql: str, deps: list[str]) -> None:
    DUCK[name], DEPS[name] = sql, deps


def duck(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named tables (and what they need), then ``extra`` in order, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} as ({DUCK[n]})" for n in order] + [f"{n} as ({s})" for n, s in extra.items()]
    return "with recursive " + ",\n".join(parts) + "\n" + body if parts else body
