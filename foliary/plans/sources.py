"""Sources (S, J): annotations, block replies, cells, transcripts, names and digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.core import NO_SPACE_CLASS, PAGE
from foliary.functions.cells import format_ref
from foliary.plans.evidence import FOOTER_GAP, Evidence, add_duck, duck
from foliary.plans.registry import query
from foliary.plans.text import q_plain, q_serial
from foliary.session import work_folder
from foliary.sources import annotations as ann
from foliary.sources import blocks as blk
from foliary.sources import replies as rep
from foliary.sources import transcripts as tra
from foliary.sources import workbook as wb
from foliary.sources.annotation_text import joined, pieces, places, sizes_of

# ------------------------------------------------------------------ annotations


# What JSON must not hold as it is, and what it holds instead.
ESCAPED = {i: f"\\u{i:04X}" for i in range(32)} | {ord(c): "\\" + to for c, to in zip('"\\\b\f\n\r\t', '"\\bfnrt')}
# Fixed value: how much text is written out at a time; an annotation is some forty times as long as its text.
TEXT_BYTES = 1 << 18


def _numbers(values: np.ndarray) -> pa.Array:
    """Whole doubles as the JVM writes them."""
    texts = pc.binary_join_element_wise(pc.cast(pa.array(values.astype(np.int64)), pa.string()), "0", ".")
    if len(values) and values.max() >= 1e7:  # 1.234E7
        digits = [str(int(v)) for v in values]
        texts = pa.array([t if len(d) < 8 else f"{d[0]}.{d[1:].rstrip('0') or '0'}E{len(d) - 1}" for d, t in zip(digits, texts.to_pylist())], pa.string())
    return texts


def _annotations(pages: pa.Array, n_lines: pa.Array, doc_id: pa.Array) -> pa.Array:
    each, _ = places(sizes_of(pages))
    lists = pages.flatten()
    row, i = places(sizes_of(lists))
    row, cut = each[row], pc.split_pattern(lists.flatten(), " ")
    line, k = places(sizes_of(cut))
    text = cut.flatten()
    filled = pc.match_substring_regex(text, NO_SPACE_CLASS)
    text, filled = text.filter(filled), filled.to_numpy(zero_copy_only=False)
    row, i, k = row[line][filled], i[line][filled], k[filled]
    if len(lists) > len(pages):  # several texts of one page: its words by place, then text
        order = np.lexsort((pc.rank(text).to_numpy(), k, i, row))
        row, i, k, text = row[order], i[order], k[order], text.take(pa.array(order))

    n = pc.fill_null(pc.cast(n_lines, pa.int64()), 1 << 40).to_numpy(zero_copy_only=False)
    gapped = pc.fill_null(pc.equal(pc.bit_wise_and(doc_id, 3), 0), False).to_numpy(zero_copy_only=False)
    top = 40.0 + i * 40 + np.where((i >= n[row] - 2) & gapped[row], FOOTER_GAP, 0)
    x, y = 40.0 + k * 90, top + k % 3
    first, rest = pc.utf8_slice_codeunits(text, 0, 1), pc.utf8_slice_codeunits(text, 1, 1_000_001)
    odd = pc.match_substring_regex(text, r'["\\\x00-\x1F]')
    if pc.any(odd).as_py():
        escape = lambda t: pc.replace_with_mask(t, odd, pa.array([v.translate(ESCAPED) for v in t.filter(odd).to_pylist()], pa.string()))
        first, rest = escape(first), escape(rest)
    kind = np.where(k % 4 == 3, 0, np.where(k % 11 == 5, 1, 2))
    kinds = pa.array(["", '"type":"UNKNOWN"', '"type":"SPACE"'])
    of = lambda some: kinds.take(pa.array(np.where(some, kind, 0)))
    xs, ys = _numbers(x), _numbers(y)
    near = pc.if_else(pa.array(k % 13 != 0), pc.binary_join_element_wise('"x":', xs, ',"y":', ys, ""), pc.binary_join_element_wise('"y":', ys, ""))
    right = _numbers(x + pc.utf8_length(text).to_numpy() * 8.0)
    far = pc.if_else(pa.array(k % 17 == 0), "", pc.binary_join_element_wise('},{"x":', right, ',"y":', _numbers(y + 24.0), ""))
    words = pc.binary_join_element_wise(
        '{"symbols":[{"text":"', first, '","property":{"detectedBreak":{}}},{"text":"', rest, '","property":{"detectedBreak":{', of(k % 2 == 0),
        '}}}],"property":{"detectedBreak":{', of(k % 2 == 1), '}},"boundingBox":{"vertices":[{', near, far, "}]}}", "",
    )

    def within(before: str, items: pa.Array, keys: list[np.ndarray], after: str) -> tuple[pa.Array, np.ndarray]:
        """The items of each run of equal keys, between brackets; and where the runs start."""
        starts = np.flatnonzero(np.any([np.diff(key, prepend=-1) != 0 for key in keys], axis=0))
        return pc.binary_join_element_wise(before, joined(items, np.diff(starts, append=len(items)), ","), after, ""), starts

    paragraphs, at = within('{"words":[', words, [row, i], "]}")
    row, i = row[at], i[at]
    blocks, at = within('{"paragraphs":[', paragraphs, [row, i // 2], "]}")
    whole = joined(blocks, np.bincount(row[at], minlength=len(pages)), ",")
    return pc.binary_join_element_wise('{"fullTextAnnotation":{"pages":[{"blocks":[', whole, "]}]}}", "")


@F.arrow_udf(T.StringType())
def annotation_text(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, n_lines, doc_id, size in batches:
        for part in pieces(size.to_numpy(zero_copy_only=False), TEXT_BYTES):
            yield _annotations(pages[part], n_lines[part], doc_id[part])


def annotation_pages(ev: Evidence) -> DataFrame:
    """One nested annotation per page: a block per two lines, a paragraph per line, and words of
    two symbols with breaks, missing corners and empty boxes.

    An annotation is built inside the page's row, in batches of pages: no word is a row of its own before it is read."""
    # a page has one text, unless its document's id repeats
    rows = ev.texts.groupBy(*PAGE, "n_lines", "doc_id").agg(F.collect_list("texts").alias("pages")).where("size(pages) > 0")
    size = F.aggregate("pages", F.lit(0), lambda n, t: n + F.coalesce(F.length(F.array_join(t, " ")), F.lit(0)))
    return rows.select(*PAGE, annotation_text("pages", "n_lines", "doc_id", size).alias("annotation"))


add_duck(
    "anw",
    """
    select run_id, page_index, seq, seq // 100000 as i, seq % 100000 as k, text,
           (dense_rank() over (partition by run_id, page_index order by (seq // 100000) // 2) - 1)::int as block_index,
           case when (seq % 100000) % 17 = 0 then null when (seq % 100000) % 13 = 0 then 0.0::double else x end as bx0,
           case when (seq % 100000) % 13 = 0 then x + w else w end as bw0, y, h,
           not ((seq % 100000) % 4 = 3 or (seq % 100000) % 11 = 5) as ends
    from wds""",
    ["wds"],
)

# Joined when the usable word before it carries no break, on the same line (same block and
# overlapping rows).
add_duck(
    "glu",
    """
    select *, sum(case when pe is null or pe or pi <> i then 1 else 0 end) over (partition by run_id, page_index order by seq) - 1 as g
    from (select *, lag(ends) over (partition by run_id, page_index order by seq) as pe, lag(i) over (partition by run_id, page_index order by seq) as pi
          from anw where bx0 is not null)""",
    ["anw"],
)


@query(
    "s1_words_from_annotations",
    duck(
        """select run_id, page_index, g::int as seq, string_agg(text, '' order by seq) as text, min(block_index) as block_index,
                  min(bx0) as x, min(y) as y, max(bx0+bw0)-min(bx0) as w, max(y+h)-min(y) as h from glu group by run_id, page_index, g""",
        "glu",
    ),
)
def s1(ev: Evidence) -> DataFrame:
    return ann.words_from_annotations(annotation_pages(ev))


@query(
    "s2_ends_token",
    duck("select run_id, page_index, ends, count(*) as n from anw group by all", "anw"),
)
def s2(ev: Evidence) -> DataFrame:
    w = ann.annotation_words(annotation_pages(ev), parts=("ends",))
    return w.groupBy(*PAGE, "ends").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_box_from_vertices",
    duck(
        """select run_id, page_index, k, block_index, case when bx0 is not null then bx0 end as x, case when bx0 is not null then y end as y,
                  case when bx0 is not null then bw0 end as w, case when bx0 is not null then h end as h from anw""",
        "anw",
    ),
)
def s3(ev: Evidence) -> DataFrame:
    return ann.annotation_words(annotation_pages(ev), parts=("box",)).select(*PAGE, "k", "block_index", "box.*")


@query(
    "s4_annotated_page_report",
    duck(
        """
        select p.run_id, p.page_index, count(distinct l.i)::int as lines, sum(l.segs)::bigint as segments, sum(l.dropped)::bigint as dropped,
               count(distinct l.i // 2)::int as blocks
        from pgs p join (select run_id, page_index, i, count(distinct g) filter (where g is not null) as segs, count(*) filter (where bx0 is null) as dropped
                         from (select anw.*, glu.g from anw left join glu using (run_id, page_index, seq)) group by all) l using (run_id, page_index)
        where l.segs > 0 or l.dropped > 0
        group by p.run_id, p.page_index""",
        "pgs",
        "glu",
    ).replace("count(distinct l.i)::int as lines", "count(distinct case when segs > 0 then l.i end)::int as lines"),
)
def s4(ev: Evidence) -> DataFrame:
    r = ann.annotated_page_report(annotation_pages(ev), ev.pages)
    return r.select(*PAGE, "lines", "segments", "dropped", "blocks")


# ------------------------------------------------------------------ block replies


def block_replies(ev: Evidence) -> DataFrame:
    """One fenced reply per page: two printed lines per block, boxes on the 0-1000 grid, some bad."""
    i, d = F.col("i"), F.col("doc_id")
    two = F.floor(i / 2).cast("int")
    g = (
        ev.lines.groupBy(*PAGE, "doc_id", two.alias("b"))
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda t: t["text"]), "\n"
            ).alias("text"),
            F.count(F.lit(1)).alias("n"),
        )
        .join(ev.pages.select(*PAGE, "width", "height"), PAGE)
    )
    b = F.col("b")
    bad = (d + b) % 23 == 0
    top = (b * 997 % 900).cast("int")
    box = F.when(bad, F.array(F.lit(500), F.lit(100), F.lit(400), F.lit(900))).otherwise(
        F.array(top, F.lit(20), top + 30, F.lit(20) + (d % 900).cast("int") + 30)
    )
    entry = F.struct(
        box.alias("box_2d"),
        F.when(b % 3 == 0, F.col("text")).alias("text"),
        F.when(b % 3 == 1, F.col("text")).alias("text_content"),
        F.when(b % 3 == 2, F.col("text")).alias("label"),
    )
    pages = g.groupBy(*PAGE, "width", "height").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("b", entry.alias("e")))), lambda z: z["e"]
        ).alias("lines")
    )
    body = F.to_json(F.struct("lines"))
    return pages.select(
        *PAGE,
        "width",
        "height",
        F.when(
            F.col("page_index") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))
        )
        .otherwise(body)
        .alias("reply"),
    )


add_duck(
    "blk",
    """
    select run_id, page_index, b, n, (doc_id + b) % 23 = 0 as bad, width, height,
           floor(greatest(0, least(20/1000.0::double*width, width)) + 0.5) as lft,
           floor(least((50 + doc_id % 900)/1000.0::double*width, width) + 0.5) as rgt,
           floor((b*997 % 900)/1000.0::double*height + 0.5) as top, floor((b*997 % 900 + 30)/1000.0::double*height + 0.5) as bot
    from (select run_id, page_index, doc_id, i // 2 as b, count(*) as n from lns group by all) join pgs using (run_id, page_index, doc_id)""",
    ["lns", "pgs"],
)


@query(
    "s5_lines_from_blocks_report",
    duck(
        """select run_id, page_index, count(*)::int as entries, (count(*) filter (where bad))::int as dropped,
                  count(*) filter (where bad) > greatest(3.0::double, count(*)*0.05::double) as refused from blk group by all""",
        "blk",
    ),
)
def s5(ev: Evidence) -> DataFrame:
    return blk.block_report(block_replies(ev))


@query("s5_lines_from_blocks")
def s5_lines(ev: Evidence) -> DataFrame:
    return blk.lines_from_blocks(block_replies(ev))


@query(
    "s6_convert_box",
    duck(
        """select run_id, page_index, b::int as pos, case when not bad then lft end as x, case when not bad then top end as y,
                  case when not bad then rgt - lft end as w, case when not bad then bot - top end as h from blk""",
        "blk",
    ),
)
def s6(ev: Evidence) -> DataFrame:
    return blk.block_entries(block_replies(ev)).select(*PAGE, "pos", "box.*")


@query(
    "s7_bands",
    duck(
        """select run_id, page_index, b::int as pos, k::int as k, lft as x, top + floor((bot-top)*k/n + 0.5) as y, rgt - lft as w,
                  (case when k = n-1 then bot else top + floor((bot-top)*(k+1)/n + 0.5) end) - (top + floor((bot-top)*k/n + 0.5)) as h
           from blk, unnest(range(n)) t(k) where not bad""",
        "blk",
    ),
)
def s7(ev: Evidence) -> DataFrame:
    e = blk.block_entries(block_replies(ev)).where("n > 0 and box is not null")
    return e.select(*PAGE, "pos", F.posexplode(blk.bands_for(F.col("box"), F.col("n"))).alias("k", "band")).select(
        *PAGE, "pos", "k", "band.*"
    )


@query(
    "s8_printed_segments",
    """
    select doc_id, case when n = 0 then 0 else l - f + 1 end::int as segments
    from (select doc_id, len(filled) as n, list_min(filled) as f, list_max(filled) as l from
       (select doc_id, list_filter(range(1, len(parts)+1), lambda k: trim(parts[k]) <> '') as filled from
          (select doc_id, string_split(case doc_id % 3 when 0 then chr(10) || chr(10) || replace(text, '.', '.' || chr(10) || ' ') || chr(10) when 1 then ' ' || chr(10) else text end, chr(10)) as parts from documents)))
    """,
)
def s8(ev: Evidence) -> DataFrame:
    d = F.col("doc_id")
    text = (
        F.when(d % 3 == 0, F.concat(F.lit("\n\n"), F.regexp_replace("text", r"\.", ".\n "), F.lit("\n")))
        .when(d % 3 == 1, " \n")
        .otherwise(F.col("text"))
    )
    return ev.table("documents").select("doc_id", F.size(blk.printed_segments(text)).alias("segments"))


@query(
    "s9_repair_doubled_keys",
    """select p_partkey, '{"lines":[{"label":"' || p_name || '","text":"' || p_brand || '"}]}' as repaired from part""",
)
def s9(ev: Evidence) -> DataFrame:
    raw = F.concat(
        F.lit('{"lines":[{"label": "label":"'), "p_name", F.lit('","text":"'), "p_brand", F.lit('"}]}')
    )
    return ev.table("part").select("p_partkey", rep.repair_doubled_keys(raw).alias("repaired"))


@query(
    "j1_extract_json",
    """select p_partkey, case when p_partkey % 4 = 3 then null else '{"name":"' || p_name || '","n":{"size":' || p_size || '}}' end as body,
              case when p_partkey % 4 = 3 then null else p_size end as size, case when p_partkey % 4 = 3 then 'no-json-object' end as error from part""",
)
def j1(ev: Evidence) -> DataFrame:
    k = F.col("p_partkey") % 4
    obj = F.concat(
        F.lit('{"name":"'), "p_name", F.lit('","n":{"size":'), F.col("p_size").cast("string"), F.lit("}}")
    )
    reply = (
        F.when(k == 0, obj)
        .when(k == 1, F.concat(F.lit("Sure {x}\n```json\n"), obj, F.lit("\n```\n{y}")))
        .when(k == 2, F.concat(F.lit("Answer: "), obj, F.lit(" -- done")))
        .otherwise(F.lit("I cannot tell."))
    )
    rows = ev.table("part").select("p_partkey", reply.alias("reply"))
    return rep.parse_replies(rows, "name string, n struct<size: int>").select(
        "p_partkey",
        rep.extract_json("reply").alias("body"),
        F.col("parsed.n.size").alias("size"),
        "error",
    )


# ------------------------------------------------------------------ cells


def cells_raw(ev: Evidence) -> DataFrame:
    """A raw cell per order: eight sheets of a book per 1,000 customers, every cell type."""
    k = F.col("o_orderkey")
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))
    t = (
        F.when(k % 8 == 0, "s")
        .when(k % 8 == 1, "inlineStr")
        .when(k % 8 == 2, "str")
        .when(k % 8 == 3, "b")
        .when(k % 8 == 4, "e")
    )
    v = (
        F.when(k % 8 == 0, (k % 40).cast("string"))
        .when(k % 8 == 2, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")))
        .when(k % 8 == 3, F.when(k % 16 == 3, "1").otherwise("0"))
        .when(k % 8 == 4, F.when(k % 3 == 0, "#N/A").otherwise(""))
        .when(k % 8 == 5, serial.cast("string"))
        .when(k % 8 == 6, F.concat(F.lit("0."), F.lpad((k % 100).cast("string"), 2, "0")))
        .when(k % 8 == 7, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("0")))
    )
    return ev.table("orders").select(
        F.concat(F.lit("book-"), F.floor(F.col("o_custkey") / 1000).cast("string")).alias("book_id"),
        F.concat(F.lit("Sheet"), (F.col("o_custkey") % 8).cast("string")).alias("sheet"),
        format_ref((k % 30 + 1).cast("int"), (F.floor(k / 30) + 1).cast("int")).alias("ref"),
        t.alias("t"),
        v.alias("v"),
        F.when(k % 8 == 1, F.concat(F.lit("\n "), F.col("o_orderstatus"), F.lit(" x "))).alias("inline"),
        (k % 8 - 4).cast("int").alias("s"),
        (k % 24 == 7).alias("has_formula"),
        k.alias("pos"),
    )


def books(ev: Evidence) -> DataFrame:
    n = ev.table("customer").select(F.floor(F.col("c_custkey") / 1000).alias("b")).distinct()
    return n.select(F.concat(F.lit("book-"), F.col("b").cast("string")).alias("book_id"), (F.col("b") % 2 == 1).alias("date1904"))


def styles(ev: Evidence) -> DataFrame:
    one = F.array(
        F.struct(F.lit(1).alias("s"), F.lit(14).alias("format_id"), F.lit(None).cast("string").alias("format_code")),
        F.struct(F.lit(2).alias("s"), F.lit(10).alias("format_id"), F.lit(None).cast("string").alias("format_code")),
        F.struct(F.lit(3).alias("s"), F.lit(200).alias("format_id"), F.lit('"yd"0.00\\d').alias("format_code")),
        F.struct(F.lit(-1).alias("s"), F.lit(164).alias("format_id"), F.lit("[$-409]d/m/yy").alias("format_code")),
        F.struct(F.lit(-2).alias("s"), F.lit(165).alias("format_id"), F.lit("[Red]0%").alias("format_code")),
        F.struct(F.lit(-3).alias("s"), F.lit(166).alias("format_id"), F.lit("[h]_d").alias("format_code")),
    )
    return books(ev).select("book_id", F.explode(one).alias("z")).select("book_id", "z.*")


def shared_strings(ev: Evidence) -> DataFrame:
    """Thirty shared strings per book (ten indexes of forty point nowhere)."""
    return books(ev).select(
        "book_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("idx")
    ).withColumn("text", F.concat(F.lit("Label "), F.col("idx").cast("string"), F.lit(" ")))


CELLS_SQL = """
  select 'book-' || (o_custkey // 1000) as book_id, 'Sheet' || (o_custkey % 8) as sheet, k, (k % 30 + 1)::int as col, (k // 30 + 1)::int as row,
         case when k % 30 >= 26 then 'A' || chr((65 + k % 30 - 26)::int) else chr((65 + k % 30)::int) end || (k // 30 + 1) as ref,
         case k % 8 when 0 then case when k % 40 < 30 then 'Label ' || (k % 40) end when 1 then o_orderstatus || ' x' when 2 then o_orderpriority
            when 3 then case when k % 16 = 3 then 'TRUE' else 'FALSE' end when 4 then case when k % 3 = 0 then '#N/A' end
            when 5 then dt when 6 then pct || '%' else pn end as text,
         case k % 8 when 3 then case when k % 16 = 3 then '1' else '0' end when 5 then serial::varchar when 6 then '0.' || lpad((k % 100)::varchar, 2, '0')
            when 7 then case when pn <> o_totalprice || '0' then o_totalprice || '0' end end as raw,
         case when k % 24 = 7 then 'formula' else case k % 8 when 2 then 'formula' when 3 then 'boolean' when 5 then case when dt is null then 'number' else 'date' end
            when 6 then 'number' when 7 then 'number' else 'text' end end as kind
  from (select *, """ + q_serial("serial", "d4") + " as dt, " + q_plain("(o_totalprice || '0')") + " as pn, " + q_plain("cast((k % 100)/100.0::double*100 as varchar)") + """ as pct
        from (select o_orderkey as k, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, (o_custkey // 1000) % 2 = 1 as d4,
                     date_diff('day', date '1899-12-30', o_orderdate::date) as serial from orders))"""


@query(
    "s10_type_cells",
    duck("select book_id, sheet, ref, row, col, text, raw, kind, k as pos from c where text is not null", c=CELLS_SQL),
)
def s10(ev: Evidence) -> DataFrame:
    return wb.type_cells(cells_raw(ev), shared_strings(ev), styles(ev), books(ev))


@query(
    "s11_format_class",
    """
    select p_partkey, case when code is null then case when id between 14 and 22 or id between 45 and 47 then 'date' when id in (9,10) then 'percent' end
       else case p_partkey % 7 when 1 then 'date' when 2 then 'percent' when 3 then null when 4 then 'date' when 5 then null when 6 then 'percent' end end as format
    from (select p_partkey, p_size % 50 as id, case when p_partkey % 7 = 0 then null else 'x' end as code from part)
    """,
)
def s11(ev: Evidence) -> DataFrame:
    k = F.col("p_partkey") % 7
    code = (
        F.when(k == 1, "[$-421]dd mmmm yyyy;@")
        .when(k == 2, '"day "0.0%')
        .when(k == 3, '[Blue]#,##0\\h_s"days"')
        .when(k == 4, "[mm]:00")
        .when(k == 5, "0.00*d")
        .when(k == 6, "0%[Red]")
    )
    rows = ev.table("part").select(
        F.lit("b").alias("book_id"), F.col("p_partkey").alias("s"), (F.col("p_size") % 50).alias("format_id"), code.alias("format_code")
    )
    return wb.style_formats(rows).select(F.col("s").alias("p_partkey"), "format")


@query(
    "s12_sheet_extents",
    duck(
        """select book_id, sheet, max(row) as rows, max(col) as cols, count(*) as cells,
                  'A1:' || case when max(col) > 26 then 'A' || chr(64 + max(col) - 26) else chr(64 + max(col)) end || max(row) as dimension
           from c where text is not null group by all""",
        c=CELLS_SQL,
    ),
)
def s12(ev: Evidence) -> DataFrame:
    return wb.sheet_extents(wb.first_at_address(s10(ev)))


# ------------------------------------------------------------------ transcripts, names, digests


def transcript_lines(ev: Evidence) -> DataFrame:
    """A log per source: one metric row per document between identity lines and noise."""
    d = F.col("doc_id")
    body = ev.documents.select(
        F.col("source_id").alias("run"),
        d.alias("k"),
        F.format_string(
            "  doc p%d   %d  %d   0.%03d   0.%03d   %d.%d%%   %d   %d   1.%02d   %d",
            d, d % 60, d * 7 % 3000, d % 1000, d * 3 % 1000, d % 9, d % 10, d % 90, d % 4, d % 100, d % 13,
        ).alias("value"),
    )
    head = ev.sources.select(
        F.col("source_id").alias("run"),
        F.posexplode(
            F.array(
                F.lit("noise p1 2 3"),
                F.concat(F.lit("Model: reader-"), F.col("pos").cast("string")),
                F.when(F.col("pos") % 2 == 0, F.concat(F.lit("OCR model: eye-"), F.col("pos").cast("string"))).otherwise("x"),
                F.lit("  (OCR engine: plain )"),
                F.concat(F.lit("TOTAL: "), F.col("pos").cast("string"), F.lit(" / 12")),
                F.lit("Completeness assertion: 3 short read(s)"),
            )
        ).alias("k", "value"),
    )
    return body.unionByName(head.withColumn("k", F.col("k").cast("bigint") - 10))


def written_transcripts(ev: Evidence) -> str:
    """The logs as text files, one a source, and one without any page row."""
    folder = work_folder(ev.spark)
    broken = ev.sources.select("source_id").where("source_id like '%3'").select(
        F.concat(F.lit("broken-"), "source_id").alias("run"), F.lit(0).cast("bigint").alias("k"), F.lit("Model: lost").alias("value")
    )
    tra.write_transcripts(transcript_lines(ev).unionByName(broken), folder, "k")
    return folder


def _run(c: str):
    return F.regexp_extract(c, "run=([^/]+)/", 1)


S13_SQL = duck(
        """select source_id as run, 'doc p' || doc_id as page, (doc_id % 60)::int as lines, (doc_id*7 % 3000)::int as chars, (doc_id % 1000)/1000.0::double as cover,
                  (doc_id*3 % 1000)/1000.0::double as ink, ((doc_id % 9) || '.' || (doc_id % 10))::double as uncovered, (doc_id % 90)::int as med_h, (doc_id % 4)::int as collapsed,
                  ('1.' || lpad((doc_id % 100)::varchar,2,'0'))::double as density, (doc_id % 13)::int as interpolated from docs""",
        "docs",
)


@query("s13_transcript_page_rows", S13_SQL)
def s13(ev: Evidence) -> DataFrame:
    return tra.parse_page_rows(transcript_lines(ev))


@query("s13_read_transcripts", S13_SQL)
def s13_files(ev: Evidence) -> DataFrame:
    log = tra.read_transcripts(ev.spark, written_transcripts(ev))
    return tra.parse_page_rows(log).withColumn("run", _run("run"))


@query("s13_refused_transcripts", duck("select 'broken-' || source_id as run, 1 as lines, 'no-page-rows' as reason from srcs where source_id like '%3'", "srcs"))
def s13_refused(ev: Evidence) -> DataFrame:
    log = tra.read_transcripts(ev.spark, written_transcripts(ev))
    return tra.transcript_refusals(log).withColumn("run", _run("run"))


@query(
    "s15_file_digests",
    duck(
        """select run, sum(length(value) + 1)::bigint as length, sha256(string_agg(value || chr(10), '' order by k)) as digest from (
             select source_id as run, doc_id as k, printf('  doc p%d   %d  %d   0.%03d   0.%03d   %d.%d%%   %d   %d   1.%02d   %d', doc_id, doc_id % 60, doc_id * 7 % 3000, doc_id % 1000, doc_id * 3 % 1000,
                    doc_id % 9, doc_id % 10, doc_id % 90, doc_id % 4, doc_id % 100, doc_id % 13) as value from docs
             union all select 'broken-' || source_id, 0, 'Model: lost' from srcs where source_id like '%3'
             union all select source_id, k - 10, ['noise p1 2 3', 'Model: reader-' || pos, case when pos % 2 = 0 then 'OCR model: eye-' || pos else 'x' end, '  (OCR engine: plain )',
                    'TOTAL: ' || pos || ' / 12', 'Completeness assertion: 3 short read(s)'][k + 1] from srcs, unnest(range(6)) t(k)) group by run""",
        "docs",
        "srcs",
    ),
)
def s15_files(ev: Evidence) -> DataFrame:
    files = tra.read_documents(ev.spark, written_transcripts(ev))
    return files.select(_run("path").alias("run"), "length", "digest")


@query(
    "s13_transcript_identity",
    duck(
        """select source_id as run, 'reader-' || pos as model, case when pos % 2 = 0 then 'eye-' || pos else 'reader-' || pos end as ocr_model,
                  'plain' as engine, pos || '/12' as total, '(unknown)' as field_slots, '3' as short_reads from srcs""",
        "srcs",
    ),
)
def s13_identity(ev: Evidence) -> DataFrame:
    return tra.parse_identity(transcript_lines(ev))


@query(
    "s14_ids_from_names",
    duck(
        """select run_id, coalesce(min_by(e, pos) filter (where e <> ''), '') as id_epic, coalesce(min_by(q, pos) filter (where q <> ''), '') as quote
           from (select run_id, pos, regexp_extract(name, 'LOP[0-9]{4,}') as e, regexp_extract(name, '[0-9]-[0-9]{9,}') as q from
              (select run_id, pos, case when pos % 3 = 0 then name when pos % 3 = 1 then 'LOP' || (12345 + pos) || ' ' || name else '1-' || (1000000000 + pos) || name end as name from srcs))
           group by run_id""",
        "srcs",
    ),
)
def s14(ev: Evidence) -> DataFrame:
    p = F.col("pos")
    name = (
        F.when(p % 3 == 0, F.col("name"))
        .when(p % 3 == 1, F.concat(F.lit("LOP"), (p + 12345).cast("string"), F.lit(" "), "name"))
        .otherwise(F.concat(F.lit("1-"), (p + 1000000000).cast("string"), "name"))
    )
    return tra.ids_from_names(ev.sources.select("run_id", "pos", name.alias("name")))


@query("s15_document_digest", "select doc_id, source, sha256(text) as digest from documents")
def s15(ev: Evidence) -> DataFrame:
    return tra.digests(ev.table("documents").select("doc_id", "source", "text"), "text")
