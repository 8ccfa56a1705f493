"""Personal data and the terms that give it away, by information theory.

Emails, IP addresses, card and phone numbers are found by pattern and check; their values are the protected entities.
The contexts of an entity are the lines that hold it and the lines next to those, so that one seen once has contexts that
can agree. Over all lines of the corpus, a term gives away an entity to the degree of their pointwise mutual information
relative to the entity's information content, log2(N n_ct / (n_c n_t)) / log2(N / n_c): 1 if the term occurs with the
entity only, 0 if they are independent. All four numbers count distinct lines (copies of a document prove nothing), and
fewer than `support` contexts with a term are no evidence: in a single line every rare word would be a term. Terms at or
over `disclosing` are spans of kind `term` in the contexts of their entity; `sanitised` removes those at or over
`revealing` and puts a general word for the rest.

Everything is DataFrame expressions. Patterns are written with possessive repeats and anchored at the start of a run,
which finds the same matches as the plain ones but in time linear in the text and without deep recursion.

Defined cases: a null text is empty and has no spans. Whole texts are searched. Rows with the same id and text get the
same spans. Null ids are kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

SUPPORT = 2
DISCLOSING = 0.9
REVEALING = 0.98

# fixed values: kinds in the order of the digest, and their patterns
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
GENERAL = {"email": "[address]", "ip": "[host]", "card": "[card]", "phone": "[number]", "term": "[term]"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    digits = F.regexp_extract_all(F.reverse(c), F.lit("[0-9]"), F.lit(0))
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x >= "5", 9).otherwise(0))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte(c: Column) -> Column:
    return (F.length(F.regexp_replace(c, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(c, "^0+(?=.)", "").try_cast("int") <= 255)


def _valid(kind: str, c: Column) -> Column:
    n = F.length(_digits(c))
    if kind == "ip":
        return F.forall(F.split(c, r"\."), _byte)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(c)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """Sums of the values before each, in blocks of about the square root of their number, as arrays grow by copying."""

    def sums(xs: Column, n) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["at"] + n(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    blocks = _let(size, lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda b: sums(F.slice(values, b * k + 1, k), lambda x: x)))
    add = lambda x, o: F.transform(x["out"], lambda v: v + o)
    return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, sums(bs, lambda x: x["at"])["out"], add)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, word), in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda w, gap: F.struct(w.alias("word"), F.length(w).cast("long").alias("n"), F.length(gap).cast("long").alias("gap")))

    def placed(ps: Column) -> Column:
        start = lambda p, at: at + p["gap"]
        span = lambda p, at: F.struct(start(p, at).alias("start"), (start(p, at) + p["n"]).alias("end"), p["word"].alias("word"))
        return F.zip_with(ps, running(F.transform(ps, lambda p: p["gap"] + p["n"])), span)

    return _let(pairs, placed)


_SPAN = "array<struct<start: bigint, rank: int, end: bigint, word: string>>"


def _typed(text: Column, kind: str) -> Column:
    may = F.contains(text, F.lit({"email": "@", "phone": "+", "ip": "."}.get(kind, ""))) & (F.lit(kind == "email") | F.rlike(text, F.lit("[0-9]")))
    valid = F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["word"]))
    ranked = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), s["word"].alias("word")))
    return F.when(may, ranked).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def base_spans(docs: DataFrame) -> DataFrame:
    """`row, doc_id, spans, lines`: all base spans in order, and the lines (`start, line, near`) that hold some or are next to
    such a line, with the spans of the three.

    No match crosses the end of a line, so each line is searched by itself, and a text of any number of spans is a pass.
    """
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(C.row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"))
    typed = lambda x: F.concat(*[_typed(x, k) for k in PATTERNS])
    own = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), F.length(x).cast("long").alias("n"), typed(x).alias("spans")))
    none = F.array().cast(_SPAN)
    may = F.contains(F.col("text"), F.lit("@")) | F.rlike(F.col("text"), F.lit("[0-9]"))
    rows = rows.select("row", "doc_id", F.when(may, own).alias("own"))
    rows = rows.select("row", "doc_id", "own", running(F.transform("own", lambda x: x["n"] + 1)).alias("starts"))
    shifted = lambda x, at: F.transform(x["spans"], lambda s: s.withField("start", s["start"] + at).withField("end", s["end"] + at))
    spans = F.array_sort(F.flatten(F.zip_with("own", "starts", shifted)))
    at = lambda i: F.coalesce(F.when(i >= 0, F.get("own", i))["spans"], none)
    line = lambda x, i: F.struct(F.get("starts", i).alias("start"), x["line"].alias("line"), F.concat(at(i - 1), x["spans"], at(i + 1)).alias("near"))
    lines = F.filter(F.transform("own", line), lambda x: F.size(x["near"]) > 0)
    return rows.select("row", "doc_id", F.coalesce(spans, none).alias("spans"), F.coalesce(lines, F.array().cast(f"array<struct<start: bigint, line: string, near: {_SPAN}>>")).alias("lines"))


def _near(found: DataFrame) -> DataFrame:
    """`row, line_key, line, start, entities, context`: each context with the distinct entities of it and its neighbours,
    and a key of line and entities."""
    value = lambda s: F.concat(s["rank"].cast("string"), F.when(s["rank"].isin(KINDS.index("card"), KINDS.index("phone")), _digits(s["word"])).otherwise(F.lower(s["word"])))
    lines = found.select("row", F.explode("lines").alias("l"))
    lines = lines.select("row", F.xxhash64("l.line").alias("line_key"), "l.line", "l.start", F.array_sort(F.array_distinct(F.transform("l.near", value))).alias("entities"))
    return lines.withColumn("context", F.xxhash64("line", "entities"))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def disclosures(docs: DataFrame, found: DataFrame, scratch: C.Scratch, support: int = SUPPORT, disclosing: float = DISCLOSING) -> DataFrame:
    """`context, terms`: for each context the terms that give one of its entities away, with how much."""
    every_context = _near(found).dropDuplicates(["context"])
    # a line may hold many entities: its text joins those that count, it isn't copied for each
    line_of = every_context.select("line_key", "line").dropDuplicates(["line_key"])
    each = every_context.select("context", "line_key", F.explode("entities").alias("entity"))
    contexts = each.select("entity", "line_key").distinct()
    common = contexts.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    terms = contexts.join(common.select("entity"), "entity").join(line_of, "line_key").select("entity", F.explode(_terms(F.col("line"))).alias("term"))
    joint = scratch.table(terms.groupBy("entity", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= support), "joint")
    # the empty term stands for the line itself, so that one pass counts lines and terms
    wanted = joint.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    every = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).distinct()
    every = every.select(F.explode(F.array_append(_terms(F.col("line")), F.lit(""))).alias("term"))
    often = scratch.table(every.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term"), "often")
    line_count = often.where("term = ''").first()
    total = line_count["n_t"] if line_count else 1
    ic, pmi = F.log2(F.lit(float(total)) / F.col("n_c")), F.log2(F.lit(float(total)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    degree = F.when(ic > 0, pmi / ic).otherwise(0.0)
    told = joint.join(common, "entity").join(often, "term").withColumn("degree", degree).where(F.col("degree") >= disclosing)
    told = scratch.table(told.select("entity", "term", "degree"), "degrees")
    here = each.join(told.select("entity").distinct(), "entity", "left_semi").join(line_of, "line_key")
    here = here.select("context", "entity", F.explode(_terms(F.col("line"))).alias("term")).join(told, ["entity", "term"])
    by_context = here.groupBy("context", "term").agg(F.max("degree").alias("degree"))
    return by_context.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("term", "degree"))).alias("terms"))


def spans(docs: DataFrame, **how) -> DataFrame:
    """`row, doc_id, spans, term_spans`; a term span has its `degree` too."""
    scratch = C.Scratch(docs.sparkSession)
    found = scratch.table(base_spans(docs), "base")
    told = scratch.table(disclosures(docs, found, scratch, **how), "told")
    lines = _near(found).select("row", "context", "line", "start").dropDuplicates(["row", "start"])
    at = lines.join(told, "context")
    words = F.filter(matches(F.col("line"), TERM), lambda m: F.map_contains_key("terms", F.lower(m["word"])))
    span = lambda m: F.struct((m["start"] + F.col("start")).alias("start"), F.lit(KINDS.index("term")).alias("rank"), (m["end"] + F.col("start")).alias("end"), m["word"].alias("word"), F.element_at("terms", F.lower(m["word"])).alias("degree"))
    # terms inside an email are part of that span already
    per_row = at.select("row", F.explode(F.transform(words, span)).alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("term_spans"))
    out = found.select("row", "doc_id", "spans").join(per_row, "row", "left")
    free = F.filter("term_spans", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    empty = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, word: string, degree: double>>")
    return out.select("row", "doc_id", "spans", F.coalesce(free, empty).alias("term_spans"))


def _digest(c: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **how) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans` for each row."""
    found = spans(docs, **how)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    terms = F.transform("term_spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["word"].alias("word")))
    return found.select(
        "doc_id", *[count(k) for k in PATTERNS], F.size("term_spans").cast("long").alias("n_term"),
        F.sha2(_digest(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _digest(F.array_sort(F.concat("spans", terms))).alias("spans"),
    )


def sanitised(docs: DataFrame, revealing: float = REVEALING, **how) -> DataFrame:
    """The rows of `docs` with personal data and disclosing terms replaced in `text`; null texts stay null.

    Where base spans overlap, the first one and what overlaps it are replaced together.
    """
    found = spans(docs, **how).dropDuplicates(["row"])
    words = F.array(*[F.lit(GENERAL[k]) for k in KINDS])
    put = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(words, s["rank"]).alias("by"))
    term = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["degree"] >= revealing, "").otherwise(GENERAL["term"]).alias("by"))
    edits = F.array_sort(F.concat(F.transform("spans", put), F.transform("term_spans", term)))
    found = found.select("row", edits.alias("edits"))
    part = lambda at, n: F.substring(F.col("text"), at.cast("int") + 1, n.cast("int"))
    step = lambda a, e: F.when(e["start"] < a["at"], F.struct(F.greatest(a["at"], e["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(e["end"].alias("at"), F.concat(a["out"], part(a["at"], e["start"] - a["at"]), e["by"]).alias("out"))
    )
    done = F.aggregate("edits", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], part(a["at"], F.length("text"))))
    rows = C.held(docs, F.col("text")).join(found, "row", "left")
    text = F.when(F.size("edits") > 0, done).otherwise(F.col("text"))
    return rows.select(F.col("all").withField("text", text).alias("all")).select("all.*")
