"""Running heads and feet of a document (F1, F2).

A tail line is furniture when at least half of its document's pages carry a tail line whose token
set overlaps it by 60% or more.  Comparing every tail line with every other is quadratic in the
pages of a document, and one document may hold a third of a corpus.  The same answer comes from:

1. tail lines collapsed to distinct token sets per document (numbered footers become one set);
2. a necessary condition on token page-counts that hardly a body line meets: a set similar to
   lines on half the pages must be made of tokens that are themselves on many pages, in lines of
   a similar length;
3. a prefix-filtered join of the surviving sets with all sets of the document (a set that
   overlaps enough has one of a surviving set's rarest tokens);
4. page counting only for sets the set sizes cannot already decide.

What several steps read (tails, token sets, alike pairs) is written once to shared storage, and so are
the small tables that tokens of all sets are looked up in, whose size then tells how to join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliary.core import bind
from foliary.functions.readings import furniture_tokens, has_a_letter, token_overlap
from foliary.session import kept

# Depth of a page's tail, overlap, page share, least pages, slack share.
TAIL_LINES = 6
TOKEN_OVERLAP = 0.6
PAGE_SHARE = 0.5
MIN_PAGES = 3
SLACK_SHARE = 0.25

DOC = ["run_id", "source_id"]
EPS = 1e-9
# Tokens on fewer lines than this share of the needed pages are not looked up one by one; their
# page-count is bounded by it instead.
RARE = 0.1
# A token on more lines of a document than this is cut: its sets are dealt to as many parts, what looks them up is copied.
HEAVY_TOKEN = 20_000


def page_tails(lines: DataFrame) -> DataFrame:
    """The last lines of every page, one more than the tail, with the page's number of lines; those of the tail that have
    a letter with their token set, its key, and whether they are the set's first on the page.

    The lines are read once and a page's windows share its one shuffle; only a few lines a page are kept.
    """
    page = W.partitionBy(*DOC, "page_index")
    rows = lines.select(*DOC, "page_index", "i", "text").withColumn("n_lines", F.count(F.lit(1)).over(page).cast("int"))
    up = page.orderBy(F.col("i").desc())
    tails = rows.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= TAIL_LINES + 1)
    cut = (F.col("rank") <= TAIL_LINES) & has_a_letter("text")
    tails = tails.withColumn("tokens", F.when(cut, F.sort_array(furniture_tokens("text"))))
    tails = tails.withColumn("sk", F.sha2(F.array_join("tokens", " "), 256))
    first = F.lag("sk").over(page.orderBy("sk", "i")).eqNullSafe(F.col("sk"))
    return kept(tails.withColumn("counts", F.when(first, 0).otherwise(1)).drop("text", "rank"))


def _prefix(tokens_by_rarity: Column) -> Column:
    """Rarest tokens of which two overlapping sets must share one."""

    def rarest(t: Column) -> Column:
        n = F.size(t)
        return F.slice(t, F.lit(1), n - F.ceil(n * TOKEN_OVERLAP - EPS).cast("int") + 1)

    return bind(tokens_by_rarity, rarest)


def running_furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(run_id, source_id, page_index, i) of every furniture line."""
    return _furniture_of(page_tails(lines), pages)


def _near_size() -> Column:
    return (F.col("size_b") >= F.col("size_a") * (TOKEN_OVERLAP - EPS)) & (
        F.col("size_a") >= F.col("size_b") * (TOKEN_OVERLAP - EPS)
    )


def _likely_sets(sets: DataFrame, words: DataFrame, documents: DataFrame) -> DataFrame:
    """Sets that may be furniture, with their tokens from rare to common.

    Of the pages a furniture set reaches, take as many as it needs: each holds most of the set's tokens, and a token counts
    at most once on each.  So tokens' lines, none more than the pages needed, add up to that share of the set on that many
    pages.  Lines of all sets are added up first, then for the few sets left those of sets of a size that can overlap enough.
    """
    common = kept(
        words.groupBy(*DOC, "token")
        .agg(F.sum("set_pages").alias("token_lines"))
        .join(documents, DOC)
        .where(F.col("token_lines") >= F.col("needed") * RARE)
        .select(*DOC, "token", "needed", F.least("token_lines", F.ceil("needed")).alias("token_pages"))
    )
    share = F.ceil(F.col("size_a") * TOKEN_OVERLAP - EPS) * F.ceil("needed")
    likely = (
        words.join(common, [*DOC, "token"])
        .groupBy(*DOC, F.col("sk").alias("sk_a"))
        .agg(
            F.max("size").alias("size_a"),
            F.max("needed").alias("needed"),
            F.sum("token_pages").alias("mass"),
            F.count(F.lit(1)).alias("n_common"),
        )
        .where(F.col("mass") + (F.col("size_a") - F.col("n_common")) * F.col("needed") * RARE >= share - EPS)
        .select(*DOC, "sk_a", "size_a", "needed")
    )
    tokens = sets.select(*DOC, F.col("sk").alias("sk_a"), F.explode("tokens").alias("token"))
    asked = kept(kept(likely).join(tokens, [*DOC, "sk_a"]))
    probes = kept(asked.select(*DOC, "token", "size_a").distinct())
    near = (
        words.withColumnRenamed("size", "size_b")
        .join(probes, [*DOC, "token"])
        .where(_near_size())
        .groupBy(*DOC, "token", "size_a")
        .agg(F.sum("set_pages").alias("token_lines"))
    )
    by_rarity = F.array_sort(F.collect_list(F.struct(F.col("token_lines").alias("n"), "token")))
    ranked = (
        asked.join(near, [*DOC, "token", "size_a"])
        .groupBy(*DOC, "sk_a", "size_a", "needed")
        .agg(by_rarity.alias("by_rarity"), F.sum(F.least("token_lines", F.ceil("needed"))).alias("mass"))
    )
    return kept(ranked.where(F.col("mass") >= share).drop("mass"))


def _furniture_of(tails: DataFrame, pages: DataFrame) -> DataFrame:
    documents = (
        pages.groupBy(*DOC)
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= MIN_PAGES)
        .select(*DOC, (F.col("n_pages") * PAGE_SHARE).alias("needed"))
    )
    tail = tails.where("tokens IS NOT NULL").select(*DOC, "page_index", "i", "tokens", "sk", "counts")
    sets = tail.groupBy(*DOC, "sk").agg(F.first("tokens").alias("tokens"), F.sum("counts").alias("set_pages"))
    sets = kept(sets.withColumn("size", F.size("tokens")))
    words = sets.select(*DOC, "sk", "size", "set_pages", F.explode("tokens").alias("token"))

    # a set that overlaps enough has one of the rarest tokens of a likely one
    likely = _likely_sets(sets, words, documents)
    rarest = likely.select(*DOC, "sk_a", "size_a", "needed", F.explode(_prefix(F.col("by_rarity"))).alias("t"))
    rarest = rarest.select(*DOC, "sk_a", "size_a", "needed", "t.token", "t.n")
    parts = kept(rarest.groupBy(*DOC, "token").agg((1 + F.floor(F.max("n") / HEAVY_TOKEN)).cast("int").alias("parts")))
    left = rarest.join(parts, [*DOC, "token"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = words.join(parts, [*DOC, "token"]).select(
        *DOC,
        "token",
        F.col("sk").alias("sk_b"),
        F.col("size").alias("size_b"),
        F.pmod(F.xxhash64("sk"), F.col("parts")).cast("int").alias("part"),
    )
    pairs = kept(
        left.join(right, [*DOC, "token", "part"])
        .where(_near_size())
        .select(*DOC, "sk_a", "sk_b", "needed")
        .distinct()
    )
    a = likely.select(*DOC, "sk_a", F.transform("by_rarity", lambda z: z["token"]).alias("tokens_a"))
    b = sets.select(*DOC, F.col("sk").alias("sk_b"), F.col("tokens").alias("tokens_b"), "set_pages")
    alike = kept(
        pairs.join(b, [*DOC, "sk_b"])
        .join(a, [*DOC, "sk_a"])
        .where(token_overlap(F.col("tokens_a"), F.col("tokens_b")) >= TOKEN_OVERLAP)
        .select(*DOC, "sk_a", "sk_b", "needed", "set_pages")
    )
    reach = alike.groupBy(*DOC, "sk_a").agg(
        F.first("needed").alias("needed"),
        F.max("set_pages").alias("most"),
        F.sum("set_pages").alias("total"),
    )
    sure = reach.where(F.col("most") >= F.col("needed")).select(*DOC, F.col("sk_a").alias("sk"))
    open_ = reach.where((F.col("most") < F.col("needed")) & (F.col("total") >= F.col("needed")))
    counted = (
        alike.join(open_.select(*DOC, "sk_a"), [*DOC, "sk_a"], "left_semi")
        .join(
            tail.where("counts = 1").select(*DOC, "page_index", F.col("sk").alias("sk_b")),
            [*DOC, "sk_b"],
        )
        .select(*DOC, "sk_a", "needed", "page_index")
        .distinct()
        .groupBy(*DOC, "sk_a")
        .agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        .where(F.col("n") >= F.col("needed"))
        .select(*DOC, F.col("sk_a").alias("sk"))
    )
    found = kept(sure.unionByName(counted))
    return tail.select(*DOC, "page_index", "i", "sk").join(found, [*DOC, "sk"], "left_semi").drop("sk")


def page_bottoms(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """per page the last content line, furniture count, line count and furniture slack."""
    tails = page_tails(lines)
    furniture = _furniture_of(tails, pages)
    f = furniture.withColumn("is_furniture", F.lit(True))
    keys = [*DOC, "page_index"]
    marked = tails.select(*keys, "i", "n_lines").join(f, [*keys, "i"], "left")
    content = F.when(F.col("is_furniture").isNull(), F.col("i"))
    bottom = marked.groupBy(*keys).agg(
        F.max(content).alias("last_content"),
        F.count("is_furniture").cast("int").alias("furniture_lines"),
        F.max("i").alias("last_line"),
        F.max("n_lines").alias("n_lines"),
    )
    per_page = (
        pages.select(*keys)
        .join(bottom, keys, "left")
        .withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
        .withColumn("furniture_lines", F.coalesce("furniture_lines", F.lit(0)))
    )
    depth = per_page.groupBy(*DOC).agg(F.max("furniture_lines").alias("deepest"))
    slack = F.least(
        F.when(F.col("deepest") > 0, F.col("deepest")).otherwise(TAIL_LINES),
        F.floor(F.col("n_lines") * SLACK_SHARE).cast("int"),
    )
    return per_page.join(depth, DOC).select(
        *keys, "last_content", "last_line", "n_lines", "furniture_lines", slack.alias("slack")
    )
