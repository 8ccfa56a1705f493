"""Scalar text functions (T) over names, values, line texts, addresses and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.core import pack_lines
from foliary.functions import cells, differ, keys, names, readings
from foliary.operators.signatures import page_signature_spans
from foliary.plans.evidence import Evidence, add_duck, duck
from foliary.plans.registry import query

# ------------------------------------------------------------------ inputs


def entity_pairs(ev: Evidence) -> DataFrame:
    """A phrase per customer against one of eight spellings of it."""
    c = ev.table("customer")
    n = ev.table("nation").join(ev.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    seg = F.lower("c_mktsegment")
    phrase = F.concat(F.lit("Bank "), seg, F.lit(" "), F.col("r_name"))
    initials = F.upper(
        F.concat(F.lit("B"), F.substring(seg, 1, 1), F.regexp_replace("r_name", r"\B[A-Z]+| ", ""))
    )
    k = F.col("c_custkey") % 8
    other = (
        F.when(k == 0, F.concat(F.lit("PT "), phrase, F.lit(" Tbk")))
        .when(k == 1, F.upper(phrase))
        .when(k == 2, initials)
        .when(k == 3, F.concat(F.lit("Perusahaan Perseroan (Persero) "), phrase))
        .when(k == 4, F.concat(phrase, F.lit(", CV.")))
        .when(k == 5, F.concat(seg, F.lit(" "), F.col("r_name")))
        .when(k == 6, F.lit("BAST"))
        .otherwise(F.lit("Bank"))
    )
    first = F.when(k == 6, F.lit("Berita Acara Serah Terima")).otherwise(phrase)
    return rows.select(F.col("c_custkey").alias("id"), first.alias("a"), other.alias("b"))


add_duck(
    "ents",
    r"""
    select c_custkey as id,
           case when c_custkey % 8 = 6 then 'Berita Acara Serah Terima'
                else 'Bank ' || lower(c_mktsegment) || ' ' || r_name end as a,
           case c_custkey % 8
             when 0 then 'PT Bank ' || lower(c_mktsegment) || ' ' || r_name || ' Tbk'
             when 1 then upper('Bank ' || lower(c_mktsegment) || ' ' || r_name)
             when 2 then upper('B' || substr(c_mktsegment,1,1) || regexp_replace(r_name, '\B[A-Z]+| ', '', 'g'))
             when 3 then 'Perusahaan Perseroan (Persero) Bank ' || lower(c_mktsegment) || ' ' || r_name
             when 4 then 'Bank ' || lower(c_mktsegment) || ' ' || r_name || ', CV.'
             when 5 then lower(c_mktsegment) || ' ' || r_name
             when 6 then 'BAST' else 'Bank' end as b
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    [],
)


def value_pairs(ev: Evidence) -> DataFrame:
    """A value per part against one of nine rewritings of it."""
    p = ev.table("part")
    size = F.col("p_size").cast("string")
    a = F.concat("p_name", F.lit(" "), size, F.lit(" Mbps"))
    k = F.col("p_partkey") % 9
    b = (
        F.when(k == 0, F.regexp_replace(a, " ", "  "))
        .when(k == 1, F.upper(a))
        .when(k == 2, F.concat(a, F.lit(".")))
        .when(k == 3, F.concat("p_name", F.lit(" "), size, F.lit(".00 Mbps")))
        .when(k == 4, F.concat("p_name", F.lit(" "), (F.col("p_size") + 1).cast("string"), F.lit(" Mbps")))
        .when(k == 5, F.concat("p_name", F.lit(" "), size, F.lit(".000 Mbps")))
        .when(k == 6, F.concat("p_name", F.lit(" ("), size, F.lit(") / Mbps:")))
        .when(k == 7, F.lit(""))
        .otherwise(F.col("p_brand"))
    )
    return p.select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))


def folded_pairs(ev: Evidence) -> DataFrame:
    """Folded values and readings, dealt to all tasks: a scan of so short rows is one or two, but an edit table a row is much work."""
    dealt = value_pairs(ev).repartition(int(ev.spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("id", readings.normalize_reading("a").alias("needle"), readings.normalize_reading("b").alias("hay"))


add_duck(
    "vals",
    """
    select p_partkey as id, p_name || ' ' || p_size || ' Mbps' as a,
           case p_partkey % 9
             when 0 then replace(p_name || ' ' || p_size || ' Mbps', ' ', '  ')
             when 1 then upper(p_name || ' ' || p_size || ' Mbps')
             when 2 then p_name || ' ' || p_size || ' Mbps.'
             when 3 then p_name || ' ' || p_size || '.00 Mbps'
             when 4 then p_name || ' ' || (p_size + 1) || ' Mbps'
             when 5 then p_name || ' ' || p_size || '.000 Mbps'
             when 6 then p_name || ' (' || p_size || ') / Mbps:'
             when 7 then '' else p_brand end as b
    from part""",
    [],
)

# ------------------------------------------------------------------ oracle fragments


def q_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


_FORMS = "(?:pt|tbk|persero|cv|ud|perusahaan perseroan)"


def q_strip(x: str) -> str:
    n = q_norm(x)
    return (
        f"coalesce(nullif(regexp_replace(regexp_replace({n}, '^(?:{_FORMS}(?: |$))+', ''),"
        f" '(?:(?:^| ){_FORMS})+$', ''), ''), {n})"
    )


def q_sig(x: str) -> str:
    return (
        f"list_filter(string_split({q_strip(x)}, ' '), lambda t: t <> '' and t not in "
        "('dan','di','ke','dari','yang','of','the','and'))"
    )


def q_letters(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^a-zA-Z0-9]+', '', 'g'))"


def q_expand(x: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in names.DOMAIN_TERMS.items())
    return f"case {q_letters(x)} {whens} end"


def q_domain(ea: str, eb: str, a: str, b: str) -> str:
    la = f"replace({q_norm(f'coalesce({ea}, {a})')}, ' ', '')"
    lb = f"replace({q_norm(f'coalesce({eb}, {b})')}, ' ', '')"
    return f"(({ea} is not null or {eb} is not null) and {la} <> '' and {la} = {lb})"


def q_acronym(sig: str) -> str:
    return f"array_to_string(list_transform({sig}, lambda t: upper(substr(t,1,1))), '')"


def entity_parts(src: str, columns: list[str]) -> str:
    """One row per distinct spelling with all its folds."""
    u = " union ".join(f"select {c} as v from {src}" for c in columns)
    return (
        f"select v, {q_norm('v')} as n, {q_strip('v')} as s, {q_sig('v')} as sig, "
        f"{q_letters('v')} as l, {q_expand('v')} as e from (select distinct v from ({u}))"
    )


def same_entity_sql(x: str, y: str) -> str:
    def acr(p: str, q: str) -> str:
        return (
            f"(length({p}.l) between 2 and 8 and {p}.n <> '' and strpos({p}.n,' ') = 0"
            f" and not regexp_matches({p}.v,'[a-z]') and len({q}.sig) >= 2"
            f" and not list_contains({q}.sig, lower({p}.l)) and {p}.l = {q_acronym(q + '.sig')})"
        )

    def like(p: str) -> str:
        return f"(len({p}.sig) >= 2 and len(list_filter({p}.sig, lambda t: regexp_matches(t,'[0-9]'))) = 0)"

    def run(p: str, q: str) -> str:
        return f"(strpos({q}.s,' ') > 0 and contains(' '||{p}.s||' ', ' '||{q}.s||' '))"

    return (
        f"({x}.n <> '' and {y}.n <> '' and ({x}.n = {y}.n or "
        f"{q_domain(x + '.e', y + '.e', x + '.v', y + '.v')} or {acr(x, y)} or {acr(y, x)} or {x}.s = {y}.s"
        f" or ({like(x)} and {like(y)} and ({run(x, y)} or {run(y, x)}))))"
    )


# ------------------------------------------------------------------ T1 - T8


@query(
    "t1_normalize_words_letters",
    duck(
        f"select id, {q_norm('b')} as normal, case when {q_norm('b')} = '' then 0 else "
        f"len(string_split({q_norm('b')},' ')) end::int as n_words, {q_letters('b')} as letters from ents",
        "ents",
    ),
)
def t1(ev: Evidence) -> DataFrame:
    return entity_pairs(ev).select(
        "id",
        names.normalize("b").alias("normal"),
        F.size(names.words("b")).alias("n_words"),
        names.letters("b").alias("letters"),
    )


@query(
    "t2_strip_corporate_forms",
    duck(f"select id, b, {q_strip('b')} as stripped from ents", "ents"),
)
def t2(ev: Evidence) -> DataFrame:
    return entity_pairs(ev).select("id", "b", names.strip_corporate_forms("b").alias("stripped"))


@query(
    "t3_significant_words_acronym",
    duck(
        f"select id, array_to_string({q_sig('b')}, ' ') as significant, {q_acronym(q_sig('b'))} as acronym from ents",
        "ents",
    ),
)
def t3(ev: Evidence) -> DataFrame:
    return entity_pairs(ev).select(
        "id",
        F.array_join(names.significant_words("b"), " ").alias("significant"),
        names.acronym_of("b").alias("acronym"),
    )


@query(
    "t4_domain_equivalent",
    duck(
        f"select id, {q_expand('b')} as expansion, {q_domain(q_expand('a'), q_expand('b'), 'a', 'b')} as equivalent from ents",
        "ents",
    ),
)
def t4(ev: Evidence) -> DataFrame:
    return entity_pairs(ev).select(
        "id", names.domain_expansion("b").alias("expansion"), names.domain_equivalent("a", "b").alias("equivalent")
    )


@query(
    "t5_acronym_matches",
    duck(
        "select id, (length(y.l) between 2 and 8 and y.n <> '' and strpos(y.n,' ')=0 and not regexp_matches(y.v,'[a-z]')"
        f" and len(x.sig) >= 2 and not list_contains(x.sig, lower(y.l)) and y.l = {q_acronym('x.sig')}) as matches"
        " from ents join parts x on x.v = a join parts y on y.v = b",
        "ents",
        parts=entity_parts("ents", ["a", "b"]),
    ),
)
def t5(ev: Evidence) -> DataFrame:
    return entity_pairs(ev).select("id", names.acronym_matches("b", "a").alias("matches"))


@query(
    "t6_name_like_contains_run",
    duck(
        f"select id, len({q_sig('b')}) >= 2 and len(list_filter({q_sig('b')}, lambda t: regexp_matches(t,'[0-9]'))) = 0 as name_like,"
        f" strpos({q_strip('b')},' ') > 0 and contains(' '||{q_strip('a')}||' ', ' '||{q_strip('b')}||' ') as inside from ents",
        "ents",
    ),
)
def t6(ev: Evidence) -> DataFrame:
    return entity_pairs(ev).select(
        "id",
        names.is_name_like("b").alias("name_like"),
        names.contains_run(names.strip_corporate_forms("a"), names.strip_corporate_forms("b")).alias("inside"),
    )


@query(
    "t7_same_entity",
    duck(
        f"select id, a, b, {same_entity_sql('x','y')} as same from ents join parts x on x.v = a join parts y on y.v = b",
        "ents",
        parts=entity_parts("ents", ["a", "b"]),
    ),
)
def t7(ev: Evidence) -> DataFrame:
    return entity_pairs(ev).select("id", "a", "b", names.same_entity("a", "b").alias("same"))


@query(
    "t8_canonical_entity",
    duck(
        f"select grp, max_by(b, (len({q_sig('b')}) * 1000000 + length(b)) * 1000000000 - id) as canonical"
        " from (select id % 50 as grp, id, trim(b) as b from ents) where b <> '' group by grp",
        "ents",
    ),
)
def t8(ev: Evidence) -> DataFrame:
    rows = entity_pairs(ev).select((F.col("id") % 50).alias("grp"), "id", F.trim("b").alias("b")).where("b <> ''")
    return rows.groupBy("grp").agg(F.max_by("b", names.canonical_rank("b", "id")).alias("canonical"))


# ------------------------------------------------------------------ T9 - T13


def q_tokens(x: str) -> str:
    kept = (
        f"trim(regexp_replace(regexp_replace(lower({x}), '[0-9]+', '#', 'g'), '[^\\p{{L}}\\p{{N}}#]+', ' ', 'g'))"
    )
    return f"case when {kept} = '' then []::varchar[] else list_distinct(string_split({kept}, ' ')) end"


@query(
    "t9_furniture_tokens",
    duck(
        rf"""
        select run_id, page_index, i, cast(len(tk) as int) as n_tokens,
               len(list_filter(tk, lambda t: regexp_matches(t,'\p{{L}}'))) > 0 as has_word,
               round(case when len(tk) = 0 or len(ptk) = 0 or ptk is null then 0.0
                    else len(list_intersect(tk, ptk)) / greatest(len(tk), len(ptk)) end, 9)::double as overlap
        from (select *, lag(tk) over (partition by run_id, page_index order by i) as ptk
              from (select run_id, page_index, i, {q_tokens('text')} as tk from lns))""",
        "lns",
    ),
)
def t9(ev: Evidence) -> DataFrame:
    from pyspark.sql import Window as W

    tk = ev.lines.select("run_id", "page_index", "i", readings.furniture_tokens("text").alias("tk"))
    prev = F.lag("tk").over(W.partitionBy("run_id", "page_index").orderBy("i"))
    return tk.withColumn("ptk", F.coalesce(prev, F.array().cast("array<string>"))).select(
        "run_id",
        "page_index",
        "i",
        F.size("tk").alias("n_tokens"),
        readings.carries_a_word(F.col("tk")).alias("has_word"),
        F.round(readings.token_overlap(F.col("tk"), F.col("ptk")), 9).alias("overlap"),
    )


def q_reading_tokens(x: str, least: int) -> str:
    return (
        rf"list_filter(list_transform(regexp_split_to_array({x}, '\s+'), lambda t: "
        rf"regexp_replace(translate(lower(t),'lio','110'), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= {least})"
    )


@query(
    "t10_normalize_reading",
    duck(f"select run_id, page_index, i, array_to_string({q_reading_tokens('text', 1)}, ' ') as folded from lns", "lns"),
)
def t10(ev: Evidence) -> DataFrame:
    return ev.lines.select("run_id", "page_index", "i", readings.normalize_reading("text").alias("folded"))


@query(
    "t11_agrees_with",
    duck(
        f"select id, contains(array_to_string({q_reading_tokens('b', 1)}, ' '), array_to_string({q_reading_tokens('a', 1)}, ' ')) as agree from vals",
        "vals",
    ),
)
def t11(ev: Evidence) -> DataFrame:
    return value_pairs(ev).select("id", readings.agrees_exactly("a", "b").alias("agree"))


def q_nearest(pairs: str) -> dict[str, str]:
    """The edit table of each of `pairs` (id, needle, hay; none empty), a row of it at a time.

    Along a row, insertions carry the least of cost - column on; among equal costs a diagonal step goes before a deletion
    and both before an insertion. Only the last row is used.
    """
    return {
        "table_rows": f"""
            select p.id, 0 as i, j, 0 as cost, j as start from {pairs} p, unnest(range(0, length(hay) + 1)) u(j)
            union all
            select id, i, j, (least_shift + j)::int, coalesce(last_value(case when fresh then base_start end ignore nulls) over (partition by id order by j), 0)
            from (select *, j = 0 or shift <= lag(least_shift) over (partition by id order by j) as fresh
                  from (select *, base - j as shift, min(base - j) over (partition by id order by j) as least_shift
                        from (select d.id, d.i + 1 as i, d.j,
                                     case when d.j = 0 then d.i + 1 else least(lag(cost) over w + (substr(hay, d.j::int, 1) <> substr(needle, d.i::int + 1, 1))::int, cost + 1) end as base,
                                     case when d.j > 0 and lag(cost) over w + (substr(hay, d.j::int, 1) <> substr(needle, d.i::int + 1, 1))::int <= cost + 1 then lag(start) over w else start end as base_start
                              from table_rows d join {pairs} p on p.id = d.id where d.i < length(needle)
                              window w as (partition by d.id order by d.j))))""",
        "nearest": f"""
            select id, arg_min(cost, (cost, j))::int as distance, arg_min(start, (cost, j))::int as start, arg_min(j, (cost, j))::int as "end"
            from table_rows join {pairs} p using (id) where i = length(needle) group by id""",
    }


FOLDED = f"select id, array_to_string({q_reading_tokens('a', 1)}, ' ') as needle, array_to_string({q_reading_tokens('b', 1)}, ' ') as hay from vals"


@query(
    "t12_best_substring_match",
    duck(
        """
        select id, needle, hay, case when needle = '' then 0 when hay = '' then length(needle)::int when strpos(hay, needle) > 0 then 0 else n.distance end as distance,
               case when needle = '' or hay = '' then 0 when strpos(hay, needle) > 0 then strpos(hay, needle)::int - 1 else n.start end as start,
               case when needle = '' or hay = '' then 0 when strpos(hay, needle) > 0 then (strpos(hay, needle) - 1 + length(needle))::int else n."end" end as "end"
        from f left join nearest n using (id)""",
        "vals",
        f=FOLDED,
        misses="select * from f where needle <> '' and hay <> '' and strpos(hay, needle) = 0",
        **q_nearest("misses"),
    ),
)
def t12(ev: Evidence) -> DataFrame:
    folded = folded_pairs(ev)
    m = readings.best_substring_match("needle", "hay")
    return folded.withColumn("m", m).select("id", "needle", "hay", "m.distance", "m.start", "m.end")


@query(
    "t11_agrees_within",
    duck(
        """
        select id, length(needle) <= tol or strpos(hay, needle) > 0 or coalesce((select min(levenshtein(needle, substr(hay, s, e))) <= tol
                    from unnest(range(1, length(hay)+1)) t(s), unnest(range(1, length(hay)+1)) u(e)
                    where s + e - 1 <= length(hay)), false) as agree
        from (select *, greatest(1, length(needle) // 5) as tol from f)""",
        "vals",
        f=FOLDED,
    ),
)
def t11_within(ev: Evidence) -> DataFrame:
    folded = folded_pairs(ev)
    tolerance = F.greatest(F.lit(1), F.floor(F.length("needle") / 5)).cast("int")
    return folded.select("id", readings.folded_agree_within("needle", "hay", tolerance).alias("agree"))


@query(
    "t11_bounded_distance",
    duck(
        """
        select id, (select least(length(needle), min(levenshtein(needle, substr(hay, s, e)))) as d
                    from unnest(range(1, length(hay)+1)) t(s), unnest(range(1, length(hay)+1)) u(e)
                    where s + e - 1 <= length(hay))::int as distance
        from f where length(hay) > 0
        union all select id, length(needle)::int from f where length(hay) = 0""",
        "vals",
        f=f"select id, array_to_string({q_reading_tokens('a', 1)}, ' ') as needle, array_to_string({q_reading_tokens('b', 1)}, ' ') as hay from vals",
    ),
)
def t11_distance(ev: Evidence) -> DataFrame:
    return t12(ev).select("id", "distance")


@query(
    "t13_page_signature_spans",
    duck(
        """
        select run_id, page_index, i, sig, cast(done as int) as start, cast(done + length(sig) as int) as "end"
        from (select *, coalesce(sum(length(sig)+1) over (partition by run_id, page_index order by i
                         rows between unbounded preceding and 1 preceding), 0) as done from s where sig <> '')""",
        "lns",
        s=f"select run_id, page_index, i, array_to_string({q_reading_tokens('text', 2)}, ' ') as sig from lns",
    ),
)
def t13(ev: Evidence) -> DataFrame:
    return page_signature_spans(ev.lines)


# ------------------------------------------------------------------ T14 - T18


def q_nospace(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def q_nopunct(x: str) -> str:
    p = x
    for _ in range(2):  # twice, as neighbouring matches share a digit
        p = rf"regexp_replace({p}, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g')"
        p = rf"regexp_replace({p}, '([0-9]),([0-9])', '\1' || chr(2) || '\2', 'g')"
    marks = ".,:;!?''\"‘’“”()[]{}-–—_/\\"
    return f"replace(replace(translate({p}, '{marks}', ''), chr(1), '.'), chr(2), ',')"


def q_fold(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


def q_part(x: str, g: int) -> str:
    return rf"regexp_extract(trim({x}), '(?s)^([^0-9]*)([0-9](?:.*[0-9])?)([^0-9]*)$', {g})"


def q_core(x: str) -> str:
    whole = f"regexp_extract({x}, '^([0-9]+)(?:[.,]([0-9]+))?$', 1)"
    part = f"regexp_extract({x}, '^([0-9]+)(?:[.,]([0-9]+))?$', 2)"
    return (
        f"case when regexp_matches({x}, '^[0-9]+([.,][0-9]+)?$') and length({part}) <> 3 then "
        f"try_cast({whole} || case when {part} = '' then '' else '.' || {part} end as double) end"
    )


def q_same_number(a: str, b: str) -> str:
    return (
        f"coalesce(regexp_matches({a},'[0-9]') and regexp_matches({b},'[0-9]') and {q_fold(q_part(a,1))} = {q_fold(q_part(b,1))}"
        f" and {q_fold(q_part(a,3))} = {q_fold(q_part(b,3))} and {q_core(q_part(a,2))} = {q_core(q_part(b,2))}, false)"
    )


def q_kind(a: str, b: str) -> str:
    na, nb = q_nospace(a), q_nospace(b)
    da, db = f"lower({q_nospace(q_nopunct(a))})", f"lower({q_nospace(q_nopunct(b))})"
    return (
        f"case when {na} = {nb} then 'spasi' when lower({na}) = lower({nb}) then 'huruf' when {da} = {db} then 'tanda-baca'"
        f" when {q_same_number(a, b)} then 'angka' else 'nilai' end"
    )


@query("t14_describe_difference", duck(f"select id, {q_kind('a','b')} as kind from vals", "vals"))
def t14(ev: Evidence) -> DataFrame:
    return value_pairs(ev).select("id", differ.describe_difference("a", "b")["kind"].alias("kind"))


@query(
    "t15_difference_spans",
    duck(
        """
        select id, p::int as a_from, (length(a) - s)::int as a_to, p::int as b_from, (length(b) - s)::int as b_to
        from (select *, (select coalesce(max(k),0) from unnest(range(1, least(length(a),length(b)) - p + 1)) t(k)
                         where right(a, k) = right(b, k)) as s
              from (select *, (select coalesce(max(k),0) from unnest(range(1, least(length(a),length(b))+1)) t(k)
                               where left(a, k) = left(b, k)) as p from vals))""",
        "vals",
    ),
)
def t15(ev: Evidence) -> DataFrame:
    return value_pairs(ev).withColumn("s", differ.spans_of("a", "b")).select("id", "s.*")


@query(
    "t16_fold_punctuation_space",
    duck(f"select id, {q_nopunct('b')} as no_marks, {q_nospace('b')} as no_space, {q_fold('b')} as folded from vals", "vals"),
)
def t16(ev: Evidence) -> DataFrame:
    return value_pairs(ev).select(
        "id",
        differ.without_punctuation("b").alias("no_marks"),
        differ.without_space("b").alias("no_space"),
        differ.fold_key("b").alias("folded"),
    )


@query(
    "t17_same_number",
    duck(
        f"select id, case when regexp_matches(b,'[0-9]') then {q_part('b',1)} end as head, case when regexp_matches(b,'[0-9]') then {q_part('b',2)} end as core,"
        f" {q_core(q_part('b',2))} as core_value, {q_same_number('a','b')} as same from vals",
        "vals",
    ),
)
def t17(ev: Evidence) -> DataFrame:
    p = differ.number_parts("b")
    return value_pairs(ev).select(
        "id",
        p["head"].alias("head"),
        p["core"].alias("core"),
        differ.core_value(p["core"]).alias("core_value"),
        differ.same_number("a", "b").alias("same"),
    )


@query(
    "t18_label_folds",
    duck(
        r"""select id, trim(regexp_replace(regexp_replace(lower(regexp_replace(t,'\s+',' ','g')), '^[ :;.,\-*()\[\]]+', ''), '[ :;.,\-*()\[\]]+$', '')) as label_key,
               trim(regexp_replace(regexp_replace(lower(regexp_replace(t,'\s+',' ','g')), '^[ :.,;\-]+', ''), '[ :.,;\-]+$', '')) as fold_label
            from (select id, '* (' || b || ') :' as t from vals)""",
        "vals",
    ),
)
def t18(ev: Evidence) -> DataFrame:
    rows = value_pairs(ev).select("id", F.concat(F.lit("* ("), "b", F.lit(") :")).alias("t"))
    return rows.select("id", differ.label_key("t").alias("label_key"), differ.fold_label("t").alias("fold_label"))


# ------------------------------------------------------------------ T19 - T26


@query(
    "t19_cell_addresses",
    """
    select o_orderkey, ref, n::int as col_number, len_ok as is_ref, ref || case when o_orderkey % 5 = 0 then '0' else '' end as bad_ref,
           false as bad_is_ref
    from (select o_orderkey, n,
                 case when n > 702 then chr(cast(65 + (n - 703) // 676 as int)) else '' end
                 || case when n > 26 then chr(cast(65 + ((n - 27) // 26) % 26 as int)) else '' end
                 || chr(cast(65 + (n-1) % 26 as int)) || (1 + o_orderkey % 1048576) as ref, true as len_ok
          from (select o_orderkey, 1 + o_orderkey % 16384 as n from orders)) where false
    union all
    select o_orderkey, ref, n::int, regexp_matches(ref, '^[A-Z]{1,3}[0-9]{1,7}$'), '0' || ref, false
    from (select o_orderkey, n,
                 case when n > 702 then chr(cast(65 + (n - 703) // 676 as int)) else '' end
                 || case when n > 26 then chr(cast(65 + ((n - 27) // 26) % 26 as int)) else '' end
                 || chr(cast(65 + (n-1) % 26 as int)) || (1 + o_orderkey % 1048576) as ref
          from (select o_orderkey, 1 + o_orderkey % 16384 as n from orders))
    """,
)
def t19(ev: Evidence) -> DataFrame:
    o = ev.table("orders").select(
        "o_orderkey",
        cells.format_ref(1 + F.col("o_orderkey") % 16384, 1 + F.col("o_orderkey") % 1048576).alias("ref"),
    )
    return o.select(
        "o_orderkey",
        "ref",
        cells.parse_ref("ref")["col"].cast("int").alias("col_number"),
        cells.is_cell_ref("ref").alias("is_ref"),
        F.concat(F.lit("0"), "ref").alias("bad_ref"),
        cells.is_cell_ref(F.concat(F.lit("0"), F.col("ref"))).alias("bad_is_ref"),
    )


def q_plain(raw: str) -> str:
    x = f"try_cast(trim({raw}) as double)"
    sci = f"printf('%.14e', {x})"
    dig = f"replace(regexp_extract({sci}, '^-?([0-9.]+)e', 1), '.', '')"
    e = f"cast(regexp_extract({sci}, 'e([+-][0-9]+)$', 1) as int)"
    body = (
        f"case when {e} < 0 then '0.' || repeat('0', -{e} - 1) || {dig} when {e} >= 14 then rpad({dig}, {e} + 1, '0')"
        f" else substr({dig}, 1, {e} + 1) || '.' || substr({dig}, {e} + 2) end"
    )
    return (
        f"case when {x} is null then trim({raw}) when {x} = floor({x}) then cast(cast({x} as hugeint) as varchar)"
        f" else case when {x} < 0 then '-' else '' end || regexp_replace(regexp_replace({body}, '0+$', ''), '[.]$', '') end"
    )


@query(
    "t20_plain_number",
    f"""
    select c_custkey, {q_plain('t')} as plain, {q_plain('u')} as small
    from (select c_custkey, case when c_custkey % 10 = 0 then ' n/a ' else cast(c_acctbal as varchar) end as t,
                 cast(c_acctbal / 1024 as varchar) as u from customer)
    """,
)
def t20(ev: Evidence) -> DataFrame:
    c = ev.table("customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 10 == 0, " n/a ").otherwise(F.col("c_acctbal").cast("string")).alias("t"),
        (F.col("c_acctbal") / 1024).cast("string").alias("u"),
    )
    return c.select("c_custkey", cells.plain_number("t").alias("plain"), cells.plain_number("u").alias("small"))


def q_serial(d: str, sys1904: str) -> str:
    return (
        f"case when {d} is null or {d} > 2958465 then null when {sys1904} then case when {d} >= 0 then strftime(date '1904-01-01' + {d}::int, '%d/%m/%Y') end"
        f" when {d} < 1 then null when {d} = 60 then '29/02/1900' when {d} > 60 then strftime(date '1899-12-30' + {d}::int, '%d/%m/%Y')"
        f" else strftime(date '1899-12-31' + {d}::int, '%d/%m/%Y') end"
    )


@query(
    "t21_serial_to_date",
    f"select o_orderkey, {q_serial('d', 'false')} as d1900, {q_serial('d', 'true')} as d1904 from"
    " (select o_orderkey, case when o_orderkey < 400 then o_orderkey - 5 else date_diff('day', date '1899-12-30', o_orderdate::date) end as d from orders)",
)
def t21(ev: Evidence) -> DataFrame:
    serial = F.when(F.col("o_orderkey") < 400, F.col("o_orderkey") - 5).otherwise(
        F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))
    )
    return ev.table("orders").select(
        "o_orderkey",
        cells.serial_to_date(serial, F.lit(False)).alias("d1900"),
        cells.serial_to_date(serial, F.lit(True)).alias("d1904"),
    )


@query(
    "t22_capture_keys",
    r"""
    select p_partkey, k, regexp_replace(k, '(?s)#[^#]*$', '') as slot_key,
           case when coalesce(try_cast(regexp_extract(k, '#([0-9]+)$', 1) as int), 0) >= 1
                then try_cast(regexp_extract(k, '#([0-9]+)$', 1) as int) else 1 end as ordinal,
           case when p_size <= 1 then p_brand else p_brand || '#' || p_size end as made
    from (select p_partkey, p_size, p_brand, p_brand || case p_partkey % 4 when 0 then '' when 1 then '#' || (p_partkey % 6)
                 when 2 then '#x' else '#3#' || (p_partkey % 3) end as k from part)
    """,
)
def t22(ev: Evidence) -> DataFrame:
    m = F.col("p_partkey") % 4
    tail = (
        F.when(m == 0, "")
        .when(m == 1, F.concat(F.lit("#"), (F.col("p_partkey") % 6).cast("string")))
        .when(m == 2, "#x")
        .otherwise(F.concat(F.lit("#3#"), (F.col("p_partkey") % 3).cast("string")))
    )
    return ev.table("part").withColumn("k", F.concat("p_brand", tail)).select(
        "p_partkey",
        "k",
        keys.slot_key_of("k").alias("slot_key"),
        keys.capture_ordinal_of("k").alias("ordinal"),
        keys.capture_key_for("p_brand", "p_size").alias("made"),
    )


@query(
    "t23_zone_fingerprint",
    duck(
        "select run_id, claim_id, fp, coalesce(fp = stamp, false) as checked from (select *, page_index || ':' || from_line || '-' || to_line as fp,"
        " page_index || ':' || from_line || '-' || (to_line + claim_id % 2) as stamp from clm)",
        "clm",
    ),
)
def t23(ev: Evidence) -> DataFrame:
    c = ev.claims.withColumn(
        "stamp",
        keys.zone_fingerprint("page_index", "from_line", (F.col("to_line") + F.col("claim_id") % 2).cast("int")),
    )
    return c.select(
        "run_id",
        "claim_id",
        keys.zone_fingerprint("page_index", "from_line", "to_line").alias("fp"),
        keys.continuation_checked("stamp", "page_index", "from_line", "to_line").alias("checked"),
    )


@query(
    "t24_fnv1a",
    """
    select p_partkey, lpad(lower(hex(list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name,''), lambda c: ascii(c)::bigint)),
           lambda h, c: (xor(h, c) * 16777619) % 4294967296))), 8, '0') as hash from part
    """,
)
def t24(ev: Evidence) -> DataFrame:
    return ev.table("part").select("p_partkey", keys.fnv1a("p_name").alias("hash"))


def q_fixed(v: str, digits: int) -> str:
    """SQL of `to_fixed`: ties away from zero, by the double's exact value."""
    text = lambda x: f"printf('%.{digits}f', {x})"
    up = f"ceil(abs({v}) * {10**digits}) / {10**digits}"
    return f"(case when (abs({v}::double) * {2 ** (digits + 1)}) % 2 = 1 then case when {v} < 0 then '-' else '' end || {text(up)} else {text(v)} end)"


@query(
    "t25_report_numbers",
    f"""
    select c_custkey, case when n >= 1000000 then {q_fixed('(n/1000000)', 2)} || 'M' when n >= 1000 then {q_fixed('(n/1000)', 1)} || 'k' else cast(n::bigint as varchar) end as tokens,
           '$' || {q_fixed('(c_acctbal/7)', 4)} as usd,
           case when rel is null then 'n/a' when rel > 0 then '+' || {q_fixed('rel', 1)} else {q_fixed('rel', 1)} end as change
    from (select c_custkey, c_acctbal, floor(abs(c_acctbal) * (c_custkey % 900)) as n,
                 case when c_custkey % 9 = 0 then case when c_custkey % 2 = 0 then 0.0 end
                      else (c_acctbal - (c_custkey % 9)) / (c_custkey % 9) * 100 end as rel from customer)
    """,
)
def t25(ev: Evidence) -> DataFrame:
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    base = (k % 9).cast("double")
    cand = F.when(k % 9 == 0, F.when(k % 2 == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(bal)
    return ev.table("customer").select(
        "c_custkey",
        keys.compact_tokens(F.floor(F.abs(bal) * (k % 900))).alias("tokens"),
        keys.usd_text(bal / 7).alias("usd"),
        keys.signed(keys.relative(base, cand)).alias("change"),
    )


@query(
    "t26_labels_and_names",
    r"""
    select p_partkey, case when o <= 1 then p_name when o = 2 then p_name || ' (lanjutan)' else p_name || ' (lanjutan ' || (o-1) || ')' end as capture_label,
           replace(p_name || ' {{quote}} x', '{{quote}}', p_brand) as display_label,
           case when p_partkey % 2 = 0 then p_name else p_name end || ' / ' || p_type as search_label,
           'Form_Validasi_' || case p_partkey % 4 when 0 then 'LOP1_Q1' when 1 then 'LOP1' when 2 then 'Q1' else 'run-' || p_partkey end || '.docx' as docx_name,
           case p_partkey % 3 when 0 then p_name || '_TERBARU.xlsx' when 1 then p_name || '.v2_TERBARU.xlsx' else '.' || replace(p_name, ' ', '_') || '_TERBARU.xlsx' end as new_name
    from (select *, p_size % 5 as o from part)
    """,
)
def t26(ev: Evidence) -> DataFrame:
    k = F.col("p_partkey")
    section = F.concat("p_name", F.when(k % 2 == 0, " (Lanjutan) ").otherwise(""))
    epic = F.when(k % 4 <= 1, "LOP1").otherwise("")
    quote = F.when((k % 4 == 0) | (k % 4 == 2), "Q1").otherwise("")
    name = (
        F.when(k % 3 == 0, F.col("p_name"))
        .when(k % 3 == 1, F.concat("p_name", F.lit(".v2.xlsx")))
        .otherwise(F.concat(F.lit("."), F.regexp_replace("p_name", " ", "_")))
    )
    return ev.table("part").select(
        "p_partkey",
        keys.capture_label("p_name", F.col("p_size") % 5).alias("capture_label"),
        keys.display_label(F.concat("p_name", F.lit(" {{quote}} x")), "p_brand").alias("display_label"),
        keys.slot_search_label(section, "p_type").alias("search_label"),
        keys.deliverable_name(epic, quote, F.concat(F.lit("run-"), k.cast("string"))).alias("docx_name"),
        keys.updated_name(name).alias("new_name"),
    )
