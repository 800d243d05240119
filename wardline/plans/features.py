"""Cleaning, histories, policies, candidates and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.functions import clean, policy
from wardline.functions.policy import DIMS
from wardline.operators import augment, candidates, history, numbering, records, sampling, tolerance
from wardline.operators.ranking import block_lists
from wardline.plans import adapters as A
from wardline.plans.registry import query
from wardline.streaming.incremental import event_windows

NUMBERS = "case o_orderkey % 6 when 0 then ' ' || o_totalprice || ' ' when 1 then '' when 2 then 'abc' when 3 then '-' || o_custkey when 4 then o_custkey || '.9' else o_orderpriority end"


@query(f"select o_orderkey, coalesce(cast(trunc(try_cast(trim(x) as double)) as bigint), -1) as_int, coalesce(try_cast(trim(x) as double), 0.5) as_float, coalesce(lower(trim(x)) in ('1', 'true', 'yes', 'y', 't', '1.0'), false) as_bool from (select o_orderkey, {NUMBERS} x from orders)")
def tolerant_cast(spark, sf_dir):
    rows = A.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 6
    price = F.when(k == 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(20,2)").cast("double").cast("string"), F.lit(" ")))
    x = price.when(k == 1, "").when(k == 2, "abc").when(k == 3, F.concat(F.lit("-"), "o_custkey")).when(k == 4, F.concat("o_custkey", F.lit(".9"))).otherwise(F.col("o_orderpriority"))
    return rows.select("o_orderkey", clean.to_int(x, -1).alias("as_int"), clean.to_float(x, 0.5).alias("as_float"), clean.to_bool(x).alias("as_bool"))


LINES = "case i % 4 when 0 then u || '::' || i || '::5' when 1 then u || chr(9) || i || ',3' when 2 then u || ',' || i else '(' || u || ',' || i || ') 3' end"


@query(f"{A.PRELUDE} select u, i, array_to_string(case i % 4 when 0 then string_split(l, '::') when 1 then string_split(l, chr(9)) when 2 then string_split(l, ',') else string_split(l, ' ') end, '|') parts from (select u, i, {LINES} l from inter)")
def line_split_precedence(spark, sf_dir):
    rows = A.interactions(spark, sf_dir).select("u", "i")
    k = F.col("i") % 4
    line = F.when(k == 0, F.concat_ws("::", "u", "i", F.lit("5"))).when(k == 1, F.concat("u", F.lit("\t"), "i", F.lit(",3"))).when(k == 2, F.concat_ws(",", "u", "i")).otherwise(F.concat(F.lit("("), "u", F.lit(","), "i", F.lit(") 3")))
    return rows.select("u", "i", F.array_join(clean.split_line(line), "|").alias("parts"))


@query(r"select doc_id, case when length(t) <= 200 then t else regexp_replace(substr(t, 1, 200), ' [^ ]*$', '') || '...' end cleaned from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) t from documents)")
def clean_truncate(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", clean.clean_text(F.col("text"), 200).alias("cleaned"))


@query("select p_partkey, case when p_partkey % 7 = 0 then 'Not specified' else array_to_string(list_distinct_ordered, ', ') end genres from (select p_partkey, [p_name, p_type] list_distinct_ordered from part)")
def ordered_ci_dedup_list(spark, sf_dir):
    rows = A.read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 7 == 0, " ; ,").otherwise(F.concat("p_name", F.lit("|"), F.upper("p_name"), F.lit(","), "p_type", F.lit("/"), F.lower("p_type")))
    return rows.select("p_partkey", clean.distinct_list(text, 5).alias("genres"))


@query("select p_partkey, array_to_string(list_sort(list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))), '|') genres from part")
def genre_parse(spark, sf_dir):
    rows = A.read(spark, sf_dir, "part")
    text = F.concat_ws("|", F.lit("none"), F.replace("p_name", F.lit(" "), F.lit(", ")), F.upper("p_type"))
    return rows.select("p_partkey", F.array_join(clean.genre_set(text), "|").alias("genres"))


TEXTS = {"ECONOMY": "G - All Ages", "SMALL": "PG - Children", "MEDIUM": "PG-13 - Teens 13 or older", "PROMO": "R - 17+ (violence & profanity)", "STANDARD": "R+ - Mild Nudity", "LARGE": "Rx - Hentai"}


@query(f"select p_partkey, bucket, cast(case bucket when 'G' then 0 when 'PG' then 1 when 'PG13' then 2 when 'R17' then 3 when 'RPLUS' then 4 when 'RX' then 5 else -1 end as int) code from (select p_partkey, {A.SQL_BUCKET} bucket from part)")
def bucket_normalize(spark, sf_dir):
    text = F.lit("?")
    for kind, t in TEXTS.items():
        text = F.when(F.col("p_type") == kind, t).otherwise(text)
    bucket = clean.rating_bucket(text)
    return A.read(spark, sf_dir, "part").select("p_partkey", bucket.alias("bucket"), clean.bucket_code(bucket).alias("code"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k, event_type from events")
def jsonl_props_extract(spark, sf_dir):
    return A.read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"), "event_type")


@query("select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then c_name else 'none' end label from customer")
def alias_coalesce(spark, sf_dir):
    k = F.col("c_custkey") % 3
    value = clean.first_of(F.when(k == 0, F.col("c_mktsegment")).otherwise(" "), F.when(k == 1, F.col("c_name")), F.lit(""), F.lit("none"))
    return A.read(spark, sf_dir, "customer").select("c_custkey", value.alias("label"))


@query("select event_id, case when event_id % 3 = 0 then 1000 * event_id when event_id % 3 = 1 then cast(epoch(date_trunc('second', ts)) as bigint) * 1000 else 1000000000000 + event_id end ms from events")
def ts_coalesce_ms(spark, sf_dir):
    k = F.col("event_id") % 3
    seconds = F.when(k == 0, F.lit(None).cast("long")).when(k == 1, F.unix_timestamp(F.col("ts").cast("timestamp"))).otherwise(F.col("event_id") + 10**12)
    return A.read(spark, sf_dir, "events").select("event_id", clean.milliseconds(seconds, F.col("event_id") * 1000).alias("ms"))


@query("select o_orderkey, cast(case when a between 0 and 100 then a else -1 end as bigint) age from (select o_orderkey, year(o_orderdate) - 1899 - o_custkey % 110 - cast((month(o_orderdate), day(o_orderdate)) < (o_custkey % 12 + 1, o_custkey % 28 + 1) as int) a from orders)")
def age_at_event(spark, sf_dir):
    birth = F.make_date(F.col("o_custkey").cast("int") % 110 + 1899, F.col("o_custkey").cast("int") % 12 + 1, F.col("o_custkey").cast("int") % 28 + 1)
    return A.read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(clean.age_at(birth, F.col("o_orderdate")), F.lit(-1)).cast("long").alias("age"))


# ------------------------------------------------------------- histories


@query(f"{A.PRELUDE} select i, row_number() over (order by i) - 1 inner_id from (select distinct i from inter)")
def dense_ids(spark, sf_dir):
    return numbering.dense_ids(A.interactions(spark, sf_dir), "i", "inner_id")


@query("""with k as (select p_name, min(case when p_size < 25 then 0 else 1 end) late from part where p_name is not null group by 1)
select p_name, row_number() over (order by late, p_name) - 1 name_id from k""")
def extended_ids(spark, sf_dir):
    """Ids of names: those of small parts first, a later run's new names behind them."""
    names = A.read(spark, sf_dir, "part").select("p_name", "p_size")
    known = numbering.dense_ids(names.where("p_size < 25"), "p_name", "name_id")
    return numbering.extended_ids(known, names.where("p_name is not null"), "p_name", "name_id")


@query(f"{A.PRELUDE} select u, i, row_number() over (partition by u order by ts, i) history_rank, n history_len, back reverse_rank from hist")
def history_rank(spark, sf_dir):
    return history.ranked(A.interactions(spark, sf_dir)).select("u", "i", "history_rank", "history_len", "reverse_rank")


@query(f"{A.PRELUDE} select u, i, back from hist where back <= 5")
def last5_profile_items(spark, sf_dir):
    return history.last_k(A.interactions(spark, sf_dir), 5).select("u", "i", F.col("back").cast("long").alias("back"))


@query(f"{A.PRELUDE} select u, i, split from spl")
def leave_last_two_split(spark, sf_dir):
    return A.split(spark, sf_dir).select("u", "i", "split")


@query("select user_id, event_type, arg_max(value, (ts, event_id)) value from events group by 1, 2")
def keep_last_dedup(spark, sf_dir):
    return history.keep_last(A.read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query(f"{A.PRELUDE} select u + 1 u1, i + 1 i1, row_number() over (partition by u order by case split when 'train' then 0 when 'valid' then 1 else 2 end, ts, i) - 1 pos from spl")
def sequence_export(spark, sf_dir):
    return history.sequence_rows(A.split(spark, sf_dir)).select((F.col("u") + 1).alias("u1"), (F.col("i") + 1).alias("i1"), "pos")


@query(f"{A.PRELUDE} select u, count(*) total, count(*) filter (rating >= 4) positives from inter group by 1 having count(*) between 30 and 60 and count(*) filter (rating >= 4) >= 10")
def user_eligibility(spark, sf_dir):
    counts = A.interactions(spark, sf_dir).groupBy("u").agg(F.count("*").alias("total"), F.count_if(F.col("rating") >= 4).alias("positives"))
    return history.eligible(counts, 30, 60, 10)


# ------------------------------------------------------------- policies


@query(f"{A.PRELUDE} select i, is_minor, " + ", ".join(f"cast({d} >= case when is_minor then 3 else 4 end as int) {d}" for d in DIMS) + f", cast(is_adult and is_minor as int) adult_hard, cast({A.FLAGS} as int) unsafe_any from item cross join (values (true), (false)) t(is_minor)")
def dim5_flags(spark, sf_dir):
    rows = A.items(spark, sf_dir).withColumn("is_minor", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.select("i", "is_minor", *[v.alias(k) for k, v in policy.dim_flags(F.col("is_minor"), F.col("is_adult")).items()])


@query(f"{A.PRELUDE} select i, is_minor, cast(bucket = 'R17' and is_minor as int) r17, cast(bucket = 'RPLUS' as int) rplus, cast(bucket = 'RX' as int) rx, cast((bucket = 'R17' and is_minor) or bucket in ('RPLUS', 'RX') as int) unsafe_any from item cross join (values (true), (false)) t(is_minor)")
def risk3_flags(spark, sf_dir):
    rows = A.items(spark, sf_dir).withColumn("is_minor", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.select("i", "is_minor", *[v.alias(k) for k, v in policy.bucket_flags(F.col("is_minor"), F.col("bucket")).items()])


TOL = ["is_adult", *DIMS]


def sql_tolerance() -> str:
    raw = ", ".join(f"cast(case when coalesce(n, 0) >= 15 then o.{d} else g.{d} end as bigint) tol_raw_{d}" for d in TOL)
    tops = ", ".join(f"ceil(quantile_cont(cast({d} as int), 0.75)) {d}" for d in TOL)
    caps = ", ".join(f"cast(case when is_minor then least(tol_raw_{d}, {tolerance.MINOR_CAPS[d]}) else tol_raw_{d} end as bigint) tol_{d}" for d in TOL)
    return f"""{A.PRELUDE}, h as materialized (select spl.u, is_minor, item.* exclude (i, title, genres, bucket) from spl join usr using (u) join item using (i) where split = 'train'),
g as materialized (select is_minor, {tops} from h group by 1), o as materialized (select u, count(*) n, {tops} from h group by 1),
r as materialized (select usr.u, is_minor, coalesce(n, 0) train_history_count, cast(coalesce(n, 0) < 15 as int) used_population_default, {raw} from usr left join o using (u) left join g using (is_minor)),
tol as materialized (select *, {caps} from r)"""


def tol(spark, sf_dir):
    train = A.split(spark, sf_dir).where("split = 'train'").select("u", "i").join(A.items(spark, sf_dir), "i")
    return tolerance.tolerances(train, A.users(spark, sf_dir), 15)


@query(sql_tolerance() + " select * from tol")
def tolerance_p75(spark, sf_dir):
    return tol(spark, sf_dir)


@query(sql_tolerance() + ", x as (select spl.u, spl.i, cast(is_adult as int) is_adult, item.* exclude (i, is_adult), tol.* exclude (u) from spl join tol using (u) join item using (i) where split <> 'train') select u, i, cast(" + " and ".join(f"{d} <= tol_{d}" for d in TOL) + " as int) within_tolerance from x order by u, i")
def within_tolerance(spark, sf_dir):
    rows = A.split(spark, sf_dir).where("split <> 'train'").select("u", "i").join(A.items(spark, sf_dir), "i").join(tol(spark, sf_dir), "u")
    return rows.select("u", "i", policy.within_tolerance().alias("within_tolerance"))


@query(
    sql_tolerance()
    + ", x as (select spl.u, spl.i, item.* exclude (i), tol.* exclude (u) from spl join tol using (u) join item using (i) where split = 'test'), y as (select u, i, is_minor, list_concat(case when is_minor and is_adult then ['is_adult'] else [] end, list_filter(["
    + ", ".join(f"case when {d} >= 4 then '{d}' end" for d in DIMS)
    + "], lambda z: z is not null)) hard, list_filter(["
    + ", ".join(f"case when {d} < 4 and {d} > tol_{d} then '{d}' end" for d in DIMS)
    + "], lambda z: z is not null) soft from x) select u, i, array_to_string(list_sort(list_distinct(case when len(soft) >= case when is_minor then 2 else 3 end then list_concat(hard, soft) when len(hard) = 0 then soft[1:1] else hard end)), '|') triggers from y order by u, i"
)
def legacy_exceed_count(spark, sf_dir):
    rows = A.split(spark, sf_dir).where("split = 'test'").select("u", "i").join(A.items(spark, sf_dir), "i").join(tol(spark, sf_dir), "u")
    return rows.select("u", "i", F.array_join(policy.exceed_triggers(F.col("is_minor"), F.col("is_adult")), "|").alias("triggers"))


def quadrants(spark, sf_dir):
    rows = A.split(spark, sf_dir).where("split = 'train'").select("u", "i", "rating", "ts").join(A.users(spark, sf_dir), "u").join(A.items(spark, sf_dir), "i")
    rows = rows.withColumns({"liked": policy.preference(F.col("rating")), "safe": 1 - policy.dim_flags(F.col("is_minor"), F.col("is_adult"))["unsafe_any"]})
    return rows.where("liked is not null").withColumn("quadrant", policy.quadrant(F.col("liked"), F.col("safe")))


SQL_QUAD = f"""{A.PRELUDE}, quad as materialized (select u, i, case when rating >= 4 then 'like' else 'dislike' end || case when {A.FLAGS} = 0 then '_safe' else '_unsafe' end quadrant
  from spl join usr using (u) join item using (i) where split = 'train' and (rating >= 4 or rating <= 2))"""


@query(SQL_QUAD + " select quadrant, count(*) n, count(distinct u) users from quad group by 1")
def preference_quadrants(spark, sf_dir):
    return quadrants(spark, sf_dir).groupBy("quadrant").agg(F.count("*").alias("n"), F.count_distinct("u").alias("users"))


@query(SQL_QUAD + " select u, i, cast(quadrant = 'like_safe' as int) label, quadrant from quad")
def sft_labels(spark, sf_dir):
    return quadrants(spark, sf_dir).select("u", "i", ((F.col("liked") == 1) & (F.col("safe") == 1)).cast("int").alias("label"), "quadrant")


@query(f"{A.PRELUDE} select spl.u, spl.i, split, rating, is_minor, greatest(" + ", ".join(DIMS) + ") risk_max, round((" + " + ".join(DIMS) + ") / 5, 4) risk_mean, " + " + ".join(DIMS) + " risk_sum from spl join usr using (u) join item using (i)")
def enrich_split(spark, sf_dir):
    rows = A.split(spark, sf_dir).join(A.users(spark, sf_dir), "u").join(A.items(spark, sf_dir), "i")
    total = sum((F.col(d) for d in DIMS[1:]), F.col(DIMS[0]))
    return rows.select("u", "i", "split", "rating", "is_minor", F.greatest(*DIMS).alias("risk_max"), F.round(total / 5, 4).alias("risk_mean"), total.alias("risk_sum"))


@query("select cast(p_size % 5 as bigint) size_class, count(*) n, count(*) filter (p_partkey % 5 = 0) missing, round(count(*) filter (p_partkey % 5 <> 0) / count(*), 6) coverage from part group by 1")
def risk_missing_audit(spark, sf_dir):
    rows = A.read(spark, sf_dir, "part")
    codes = A.items(spark, sf_dir).where("i % 5 <> 0").select(F.col("i").alias("p_partkey"), "sex")
    full = rows.join(codes, "p_partkey", "left").withColumn("risk_missing", F.col("sex").isNull().cast("int"))
    return full.groupBy((F.col("p_size") % 5).cast("long").alias("size_class")).agg(F.count("*").alias("n"), F.sum("risk_missing").alias("missing"), F.round(F.avg(1 - F.col("risk_missing")), 6).alias("coverage"))


# ------------------------------------------------------------- candidates


@query(f"{A.PRELUDE}, c as (select item.i, count(spl.u) n from item left join spl on spl.i = item.i and split = 'train' group by 1) select i, n, round(ln(1 + n) / (select ln(1 + greatest(max(n), 1)) from c), 6) pop from c")
def popularity_log(spark, sf_dir):
    rows = candidates.popularity(A.split(spark, sf_dir).where("split = 'train'"), A.items(spark, sf_dir))
    return rows.withColumn("pop", F.round("pop", 6))


SQL_GENRE = f"""{A.PRELUDE}, c as (select item.i, genres, count(spl.u) n from item left join spl on spl.i = item.i and split = 'train' group by 1, 2), pop as (select i, genres, ln(1 + n) / (select ln(1 + greatest(max(n), 1)) from c) pop from c),
ug as (select u, list_sort(list_distinct(flatten(list(genres)))) ug from hist join item using (i) where back <= 5 and n >= 3 group by 1),
sc as (select ug.u, pop.i, 0.85::double * (len(list_intersect(ug, genres)) / len(list_distinct(list_concat(ug, genres)))) + 0.15::double * pop score from ug cross join pop where not exists (select 1 from inter s where s.u = ug.u and s.i = pop.i))"""


def genre_users(spark, sf_dir):
    rows = A.interactions(spark, sf_dir)
    last = history.last_k(rows, 5).join(A.split(spark, sf_dir).select("u").distinct(), "u", "left_semi")
    return block_lists(candidates.user_genres(last, A.items(spark, sf_dir)), rows)


def popular_items(spark, sf_dir):
    pop = candidates.popularity(A.split(spark, sf_dir).where("split = 'train'"), A.items(spark, sf_dir))
    return A.items(spark, sf_dir).select("i", "genres").join(pop.select("i", "pop"), "i")


@query(SQL_GENRE + " select u, i, round(score, 6) score from sc qualify row_number() over (partition by u order by round(score, 9) desc, i) <= 100")
def genre_jaccard_topn(spark, sf_dir):
    items = popular_items(spark, sf_dir)
    top = candidates.genre_top(genre_users(spark, sf_dir), items, 100)
    return top.select("u", "i", F.round("score", 6).alias("score"))


@query(f"{A.PRELUDE} select usr.u, cast((select count(*) from item) - count(i) as bigint) eligible_all, cast((select count(*) from item) - count(i) filter (split = 'train') as bigint) eligible_train_only from usr left join spl using (u) group by 1")
def block_pool_variants(spark, sf_dir):
    n = A.items(spark, sf_dir).agg(F.count("*").alias("n"))
    rows = A.split(spark, sf_dir).groupBy("u").agg(F.count("*").alias("seen"), F.count_if(F.col("split") == "train").alias("train"))
    out = A.users(spark, sf_dir).join(rows, "u", "left").join(F.broadcast(n), F.lit(True))
    return out.select("u", (F.col("n") - F.coalesce("seen", F.lit(0))).alias("eligible_all"), (F.col("n") - F.coalesce("train", F.lit(0))).alias("eligible_train_only"))


def sql_scores(score: str) -> str:
    return f"list_transform(range(1, len(rel) + 1), lambda k: case when free[k] then {score} else -1e9 end)"


def sql_without(taken: str) -> str:
    return f"list_transform(free, lambda f, k: f and k <> {taken})"


@query(
    f"""{SQL_GENRE.replace("with inter as", "with recursive inter as", 1)}, names as (select list_sort(list_distinct(flatten(list(genres)))) g from item),
top as materialized (select u, i, score, row_number() over (partition by u order by score desc, i) o from sc qualify o <= 600),
l as materialized (select u, list(top.i order by o) i, list(score order by o) rel, list(pop.pop order by o) pop, list(list_sum(list_transform(genres, lambda x: 1::bigint << cast(list_position(g, x) - 1 as int)))::bigint order by o) bits from top join pop on pop.i = top.i cross join names group by 1),
st(u, step, red, free, chosen) using key (u) as (select u, 0, list_transform(rel, lambda x: 0.0::double), list_transform(rel, lambda x: true), cast([] as bigint[]) from l
  union select u, step + 1, list_transform(red, lambda x, k: greatest(x, bit_count(bits[k] & bits[j]) / bit_count(bits[k] | bits[j]))), {sql_without("j")}, list_append(chosen, j)
  from (select *, list_position(s, list_max(s)) j from (select st.u, step, red, free, chosen, bits, {sql_scores("0.75::double * rel[k] - 0.25::double * red[k]")} s from st join l on l.u = st.u where step < 60 and len(chosen) < len(rel)))),
pp as (select u, list(k order by x desc, k) c from (select st.u, k, pop[k] x, row_number() over (partition by st.u order by pop[k] desc, k) n from st join l on l.u = st.u, unnest(range(1, len(rel) + 1)) t(k) where free[k]) where n <= 20 group by 1),
s2 as materialized (select st.u, chosen m, coalesce(c, []) c, list_transform(free, lambda f, k: f and not list_contains(coalesce(c, []), k)) free from st left join pp on pp.u = st.u),
dv(u, step, free, seen, chosen) using key (u) as (select s2.u, 0, free, list_reduce(list_transform(list_concat(m, c), lambda k: bits[k]), lambda x, y: x | y), cast([] as bigint[]) from s2 join l on l.u = s2.u
  union select u, step + 1, {sql_without("j")}, seen | bits[j], list_append(chosen, j) from (select *, list_position(s, list_max(s)) j from (select dv.u, step, free, seen, chosen, bits, {sql_scores("bit_count(bits[k] & ~seen) + 0.20::double * rel[k] + 0.10::double * pop[k]")} s from dv join l on l.u = dv.u where step < 20 and list_contains(free, true)))),
f as (select s2.u, list_concat(list_concat(list_transform(m, lambda k: {{'k': k, 'b': 'mmr'}}), list_transform(c, lambda k: {{'k': k, 'b': 'popularity'}})), list_concat(list_transform(dv.chosen, lambda k: {{'k': k, 'b': 'diversity'}}), list_transform(list_filter(range(1, len(dv.free) + 1), lambda k: dv.free[k]), lambda k: {{'k': k, 'b': 'relevance'}})))[:100] x from s2 join dv on dv.u = s2.u)
select f.u, l.i[x[n].k] i, x[n].b bucket, n place from f join l on l.u = f.u, unnest(range(1, len(x) + 1)) t(n)"""
)
def mmr_quota_mix(spark, sf_dir):
    rows = genre_users(spark, sf_dir)
    items = popular_items(spark, sf_dir)
    otherwise = lambda top: candidates.select_mixed(top.select("u", "i", F.col("score").alias("rel")).join(items, "i"))
    return candidates.genre_top(rows, items, 600, then=candidates.mixed_where_found, otherwise=otherwise)


# ------------------------------------------------------------- sampling


def sql_negatives(n: int, seed: int, who: str = "usr") -> str:
    """CTE neg (u, i, place): what sampling.negatives gives the users of a CTE who."""
    return f"""ids as materialized (select i, row_number() over (order by i) - 1 d from item),
dr as (select u, t, cast('0x' || substr(md5('{seed}|' || u || '|' || t), 1, 12) as bigint) % (select count(*) from item) d from {who} cross join (select unnest(generate_series(-1, {sampling.DRAWS * n - 1})) t)),
fr as materialized (select dr.u, ids.i, min(t) t from dr join ids using (d) left join inter s on s.u = dr.u and s.i = ids.i where s.u is null and t >= 0 group by 1, 2),
lack as materialized (select w.u, dr.d start from {who} w join dr on dr.u = w.u and t = -1 where (select count(*) from fr where fr.u = w.u) < {n}),
neg as materialized (select u, i, row_number() over (partition by u order by k) place from (select u, i, t k from fr union all
  select lack.u, ids.i, 1000000 + (ids.d - start + (select count(*) from item)) % (select count(*) from item) from lack cross join ids
  where not exists (select 1 from inter s where s.u = lack.u and s.i = ids.i) and not exists (select 1 from fr where fr.u = lack.u and fr.i = ids.i)) qualify place <= {n})"""


@query(f"{A.PRELUDE}, {sql_negatives(99, 7)} select u, i, place from neg")
def hash_negatives(spark, sf_dir):
    return sampling.negatives(A.users(spark, sf_dir), A.items(spark, sf_dir), A.interactions(spark, sf_dir), 99, 7)


@query("select u, is_minor from (select c_custkey u, c_custkey % 10 = 0 is_minor, row_number() over (partition by c_custkey % 10 = 0 order by md5('2028|' || c_custkey), c_custkey) k from customer) where k <= case when is_minor then 20 else 180 end")
def stratified_users(spark, sf_dir):
    return sampling.stratified(A.users(spark, sf_dir), "u", "is_minor", {True: 20, False: 180}, 2028)


@query("select u, case when row_number() over (order by md5('5|' || u), u) <= (select round_even(count(*) * 0.8, 0) from customer) then 'calib' else 'holdout' end part from (select c_custkey u from customer)")
def calib_holdout(spark, sf_dir):
    return sampling.hash_split(A.users(spark, sf_dir).select("u"), "u", 0.8, 5)


@query(
    SQL_QUAD
    + """, c as (select count(*) filter (quadrant = 'like_safe') ls, count(*) filter (quadrant = 'like_unsafe') a, count(*) filter (quadrant = 'dislike_safe') b, count(*) filter (quadrant = 'dislike_unsafe') d from quad),
t as (select least(500, ls) ls, a, b, d, least(200, a) ta, least(200, b) tb, least(100, d) td from c), s1 as (select *, 500 - ta - tb - td s from t), s2 as (select *, least(s, a - ta) xa from s1), s3 as (select *, least(s - xa, b - tb) xb from s2), s4 as (select *, least(s - xa - xb, d - td) xd from s3)
select u, i, quadrant from (select *, row_number() over (partition by quadrant order by md5('3|' || u || '|' || i), u, i) k from quad) cross join s4
where k <= case quadrant when 'like_safe' then ls when 'like_unsafe' then ta + xa when 'dislike_safe' then tb + xb else td + xd end"""
)
def quadrant_balanced(spark, sf_dir):
    return sampling.balanced(quadrants(spark, sf_dir).select("u", "i", "quadrant"), 500, 500, 3)


@query(
    f"""{A.PRELUDE}, m as (select u, 0 p, (u * 13 + 5) % (select count(*) from part) i from usr union all select u, 1, 999999999 from usr union all select u, 2, (u * 29 + 1) % (select count(*) from part) from usr union all select u, 3, (u * 13 + 5) % (select count(*) from part) from usr),
v as (select u, i, min(p) p from m join item using (i) group by 1, 2), e as (select *, count(*) over (partition by u) n from v)
select u, i, row_number() over (partition by u order by p) place from e where n >= 2 and not exists (select 1 from spl s where s.split = 'train' and s.u = e.u and s.i = e.i)"""
)
def generated_id_augment(spark, sf_dir):
    n = A.read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    a, b = (F.col("u") * 13 + 5) % F.col("n"), (F.col("u") * 29 + 1) % F.col("n")
    texts = A.users(spark, sf_dir).join(F.broadcast(n), F.lit(True)).select("u", F.concat(F.lit("I like i"), a, F.lit(", xi3 i999999999 and i"), b, F.lit("; again i"), a).alias("text"))
    return augment.generated_ids(texts, A.items(spark, sf_dir), A.split(spark, sf_dir).where("split = 'train'"), 10)


@query(
    f"""{A.PRELUDE}, {sql_negatives(200, 9)},
r as (select neg.u, neg.i, {A.FLAGS} unsafe, row_number() over (partition by neg.u order by {A.sql_base("neg.u", "neg.i")} + 0.5::double * ({A.sql_p1("neg.u", "neg.i")} - {A.sql_base("neg.u", "neg.i")}) desc, neg.i) r from neg join usr using (u) join item using (i))
select u, coalesce(arg_min(i, r) filter (unsafe = 0 and r <= 50), arg_min(i, r) filter (unsafe = 0)) safe_item, coalesce(arg_min(i, r) filter (unsafe = 1 and r <= 50), arg_min(i, r) filter (unsafe = 1)) unsafe_item from r group by 1"""
)
def hard_safety_pair(spark, sf_dir):
    """Per user one safe and one unsafe unseen item: the first of each among the 50 best by base + 0.5 * (p1 - base) of a hashed pool of 200."""
    pool = sampling.negatives(A.users(spark, sf_dir), A.items(spark, sf_dir), A.interactions(spark, sf_dir), 200, 9).join(A.users(spark, sf_dir), "u").join(A.items(spark, sf_dir), "i")
    proxy = A.base_col() + 0.5 * (A.p1_col() - A.base_col())
    pool = pool.withColumns({"unsafe": policy.dim_flags(F.col("is_minor"), F.col("is_adult"))["unsafe_any"], "r": F.row_number().over(Window.partitionBy("u").orderBy(F.desc(proxy), "i"))})
    first = lambda flag: F.coalesce(F.min_by("i", F.when((F.col("unsafe") == flag) & (F.col("r") <= 50), F.col("r"))), F.min_by("i", F.when(F.col("unsafe") == flag, F.col("r"))))
    return pool.groupBy("u").agg(first(0).alias("safe_item"), first(1).alias("unsafe_item"))


@query("select time_bucket(interval '1 hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def event_hour_windows(spark, sf_dir):
    rows = event_windows(A.read(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select conv_id, count(*) n_turns, string_agg(role || ': ' || text, chr(10) order by turn) prompt from conversations group by 1")
def conversation_prompts(spark, sf_dir):
    return records.conversation_prompts(A.read(spark, sf_dir, "conversations"))
