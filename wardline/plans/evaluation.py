"""Ranking, metrics, fusion, calibration and audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wardline.functions.policy import DIMS, bucket_flags, dim_flags
from wardline.operators import audit, augment, calibrate, metrics, sampling, scoring
from wardline.operators.ranking import block_lists, rank_catalogue
from wardline.plans import adapters as A
from wardline.plans.features import sql_negatives
from wardline.plans.registry import query
from wardline.sources.shared import stored, tasks

ALL_FLAGS = [*DIMS, "adult_hard", "unsafe_any"]
SQL_DIM_FLAGS = ", ".join(f"cast({d} >= case when is_minor then 3 else 4 end as bigint) f_{d}" for d in DIMS)


def sql_per(score: str, flags: str, names: list[str]) -> str:
    """CTEs up to ``per``: one row per user and cutoff."""
    return f"""{A.PRELUDE}, {A.sql_ranked(score)},
scored as (select r.u, r.is_minor, r.rank, r.i = t.i hit, {flags} from ranked r join item using (i) join spl t on t.u = r.u and t.split = 'test'),
per as (select u, is_minor, k, max(cast(hit as int)) hit, sum(case when hit then 1 / log2(rank + 1) else 0 end) ndcg, count(*) slots, {", ".join(f"sum(f_{n}) {n}" for n in names)}
  from scored join (values (1), (5), (10), (20)) v(k) on rank <= k group by 1, 2, 3)"""


def sql_metrics(score: str, flags: str, names: list[str]) -> str:
    return f"""{sql_per(score, flags, names)},
grouped as (select *, 'all' grp from per union all select *, case when is_minor then 'minor' else 'adult' end grp from per)
select cast(k as bigint) k, grp, count(*) users, round(avg(hit), 6) hr, round(avg(ndcg), 6) ndcg, {", ".join(f"round(sum({n}) / sum(slots), 6) {n}" for n in names)} from grouped group by 1, 2"""


DIM_SQL_FLAGS = f"{SQL_DIM_FLAGS}, cast(is_adult and r.is_minor as bigint) f_adult_hard, {A.FLAGS} f_unsafe_any"


def dim_metrics(spark, sf_dir, score):
    top, positives = A.ranked_test(spark, sf_dir, score)
    rows = top.join(A.items(spark, sf_dir), "i").withColumns({f"f_{k}": v for k, v in dim_flags(F.col("is_minor"), F.col("is_adult")).items()})
    rows = rows.select("u", "i", "rank", "is_minor", *[F.col(f"f_{n}").alias(n) for n in ALL_FLAGS])
    return metrics.per_user(rows, positives, ALL_FLAGS)


@query(sql_metrics(A.sql_base(), DIM_SQL_FLAGS.replace("is_minor", "r.is_minor").replace("r.r.", "r."), ALL_FLAGS))
def allranking_dim5_metrics(spark, sf_dir):
    return metrics.summarise(dim_metrics(spark, sf_dir, A.base_score), ALL_FLAGS)


@query(sql_metrics(f"{A.sql_base()} + 0.1::double * ({A.sql_aug()} - {A.sql_base()})", DIM_SQL_FLAGS.replace("is_minor", "r.is_minor").replace("r.r.", "r."), ALL_FLAGS))
def fused_allranking(spark, sf_dir):
    return metrics.summarise(dim_metrics(spark, sf_dir, A.fused_score), ALL_FLAGS)


RISK = ["r17", "rplus", "rx", "unsafe_any"]
RISK_SQL = "cast(bucket = 'R17' and r.is_minor as bigint) f_r17, cast(bucket = 'RPLUS' as bigint) f_rplus, cast(bucket = 'RX' as bigint) f_rx, cast((bucket = 'R17' and r.is_minor) or bucket in ('RPLUS', 'RX') as bigint) f_unsafe_any"


@query(sql_metrics(A.sql_base(), RISK_SQL, RISK))
def allranking_risk3_metrics(spark, sf_dir):
    top, positives = A.ranked_test(spark, sf_dir)
    rows = top.join(A.items(spark, sf_dir).select("i", "bucket"), "i")
    rows = rows.withColumns(bucket_flags(F.col("is_minor"), F.col("bucket")))
    return metrics.summarise(metrics.per_user(rows, positives, RISK), RISK)


@query(
    f"""{A.PRELUDE}, {A.sql_ranked(A.sql_base())},
per as (select u, r.is_minor, k, count(*) slots, sum({A.FLAGS.replace("is_minor", "r.is_minor")}) unsafe from ranked r join item using (i) join (values (1), (5), (10), (20)) v(k) on rank <= k group by 1, 2, 3),
grouped as (select *, 'all' grp from per union all select *, case when is_minor then 'minor' else 'adult' end from per)
select cast(k as bigint) k, grp, round(avg(unsafe / k), 6) exposure_k, round(avg(unsafe / slots), 6) exposure_len, round(avg(slots), 6) mean_length, round(avg(cast(slots = k as int)), 6) full_list_fraction from grouped group by 1, 2"""
)
def macro_exposure(spark, sf_dir):
    return metrics.macro(dim_metrics(spark, sf_dir, A.base_score), "unsafe_any")


PER_DIM = sql_per(A.sql_base(), DIM_SQL_FLAGS.replace("is_minor", "r.is_minor").replace("r.r.", "r."), ALL_FLAGS)


@query(
    f"""{PER_DIM}
select 'part_over_whole' "check", count(*) filter (greatest({", ".join([*DIMS, "adult_hard"])}) > unsafe_any) n from per union all select 'whole_over_slots', count(*) filter (unsafe_any > slots) from per"""
)
def metric_consistency(spark, sf_dir):
    return audit.exposure_faults(dim_metrics(spark, sf_dir, A.base_score), [*DIMS, "adult_hard"], "unsafe_any")


@query(
    f"""{PER_DIM}, bad as (select u, k, slots, case when u % 7 = 0 then unsafe_any + 1 else sex end sex, case when u % 11 = 0 then slots + 2 else unsafe_any end unsafe_any from per)
select 'part_over_whole' "check", count(*) filter (sex > unsafe_any) n from bad union all select 'whole_over_slots', count(*) filter (unsafe_any > slots) from bad"""
)
def metric_faults_found(spark, sf_dir):
    """The same check over rows with planted faults."""
    rows = dim_metrics(spark, sf_dir, A.base_score)
    planted = {"sex": F.when(F.col("u") % 7 == 0, F.col("unsafe_any") + 1).otherwise(F.col("sex")), "unsafe_any": F.when(F.col("u") % 11 == 0, F.col("slots") + 2).otherwise(F.col("unsafe_any"))}
    return audit.exposure_faults(rows.withColumns(planted), ["sex"], "unsafe_any")


@query(
    f"""{A.PRELUDE},
who as materialized (select distinct u from spl), {sql_negatives(99, 7, "who")},
cand as (select u, i, 0 pos from neg union all select u, i, 1 from spl where split = 'test'),
r as (select u, i, pos, row_number() over (partition by u order by {A.sql_base("u", "i")} desc, i) rank from cand),
k as (select k, u, max(case when pos = 1 and rank <= k then 1 else 0 end) hit, sum(case when pos = 1 and rank <= k then ln(2) / ln(rank + 1) else 0 end) ndcg from r cross join (values (1), (5), (10), (20)) v(k) group by 1, 2)
select cast(k as bigint) k, count(*) users, round(avg(hit), 6) hr, round(avg(ndcg), 6) ndcg from k group by 1"""
)
def sampled_1p99_metrics(spark, sf_dir):
    rows = A.split(spark, sf_dir)
    who = A.users(spark, sf_dir).join(rows.select("u").distinct(), "u", "left_semi")
    drawn = sampling.negatives(who, A.items(spark, sf_dir), A.interactions(spark, sf_dir), 99, 7)
    cand = drawn.select("u", "i", F.lit(0).alias("pos")).unionByName(rows.where("split = 'test'").select("u", "i", F.lit(1).alias("pos")))
    from pyspark.sql import Window

    r = cand.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc(A.base_col()), "i"))).where("pos = 1")
    r = r.withColumn("k", F.explode(F.array(*[F.lit(k) for k in metrics.KS]))).withColumn("hit", (F.col("rank") <= F.col("k")).cast("int"))
    gain = F.when(F.col("hit") == 1, F.log(F.lit(2.0)) / F.log(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    return r.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("users"), F.round(F.avg("hit"), 6).alias("hr"), F.round(F.avg(gain), 6).alias("ndcg"))


@query(
    f"""{A.PRELUDE}
select u, i, round({A.sql_base("u", "i")}, 6) base, round({A.sql_aug("u", "i")}, 6) aug, round({A.sql_base("u", "i")} + 0.1::double * ({A.sql_aug("u", "i")} - {A.sql_base("u", "i")}), 6) fused from inter"""
)
def fusion_fixed_alpha(spark, sf_dir):
    rows = A.interactions(spark, sf_dir).select("u", "i")
    b, p = A.base_col(), A.aug_col()
    return rows.select("u", "i", F.round(b, 6).alias("base"), F.round(p, 6).alias("aug"), F.round(scoring.fused(b, p, F.lit(0.1)), 6).alias("fused"))


GATE = {"relevance": ([0.5, -0.25, 1.0, 0.1, 0.2, 0.7, 0.3, -0.1, 0, 0, 0, 0, 0, -0.5], 0.1), "safety": ([0, 0, 0.2, 0, 0.1, 0.1, 0.1, -0.4, -0.3, -0.3, -0.3, -0.3, -0.6, -1.2], 0.8), "trust": ([0, 0, -0.5, -0.5, 0.4, 0.9, 0.6, 0, 0, 0, 0, 0, 0, 0], 0.0)}


def featured(spark, sf_dir):
    rows = A.interactions(spark, sf_dir).select("u", "i").join(A.users(spark, sf_dir), "u").join(A.items(spark, sf_dir), "i")
    p1 = A.p1_col()
    rows = rows.withColumns({"base": A.base_col(), "aug": A.aug_col(), "p1": p1, "psg_pred": (p1 >= 0.5).cast("int"), "margin": 2 * p1 - 1})
    flags = dim_flags(F.col("is_minor"), F.col("is_adult"))
    return rows.select("u", "i", "is_minor", "base", "aug", "p1", "psg_pred", "margin", *[v.alias(k) for k, v in flags.items()])


FEATURES = ["base", "aug", "gap", "abs_gap", "pred", "p1", "margin", "minor", "violence", "profanity", "drug", "intense", "adult_hard", "unsafe_any"]
SQL_FEATURES = f"""{A.PRELUDE}, f as (select u, i, {A.sql_base("u", "i")} base, {A.sql_aug("u", "i")} aug, {A.sql_p1("u", "i")} p1, is_minor, item.* exclude (i) from inter join usr using (u) join item using (i)),
x as (select u, i, base, aug, aug - base gap, abs(aug - base) abs_gap, cast(p1 >= 0.5 as double) pred, p1, 2 * p1 - 1 margin, cast(is_minor as double) minor,
  {", ".join(f"cast({d} >= case when is_minor then 3 else 4 end as double) {d}" for d in DIMS[1:])}, cast(is_adult and is_minor as double) adult_hard, cast({A.FLAGS} as double) unsafe_any from f)"""


@query(SQL_FEATURES + " select u, i, " + ", ".join(f"round({n}, 6) {n}" for n in FEATURES) + " from x")
def fusion_features(spark, sf_dir):
    return featured(spark, sf_dir).select("u", "i", *[F.round(v, 6).alias(k) for k, v in scoring.gate_features().items()])


def sql_head(w: list[float], b: float) -> str:
    return f"1 / (1 + exp(-({b}::double" + "".join(f" + {n} * {float(x)}::double" for n, x in zip(FEATURES, w, strict=True)) + ")))"


@query(SQL_FEATURES + f" select u, i, round(base + 0.8::double * ({') * ('.join(sql_head(*h) for h in GATE.values())}) * (aug - base), 6) score from x")
def gate_threehead(spark, sf_dir):
    gate = scoring.three_heads(scoring.gate_features(), GATE, 0.8)
    return featured(spark, sf_dir).select("u", "i", F.round(scoring.fused(F.col("base"), F.col("aug"), gate), 6).alias("score"))


@query(
    """with p as (select vec_id u, embedding e from embeddings), q as (select vec_id i, embedding e from embeddings)
select p.u, q.i, round(1 / (1 + exp(-(2.0 * list_sum(list_transform(list_zip(p.e, q.e), lambda z: cast(z[1] as double) * cast(z[2] as double))) + 0.1))), 5) score from p join q on q.i = (p.u * 7 + 3) % (select count(*) from q)"""
)
def gmf_dot(spark, sf_dir):
    v = A.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    p = v.select(F.col("vec_id").alias("u"), F.col("embedding").alias("p")).join(F.broadcast(n), F.lit(True)).withColumn("i", (F.col("u") * 7 + 3) % F.col("n"))
    pairs = p.join(v.select(F.col("vec_id").alias("i"), F.col("embedding").alias("q")), "i")
    w = F.transform("p", lambda x: F.lit(2.0))
    return pairs.select("u", "i", F.round(scoring.gmf(F.col("p"), F.col("q"), w, 0.1), 5).alias("score"))


@query(
    f"""{A.PRELUDE}, e as materialized (select 'u' || u a, 'i' || i b from inter union all select 'i' || i, 'u' || u from inter),
d as materialized (select a, count(*) d from e group by 1),
n as materialized (select a node, dim, ((length(a) * 7 + dim * 3 + cast(substr(a, 2) as bigint)) % 11) / 11.0::double x from d cross join (values (0), (1), (2), (3)) t(dim)),
m as materialized (select e.a node, dim, sum(x / sqrt(cast(d1.d as double) * d2.d)) x from e join d d1 on d1.a = e.a join d d2 on d2.a = e.b join n on n.node = e.b group by 1, 2)
select n.node, cast(n.dim as bigint) dim, round((n.x + coalesce(m.x, 0)) / 2, 6) x from n left join m using (node, dim)"""
)
def lightgcn_propagate_1hop(spark, sf_dir):
    rows = A.interactions(spark, sf_dir).select(F.concat(F.lit("u"), "u").alias("a"), F.concat(F.lit("i"), "i").alias("b"))
    edges = rows.union(rows.select("b", "a"))
    nodes = edges.select(F.col("a").alias("node")).distinct().withColumn("dim", F.explode(F.array(*[F.lit(d).cast("long") for d in range(4)])))
    x = ((F.length("node") * 7 + F.col("dim") * 3 + F.substring("node", 2, 20).cast("long")) % 11) / F.lit(11.0)
    return scoring.propagate(edges, nodes.withColumn("x", x), 1, 6)


def predictions(spark, sf_dir):
    """Pseudo-label predictions of a stated set of pairs: each user with 40 items."""
    n = A.read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    # users come in few files: dealt before each becomes forty rows, so that no task sorts them all
    who = A.users(spark, sf_dir).repartition(tasks(spark), "u")
    rows = who.join(F.broadcast(n), F.lit(True)).withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))))
    rows = rows.withColumn("i", (F.col("u") * 13 + F.col("rank") * 37) % F.col("n"))
    return rows.select("u", "i", "rank", A.p1_col().alias("p1")).withColumns({"psg_pred": (F.col("p1") >= 0.5).cast("long"), "margin": 2 * F.col("p1") - 1})


SQL_PRED = f"""pred as (select u, i, rank, p1, cast(p1 >= 0.5 as bigint) psg_pred, 2 * p1 - 1 margin from (select u, i, rank, {A.sql_p1("u", "i")} p1 from
  (select u, rank, (u * 13 + rank * 37) % (select count(*) from part) i from usr cross join (select unnest(generate_series(1, 40)) rank))))"""


@query(
    f"""{A.PRELUDE}, {SQL_PRED},
n as (select u, count(*) n from spl where split = 'train' group by 1),
f as (select u, i, n, arg_max(p1, (p1, margin, -rank)) p1, arg_max(rank, (p1, margin, -rank)) rank from pred join n using (u) where psg_pred = 1 and p1 >= 0.6 and margin >= 0.2 and not exists (select 1 from spl s where s.split = 'train' and s.u = pred.u and s.i = pred.i) group by all),
r as (select *, row_number() over (partition by u order by p1 desc, 2 * p1 - 1 desc, rank, i) k from f)
select u, i, 'observed' source from spl where split = 'train' union all select u, i, 'pseudo' from r where k <= greatest(1, round_even(n * 0.2, 0))"""
)
def inject_quota(spark, sf_dir):
    train = A.split(spark, sf_dir).where("split = 'train'")
    return augment.inject(train, augment.gated(predictions(spark, sf_dir), 0.6, 0.2), 0.2)


@query(
    f"""{A.PRELUDE}, {SQL_PRED}
select psg_pred, count(*) n, count(*) filter (rank <= 10) top10, count(*) filter (rank <= 20) top20, round(avg(p1), 6) mean_p1, round(min(margin), 6) min_margin, round(max(margin), 6) max_margin from pred group by 1"""
)
def prediction_stats(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("psg_pred").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("rank") <= 10, 1)).alias("top10"),
        F.count(F.when(F.col("rank") <= 20, 1)).alias("top20"),
        F.round(F.avg("p1"), 6).alias("mean_p1"),
        F.round(F.min("margin"), 6).alias("min_margin"),
        F.round(F.max("margin"), 6).alias("max_margin"),
    )


def safety_ranked(spark, sf_dir):
    top, _ = A.ranked_test(spark, sf_dir, k=60)
    rows = top.join(A.items(spark, sf_dir), "i")
    unsafe = dim_flags(F.col("is_minor"), F.col("is_adult"))["unsafe_any"]
    return rows.select("u", "i", "score", "rank", "is_minor", A.p1_col().alias("safety"), unsafe.alias("unsafe"))


def safe_past(spark, sf_dir):
    """u, i, score, unsafe (0) of each user's safe training items."""
    past = A.split(spark, sf_dir).where("split = 'train'").select("u", "i").join(A.users(spark, sf_dir), "u").join(A.items(spark, sf_dir), "i")
    return past.where(dim_flags(F.col("is_minor"), F.col("is_adult"))["unsafe_any"] == 0).select("u", "i", A.base_col().alias("score"), F.lit(0).alias("unsafe"))


SAFE_PAST = f"select spl.u, spl.i, {A.sql_base('spl.u', 'spl.i')} score from spl join usr using (u) join item using (i) where split = 'train' and {A.FLAGS} = 0"
SQL_CURVE = f"""{A.PRELUDE}, {A.sql_ranked(A.sql_base(), 60)},
s as materialized (select r.u, r.rank, {A.sql_p1("r.u", "r.i")} safety, {A.FLAGS.replace("is_minor", "r.is_minor")} unsafe from ranked r join item using (i)),
grid as (select g, g / 99.0::double gamma from (select unnest(generate_series(0, 99)) g) union all select 100, 1.0000000000000002::double),
a as (select u, g, unsafe, row_number() over (partition by u, g order by rank) k from s join grid on safety >= gamma),
risk as (select u, g, sum(unsafe) / 20 risk from a where k <= 20 group by 1, 2),
f as (select t.u, grid.g, gamma, coalesce(risk, 0) risk from (select distinct u from s) t cross join grid left join risk on risk.u = t.u and risk.g = grid.g),
e as (select *, max(risk) over (partition by u order by g desc rows unbounded preceding) top from f),
curve as (select cast(g as bigint) g, gamma, avg(risk) "raw", avg(top) envelope, (count(*) * avg(top) + 1) / (count(*) + 1) adjusted from e group by 1, 2)"""


@query(SQL_CURVE + ' select g, round("raw", 6) "raw", round(envelope, 6) envelope, round(adjusted, 6) adjusted from curve')
def crc_calibration(spark, sf_dir):
    curve = calibrate.risk_curve(safety_ranked(spark, sf_dir), calibrate.thresholds(spark))
    return curve.select("g", *[F.round(c, 6).alias(c) for c in ("raw", "envelope", "adjusted")])


@query(
    f"""{A.PRELUDE}, {A.sql_ranked(A.sql_base(), 60)}, past as materialized ({SAFE_PAST}),
m as (select u, i, score, {A.sql_p1("u", "i")} safety, {A.FLAGS.replace("is_minor", "r.is_minor")} unsafe from ranked r join item using (i) anti join past using (u, i) union all select past.u, past.i, past.score, 2.0::double, 0 from past where u in (select u from ranked)),
grid as (select g, g / 99.0::double gamma from (select unnest(generate_series(0, 99)) g) union all select 100, 1.0000000000000002::double),
a as (select u, g, unsafe, row_number() over (partition by u, g order by score desc, i) k from m join grid on safety >= gamma),
risk as (select u, g, sum(unsafe) / 20 risk from a where k <= 20 group by 1, 2),
f as (select t.u, grid.g, gamma, coalesce(risk, 0) risk from (select distinct u from ranked) t cross join grid left join risk on risk.u = t.u and risk.g = grid.g),
e as (select *, max(risk) over (partition by u order by g desc rows unbounded preceding) top from f)
select cast(g as bigint) g, round(avg(risk), 6) "raw", round(avg(top), 6) envelope, round((count(*) * avg(top) + 1) / (count(*) + 1), 6) adjusted from e group by 1"""
)
def crc_calibration_history(spark, sf_dir):
    """The curve of lists that safe past items are merged into."""
    curve = calibrate.risk_curve(safety_ranked(spark, sf_dir), calibrate.thresholds(spark), safe_past(spark, sf_dir))
    return curve.select("g", *[F.round(c, 6).alias(c) for c in ("raw", "envelope", "adjusted")])


FRACTIONS = [1.0, 0.75, 0.5, 0.25, 0.1, 0.0]


@query(
    SQL_CURVE
    + ', fr as (select unnest([1.0, 0.75, 0.5, 0.25, 0.1, 0.0])::double fraction), b as (select "raw" base from curve where g = 0) select fraction, round(max(base * fraction), 6) alpha, coalesce(min(g) filter (adjusted <= base * fraction), max(g)) g from curve cross join fr cross join b group by 1'
)
def crc_threshold_choice(spark, sf_dir):
    curve = calibrate.risk_curve(safety_ranked(spark, sf_dir), calibrate.thresholds(spark))
    return calibrate.choose(curve, FRACTIONS).withColumn("alpha", F.round("alpha", 6))


@query(
    f"""{A.PRELUDE}, {A.sql_ranked(A.sql_base(), 60)}
select u, i, place from (select u, i, row_number() over (partition by u order by score desc, i) place from ranked where {A.sql_p1("u", "i")} >= 0.3) where place <= 20"""
)
def crc_select_remove(spark, sf_dir):
    return calibrate.select_safe(safety_ranked(spark, sf_dir), 0.3)


@query(
    f"""{A.PRELUDE}, {A.sql_ranked(A.sql_base(), 60)},
m as (select u, i, score from ranked where {A.sql_p1("u", "i")} >= 0.3 union {SAFE_PAST})
select u, i, place from (select u, i, row_number() over (partition by u order by score desc, i) place from m) where place <= 20"""
)
def crc_select_history_union(spark, sf_dir):
    return calibrate.select_safe(safety_ranked(spark, sf_dir), 0.3, safe_past(spark, sf_dir))


JUDGE_FWD, JUDGE_REV = "(lo * 3 + hi * 5 + m) % 3", "(lo * 7 + hi * 2 + m) % 3"


@query(
    f"""{A.PRELUDE}, {A.sql_ranked(A.sql_base())},
p as (select a.u, cast(a.is_minor as int) m, least(a.i, b.i) lo, greatest(a.i, b.i) hi from ranked a join ranked b on a.u = b.u and a.rank < b.rank),
j as (select *, {JUDGE_FWD} f, {JUDGE_REV} r from p),
v as (select u, lo i, cast(f = 0 as int) + cast(r = 1 as int) v from j union all select u, hi, cast(f = 1 as int) + cast(r = 0 as int) from j),
s as (select u, i, cast(sum(v) as bigint) votes from v group by 1, 2)
select u, i, coalesce(votes, 0) votes, row_number() over (partition by u order by coalesce(votes, 0), rank) place from ranked left join s using (u, i)"""
)
def harm_vote_rerank(spark, sf_dir):
    top = stored(A.ranked_test(spark, sf_dir)[0].select("u", "is_minor", "i", "rank"))
    _, kinds = calibrate.alike(top)
    pairs = kinds.alias("a").join(kinds.alias("b"), F.expr("a.u = b.u and a.rank < b.rank")).select("a.is_minor", F.expr("cast(a.is_minor as int)").alias("m"), F.least("a.i", "b.i").alias("lo"), F.greatest("a.i", "b.i").alias("hi")).distinct()
    judged = pairs.select("is_minor", "lo", "hi", F.expr(JUDGE_FWD).alias("choice_fwd"), F.expr(JUDGE_REV).alias("choice_rev"))
    return calibrate.vote_rerank(top, judged)


@query(
    f"""{A.PRELUDE}, {A.sql_ranked(A.sql_base())}, {A.sql_ranked(A.sql_aug()).replace("ranked as", "other as")},
x as (select u, sum({A.FLAGS}) / 20 v from ranked join item using (i) group by 1), y as (select u, sum({A.FLAGS}) / 20 v from other join item using (i) group by 1)
select count(y.v - x.v) n, round(avg(y.v - x.v), 6) mean_diff, count(*) filter (x.v is null or y.v is null) unpaired from x full join y using (u)"""
)
def paired_diff_mean(spark, sf_dir):
    def exposure(score):
        return dim_metrics(spark, sf_dir, score).where("k = 20").select("u", (F.col("unsafe_any") / 20).alias("v"))

    return audit.paired_means(exposure(A.base_score), exposure(A.aug_score), "v")


STEPS = " + ".join(f"cast(z > {t!r}::double as int)" for t in audit.poisson_steps())


@query(
    f"""{PER_DIM}, v as materialized (select u, unsafe_any / 20.0::double - hit v from per where k = 20),
b as (select v, b, md5('7|' || u || '|' || b) d from v cross join (select unnest(generate_series(0, 499)) b)),
z as (select v, b * 4 + q r, (cast('0x' || substr(d, 8 * q + 1, 8) as bigint) + 0.5::double) / 4294967296.0::double z from b cross join (values (0), (1), (2), (3)) t(q)),
m as (select r, sum(w * v) / greatest(sum(w), 1) m from (select r, v, {STEPS} w from z) group by 1)
select round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high, (select round(avg(v), 6) from v) mean from m"""
)
def paired_bootstrap(spark, sf_dir):
    base = dim_metrics(spark, sf_dir, A.base_score).where("k = 20").select("u", (F.col("unsafe_any") / 20 - F.col("hit")).alias("v"))
    found = audit.bootstrap(base, "v")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def sql_leaks(rows: str) -> str:
    """The six counts of split_leaks over a CTE with u, i, ts, split."""
    out = []
    for a, b in (("train", "valid"), ("train", "test"), ("valid", "test")):
        out.append(f"select '{a}_{b}_overlap' \"check\", count(*) n from {rows} x where split = '{a}' and exists (select 1 from {rows} y where y.split = '{b}' and y.u = x.u and y.i = x.i)")
        out.append(f"select '{a}_{b}_time', count(*) from (select u, max(ts) hi from {rows} where split = '{a}' group by 1) x join (select u, min(ts) lo from {rows} where split = '{b}' group by 1) y using (u) where hi > lo")
    return " union all ".join(out)


@query(f"{A.PRELUDE} {sql_leaks('spl')}")
def split_leakage_audit(spark, sf_dir):
    return audit.split_leaks(A.split(spark, sf_dir))


FAULTY = """faulty as materialized (select u, i, ts, split from spl union all select u, i, ts, 'valid' from spl where split = 'train' and u % 10 = 0 union all select u, i, ts - interval '4000 days', 'test' from spl where split = 'valid' and u % 4 = 0)"""


def faulty_split(spark, sf_dir):
    """The split with planted faults: training pairs that are also valid, valid pairs that are also old test pairs."""
    rows = A.split(spark, sf_dir).select("u", "i", "ts", "split")
    twice = rows.where("split = 'train' and u % 10 = 0").withColumn("split", F.lit("valid"))
    old = rows.where("split = 'valid' and u % 4 = 0").withColumns({"split": F.lit("test"), "ts": F.col("ts") - F.expr("interval 4000 days")})
    return rows.union(twice).union(old)


@query(f"{A.PRELUDE}, {FAULTY} {sql_leaks('faulty')}")
def split_leakage_found(spark, sf_dir):
    """The same audit over a split with planted faults."""
    return audit.split_leaks(faulty_split(spark, sf_dir))


@query(
    f"""{A.PRELUDE}, pool as (select u, case when u % 9 = 0 then pos + 1 else pos end pos, place, x i from (select u, i pos, unnest([1, 2]) place, unnest([(i * 3 + 1) % 1000, (u + i) % 1000]) x from spl where split = 'test')),
heads as (select distinct u, pos i from pool), want as (select u, i from spl where split = 'test')
select 'test_negative_leak' "check", count(distinct p.u) n from pool p where exists (select 1 from spl s where s.u = p.u and s.i = p.i)
union all select 'test_head_mismatch', count(distinct u) from ((select * from heads except select * from want) union all (select * from want except select * from heads))"""
)
def negative_pool_audit(spark, sf_dir):
    """Pools of the test pairs, some with a wrong head, against all interactions."""
    rows = A.split(spark, sf_dir)
    test = rows.where("split = 'test'")
    each = F.array((F.col("i") * 3 + 1) % 1000, (F.col("u") + F.col("i")) % 1000)
    pool = test.select("u", F.when(F.col("u") % 9 == 0, F.col("i") + 1).otherwise(F.col("i")).alias("pos"), F.posexplode(each).alias("place", "i"))
    return audit.pool_leaks(rows, {"test": pool.select("u", "pos", (F.col("place") + 1).alias("place"), "i")})


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def dup_key_audit(spark, sf_dir):
    return audit.duplicate_keys(A.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("select count(*) total, count(l.doc_id) matched, round(count(l.doc_id) / count(*), 6) coverage from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def coverage_audit(spark, sf_dir):
    return audit.coverage(A.read(spark, sf_dir, "documents"), A.read(spark, sf_dir, "labels"), "doc_id")


@query(
    f"""{A.PRELUDE} select count(*) n_rows, count(distinct u) n_users, count(distinct i) n_items, round(avg(rating), 6) mean_rating, cast(sum(cast(rating >= 4 as int)) as bigint) liked, max(u) + 1 dim_users, max(i) + 1 dim_items,
 count(*) filter (split = 'train') n_train, count(*) filter (split = 'valid') n_valid, count(*) filter (split = 'test') n_test from spl"""
)
def build_summary(spark, sf_dir):
    n = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}")
    return A.split(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.count_distinct("u").alias("n_users"), F.count_distinct("i").alias("n_items"), F.round(F.avg("rating"), 6).alias("mean_rating"),
        F.sum((F.col("rating") >= 4).cast("long")).alias("liked"), (F.max("u") + 1).alias("dim_users"), (F.max("i") + 1).alias("dim_items"), n("train"), n("valid"), n("test"),
    )
