"""Chunking, tags, retrieval, rerank, rules and leak checks over the text tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.operators import candidates, records, retrieval, vector_index
from wardline.plans import adapters as A
from wardline.plans.files import folder
from wardline.plans.registry import ORACLE, query

#: Tag lexicons over the synthetic corpus' words.
LEXICON = {"minor": ["children", "the", "niñ"], "sex": ["idiot", "scum"], "violence": ["trash", "clown"], "adult_content": ["license", "copyright"], "drug": ["password", "token"]}


@query("with s as (select doc_id, text, length(text) n from documents where length(text) > 0) select doc_id, n.n, n.n * 570 start, substr(text, n.n * 570 + 1, 650) chunk from (select doc_id, text, unnest(generate_series(0, greatest(0, cast(ceil((n - 650) / 570.0) as bigint)))) n from s) n")
def chunk_sliding(spark, sf_dir):
    return retrieval.sliding_chunks(A.read(spark, sf_dir, "documents"), "doc_id")


SQL_TAGS = "list_filter([" + ", ".join("case when " + " or ".join(f"contains(lower(text), '{w}')" for w in words) + f" then '{tag}' end" for tag, words in sorted(LEXICON.items())) + "], lambda x: x is not null)"


@query(f"select doc_id, case when len(t) > 0 then array_to_string(t, '|') else 'general' end tags from (select doc_id, {SQL_TAGS} t from documents)")
def keyword_tags(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", F.array_join(retrieval.tags(F.col("text"), LEXICON), "|").alias("tags"))


SQL_NEAR = "(select q.vec_id q, c.vec_id c, c.label, round(list_dot_product(cast(q.embedding as double[]), cast(c.embedding as double[])), 9) score from embeddings q cross join embeddings c where q.vec_id % 20 = 0)"


def near(spark, sf_dir, k):
    """The vectors whose id is divisible by 20 as queries, against all vectors."""
    v = A.read(spark, sf_dir, "embeddings")
    found = retrieval.nearest(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), v.select(F.col("vec_id").alias("c"), F.col("embedding").alias("cv")), k)
    return found.join(v.select(F.col("vec_id").alias("c"), "label"), "c")



@query(f"select q, c, round(score, 5) score, rank from (select *, row_number() over (partition by q order by score desc, c) rank from {SQL_NEAR}) where rank <= 20")
def dense_retrieve_topn(spark, sf_dir):
    return near(spark, sf_dir, 20).select("q", "c", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


#: Cells of the registered index, and those that its fast search visits: the given embeddings form no clusters, so most cells are needed.
CELLS, PROBES = 16, 12


def indexed(spark, sf_dir, k: int, exact: bool):
    v, at = A.read(spark, sf_dir, "embeddings"), folder(spark, sf_dir, "index")
    vector_index.build_index(v.select(F.col("vec_id").alias("c"), F.col("embedding").alias("cv")), at, CELLS)
    return vector_index.search(spark, at, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), k, PROBES, exact)


@query(ORACLE["dense_retrieve_topn"])
def indexed_retrieve_topn(spark, sf_dir):
    """The rows of the full scan, from a stored index whose cells are left out by their bounds."""
    return indexed(spark, sf_dir, 20, True).select("q", "c", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def indexed_recall(spark, sf_dir):
    """Of the 20 nearest by the full scan, the share that the fast search of the stored index finds."""
    true = near(spark, sf_dir, 20).select("q", "c")
    found = indexed(spark, sf_dir, 20, False).select("q", "c", F.lit(1).alias("hit"))
    return true.join(found, ["q", "c"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


#: The synthetic tag of an embedding's label.
LABEL_TAGS = ("minor", "adult", "sex", "violence", "drug", "general", "adult_content")
SQL_LABEL = "['minor', 'adult', 'sex', 'violence', 'drug', 'general', 'adult_content'][cast(label % 7 as int) + 1]"


def raw(spark, sf_dir):
    tag = F.element_at(F.array(*[F.lit(t) for t in LABEL_TAGS]), (F.col("label") % 7 + 1).cast("int"))
    rows = near(spark, sf_dir, 80).withColumns({"chunk_tags": F.array(tag), "triggered": F.array(F.when(F.col("q") % 2 == 0, "sex").otherwise("violence")), "is_minor": F.col("q") % 3 == 0, "hits": (F.col("c") % 9).cast("int")})
    rows = rows.withColumns({"adult_hard": F.col("is_minor") & (F.col("q") % 2 == 0), "source_score": (F.col("c") % 4) / F.lit(3.0), "chars": (F.col("c") * 7 % 600).cast("int"), "penalty": F.when(F.col("c") % 11 == 0, 0.1).otherwise(0.0)})
    return rows.withColumn("source", (F.col("c") % 5).cast("string"))


SQL_RAW = f"""raw as (select *, max(abs(score)) over (partition by q) top from (select q, c, score, {SQL_LABEL} tag, case when q % 2 = 0 then 'sex' else 'violence' end trig, q % 3 = 0 is_minor, cast(c % 9 as int) hits, q % 6 = 0 hard, (c % 4) / 3.0::double src, c * 7 % 600 chars, case when c % 11 = 0 then 0.1::double else 0 end pen,
  row_number() over (partition by q order by score desc, c) rank from {SQL_NEAR}) where rank <= 80)"""


@query(
    f"""with {SQL_RAW}, w as (select *, case when tag = trig then 1.45::double when tag = 'minor' and is_minor then 1.35 when tag = 'adult' and not is_minor then 1.0 when tag = 'adult_content' and hard then 1.55 when tag = 'general' then 0.75 else 0 end tw,
 1.45::double + case when hard then 1.55 else 0 end + case when is_minor then 1.35 else 1.0 end + 0.75 total from raw)
select q, c, round(0.35::double * score / top + 0.35::double * tw / total + 0.15::double * least(hits / 4.0::double, 1) + 0.10::double * src + 0.05::double * least(chars / 450.0::double, 1) - pen, 5) rerank_score from w where tw > 0 or score / top >= 0.1"""
)
def rerank_ml(spark, sf_dir):
    return retrieval.rerank_dims(raw(spark, sf_dir)).select("q", "c", F.round("rerank_score", 5).alias("rerank_score"))


@query(
    f"""with {SQL_RAW}, w as (select *, tag = trig dim, (tag = 'minor' and is_minor) mm, (tag = trig or (tag = 'minor' and is_minor) or (tag = 'adult' and not is_minor) or tag = 'general') m from raw)
select q, c, round(score * 0.55::double + least(hits, 12) / 12.0::double * 0.25::double + src * 0.15::double + case when m then 0.04::double else 0 end + case when dim then 0.12::double else 0 end + case when mm then 0.10::double else 0 end - pen, 5) rerank_score from w"""
)
def rerank_mal(spark, sf_dir):
    want = F.concat("triggered", F.array(F.when(F.col("is_minor"), "minor").otherwise("adult"), F.lit("general")))
    rows = raw(spark, sf_dir).withColumn("matched", F.array_intersect("chunk_tags", want))
    return retrieval.rerank_buckets(rows).select("q", "c", F.round("rerank_score", 5).alias("rerank_score"))


@query(
    f"""with {SQL_RAW}, w as (select *, case when tag = trig then 1.45::double when tag = 'minor' and is_minor then 1.35 when tag = 'adult' and not is_minor then 1.0 when tag = 'adult_content' and hard then 1.55 when tag = 'general' then 0.75 else 0 end tw,
 1.45::double + case when hard then 1.55 else 0 end + case when is_minor then 1.35 else 1.0 end + 0.75 total from raw),
sc as (select q, c, tag, c % 5 source, is_minor, hard, trig, row_number() over (partition by q order by 0.35::double * score / top + 0.35::double * tw / total + 0.15::double * least(hits / 4.0::double, 1) + 0.10::double * src + 0.05::double * least(chars / 450.0::double, 1) - pen desc, c) o from w where tw > 0 or score / top >= 0.1),
need as (select *, case when tag = 'minor' and is_minor then 1 when tag = 'adult_content' and hard then 2 when tag = trig then 3 when tag = 'general' then 4 end m from sc),
taken as (select *, m is not null and row_number() over (partition by q, m order by o) = 1 must from need),
fit as (select *, not must and row_number() over (partition by q, source, must order by o) <= 2 - count(*) filter (must) over (partition by q, source) spread from taken),
s as (select q, c, row_number() over (partition by q order by case when must then 0 when spread then 1 else 2 end, case when must then m end, o) slot from fit)
select q, c, slot from s where slot <= 5"""
)
def rag_slot_select(spark, sf_dir):
    scored = retrieval.rerank_dims(raw(spark, sf_dir))
    must = F.concat(F.when(F.col("is_minor"), F.array(F.lit("minor"))).otherwise(F.array().cast("array<string>")), F.when(F.col("adult_hard"), F.array(F.lit("adult_content"))).otherwise(F.array().cast("array<string>")), "triggered", F.array(F.lit("general")))
    return retrieval.fill_slots(scored.select("q", "c", "rerank_score", "source", "chunk_tags", must.alias("must")))


@query(
    r"""with t as materialized (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_\-'']+') w from documents),
g as (select doc_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(generate_series(1, len(w) - 1), lambda j: w[j] || '_' || w[j + 1]) else [] end)) term from t),
tf as materialized (select doc_id, term, count(*) tf from g group by 1, 2), df as (select term, count(*) df from tf group by 1),
x as materialized (select doc_id, term, (1 + ln(tf)) * (ln(((select count(*) from t) + 1) / (df + 1)) + 1) w from tf join df using (term)),
n as (select doc_id, sqrt(sum(w * w)) norm from x group by 1)
select doc_id, count(*) terms, round(max(w / norm), 5) top, round(sum(w / norm), 4) mass from x join n using (doc_id) group by 1"""
)
def tfidf_weights(spark, sf_dir):
    rows = candidates.tfidf(A.read(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("w"), 5).alias("top"), F.round(F.sum("w"), 4).alias("mass"))


@query(f"{A.PRELUDE} select u, case when is_minor then 'minor' else 'adult' end || '::' || case when u % 4 = 0 then 'sex+violence' else 'none' end || '::' || cast(u % 3 = 0 as int) || '::' || cast(u % 6 = 0 as int) signature, case when is_minor then '- Keep content suitable for viewers under eighteen.' else '- Respect the general limits for adult viewers.' end || case when u % 4 = 0 then chr(10) || '- Avoid strong violence content.' || chr(10) || '- Avoid strong sex content.' else '' end rule from usr")
def rule_signature_cache(spark, sf_dir):
    rows = A.users(spark, sf_dir).withColumn("triggered", F.when(F.col("u") % 4 == 0, F.array(F.lit("violence"), F.lit("sex"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("signature", records.signature(F.col("is_minor"), F.col("triggered"), F.col("u") % 3 == 0, F.col("u") % 6 == 0))
    return records.memoised(rows, "signature", ["is_minor", "triggered"], records.template_rule(F.col("is_minor"), F.col("triggered"))).select("u", "signature", "rule")


@query(r"select conv_id, turn, array_to_string(list_transform(l[1:6], lambda x: '- ' || x), chr(10)) rules from (select conv_id, turn, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*([-*•]|\d+[.)])\s*', ''))), lambda x: x <> '' and not regexp_matches(x, 'tion|zz')), lambda x, i: true) a, list_filter(a, lambda x, i: list_position(a, x) = i) l from conversations)")
def rule_clean(spark, sf_dir):
    return A.read(spark, sf_dir, "conversations").select("conv_id", "turn", records.clean_rules(F.col("text"), "tion|zz").alias("rules"))



FORBIDDEN = ["password", "Licensed under", "the and of"]


@query("select doc_id, array_to_string(list_filter(['password', 'Licensed under', 'the and of'], lambda f: contains(lower(text), lower(f))), '|') leaks from documents")
def prompt_leakage(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", F.array_join(records.leaks(F.col("text"), FORBIDDEN), "|").alias("leaks"))


@query(f"{A.PRELUDE}, said as (select u, 'We saw ' || t.title || ' (1984) and a blue bolt' line from usr join item t on t.i = (u * 37) % (select count(*) from item)) select hist.u, bool_or(contains(lower(line), lower(title))) leak from hist join said on said.u = hist.u join item using (i) where back <= 5 group by 1")
def title_leak(spark, sf_dir):
    """Whether a sentence about another item names a title of the user's latest ones."""
    from wardline.operators import history

    items = A.items(spark, sf_dir).select("i", "title")
    n = items.agg(F.count("*").alias("n"))
    said = A.users(spark, sf_dir).join(F.broadcast(n), F.lit(True)).select("u", ((F.col("u") * 37) % F.col("n")).alias("i")).join(items, "i")
    said = said.select("u", F.concat(F.lit("We saw "), "title", F.lit(" (1984) and a blue bolt")).alias("line"))
    last = history.last_k(A.interactions(spark, sf_dir), 5).join(items, "i")
    rows = last.groupBy("u").agg(F.collect_list(F.concat("title", F.lit(" (1999)"))).alias("titles")).join(said, "u")
    return rows.select("u", records.title_leaks(F.col("line"), F.col("titles")).alias("leak"))


@query("select doc_id, regexp_replace(regexp_replace(text, 'worthless', 'mature', 'gi'), 'idiot', 'mature', 'gi') cleaned, regexp_matches(lower(text), 'worthless|idiot') had from documents")
def sensitive_sanitize(spark, sf_dir):
    terms = ["idiot", "worthless"]
    return A.read(spark, sf_dir, "documents").select("doc_id", records.without_terms(F.col("text"), terms).alias("cleaned"), records.has_term(F.col("text"), terms).alias("had"))


#: Passages of at most two words, which have no whole word inside: so many at most are held against every text.
MOST_SHORT = 10_000


@query("select d.doc_id, count(*) n_items, min(b.item_id) first_item from documents d join benchmark b on contains(d.text, b.text) group by 1")
def verbatim_benchmark(spark, sf_dir):
    return verbatim(A.read(spark, sf_dir, "documents").select("doc_id", "text"), A.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))


def verbatim(docs, passages):
    """doc_id, n_items, first_item of documents that hold a passage character by character.

    A passage may begin and end inside a word, but the words within are whole:
    documents and passages meet on up to three of these, then are compared whole.
    """
    inner = F.split("passage", r"\s")
    b = passages.where("passage is not null").withColumn("n", F.least(F.size(inner) - 2, F.lit(3))).withColumn("head", F.array_join(F.slice(inner, F.lit(2), F.greatest("n", F.lit(0))), " "))
    sizes = sorted(r["n"] for r in b.select("n").distinct().collect())
    w = F.split("text", r"\s")

    def grams_of(n: int):
        return F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get("w", i + j) for j in range(1, n)]))

    grams = [grams_of(n) for n in sizes if n > 0]
    hits = docs.select("doc_id", F.lit(None).cast(passages.schema["item_id"].dataType).alias("item_id")).limit(0)
    if grams:
        # outer: the filter that a plain explode infers would split each text again for every word
        starts = docs.select("doc_id", w.alias("w")).select("doc_id", F.explode_outer(F.array_distinct(F.concat(*grams))).alias("head"))
        met = starts.join(b.where("n > 0"), "head").select("doc_id", "item_id", "passage")
        hits = met.join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    if sizes and sizes[0] <= 0:
        few = b.where("n <= 0")
        if few.count() > MOST_SHORT:
            raise ValueError(f"more than {MOST_SHORT} passages of at most two words")
        lists = few.agg(F.collect_list(F.struct("item_id", "passage")).alias("p"))
        short = docs.join(F.broadcast(lists), F.lit(True)).select("doc_id", F.explode(F.filter("p", lambda p: F.contains("text", p["passage"]))).alias("x"))
        hits = hits.unionByName(short.select("doc_id", "x.item_id"))
    return hits.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"))


@query(
    f"""with {SQL_RAW}, w as (select *, case when tag = trig then 1.45::double when tag = 'minor' and is_minor then 1.35 when tag = 'adult' and not is_minor then 1.0 when tag = 'adult_content' and hard then 1.55 when tag = 'general' then 0.75 else 0 end tw,
 1.45::double + case when hard then 1.55 else 0 end + case when is_minor then 1.35 else 1.0 end + 0.75 total from raw),
sc as (select q, c, is_minor, hard, trig, row_number() over (partition by q order by 0.35::double * score / top + 0.35::double * tw / total + 0.15::double * least(hits / 4.0::double, 1) + 0.10::double * src + 0.05::double * least(chars / 450.0::double, 1) - pen desc, c) o from w where tw > 0 or score / top >= 0.1)
select q, case when is_minor then 'minor' else 'adult' end || '::' || trig || '::' || cast(hard as int) || '::' || cast(hard as int) signature, string_agg(c, ',' order by o) chunks,
  case when is_minor then '- Keep content suitable for viewers under eighteen.' else '- Respect the general limits for adult viewers.' end || chr(10) || '- Avoid strong ' || trig || ' content.' as rule from sc where o <= 3 group by q, is_minor, hard, trig"""
)
def policy_rules(spark, sf_dir):
    """From queries to rules: retrieve, rerank, keep three chunks, and write the rule of each signature once."""
    w = Window.partitionBy("q").orderBy(F.desc("rerank_score"), "c")
    best = retrieval.rerank_dims(raw(spark, sf_dir)).withColumn("o", F.row_number().over(w)).where("o <= 3")
    rows = best.groupBy("q", "is_minor", "adult_hard", "triggered").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda s: s["c"].cast("string")), ",").alias("chunks"))
    rows = rows.withColumn("signature", records.signature(F.col("is_minor"), F.col("triggered"), F.col("adult_hard"), F.col("adult_hard")))
    return records.memoised(rows, "signature", ["is_minor", "triggered"], records.template_rule(F.col("is_minor"), F.col("triggered"))).select("q", "signature", "chunks", "rule")
