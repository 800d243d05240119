"""Prompt records, rule text and leak checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.clean import clean_text, distinct_list, strip


def leaks(text: Column, forbidden: list[str]) -> Column:
    """The forbidden phrases in the text, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(f.lower())), F.lit(f)) for f in forbidden]).cast("array<string>"), lambda x: x.isNotNull())


def title_leaks(text: Column, titles: Column, least: int = 4) -> Column:
    """Whether any title (its year dropped, at least so long) is in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.transform(titles, lambda t: F.lower(strip(F.regexp_replace(t, r"\s*\(\d{4}\)\s*$", ""))))
    return F.exists(F.filter(bare, lambda t: F.length(t) >= least), lambda t: F.contains(low, t))


def has_term(text: Column, terms: list[str]) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit("(?i)" + "|".join(rf"\Q{t}\E" for t in terms)))


def without_terms(text: Column, terms: list[str], by: str = "mature") -> Column:
    """Terms replaced in any case, longest first."""
    for t in sorted(terms, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?i)\Q{t}\E", by)
    return text


def has_cjk(text: Column) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit("[一-鿿]"))


def clean_rules(text: Column, bad: str, most: int = 6) -> Column:
    """Lines without list marks, non-empty, not matching ``bad``, once each, at most ``most``, as "- " bullets."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    kept = F.array_distinct(F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(bad))))
    return F.array_join(F.transform(F.slice(kept, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")


def signature(minor: Column, triggered: Column, adult: Column, hard: Column) -> Column:
    """What a rule depends on: audience, sorted triggers, adult flags."""
    flag = lambda c: F.when(c, "1").otherwise("0")
    return F.concat_ws("::", F.when(minor, "minor").otherwise("adult"), F.coalesce(F.nullif(F.array_join(F.array_sort(triggered), "+"), F.lit("")), F.lit("none")), flag(adult), flag(hard))


def template_rule(minor: Column, triggered: Column) -> Column:
    """A rule without a model: one bullet for the audience, one for each trigger."""
    lead = F.when(minor, "- Keep content suitable for viewers under eighteen.").otherwise("- Respect the general limits for adult viewers.")
    return F.array_join(F.concat(F.array(lead), F.transform(triggered, lambda d: F.concat(F.lit("- Avoid strong "), d, F.lit(" content.")))), "\n")


def memoised(rows: DataFrame, key: str, inputs: list[str], rule: Column) -> DataFrame:
    """rows with ``rule`` computed once per distinct key and joined back."""
    once = rows.select(key, *inputs).dropDuplicates([key]).select(key, rule.alias("rule"))
    return rows.join(once, key)


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, prompt: turns in order as "role: text" lines. A conversation is one bounded prompt."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return lists.select("conv_id", F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("prompt"))


def last_json(text: Column) -> Column:
    """From the first { to the last }, code fences aside."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)\{.*\}", 0), F.lit(""))


def targets(history: DataFrame, profile_k: int) -> DataFrame:
    """History rows outside the profile's last k, latest first (n)."""
    w = Window.partitionBy("u").orderBy(F.desc("ts"), F.desc("i"))
    rows = history.withColumn("_b", F.row_number().over(w)).where(F.col("_b") > profile_k)
    return rows.withColumn("n", (F.col("_b") - profile_k).cast("long")).drop("_b")


def history_lines(history: DataFrame, k: int) -> DataFrame:
    """u, lines: the k latest items (u, ts, i, title, rating) as numbered lines, oldest first."""
    w = Window.partitionBy("u").orderBy(F.desc("ts"), F.desc("i"))
    last = history.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= k)
    lists = last.groupBy("u").agg(F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("b"), "title", "rating"))).alias("x"))
    line = lambda s, j: F.concat((j + 1).cast("string"), F.lit(". "), s["title"], F.lit(" ("), s["rating"].cast("string"), F.lit(")"))
    return lists.select("u", F.array_join(F.transform("x", line), "\n").alias("lines"))


def pair_prompt(minor: Column, lines: Column, title: Column, genres: Column) -> Column:
    """Input text of one judged pair: audience, history, candidate."""
    audience = F.when(minor, "minor").otherwise("adult")
    return F.concat(F.lit("Audience: "), audience, F.lit("\nHistory:\n"), F.coalesce(lines, F.lit("none")), F.lit("\nCandidate: "), title, F.lit(" ["), F.array_join(genres, ", "), F.lit("]"))


def within_budget(parts: Column, budget: int) -> Column:
    """The array without its oldest size // 8 + 1 parts, time and again, until its characters fit the budget (or nothing is left).

    A cut leaves less than 7/8 of the parts, so the rounds that empty the array follow from its size.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    cut = lambda a: F.slice(a, F.floor(F.size(a) / 8).cast("int") + 2, F.greatest(F.size(a), F.lit(1)))
    rounds = F.floor(F.ln(F.size(parts) + 1) / math.log(8 / 7)).cast("int") + 2
    return F.aggregate(F.sequence(F.lit(1), rounds), parts, lambda a, _: F.when(total(a) > budget, cut(a)).otherwise(a))


def hidden_query(minor: Column, triggered: Column, terms: dict[str, str]) -> Column:
    """Search text of the policy retrieval: audience, then a phrase for each trigger in the order of terms."""
    phrases = [F.when(F.array_contains(triggered, name), F.lit(text)) for name, text in terms.items()]
    return F.concat_ws(" ", F.when(minor, "protection of minors").otherwise("general content limits"), *phrases)


def profile_text(age: Column, said: Column, genres: Column, themes: Column, items: Column, most: int = 4000) -> Column:
    """The query document of a profile: age group, description, preferred genres and themes, then numbered item lines; missing parts go."""
    told = lambda head, x: F.when(strip(x) != "", F.concat(F.lit(head), x, F.lit(".")))
    lines = F.array_join(F.transform(items, lambda t, j: F.concat(F.lit("History "), (j + 1).cast("string"), F.lit(": "), t)), " ")
    return clean_text(F.concat_ws(" ", told("User age group: ", age), F.nullif(strip(said), F.lit("")), told("Preferred genres: ", genres), told("Preferred themes: ", themes), F.nullif(lines, F.lit(""))), most)


#: Fixed value: what stands for a description that is missing.
NO_DESCRIPTION = "A viewer with general interests."


def normal_profile(description: Column, text: Column, genres: Column, terms: list[str], most: int = 8) -> dict[str, Column]:
    """user_description (or a stand-in), profile_text (or the description) without the terms, preferred_genres once each."""
    said = clean_text(description, 300)
    said = without_terms(F.when(said != "", said).otherwise(NO_DESCRIPTION), terms)
    long = without_terms(clean_text(text, 700), terms)
    return {"user_description": said, "profile_text": F.when(long != "", long).otherwise(said), "preferred_genres": distinct_list(genres, most)}
