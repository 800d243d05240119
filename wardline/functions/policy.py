"""Age policies: preference labels, five-dimension codes and rating buckets, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = ("sex", "violence", "profanity", "drug", "intense")
MINOR_LIMIT, ADULT_LIMIT = 3, 4


def preference(rating: Column, liked: float = 4, disliked: float = 2) -> Column:
    """1 at or above liked, 0 at or below disliked, null between."""
    return F.when(rating >= liked, 1).when(rating <= disliked, 0)


def dim_flags(minor: Column, adult: Column, policy: str = "minor_only") -> dict[str, Column]:
    """One flag per dimension, adult_hard, and unsafe_any. policy: whom adult items block (minor_only, all, none)."""
    limit = F.when(minor, MINOR_LIMIT).otherwise(ADULT_LIMIT)
    flags = {d: (F.coalesce(F.col(d), F.lit(0)) >= limit).cast("int") for d in DIMS}
    hard = {"minor_only": adult & minor, "all": adult, "none": F.lit(False)}[policy]
    flags["adult_hard"] = F.coalesce(hard, F.lit(False)).cast("int")
    flags["unsafe_any"] = F.greatest(*flags.values())
    return flags


def bucket_flags(minor: Column, bucket: Column) -> dict[str, Column]:
    """R17 counts for minors only, RPLUS and RX for all; unknown buckets are safe."""
    flags = {"r17": ((bucket == "R17") & minor).cast("int"), "rplus": (bucket == "RPLUS").cast("int"), "rx": (bucket == "RX").cast("int")}
    flags = {k: F.coalesce(v, F.lit(0)) for k, v in flags.items()}
    return flags | {"unsafe_any": F.greatest(*flags.values())}


def within_tolerance() -> Column:
    """All of adult and the five codes are at most the user's tolerance (columns tol_*)."""
    parts = [F.col(d) <= F.col(f"tol_{d}") for d in DIMS]
    out = F.col("is_adult").cast("int") <= F.col("tol_is_adult")
    for p in parts:
        out = out & p
    return out.cast("int")


def exceed_triggers(minor: Column, adult: Column, severe: int = 4, minor_count: int = 2, adult_count: int = 3) -> Column:
    """Sorted dimensions that trigger: severe codes always, those over tolerance if enough of them, else one of these if nothing else does."""
    hard = F.when(minor & adult, F.array(F.lit("is_adult"))).otherwise(F.array().cast("array<string>"))
    hard = F.concat(hard, F.filter(F.array(*[F.when(F.col(d) >= severe, F.lit(d)) for d in DIMS]), lambda x: x.isNotNull()))
    soft = F.filter(F.array(*[F.when((F.col(d) < severe) & (F.col(d) > F.col(f"tol_{d}")), F.lit(d)) for d in DIMS]), lambda x: x.isNotNull())
    most = F.when(minor, minor_count).otherwise(adult_count)
    chosen = F.when(F.size(soft) >= most, F.concat(hard, soft)).when(F.size(hard) == 0, F.slice(soft, 1, 1)).otherwise(hard)
    return F.array_sort(F.array_distinct(chosen))


def quadrant(liked: Column, safe: Column) -> Column:
    return F.concat(F.when(liked == 1, "like").otherwise("dislike"), F.lit("_"), F.when(safe == 1, "safe").otherwise("unsafe"))


def one_hot(names: list[str], codes: tuple[int, ...]) -> dict[str, Column]:
    """0/1 columns name_code; an unknown code sets none."""
    return {f"{n}_{c}": F.coalesce((F.col(n) == c).cast("int"), F.lit(0)) for n in names for c in codes}
