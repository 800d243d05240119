"""Chunking, tagging, dense retrieval, reranking and slot selection of policy text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_chunks(texts: DataFrame, key: str, size: int = 650, overlap: int = 80) -> DataFrame:
    """key, n, start, chunk: stretches of size characters, each beginning overlap before the last one's end, until the text ends."""
    step, length = size - overlap, F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("int"))
    rows = texts.where(length > 0).select(key, "text", F.explode(starts).alias("n"))
    start = F.col("n") * step
    return rows.select(key, F.col("n").cast("long").alias("n"), start.cast("long").alias("start"), F.substring("text", start + 1, F.lit(size)).alias("chunk"))


def packed_chunks(paragraphs: DataFrame, size: int = 650, overlap: int = 80) -> DataFrame:
    """page, n, chunk: paragraphs (page, n, text) gathered while they fit; a long one slides; one page is one bounded group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out, open_ = [], ""
        for text in rows.sort_values("n")["text"]:
            if len(text) > size:
                out += [open_] if open_ else []
                open_ = ""
                out += [text[a : a + size] for a in range(0, max(1, len(text) - overlap), size - overlap)]
            elif len(open_) + len(text) + bool(open_) <= size:
                open_ = f"{open_}\n{text}" if open_ else text
            else:
                out.append(open_)
                open_ = text
        out += [open_] if open_ else []
        return pd.DataFrame({"page": rows["page"].iloc[0], "n": range(len(out)), "chunk": out})

    return paragraphs.groupBy("page").applyInPandas(one, "page long, n long, chunk string")


def keyword_hits(low: Column, words: list[str]) -> Column:
    """How many of the words a lower-cased text contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w.lower())).cast("int")
    return out


def tags(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Sorted tags with a keyword in the text; "general" if there is none."""
    # lower-cased once: what a lambda is given is not worked out again for each keyword
    hit = lambda low: F.array_compact(F.array(*[F.when(keyword_hits(low, words) > 0, F.lit(tag)) for tag, words in sorted(lexicon.items())]))
    found = F.get(F.transform(F.array(F.lower(text)), hit), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


#: The keywords of the policy tags.
POLICY_LEXICON = {
    "sex": ["色情", "淫秽", "性", "裸露", "低俗", "挑逗", "成人", "性暗示", "sexual", "nudity", "adult"],
    "violence": ["暴力", "血腥", "凶杀", "杀戮", "残忍", "伤害", "恐怖活动", "violence", "gore", "blood"],
    "profanity": ["脏话", "粗口", "粗俗", "辱骂", "低俗语言", "profanity", "vulgar", "abusive"],
    "drug": ["毒品", "吸毒", "酒精", "酗酒", "吸烟", "成瘾", "drug", "alcohol", "smoking", "addiction"],
    "intense": ["惊悚", "恐怖", "惊吓", "紧张", "心理", "危险", "horror", "frightening", "disturbing"],
    "adult_content": ["成人", "未成年人不宜", "儿童不宜", "色情", "淫秽", "低俗", "adult-oriented"],
    "minor": ["未成年人", "未成年", "青少年", "儿童", "身心健康", "保护", "适龄", "minor", "child"],
    "adult": ["成年人", "一般内容", "合规", "底线", "公众", "社会公德", "adult"],
    "general": ["互联网视听", "内容审核", "禁止", "不得", "违法", "有害", "导向", "公序良俗"],
}

#: Queries of one block; their vectors are sent to every worker, so this bounds what is broadcast.
QUERY_BLOCK = 10_000
#: Score cells that a worker holds at once.
CELLS = 1 << 22
NEAR = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("score", pa.float64())])


def nearest(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """q, c, score, rank: the k chunks of largest inner product per query, ties to the smaller c.

    queries: q, qv; chunks: c, cv, all of one length. Scores are rounded, so that equal vectors tie. Up to QUERY_BLOCK queries come to
    the chunks, which stay where they are; of more, each block meets each block of chunks in a task. A task gives only its k best per query.
    """
    blocks = -(-queries.count() // QUERY_BLOCK)
    if blocks <= 1:
        rows = queries.select("q", "qv").toArrow()
        best = best_of_pieces(chunks, rows["q"].to_numpy(), stacked(rows["qv"]), k, digits) if rows.num_rows else queries.sparkSession.createDataFrame([], "q long, c long, score double")
    else:
        best = best_of_blocks(queries, chunks, blocks, k, digits)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best chunks of each query so far: scores descending, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((queries, 0), 0.0), np.full((queries, 0), 0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """ids ascending, scores queries x ids."""
        if scores.shape[1] > self.k:  # the k-th best of the piece; ties at it go to the smaller ids
            edge = np.partition(scores, scores.shape[1] - self.k, 1)[:, -self.k, None]
            over, tie = scores > edge, scores == edge
            take = over | (tie & (np.cumsum(tie, 1) <= self.k - over.sum(1, keepdims=True)))
            at = np.nonzero(take)[1].reshape(len(scores), self.k)
            ids, scores = ids[at], np.take_along_axis(scores, at, 1)
        else:
            ids = np.broadcast_to(ids, scores.shape)
        both, who = np.concatenate([self.score, scores], 1), np.concatenate([self.id, ids], 1)
        order = np.lexsort((who, -both), axis=1)[:, : self.k]
        self.score, self.id = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)


def stacked(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """rows x dimensions of lists of one length."""
    return np.stack(vectors.to_numpy() if isinstance(vectors, pa.ChunkedArray) else vectors.to_numpy(zero_copy_only=False)).astype(np.float64)


def best_of_blocks(queries: DataFrame, chunks: DataFrame, blocks: int, k: int, digits: int) -> DataFrame:
    """The k best of each block of chunks for each query; neither side passes the driver."""
    dealt = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    left = queries.select("q", "qv", part("q", blocks).alias("_q")).withColumn("_c", each(dealt))
    right = chunks.select("c", "cv", part("c", dealt).alias("_c")).where("c is not null and cv is not null").withColumn("_q", each(blocks))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        best = Best(asked.num_rows, k)
        if asked.num_rows and held.num_rows:
            ids, vectors = asked["q"].to_numpy(), stacked(asked["qv"])
            step = max(1, CELLS // asked.num_rows)
            for lo in range(0, held.num_rows, step):
                piece = held.slice(lo, step)
                c = piece["c"].to_numpy()
                order = np.argsort(c, kind="stable")
                best.add(c[order], np.round(vectors @ stacked(piece["cv"])[order].T, digits))
        ids = asked["q"].to_numpy() if asked.num_rows else np.empty(0, np.int64)
        return pa.Table.from_arrays([pa.array(np.repeat(ids, best.id.shape[1])), pa.array(best.id.ravel()), pa.array(best.score.ravel())], schema=NEAR)

    keys = ["_q", "_c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "q long, c long, score double")


def best_of_pieces(chunks: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> DataFrame:
    """The k best of each task for each query, kept over all its pieces and sent on once."""

    def run(batches):
        best, step = Best(len(ids), k), max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                c = piece["c"].to_numpy()
                v = stacked(piece["cv"])
                order = np.argsort(c, kind="stable")
                best.add(c[order], np.round(vectors @ v[order].T, digits))
        n = max(1, CELLS // max(1, best.id.shape[1]))
        for lo in range(0, len(ids), n):
            own = best.id[lo : lo + n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + n], own.shape[1])), pa.array(own.ravel()), pa.array(best.score[lo : lo + n].ravel())], schema=NEAR)

    return chunks.select("c", "cv").where("c is not null and cv is not null").mapInArrow(run, "q long, c long, score double")


#: Weights of matched tags.
TAG_WEIGHTS = {"minor": 1.35, "dim": 1.45, "adult_content": 1.55, "general": 0.75, "adult": 1.0}


def rerank_dims(raw: DataFrame) -> DataFrame:
    """raw with rerank_score for five-dimension queries; rows that match no tag and score below a tenth of the query's best go.

    raw: q, c, score, chunk_tags, triggered, is_minor, adult_hard, hits, source_score, chars, penalty.
    """
    top = F.max(F.abs("score")).over(Window.partitionBy("q"))
    raw = raw.withColumn("_top", F.when(top > 0, top).otherwise(1.0))
    audience = F.array(F.when(F.col("is_minor"), "minor").otherwise("adult"), F.lit("general"))
    want = F.array_distinct(F.concat("triggered", F.when(F.col("adult_hard"), F.array(F.lit("adult_content"))).otherwise(F.array().cast("array<string>")), audience))

    def weight(tag: Column) -> Column:
        out = F.lit(TAG_WEIGHTS["dim"])
        for name in ("minor", "adult", "adult_content", "general"):
            out = F.when((tag == name) & (~F.array_contains("triggered", tag) | F.lit(name != "minor")), TAG_WEIGHTS[name]).otherwise(out)
        return out

    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + weight(t))
    raw = raw.withColumn("matched", F.array_intersect("chunk_tags", want)).withColumn("_want", want)
    dense = F.col("score") / F.col("_top")
    final = 0.35 * dense + 0.35 * total(F.col("matched")) / F.greatest(total(F.col("_want")), F.lit(1.0)) + 0.15 * F.least(F.col("hits") / 4.0, F.lit(1.0)) + 0.10 * F.col("source_score") + 0.05 * F.least(F.col("chars") / 450.0, F.lit(1.0)) - F.col("penalty")
    return raw.where((F.size("matched") > 0) | (dense >= 0.10)).withColumn("rerank_score", final).drop("_top", "_want")


def rerank_buckets(raw: DataFrame) -> DataFrame:
    """raw with rerank_score for rating-bucket queries. raw: score, hits, source_score, matched, triggered, is_minor, penalty."""
    bonus = 0.04 * F.size("matched")
    bonus = bonus + F.when(F.size(F.array_intersect("matched", "triggered")) > 0, 0.12).otherwise(0.0)
    bonus = bonus + F.when(F.col("is_minor") & F.array_contains("matched", "minor"), 0.10).otherwise(0.0)
    return raw.withColumn("rerank_score", F.col("score") * 0.55 + F.least(F.col("hits"), F.lit(12)) / 12.0 * 0.25 + F.col("source_score") * 0.15 + bonus - F.col("penalty"))


def fill_slots(scored: DataFrame, k: int = 5, per_source: int = 2) -> DataFrame:
    """q, c, slot: per query first one chunk for each wanted tag, then the best with at most per_source of a source, then the best.

    scored: q, c, rerank_score, source, chunk_tags, must (tags in order of need). A query's candidates are bounded by its retrieval.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rerank_score", "c"], ascending=[False, True], kind="stable").reset_index(drop=True)
        have = [set(t) for t in rows["chunk_tags"]]
        taken: dict[int, None] = {}
        for tag in rows["must"].iloc[0]:
            for j, own in enumerate(have):
                if tag in own and j not in taken:
                    taken[j] = None
                    break
        for limit in (per_source, len(rows)):
            for j, source in enumerate(rows["source"]):
                if len(taken) < k and j not in taken and sum(rows["source"][x] == source for x in taken) < limit:
                    taken[j] = None
        picked = list(taken)[:k]
        return pd.DataFrame({"q": rows["q"].iloc[0], "c": rows["c"].iloc[picked].to_numpy(), "slot": range(1, len(picked) + 1)})

    return scored.groupBy("q").applyInPandas(one, "q long, c long, slot long")


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, x: the mean of a key's vectors at unit length (zero stays zero); sums are partial before the shuffle."""
    flat = rows.select(key, F.posexplode(vector).alias("dim", "x"))
    mean = flat.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return mean.join(norm, key).select(key, F.col("dim").cast("long").alias("dim"), F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("x"))


def paragraphs(texts: DataFrame, key: str, marker: str, least: int = 4) -> DataFrame:
    """key, n, text: stretches that begin at a line end or a marker, trimmed; shorter ones than least go before they are numbered."""
    parts = F.split(F.regexp_replace("text", f"({marker})", "\n$1"), "\n")
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return texts.select(key, F.posexplode(kept).alias("n", "text")).withColumn("n", F.col("n").cast("long"))
