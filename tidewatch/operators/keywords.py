"""Keywords of articles and groups: tokens, scores, bigrams, graphs, snapshots."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from tidewatch.runtime import exists, remove, written
from tidewatch.sources.tables import ago

#: English stop words; Korean particles, news boilerplate, media names and office words.
STOP = ("the", "is", "at", "which", "on", "and", "or", "but", "in", "to", "for", "of", "with", "as", "by", "an", "be", "this", "that", "it", "are", "was", "were", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "from", "not", "no", "if", "then", "than", "so", "up", "out", "about", "into", "over", "after", "also", "its", "his", "her",
        "것이", "하는", "있는", "하고", "에서", "으로", "이다", "했다", "되는", "하며", "그리고", "또한", "이를", "통해", "이번", "대한", "위해", "관련", "따르면", "밝혔다", "전했다",
        "것으로", "지난", "올해", "오늘", "내년", "최근", "현재", "이후", "가운데", "사이", "가량", "정도", "이상", "미만", "대비", "전년", "분기", "한편", "이날",
        "기자", "특파원", "뉴스", "연합뉴스", "한겨레", "매일경제", "조선일보", "중앙일보", "동아일보", "한국경제", "머니투데이", "아시아경제", "헤럴드경제",
        "인사", "발표", "현황", "일정", "안내", "공지", "결과", "자료", "보도", "회의", "회견", "성명", "담화")
DATE_LIKE = r"^\d+월\d*일?$|^\d{4}년$|^\d+월$|^\d+일$"
LATIN, ANY_LETTER = "[a-zA-Z]{2,}", r"\p{L}{2,}"


def tokenize(text: Column, stop: tuple[str, ...] = STOP, latin: str = LATIN) -> Column:
    """Hangul runs, then lower-cased Latin runs, of 2 to 30 characters, without stop words and dates. ``latin`` may be
    ``ANY_LETTER`` for words with accents."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(t, F.lit("([가-힣]{2,})"), 1), F.transform(F.regexp_extract_all(t, F.lit(f"({latin})"), 1), F.lower))
    return F.filter(found, lambda w: (F.length(w) <= 30) & ~w.isin(*stop) & ~w.rlike(DATE_LIKE))


def _terms(articles: DataFrame, boost: float, body: int) -> DataFrame:
    """article, term and boosted count: int(count * boost) for titles plus the count in body[:body]."""
    title, text = tokenize(F.col("title")), tokenize(F.substring(F.coalesce("body", F.lit("")), 1, body))
    both = F.concat(F.transform(title, lambda t: F.struct(t.alias("term"), F.lit(1).alias("t"), F.lit(0).alias("b"))), F.transform(text, lambda t: F.struct(t.alias("term"), F.lit(0).alias("t"), F.lit(1).alias("b"))))
    rows = articles.select("article_id", F.explode(both).alias("x")).groupBy("article_id", "x.term").agg(F.sum("x.t").alias("t"), F.sum("x.b").alias("b"))
    return rows.select("article_id", "term", (F.floor(F.col("t") * boost) + F.col("b")).cast("long").alias("tf")).filter("tf > 0")


def corpus_stats(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document frequency per term; one row with document count and mean length. Over the whole table."""
    lengths = terms.groupBy("article_id").agg(F.sum("tf").alias("n"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean_n"))


#: Batches after which the counts kept under a path are folded into one table.
FOLD = 16


def _counted(terms: DataFrame) -> DataFrame:
    """What a batch adds: term and df, and under a null term its documents (df) and their terms (n). Sums of such tables
    are those of the union of batches, each of which has whole articles."""
    length = terms.groupBy("article_id").agg(F.sum("tf").alias("n"))
    total = length.agg(F.lit(None).cast("string").alias("term"), F.count(F.lit(1)).alias("df"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("n", F.lit(0).cast("long")).unionByName(total)


def _kept(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """Sums over batches 0 to ``upto``: the last fold before it and what came after."""
    folds = [f for f in range(FOLD - 1, upto + 1, FOLD) if exists(spark, f"{path}/fold={f}/_SUCCESS")]
    last = folds[-1] if folds else -1
    parts = [f"{path}/fold={last}"] if folds else []
    parts += [p for n in range(last + 1, upto + 1) if exists(spark, (p := f"{path}/batch={n}") + "/_SUCCESS")]
    return spark.read.schema("term string, df long, n long").parquet(*parts).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def running_stats(terms: DataFrame, path: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """:func:`corpus_stats` over batches 0 to ``batch``, of which ``terms`` is the last; the counts of each are kept under
    ``path``. A repeated batch replaces its own counts. Every FOLD batches the counts before become one table, so a batch
    reads FOLD tables at most, each no longer than the vocabulary. An article that two batches bring counts twice."""
    spark = terms.sparkSession
    _counted(terms).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if batch and batch % FOLD == 0 and not exists(spark, f"{path}/fold={batch - 1}/_SUCCESS"):
        _kept(spark, path, batch - 1).write.mode("overwrite").parquet(f"{path}/fold={batch - 1}")
        for old in [f"batch={n}" for n in range(batch - FOLD, batch)] + [f"fold={batch - 1 - FOLD}"]:
            remove(spark, f"{path}/{old}")
    kept = _kept(spark, path, batch)
    mean = F.col("n") / F.when(F.col("df") > 0, F.col("df"))
    return kept.filter("term is not null").select("term", "df"), kept.filter("term is null").select(F.col("df").alias("docs"), mean.alias("mean_n"))


def keyword_scores(articles: DataFrame, boost: float = 2.0, body: int = 500, k1: float = 1.5, b: float = 0.75, statistics: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = corpus_stats) -> DataFrame:
    """article, term, tf and score: tf/len * idf * BM25, idf = ln((N - df + .5) / (df + .5) + 1). ``statistics`` gives df
    and the row of totals for the terms: those of the articles themselves, or of all batches (:func:`running_stats`)."""
    terms = written(_terms(articles, boost, body), "terms")  # tokenised once for the statistics and the scores
    df, stats = statistics(terms)
    rows = terms.withColumn("n", F.sum("tf").over(Window.partitionBy("article_id"))).join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    bm25 = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean_n")))
    return rows.select("article_id", "term", "tf", (F.col("tf") / F.col("n") * idf * bm25).alias("score"))


def extract_keywords(articles: DataFrame, k: int = 10, **params) -> DataFrame:
    """article, its best ``k`` terms in order (ties: term) and the best score as ``keyword_importance``."""
    w = Window.partitionBy("article_id").orderBy(F.desc(F.round("score", 9)), "term")
    best = keyword_scores(articles, **params).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    out = best.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("r", "term"))).alias("x"), F.max("score").alias("keyword_importance"))
    return out.select("article_id", F.transform("x", lambda e: e["term"]).alias("keywords"), "keyword_importance")


@F.pandas_udf(ArrayType(StructType().add("bigram", StringType()).add("freq", LongType()).add("score", DoubleType())))
def _counted_bigrams(tokens: pd.Series, least: pd.Series, weight: pd.Series) -> pd.Series:
    def one(t, least: int, weight: float) -> list:
        t = [] if t is None else list(t)
        two = Counter(pair for pair in zip(t, t[1:]) if pair[0] != pair[1])
        kept = [(pair, n) for pair, n in two.items() if n >= least]
        words = {w for pair, _ in kept for w in pair}
        share = {w: n / len(t) for w, n in Counter(w for w in t if w in words).items()}
        return [{"bigram": f"{a}_{b}", "freq": n, "score": weight * (share[a] + share[b]) / 2} for (a, b), n in kept]

    return pd.Series([one(t, n, w) for t, n, w in zip(tokens, least, weight)])


def bigrams(articles: DataFrame, text: str = "body", min_count: int = 2, weight: float = 0.5) -> DataFrame:
    """article, bigram ``a_b`` of unequal neighbours in reading order, its count and score: ``weight`` times the mean
    share of its parts among the document's tokens. A text is counted in its row, so no token is shuffled; rows with the
    same id are counted each for itself."""
    found = _counted_bigrams(tokenize(F.col(text)), F.lit(min_count), F.lit(float(weight)))
    return articles.select("article_id", found.alias("x")).select("article_id", F.explode("x").alias("x")).select("article_id", "x.bigram", "x.freq", "x.score")



def group_keywords(assigned: DataFrame, k: int = 20) -> DataFrame:
    """group and its ``k`` keywords in most articles (ties: keyword), without digits and single characters.
    ``assigned``: group_id, article_id, keywords."""
    rows = assigned.filter("group_id is not null").select("group_id", "article_id", F.explode(F.array_distinct("keywords")).alias("keyword")).filter("length(keyword) > 1 and not keyword rlike '^[0-9]+$'")
    counts = rows.groupBy("group_id", "keyword").agg(F.countDistinct("article_id").alias("articles"))
    w = Window.partitionBy("group_id").orderBy(F.desc("articles"), "keyword")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_nodes(assigned: DataFrame, k: int = 30) -> DataFrame:
    """group, keyword, frequency (articles) and its share of the group's largest; top ``k`` per group."""
    counts = assigned.filter("group_id is not null").select("group_id", "article_id", F.explode(F.array_distinct("keywords")).alias("keyword")).groupBy("group_id", "keyword").agg(F.countDistinct("article_id").alias("frequency"))
    w = Window.partitionBy("group_id").orderBy(F.desc("frequency"), "keyword")
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumn("score", F.col("frequency") / F.max("frequency").over(Window.partitionBy("group_id"))).drop("rank")


def keyword_edges(assigned: DataFrame, floor: float = 0.1, top: int = 50, nodes: int = 30) -> DataFrame:
    """group, source and target keyword and the Jaccard of their article sets, from ``floor``, top ``top`` per group.
    Pairs are made among the group's node keywords only, article by article."""
    n = keyword_nodes(assigned, nodes).select("group_id", "keyword", "frequency")
    rows = assigned.select("group_id", "article_id", F.explode(F.array_distinct("keywords")).alias("keyword")).distinct().join(n, ["group_id", "keyword"])
    a, b = rows.select("group_id", "article_id", F.col("keyword").alias("source"), F.col("frequency").alias("fa")), rows.select("group_id", "article_id", F.col("keyword").alias("target"), F.col("frequency").alias("fb"))
    both = a.join(b, ["group_id", "article_id"]).filter("source < target").groupBy("group_id", "source", "target", "fa", "fb").agg(F.count(F.lit(1)).alias("n"))
    edges = both.withColumn("weight", F.col("n") / (F.col("fa") + F.col("fb") - F.col("n"))).filter(F.col("weight") >= floor)
    w = Window.partitionBy("group_id").orderBy(F.desc("weight"), "source", "target")
    return edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("group_id", "source", "target", "weight")


def keyword_snapshot(groups: DataFrame, as_of, top: int = 500, k: int = 10) -> DataFrame:
    """group, keyword, frequency 1 and time, for the first ``k`` keywords of the best ``top`` groups of the last day."""
    best = groups.filter(F.col("created_at") > ago(as_of, 86400)).orderBy(F.desc("score"), "id").limit(top)
    return best.select(F.col("id").alias("group_id"), F.explode(F.slice("keywords", 1, k)).alias("keyword"), F.lit(1).alias("frequency"), ago(as_of, 0).alias("snapshot_at"))


def keyword_history(snapshots: DataFrame, times: int = 10, k: int = 10) -> DataFrame:
    """Per group and each of its newest ``times`` snapshots, up to ``k`` keywords by frequency, joined in order."""
    rows = snapshots.groupBy("group_id", "snapshot_at", "keyword").agg(F.max("frequency").alias("frequency"))
    rows = rows.withColumn("t", F.dense_rank().over(Window.partitionBy("group_id").orderBy(F.desc("snapshot_at")))).filter(F.col("t") <= times)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "snapshot_at").orderBy(F.desc("frequency"), "keyword"))).filter(F.col("r") <= k)
    out = rows.groupBy("group_id", "snapshot_at").agg(F.sort_array(F.collect_list(F.struct("r", "keyword"))).alias("x"))
    return out.select("group_id", "snapshot_at", F.transform("x", lambda e: e["keyword"]).alias("keywords"))


def keyword_batches(groups: DataFrame, as_of, size: int = 5, most: int = 10) -> DataFrame:
    """Batches of ``size`` distinct keywords of the last day's groups, at most ``most``, in keyword order."""
    words = groups.filter(F.col("created_at") > ago(as_of, 86400)).select(F.explode("keywords").alias("keyword")).filter("length(keyword) > 1").distinct()
    first = words.orderBy("keyword").limit(size * most)  # the feature's own cap, so the window below has few rows
    return first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("keyword")) - 1) / size).cast("int"))
