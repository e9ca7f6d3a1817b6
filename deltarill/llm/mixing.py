"""Mixing sources to target weights.

Tokens are counted per source over all documents; a repetition rate per source follows from its share, and each document
comes out ``floor(rate)`` times plus once more if a number made of a seed and its id falls below the rate's fraction. Documents
are never shuffled for the draw: it depends on nothing but the id, so :func:`records` emits them, whole, in a pass over the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltarill.session import materialize, ship

#: where the public vocabularies lie by default, and which one sizes are measured with
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # fixed value: the word pattern these vocabularies were made with
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str, keep: list[str], tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep..., n_tokens``: tokens of each whole text; a null or empty text has none. Arrow batches, no shuffle."""
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.select(*keep, count(F.col(text)).alias("n_tokens"))


def rates(counted: DataFrame, targets: DataFrame, source: str, total_tokens: float | None = None) -> DataFrame:
    """``source, target_share, max_repeats, tokens, rate``: how often a document of each source is used on average.

    Shares are normalised over the listed sources that have tokens: a source without any can have no share. By default the
    mixture is as large as it can be with every share reached: the least of ``max_repeats * tokens / share``. A larger
    ``total_tokens`` caps what falls short at ``max_repeats`` and spreads the rest over the other sources by their shares;
    what is reached is in :func:`shares`. Listed twice, a source has its first row by share. Null shares or repeats count as 0.
    """
    per = counted.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in t.join(per, "source", "left").collect()]  # one row per listed source
    live = []
    for r in rows:
        r.update(target_share=float(r["target_share"] or 0), max_repeats=int(r["max_repeats"] or 0), tokens=int(r["tokens"] or 0), rate=0.0)
        if r["tokens"] and r["target_share"] > 0 and r["max_repeats"] > 0:
            live.append(r)
    if live:
        whole = sum(r["target_share"] for r in live)
        most = min(r["max_repeats"] * r["tokens"] * whole / r["target_share"] for r in live)
        left, open_ = most if total_tokens is None else float(total_tokens), list(live)
        while open_:
            share = sum(r["target_share"] for r in open_)
            short = [r for r in open_ if left * r["target_share"] / share > r["max_repeats"] * r["tokens"] * (1 + 1e-12)]
            for r in short or open_:
                r["rate"] = float(r["max_repeats"]) if short else left * r["target_share"] / share / r["tokens"]
            if not short:
                break
            left -= sum(r["max_repeats"] * r["tokens"] for r in short)
            open_ = [r for r in open_ if r not in short]
    cols = ["source", "target_share", "max_repeats", "tokens", "rate"]
    return targets.sparkSession.createDataFrame(
        [tuple(r[c] for c in cols) for r in rows], "source string, target_share double, max_repeats int, tokens long, rate double"
    )


def draw(counted: DataFrame, rated: DataFrame, doc_id: str, source: str, seed: int = 17, keep: tuple | list = ()) -> DataFrame:
    """``doc_id, source, copy, n_tokens``: one row per use of a document, ``copy`` from 1 on.

    ``rated`` has one row per listed source. Documents with a null or unlisted source are not used. Rows that repeat a
    document's id draw alike.
    """
    r = rated.select(F.col("source").alias("rated_source"), "rate", "max_repeats")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) / F.lit(float(1 << 53))
    base = F.floor(F.col("rate") + F.lit(1e-9))
    n = F.least(base + (unit < F.col("rate") - base).cast("long"), F.col("max_repeats")).cast("int")
    return (
        counted.join(F.broadcast(r), F.col(source) == F.col("rated_source"))  # one row per listed source
        .withColumn("n", n)
        .where("n > 0")
        .select(F.col(doc_id).alias("doc_id"), F.col("rated_source").alias("source"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "n_tokens", *keep)
    )


def records(docs: DataFrame, rated: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """The mixture itself: the drawn documents with all their columns and ``copy``, once per use, without a shuffle of the corpus.

    A column of the documents that is called ``copy`` keeps its name; the number of the copy then has underscores behind its own.
    """
    name = "copy"
    while name in docs.columns:
        name += "_"
    whole = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.lit(0).alias("n_tokens"))
    drawn = draw(whole, rated, "_id", "_source", seed, keep=["_doc"])
    return drawn.select("_doc.*", F.col("copy").alias(name))


def check(drawn: DataFrame, rated: DataFrame, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", tolerance: float = 0.01) -> DataFrame:
    """``source, n_docs`` of each listed source and the faults of a mixture: ``over_used`` documents, ``foreign`` uses (of a document whose
    source is another one or not listed); ``near_target`` is whether its share of the tokens is within ``tolerance`` and the scatter of so many draws
    (one over the root of their number) of the target among the sources with documents."""
    uses = drawn.groupBy("source", F.col(doc_id).alias("_id")).agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n_tokens"))
    own = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_own"))
    there = own.where("_own is not null").groupBy(F.col("_own").alias("source")).agg(F.count("*").alias("n_docs"))
    wrong = uses.join(own, (uses._id == own._id) & uses.source.eqNullSafe(own._own), "left_anti").groupBy("source").agg(F.sum("uses").alias("foreign"))
    per = uses.join(F.broadcast(rated.select("source", "max_repeats")), "source", "left").groupBy("source").agg(
        F.count_if(F.col("uses") > F.col("max_repeats")).alias("over_used"), F.sum("n_tokens").alias("mixed"), F.sum("uses").alias("n_uses"))
    j = rated.join(there, "source", "left").join(per, "source", "left").join(wrong, "source", "left").fillna(0, ["n_docs", "over_used", "mixed", "foreign", "n_uses"])
    sums = j.agg(F.sum("mixed"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))), F.sum("n_uses")).first()
    tolerance += float(sums[2] or 1) ** -0.5
    target = F.when(F.col("tokens") > 0, F.col("target_share") / F.lit(float(sums[1] or 1))).otherwise(0.0)
    return j.select("source", "n_docs", "over_used", "foreign", (F.abs(F.col("mixed") / F.lit(float(sums[0] or 1)) - target) <= tolerance).alias("near_target"))


def mixture(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
            total_tokens: float | None = None, seed: int = 17, tokenizer_dir: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """The drawn ids and sizes (see :func:`draw`; :func:`records` gives the documents themselves) and the rates; texts are tokenized once and their sizes kept in the shared folder."""
    counted = materialize(token_counts(docs, text, [doc_id, source], tokenizer_dir))
    rated = rates(counted, targets, source, total_tokens)
    return draw(counted, rated, doc_id, source, seed), rated


def shares(drawn: DataFrame, rated: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, mixed_tokens, n_docs, n_uses, most_uses``: one row per listed source."""
    per = drawn.groupBy("source").agg(
        F.sum("n_tokens").alias("mixed_tokens"), F.count_if(F.col("copy") == 1).alias("n_docs"), F.count("*").alias("n_uses"), F.max("copy").alias("most_uses")
    )
    out = rated.join(per, "source", "left").fillna(0, ["mixed_tokens", "n_docs", "n_uses", "most_uses"])
    whole = drawn.agg(F.sum("n_tokens")).scalar()
    return out.select(
        "source", "target_share", F.coalesce(F.col("mixed_tokens") / whole, F.lit(0.0)).alias("actual_share"),
        "tokens", "mixed_tokens", "n_docs", "n_uses", "most_uses",
    )
