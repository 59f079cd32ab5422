"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded whole in a narrow map that gives only lengths; they are summed by length before and
after one shuffle. For every context limit L that occurs as a length, suffix sums give how many documents
and tokens reach past L and the corpus's tokens if each document is cut at L; any other limit and any
quantile follow from the row at or below it.

The sums are in two levels, blocks of ``SPAN`` lengths and lengths within a block, so no task holds the
histogram; the table of block sums has a row for each SPAN lengths that occur.

Edge cases: null and empty texts have length 0; an empty table gives no rows; repeated rows all count;
other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, col, materialize, resident, table, texts

SPAN = 1024
RANKS = "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(name: str):
    return resident(("ranks", name), lambda: _encoding(name))


def _encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, text_column: str = "text", ranks: str = RANKS) -> DataFrame:
    """(n_tokens): the encoded length of each whole text."""

    def run(batches):
        import pyarrow as pa

        enc = encoding(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode_ordinary(x)) for x in texts(batch.column(0))], pa.int64())], ["n_tokens"])

    return arrow_map(docs.select(col(text_column).cast("string").alias("text")), run, "n_tokens long", model=True)


def histogram(lens: DataFrame) -> DataFrame:
    """(n_tokens, docs)."""
    return lens.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens at it, at most at it and past it, and tokens_cut, the total
    if every document is cut at that length."""
    h = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / SPAN).alias("block"))
    upto = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    past = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(past), F.lit(0)).alias("docs_below"), F.coalesce(F.sum("bt").over(past), F.lit(0)).alias("tokens_below"),
        F.sum("bd").over(whole).alias("all_docs"), F.sum("bt").over(whole).alias("all_tokens"),
    )
    h = h.select("*", F.sum("docs").over(upto).alias("d"), F.sum("tokens").over(upto).alias("t")).join(blocks, "block")
    docs_to, tokens_to = F.col("docs_below") + F.col("d"), F.col("tokens_below") + F.col("t")
    return h.select(
        "n_tokens", "docs", "tokens", docs_to.alias("docs_upto"), (F.col("all_docs") - docs_to).alias("docs_past"), (F.col("all_tokens") - tokens_to).alias("tokens_past"),
        (tokens_to + F.col("n_tokens") * (F.col("all_docs") - docs_to)).alias("tokens_cut"), (docs_to / F.col("all_docs")).alias("quantile"),
    )


def cut_total(sums: DataFrame, limit: int) -> int:
    """The corpus's tokens if each document is cut at limit, any limit: from the last row at or below it."""
    row = sums.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).select("n_tokens", "tokens_cut", "docs_past").first()
    if row is None:
        some = sums.agg(F.max("docs_past"), F.max(F.when(F.col("docs_past") + F.col("docs_upto") > 0, F.col("docs_past") + F.col("docs_upto")))).first()
        return limit * (some[1] or 0)
    return row["tokens_cut"] + (limit - row["n_tokens"]) * row["docs_past"]


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents don't pass."""
    row = sums.where(F.col("quantile") >= q).orderBy("n_tokens").select("n_tokens").first()
    return row and row[0]


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    return suffix_sums(materialize(histogram(lengths(table(spark, sf_dir, "documents"))), "histogram"))
