"""Mixing sources to target shares by Sainte-Laguë apportionment of equal-token blocks.

Texts are counted in tokens and laid in a seeded order over all of their source, which is cut into
blocks of equal size. Blocks are handed to the sources by the highest quotients share / (2k + 1);
a source that has given all its tokens as often as it may gets no more, and the rest goes on to the
others, until the blocks hold the wished size. Each source gives the tokens of its blocks in the seeded
order, whole rounds first. The order is that of shards and of keys in them, so that no task sorts a source:
a text's place is its place in the shard behind the tokens of the shards before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.text import normalize
from crumbtrail.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks that the whole mixture is cut into: the grain of the shares.
BLOCKS = 2048
#: Texts that a shard holds on average; a shard is ordered in one task.
SHARD_TEXTS = 20_000


@lru_cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (normalised), n_tokens. A null text has no tokens; an id counts once."""
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), normalize(F.col(source)).alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "source", "n_tokens"])

    return narrow.mapInArrow(run, f"doc_id {kind}, source string, n_tokens long").dropDuplicates(["doc_id"])


def _seats(claims: DataFrame, within: list[str], weight: str, cap: str, seats: str, held: str | None = None, block: int = 1, wish: int = 0) -> DataFrame:
    """Each claim's number of seats by highest quotients, at most its ``cap``; ties by ``name``.

    With ``held``, the tokens a claim can give, seats are handed out until they hold ``wish`` tokens: a seat holds
    ``block`` of them, and a claim's last one what is left.
    """
    quotients = claims.where((F.col(weight) > 0) & (F.least(cap, seats) > 0)).select(
        *within, "name", seats, weight, *([held] if held else []), F.explode(F.sequence(F.lit(0).cast("long"), F.least(cap, seats) - 1)).alias("k")
    )
    order = Window.partitionBy(*within).orderBy((F.col(weight).cast("double") / (2 * F.col("k") + 1)).desc(), "name", "k")
    if held:
        tokens = F.least(F.lit(block).cast("long"), F.col(held) - F.col("k") * F.lit(block))
        before = F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, -1))
        taken = quotients.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < F.lit(wish))
    else:
        taken = quotients.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col(seats))
    return taken.groupBy(*within, "name").agg(F.count("*").alias("quota"))


def _ahead(parts: DataFrame, span: int) -> DataFrame:
    """``parts`` with the tokens of their source's shards before them: summed over spans of shards, and inside of one."""
    parts = parts.withColumn("_span", F.floor(F.col("shard") / F.lit(span)))
    inside = F.sum("held").over(Window.partitionBy("source", "_span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = parts.groupBy("source", "_span").agg(F.sum("held").alias("held")).select("source", "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    return parts.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(spans, ["source", "_span"]).withColumn("ahead", F.col("_inside") + F.col("_before")).drop("_span", "_inside", "_before")


def _goals(targets: DataFrame) -> DataFrame:
    goals = targets.select(normalize(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").cast("long").alias("repeats"))
    return goals.where("source IS NOT NULL AND share > 0 AND NOT isnan(share) AND repeats > 0").groupBy("source").agg(F.max(F.struct("share", "repeats")).alias("g")).select("source", "g.*")


def _block(wish: int, blocks: int, held: int, texts: int) -> int:
    """A block holds some texts at least, or blocks could not be of one size."""
    return max(1, -(-wish // blocks), 2 * -(-held // max(1, texts)))


def _takes(stock: DataFrame, block: int, wish: int) -> DataFrame:
    """source, have, quota, take: the tokens that each source (source, share, repeats, have) gives."""
    stock = stock.withColumn("most", F.col("have") * F.col("repeats"))
    cap = F.ceil(F.col("most").cast("decimal(38,0)") / F.lit(block)).cast("long")
    claims = stock.select(F.lit(0).alias("_all"), F.col("source").alias("name"), F.col("share").alias("weight"), cap.alias("cap"), F.lit(-(-wish // block)).cast("long").alias("seats"), "most")
    quotas = _seats(claims, ["_all"], "weight", "cap", "seats", "most", block, wish).select(F.col("name").alias("source"), "quota")
    return stock.join(quotas, "source").select("source", "have", "quota", F.least(F.col("quota") * F.lit(block), "most").alias("take"))


def quotas(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """source, have, quota, take of ``mixture``: the tokens of each targeted source, its blocks, and the tokens it is to give."""
    stock = counted.where(F.col("n_tokens") > 0).join(_goals(targets), "source").groupBy("source", "share", "repeats").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n"))
    stock = stage(stock, "stock")
    held, n = stock.agg(F.coalesce(F.sum("have"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wish = total_tokens if total_tokens is not None else held
    return _takes(stock.drop("n"), _block(wish, blocks, held, n), wish)


def mixture(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, copies of the texts taken, by ``count_tokens`` and the targets.

    ``targets`` has source, target_share, max_repeats. ``total_tokens`` is the wished size (all
    tokens of the targeted sources if not given); less comes out if the sources, each taken
    ``max_repeats`` times, don't reach it. Texts without a source, of a source that isn't targeted, or
    without tokens are left out, and so are targets with a null or a share or repeats below
    one. A source named twice takes the first row by share and repeats. The apportionment handles
    at most ``blocks`` seats, whatever the size of the collection.
    """
    texts = stage(counted.where(F.col("n_tokens") > 0).join(_goals(targets), "source").select("doc_id", "source", "n_tokens", "repeats", "share"), "texts")
    size = texts.agg(F.sum("n_tokens"), F.count("*")).first()
    wish = total_tokens if total_tokens is not None else (size[0] or 0)
    block = _block(wish, blocks, size[0] or 0, size[1])
    shards = max(1, size[1] // SHARD_TEXTS)
    # Places: the seeded order within a shard of a source, behind all tokens of its shards before.
    key = F.xxhash64(F.lit(seed), "doc_id")
    texts = texts.withColumn("_key", key).withColumn("shard", F.pmod(F.xxhash64("_key"), F.lit(shards)))
    before = F.sum("n_tokens").over(Window.partitionBy("source", "shard").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    laid = stage(texts.withColumn("place", F.coalesce(before, F.lit(0))), "laid")
    parts = laid.groupBy("source", "shard", "share", "repeats").agg(F.sum("n_tokens").alias("held"))
    parts = _ahead(parts, int(shards**0.5) + 1)
    stock = parts.groupBy("source", "share", "repeats").agg(F.sum("held").alias("have"))
    takes = _takes(stock, block, wish).select("source", F.expr("take div have").alias("rounds"), (F.col("take") % F.col("have")).alias("rest"))
    picked = laid.join(parts.select("source", "shard", "ahead").join(takes, "source"), ["source", "shard"])
    copies = F.col("rounds") + F.when(F.col("ahead") + F.col("place") < F.col("rest"), 1).otherwise(0)
    return picked.withColumn("copies", copies.cast("long")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def reachable_total(counted: DataFrame, targets: DataFrame) -> int:
    """The largest size at which no source that has texts falls short of its share."""
    goals = targets.select(normalize(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
    stock = counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    held = goals.where("share > 0 AND repeats > 0").join(stock, "source").agg(F.min(F.col("n") * F.col("repeats") / F.col("share")), F.sum("share")).first()
    return int(held[0] * held[1]) if held[0] is not None else 0


def reached_shares(counted: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, tokens, actual_share: one row per target."""
    goals = targets.select(normalize(F.col("source")).alias("source"), "target_share", "max_repeats")
    stock = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    took = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    all_ = took.agg(F.sum("tokens").alias("_all"))
    out = goals.join(stock, "source", "left").join(took, "source", "left").crossJoin(F.broadcast(all_))  # one row
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("_all").cast("double")), F.lit(0.0))
    return out.select("source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"), share.alias("actual_share"))
