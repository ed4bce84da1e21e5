"""Filling containers of fixed capacity with whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.plans.storage import spread, write_table

#: A token of the plain counter: a run of letters and digits, or one other character that is not white space.
PLAIN_TOKEN = r"(?U)[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Documents per shard, about. A shard is packed by one task; its last, ill-filled containers are the price of splitting.
SHARD_ITEMS = 20_000

BINS = "doc_id long, piece int, pieces int, size long, container string, used long, oversize boolean"


def plain_tokens(text: Column) -> Column:
    """Number of plain tokens of a text; 0 of a null or blank one."""
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_TOKEN)), F.lit(0)).cast("long")


def bpe_tokens(text: Column, vocabulary: str) -> Column:
    """Number of tokens by a byte-pair vocabulary in the ``tokenizers`` JSON format at the path ``vocabulary``.

    The path must be readable on every executor. Special tokens count as text.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            encoded = tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(e.ids) for e in encoded], dtype="int64")

    return count(text)


def fingerprint(text: Column) -> Column:
    """A 64-bit key of the letters and digits of a text, lower-cased: equal for copies that differ in layout or punctuation only."""
    return F.xxhash64(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", ""))


class Bins:
    """Open containers ordered by residual capacity.

    Each residual has a queue of containers; a bit mask of the residuals in use
    gives the successor of a size in one step. Every container carries bitmaps
    of the sources it holds (one for those held once or more, one for twice or
    more, ...) and one of the duplicate clusters. What keeps a container from an
    item keeps it from all items of the same source and cluster as long as it
    stays in its queue, so for each such pair and residual the search goes on
    where it ended; no container is looked at twice.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.queues: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.heads, self.alive = [0] * (capacity + 1), [0] * (capacity + 1)
        self.seen: dict[tuple[int, int, int], int] = {}
        self.mask = 0
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.used: list[int] = []
        self.place_of: list[tuple[int, int]] = []

    def _admits(self, b: int, source: int, cluster: int) -> bool:
        if self.clusters[b] & cluster:
            return False
        layers = self.sources[b]
        return len(layers) < self.per_source or not layers[self.per_source - 1] & source

    def place(self, size: int, source: int, cluster: int) -> int:
        """The tightest open container that fits and has no conflict, else a new one.

        The search goes from the smallest residual that fits to the next larger
        one, through all containers of each, until one admits the item. A source
        matters only if a container could hold more than ``per_source`` items.
        """
        pair = (source if self.per_source < self.capacity else 0, cluster)
        left = self.mask >> size
        while left:
            step = (left & -left).bit_length() - 1
            residual = size + step
            b = self._next(residual, pair, source, cluster)
            if b is not None:
                self._put(b, residual - size, size, source, cluster)
                return b
            left &= ~(1 << step)
        b = len(self.used)
        self.sources.append([])
        self.clusters.append(0)
        self.used.append(0)
        self.place_of.append((-1, -1))
        self._put(b, self.capacity - size, size, source, cluster)
        return b

    def _next(self, residual: int, pair: tuple[int, int], source: int, cluster: int) -> int | None:
        """Take the first container of a queue that admits the item out of it."""
        queue, head, key = self.queues[residual], self.heads[residual], (residual, *pair)
        while head < len(queue) and self.place_of[queue[head]] != (residual, head):
            head += 1
        self.heads[residual] = head
        i = max(head, self.seen.get(key, 0))
        while i < len(queue):
            b = queue[i]
            if self.place_of[b] == (residual, i) and self._admits(b, source, cluster):
                self.alive[residual] -= 1
                if not self.alive[residual]:
                    self.mask &= ~(1 << residual)
                break
            i += 1
        if any(pair):
            self.seen[key] = i
        return queue[i] if i < len(queue) else None

    def _put(self, b: int, residual: int, size: int, source: int, cluster: int) -> None:
        layers = self.sources[b]
        for i, layer in enumerate(layers):
            if not layer & source:
                layers[i] |= source
                break
        else:
            layers.append(source)
        self.clusters[b] |= cluster
        self.used[b] += size
        self.place_of[b] = (residual, len(self.queues[residual]))
        self.queues[residual].append(b)
        self.alive[residual] += 1
        self.mask |= 1 << residual


def pack_shard(pdf: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Pack one shard, largest items first; only clusters met more than once need a bit."""
    pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    codes, _ = pd.factorize(pdf["source"], use_na_sentinel=False)
    shared = pdf["cluster"].duplicated(keep=False) & pdf["cluster"].notna()
    cluster_codes, _ = pd.factorize(pdf["cluster"].where(shared), use_na_sentinel=True)
    bins = Bins(capacity, per_source)
    placed = [bins.place(int(s), 1 << int(c), (1 << int(k)) if k >= 0 else 0) for s, c, k in zip(pdf["size"], codes, cluster_codes, strict=True)]
    shard = int(pdf["shard"].iloc[0])
    out = pdf[["doc_id", "piece", "pieces", "size"]].copy()
    out["container"] = [f"{shard}-{b}" for b in placed]
    out["used"] = [bins.used[b] for b in placed]
    out["oversize"] = out["pieces"] > 1
    return out


def pack(items: DataFrame, capacity: int = 1024, per_source: int = 1024, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign every item of ``items(doc_id, size, source, cluster)`` to containers of ``capacity``.

    Conflict-constrained best fit, largest items first: among the open containers
    ordered by residual, the search goes on from the tightest that fits until one
    is found that holds no member of the item's duplicate cluster and fewer than
    ``per_source`` items of its source. Items are spread over shards by a hash of
    their id (a large source or cluster spreads with them), a container belongs
    to one shard, and each shard is packed by itself, so conflicts need no look
    beyond it; a shard wastes at most a few ill-filled containers.

    An item larger than ``capacity`` is the only kind that is split: into full
    pieces, each a container of its own, and a rest that is packed like an item
    (pieces of one item do not conflict with each other's container, which is
    full). Items of size 0, and of null size, need no room and come out with a
    null container. Null clusters conflict with nothing; null sources count as
    one source. Repeated ids are packed each by itself. The items are written once,
    so sizes are worked out once, and counted to choose the number of shards
    (actions). Empty in, empty out.
    """
    items = write_table(items.select("doc_id", "size", "source", "cluster"), "sizes")
    n_shards = max(1, -(-items.count() // shard_items))
    sized = items.select("doc_id", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), "source", "cluster")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    room = sized.where("size > 0").withColumn("pieces", pieces).withColumn("full", F.floor(F.col("size") / capacity).cast("int"))
    rest = room.where(F.col("size") % capacity > 0).select("doc_id", "source", "cluster", "full", "pieces", (F.col("size") % capacity).alias("size"))
    full = room.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), "pieces")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")
    shards = rest.select("doc_id", F.col("full").alias("piece"), "pieces", "size", "source", "cluster", shard.alias("shard"))
    packed = spread(shards, "shard").groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity, per_source), BINS)
    whole = full.select("doc_id", "piece", "pieces", F.lit(capacity).cast("long").alias("size"), F.concat(F.lit("f-"), "doc_id", F.lit("-"), "piece").alias("container"), F.lit(capacity).cast("long").alias("used"), (F.col("pieces") > 1).alias("oversize"))
    nothing = sized.where("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("container"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("oversize"))
    return packed.unionByName(whole).unionByName(nothing)


def packing_facts(packed: DataFrame, capacity: int = 1024, slack: float = 1.02) -> DataFrame:
    """One row on a packing: documents and tokens placed, containers over capacity, documents split that fit whole, wrong totals of ``used``, and whether the containers are at most ``slack`` times the least possible (and one a shard's share more)."""
    placed = packed.where("container is not null")
    bins = placed.groupBy("container").agg(F.sum("size").alias("load"), F.max("used").alias("used"))
    docs = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    of_bins = bins.agg(F.count("*").alias("containers"), F.sum((F.col("load") > capacity).cast("long")).alias("overfull"), F.sum((F.col("load") != F.col("used")).cast("long")).alias("wrong_used"))
    of_docs = docs.agg(F.count("*").alias("documents"), F.sum("size").alias("tokens"), F.sum(((F.col("size") <= capacity) & (F.col("n") > 1)).cast("long")).alias("split_needlessly"))
    both = of_bins.withColumn("_k", F.lit(0)).join(of_docs.withColumn("_k", F.lit(0)), "_k")
    return both.select("documents", "tokens", "overfull", "split_needlessly", "wrong_used", (F.col("containers") <= F.ceil(F.col("tokens") / capacity) * slack + 1).alias("tight"))


def pack_documents(documents: DataFrame, capacity: int = 1024, per_source: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Pack the documents by their number of tokens: plain tokens, or those of the ``tokenizers`` file ``vocabulary``."""
    size = bpe_tokens(F.col("text"), vocabulary) if vocabulary else plain_tokens(F.col("text"))
    items = documents.select("doc_id", "source", "text").where("doc_id is not null").select("doc_id", size.alias("size"), "source", fingerprint(F.col("text")).alias("cluster"))
    return pack(items, capacity, per_source)
