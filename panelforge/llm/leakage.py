"""Evaluation passages that stand, fully or partly, in a corpus of scanned pages.

A prefix-filtered set join. The shingles are runs of letters, since misread
letters and broken words leave few runs of five words whole. All corpus
documents are counted to order the shingles by rarity. Of every item-sized
window as many of the most frequent shingles are left out as a page that holds
the window can do without; the rest are the prefix. Pages meet items by an
equi-join on prefix shingles, under bounds of length and position; what is left
is held against whole windows and then verified word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.reading import fold, gram_hashes, gram_numbers, page_streams, word_ends
from panelforge.plans.storage import spread, write_table

#: Letters per shingle of the join; per stretch of the verification, by itself and beside a longer one.
SHINGLE, ANCHOR, SEED = 12, 10, 6
#: Words of an item-sized window, and words of the item that must stand in a page.
WINDOW, ENOUGH = 25, 23
#: Items that one passage has at most; a longer opening that more texts share is an instruction.
PASSAGE = 20
#: A page that holds a window shares at least SHARED of its shingles, and at least NEEDED of its prefix; half of these lie on one side of an advertisement.
SHARED, NEEDED = 0.42, 28
#: Share of a run's shingles that lie in the chain of common stretches, at the least.
CHAINED = 0.35
#: Same-diagonal stretches so many letters apart are one.
JOINED = 15
#: Letters by which shared shingles of one place may be shifted against each other (half, twice).
BAND = 64
#: Letters of pages hashed at once.
CHUNK = 1 << 16
#: Between matched stretches: letters of the item, letters of the page (an advertisement).
ITEM_GAP, PAGE_GAP = 30, 600
#: A table has SLOTS slots of two bytes a shingle as long as that makes no more than 2**MOST_SLOTS; beyond, more pages and rows meet the joins, and none is lost.
SLOTS, MOST_SLOTS = 16, 25
#: The value of a slot that shingles of different values fall into.
SEVERAL = 0xFFFF
#: Prefix shingles (20 bytes each) up to which they and their items are sent to all executors, where a page's join needs no shuffle; beyond, the joins are those of tables.
SENT_SHINGLES = 1_000_000


@dataclass
class Table:
    """Values of two bytes by hash, of bounded size: 0 of a hash that is not in it, SEVERAL where hashes of different values meet."""

    values: np.ndarray

    def look(self, hashes: np.ndarray) -> np.ndarray:
        return self.values[hashes & (len(self.values) - 1)]


def mark(c: Column) -> Column:
    """A value for a table, from 1 to 65,534, of a column of whole numbers."""
    return (F.pmod(F.shiftright(c, 40), F.lit(65_534)) + 1).cast("int")


def marks(hashes: np.ndarray) -> np.ndarray:
    """The same of an array."""
    return ((hashes >> 40) % 65_534 + 1).astype(np.uint16)


def table_of(shingles: DataFrame) -> Table:
    """The table of ``hash, value``: made in segments where the rows are, brought to the driver (at most 64 MB). Two actions."""
    n = 1 << min(MOST_SLOTS, max(16, (SLOTS * shingles.count()).bit_length()))
    slots = shingles.groupBy(F.col("hash").bitwiseAND(F.lit(n - 1)).alias("slot")).agg(F.min("value").alias("value"), F.max("value").alias("other"))
    slots = slots.select(F.shiftright("slot", 15).cast("int").alias("segment"), "slot", F.when(F.col("value") == F.col("other"), F.col("value")).otherwise(SEVERAL).alias("value"))

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(1 << 15, dtype="<u2")
        values[pdf["slot"].to_numpy() & 0x7FFF] = pdf["value"].to_numpy()
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bytes": [values.tobytes()]})

    values = np.zeros(n, dtype="<u2")
    for row in slots.groupBy("segment").applyInPandas(segment, "segment int, bytes binary").collect():
        values[row["segment"] << 15 : (row["segment"] + 1) << 15] = np.frombuffer(row["bytes"], "<u2")
    return Table(values)


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.?!:])\s+", text.strip())


def heads(text: str) -> list[int]:
    """A hash of each run of leading sentences of four or more words, the shortest run first."""
    h, out = hashlib.blake2b(digest_size=8), []
    for sentence in _sentences(text):
        if len(sentence.split()) < 4:
            break
        h.update(fold(sentence) + b"|")
        out.append(int.from_bytes(h.digest(), "big", signed=True))
    return out


def body(text: str, shared: Mapping[int, int]) -> str:
    """The text without the instructions before it; ``shared`` has in how many texts each of the shared :func:`heads` stands.

    Sentences that the same texts share make one piece, taken off or kept as a
    whole. A piece is the passage's own text, and kept with all after it, if the
    text could not be found without it, or if it could be found by itself (it has
    ENOUGH words) and no more than PASSAGE texts share it.
    """
    sentences, counts = _sentences(text), [shared.get(h, 1) for h in heads(text)]
    length, start = [len(s.split()) for s in sentences], 0
    while start < len(counts) and counts[start] > 1:
        end = start + 1
        while end < len(counts) and counts[end] == counts[start]:
            end += 1
        left = sum(length[end:])
        if not left or left < ENOUGH <= sum(length) or (sum(length[start:end]) >= ENOUGH and counts[start] <= PASSAGE):
            break
        start = end
    return " ".join(sentences[start:])


def bodies(texts: list[str]) -> list[str]:
    """The texts without the instructions that several different ones begin with."""
    shared = Counter(h for t in set(texts) for h in heads(t))
    return [body(t, shared) for t in texts]


def windows_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shingle of each window of an item, and one past its last; the whole item where it is shorter."""
    starts = np.concatenate([[0], ends[:-1]])[: max(1, len(ends) - WINDOW + 1)]
    last = ends[min(WINDOW, len(ends)) - 1 :]
    return starts, np.maximum(starts + 1, last - SHINGLE + 1)


def prefix_of(ends: np.ndarray, hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Positions of an item's prefix shingles.

    From the most frequent shingle (then by hash) to the rarest, each is left out
    if all windows that it belongs to can do without it: a page that holds a
    window shares SHARED of its shingles, so it still shares NEEDED of those kept
    as long as no more than the rest has been left out.
    """
    first, end = windows_of(ends)
    spare = np.floor(SHARED * (end - first)).astype(np.int64) - NEEDED
    low, high = np.searchsorted(end, np.arange(len(hashes)), "right"), np.searchsorted(first, np.arange(len(hashes)), "right")
    kept = np.ones(len(hashes), dtype=bool)
    for i in np.lexsort((hashes, frequency))[::-1]:
        if low[i] < high[i] and spare[low[i] : high[i]].min() > 0:
            spare[low[i] : high[i]] -= 1
            kept[i] = False
    return np.nonzero(kept)[0]


def holds_window(hashes: np.ndarray, numbers: np.ndarray, ends: np.ndarray, page: bytes) -> bool:
    """Whether the page shares enough shingles with some window of the item, whatever their order.

    ``hashes`` are the item's different shingles in order, ``numbers`` their places in
    it by position. A run of ENOUGH words fills no whole window, so the share asked
    for is that much smaller.
    """
    here = gram_hashes(page, SHINGLE)
    place = np.minimum(np.searchsorted(hashes, here), len(hashes) - 1)
    seen = np.zeros(len(hashes), dtype=np.int64)
    seen[place[hashes[place] == here]] = 1
    shared = np.concatenate([[0], np.cumsum(seen[numbers])])
    first, end = windows_of(ends)
    end = np.minimum(end, len(numbers))
    return bool((shared[end] - shared[first] >= SHARED * ENOUGH / WINDOW * (end - first)).any())


def best_run(item: bytes, ends: np.ndarray, piece: bytes, lows: np.ndarray, highs: np.ndarray, enough: int = ENOUGH) -> tuple[int, int]:
    """The longest :func:`longest_run` around the places ``lows`` to ``highs`` of a piece of a page; near places are looked at together."""
    reach, best = len(item) + PAGE_GAP, (0, 0)
    hashes, numbers = np.unique(gram_hashes(item, SHINGLE), return_inverse=True)
    if not len(hashes):
        return best
    order = np.argsort(lows, kind="stable")
    begin = end = -1
    for low, high in [*zip((lows - reach)[order].tolist(), (highs + reach)[order].tolist(), strict=True), (None, None)]:
        if end >= 0 and low is not None and low <= end and high - begin <= 4 * reach:
            end = max(end, high)
            continue
        if end >= 0:
            part = piece[begin:end]
            if holds_window(hashes, numbers, ends, part):
                best = max(best, longest_run(item, ends, part, enough))
        begin, end = (max(0, low), high) if low is not None else (-1, -1)
    return best


def stretches(item: bytes, page: bytes) -> np.ndarray:
    """Rows ``(item position, page position, length)`` of the common stretches, by item position.

    They have ANCHOR letters or more, or SEED and lie beside one that has, hardly shifted against it.
    """
    gi, gp = gram_numbers(item, SEED), gram_numbers(page, SEED)
    order = np.argsort(gi, kind="stable")
    ranked = gi[order]
    low, high = np.searchsorted(ranked, gp, "left"), np.searchsorted(ranked, gp, "right")
    n = high - low
    total = int(n.sum())
    if not total:
        return np.zeros((0, 3), dtype=np.int64)
    p = np.repeat(np.arange(len(gp)), n)
    i = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)]
    by = np.lexsort((i, p - i))
    i, p = i[by], p[by]
    starts = np.nonzero(np.concatenate([[True], (np.diff(p - i) != 0) | (np.diff(i) > 1)]))[0]
    ends = np.concatenate([starts[1:], [total]]) - 1
    found = np.stack([i[starts], p[starts], i[ends] - i[starts] + SEED], axis=1)
    anchors = found[found[:, 2] >= ANCHOR]
    beside = (np.abs(found[:, :1] - anchors[:, 0]) <= 2 * BAND) & (np.abs((found[:, 1] - found[:, 0])[:, None] - (anchors[:, 1] - anchors[:, 0])) <= 2 * SEED)
    found = found[beside.any(axis=1)]
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def best_chain(found: np.ndarray) -> np.ndarray:
    """The stretches, in the order of item and page, that cover most letters of the item at the least shift.

    Stretches of one diagonal with few letters between them go together.
    """
    found = found[np.lexsort((found[:, 0], found[:, 1] - found[:, 0]))]
    gap = found[1:, 0] - found[:-1, 0] - found[:-1, 2]
    starts = np.nonzero(np.concatenate([[True], (np.diff(found[:, 1] - found[:, 0]) != 0) | (gap > JOINED)]))[0]
    ends = np.concatenate([starts[1:], [len(found)]])
    letters = np.concatenate([[0], np.cumsum(found[:, 2])])
    by = np.lexsort((found[starts, 1], found[starts, 0]))
    starts, ends = starts[by], ends[by]
    i, p = found[starts, 0], found[starts, 1]
    i_end, p_end = found[ends - 1, 0] + found[ends - 1, 2], found[ends - 1, 1] + found[ends - 1, 2]
    own = letters[ends] - letters[starts]
    score = own - 0.2 * (i_end - i - own)
    before = np.full(len(starts), -1)
    furthest = np.maximum.accumulate(i_end)
    low = 0
    for j in range(1, len(starts)):
        while low < j and furthest[low] < i[j] - ITEM_GAP:
            low += 1
        gap_i, gap_p = i[j] - i_end[low:j], p[j] - p_end[low:j]
        fits = np.nonzero((p[low:j] < p[j]) & (gap_i > -SEED) & (gap_p > -SEED) & (gap_i <= ITEM_GAP) & (gap_p <= PAGE_GAP) & (i[low:j] < i[j]))[0]
        if len(fits):
            gap_i, gap_p = gap_i[fits], gap_p[fits]
            shift = np.abs(gap_p - gap_i)
            toll = np.where(shift == 0, 0.0, np.where(shift <= 15, np.minimum(6.0, 1 + 0.3 * shift), 14.0)) + 0.2 * np.maximum(gap_i, 0) + np.maximum(0, np.maximum(-gap_i, -gap_p))
            total = score[low + fits] - toll
            b = int(np.argmax(total))
            if total[b] > 0:
                score[j] += total[b]
                before[j] = low + fits[b]
    path, j = [], int(np.argmax(score))
    while j >= 0:
        path.append(np.arange(starts[j], ends[j]))
        j = int(before[j])
    return found[np.concatenate(path[::-1])]


def _longest(covered: np.ndarray, whole: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """The longest run of words, and how many match, by the letters ``covered`` and the shingles that lie ``whole`` in what is common."""
    letters, shingles = np.concatenate([[0], np.cumsum(covered)]), np.concatenate([[0], np.cumsum(whole)])
    starts = np.concatenate([[0], ends[:-1]])
    match = (letters[ends] - letters[starts]) * 2 >= ends - starts
    count = np.concatenate([[0], np.cumsum(match)])
    at = np.nonzero(match)[0]
    best = (0, 0)
    for k, a in enumerate(at):
        b = at[k:][::-1]
        words = b - a + 1
        b, words = b[words > best[0]], words[words > best[0]]
        if not len(b):
            break
        some = count[b + 1] - count[a]
        ok = (some >= words - np.maximum(1, np.rint(words / 10))) & (shingles[ends[b]] - shingles[starts[a]] >= CHAINED * (ends[b] - starts[a] - SHINGLE + 1))
        if ok.any():
            best = (int(words[ok.argmax()]), int(some[ok.argmax()]))
    return best


def _cover(found: np.ndarray, n: int, bridge: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of an item's ``n`` letters lie in the stretches, or in gaps of up to ``bridge`` letters between one and the next; and which shingles lie in one whole."""
    covered, whole = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    i, p, length = found[:, 0], found[:, 1], found[:, 2]
    np.add.at(covered, i, 1)
    np.add.at(covered, i + length, -1)
    np.add.at(whole, i, 1)
    np.add.at(whole, np.maximum(i, i + length - SHINGLE + 1), -1)
    gap_i, gap_p = i[1:] - i[:-1] - length[:-1], p[1:] - p[:-1] - length[:-1]
    near = np.nonzero((gap_i > 0) & (gap_i <= bridge) & (np.abs(gap_i - gap_p) <= 2))[0]
    np.add.at(covered, (i + length)[near], 1)
    np.add.at(covered, i[near + 1], -1)
    return np.cumsum(covered)[:n] > 0, np.cumsum(whole)[:n] > 0


def longest_run(item: bytes, ends: np.ndarray, page: bytes, enough: int = 0) -> tuple[int, int]:
    """Words of the item's longest run that stands in the page, and how many of them match.

    A word matches if at least half of its letters lie in the chain of common
    stretches; of the run's words at most one in ten is unmatched, and none at
    its ends. Single misread letters between two stretches count as common. Of
    the run's shingles at least the share CHAINED must lie in the chain, so that
    turns of speech strung together make no run. If all stretches together,
    whatever their order, have no run of ``enough`` words, no chain is sought.
    """
    found = stretches(item, page)
    if not len(found):
        return 0, 0
    if enough:
        covered, whole = _cover(found, len(item), 0)
        edge = np.concatenate([[0], covered, [0]])
        left, right = np.nonzero(np.diff(edge) < 0)[0], np.nonzero(np.diff(edge) > 0)[0]
        for a, b in zip(left[:-1], right[1:], strict=True):
            if b - a <= SEED:
                covered[a:b] = True
        if _longest(covered, whole, ends)[0] < enough:
            return 0, 0
    return _longest(*_cover(best_chain(found), len(item), SEED), ends)


def _streams(batch: pa.RecordBatch) -> list[bytes]:
    boxes = []
    for c in ("line_x", "line_y"):
        column = batch.column(c)
        boxes.append((column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
    (x, n_x), (y, n_y) = boxes
    return page_streams(batch.column("text").to_pylist(), x, y, n_x, n_y)


def _found(streams: list[bytes], table: Table, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(page, position, hash, value) of the shingles of pages that are in the table, some pages at a time; no page's are split.

    ``own``: the table's values are the marks of its hashes, and must be those of the page's.
    """
    n = np.array([len(s) for s in streams], dtype=np.int64)
    first = 0
    while first < len(streams):
        last = first + 1
        size = n[first]
        while last < len(streams) and size + n[last] <= CHUNK:
            size += n[last] + 1
            last += 1
        letters = b"\0".join(streams[first:last])
        begin = np.cumsum(n[first:last] + 1) - n[first:last] - 1
        at, hashes, values = [], [], []
        for s in range(0, max(1, len(letters) - SHINGLE + 1), CHUNK):
            h = gram_hashes(letters[s : s + CHUNK + SHINGLE - 1], SHINGLE)
            value = table.look(h)
            here = np.nonzero(value)[0]
            if own:
                here = here[(value[here] == SEVERAL) | (value[here] == marks(h[here]))]
            at.append(here + s)
            hashes.append(h[here])
            values.append(value[here])
        at = np.concatenate(at)
        page = np.searchsorted(begin, at, "right") - 1
        yield page + first, at - begin[page], np.concatenate(hashes), np.concatenate(values)
        first = last


def _head_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        runs = [(i, h) for i, t in zip(pdf["item"], pdf["text"], strict=True) for h in heads(t)]
        yield pd.DataFrame(runs, columns=["item", "head"], dtype="int64")


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = [word_ends(body(t, dict(zip(*map(list, (h, c)), strict=True)))) for t, h, c in zip(pdf["text"], pdf["heads"], pdf["counts"], strict=True)]
        yield pd.DataFrame({"item": pdf["item"], "ids": pdf["ids"], "stream": [s for s, _ in pairs], "ends": [e for _, e in pairs]})


def items_of(eval_items: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """``item, ids, stream, ends``: each different text once, without the instructions that different texts of the whole table begin with (two tables are written).

    Texts of fewer than ``enough`` words are left out.
    """
    pairs = eval_items.select("item_id", "text").where("item_id is not null and text is not null")
    texts = write_table(pairs.groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids")).withColumn("item", F.monotonically_increasing_id()), "texts")
    runs = texts.select("item", "text").mapInPandas(_head_rows, "item long, head long")
    counts = runs.groupBy("head").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    shared = runs.join(counts, "head").groupBy("item").agg(F.collect_list(F.struct("head", "n")).alias("shared"))
    opened = texts.join(shared, "item", "left").select("item", "ids", "text", F.coalesce("shared.head", F.array().cast("array<long>")).alias("heads"), F.coalesce("shared.n", F.array().cast("array<int>")).alias("counts"))
    items = opened.mapInPandas(_item_rows, "item long, ids array<long>, stream binary, ends array<int>")
    return write_table(items.where(F.size("ends") >= enough), "items")


def shingles_of(items: DataFrame) -> DataFrame:
    """``item, at, hash`` of all shingles of the items."""

    def cut(batches):
        for pdf in batches:
            hashes = [gram_hashes(s, SHINGLE) for s in pdf["stream"]]
            n = [len(h) for h in hashes]
            yield pd.DataFrame({"item": np.repeat(pdf["item"].to_numpy(np.int64), n), "at": np.concatenate([np.arange(k, dtype=np.int32) for k in [0, *n]]), "hash": np.concatenate([np.zeros(0, np.int64), *hashes])})

    return items.select("item", "stream").mapInPandas(cut, "item long, at int, hash long")


def page_counts(pages: DataFrame, members: Table) -> DataFrame:
    """``hash, pages``: in how many pages of the whole corpus each shingle of the table occurs (and a few others)."""
    sent = pages.sparkSession.sparkContext.broadcast(members)

    def count(batches):
        for batch in batches:
            seen = []
            for page, _, h, _ in _found(_streams(batch), sent.value, own=True):
                order = np.lexsort((h, page))
                page, h = page[order], h[order]
                seen.append(h[np.concatenate([np.ones(min(1, len(h)), dtype=bool), (np.diff(h) != 0) | (np.diff(page) != 0)])])
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["hash", "pages"])

    return pages.mapInArrow(count, "hash long, pages long").groupBy("hash").agg(F.sum("pages").alias("pages"))


def prefixes(items: DataFrame, shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """``item, at, hash`` of the prefix shingles of all items."""

    def choose(batches):
        for pdf in batches:
            for item, ends, at, h, n in pdf.itertuples(index=False):
                order = np.argsort(at)
                kept = prefix_of(np.asarray(ends), np.asarray(h)[order], np.asarray(n)[order])
                yield pd.DataFrame({"item": np.full(len(kept), item), "at": kept.astype(np.int32), "hash": np.asarray(h)[order][kept]})

    lists = shingles.join(counts, "hash", "left").groupBy("item").agg(F.collect_list(F.struct("at", "hash", F.coalesce("pages", F.lit(0)).alias("n"))).alias("s"))
    return items.select("item", "ends").join(lists, "item").select("item", "ends", "s.at", "s.hash", "s.n").mapInPandas(choose, "item long, at int, hash long")


@dataclass
class Index:
    """Prefix shingles in ascending order of hash, each with its item (a number) and position, and the items' streams and ends of words."""

    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    ids: list[np.ndarray]
    streams: list[bytes]
    ends: list[np.ndarray]

    def places(self, page: np.ndarray, at: np.ndarray, hashes: np.ndarray, least: int, longest: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By page and item the places as :func:`candidates` has them."""
        first = np.searchsorted(self.hashes, hashes, "left")
        n = np.searchsorted(self.hashes, hashes, "right") - first
        posting = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        pair, at, item_at = np.repeat(page * len(self.ids), n) + self.item[posting], np.repeat(at, n), self.at[posting]
        enough = np.bincount(pair)[pair] >= least if len(pair) else np.zeros(0, dtype=bool)
        pair, at, item_at = pair[enough], at[enough], item_at[enough]
        band = (at - item_at) // BAND
        pair, at, item_at, band = np.tile(pair, 2), np.tile(at, 2), np.tile(item_at, 2), np.concatenate([band, band - 1])
        order = np.lexsort((item_at, band, pair))
        pair, at, item_at, band = pair[order], at[order], item_at[order], band[order]
        begins = np.concatenate([np.ones(min(1, len(pair)), dtype=bool), (np.diff(pair) != 0) | (np.diff(band) != 0)])
        starts, group = np.nonzero(begins)[0], np.cumsum(begins) - 1
        new = np.nonzero(begins | np.concatenate([np.zeros(min(1, len(pair)), dtype=bool), np.diff(item_at) != 0]))[0]
        g, i = group[new], item_at[new]
        full = (g[least - 1 :] == g[: len(g) - least + 1]) & (i[least - 1 :] - i[: len(i) - least + 1] <= longest) if len(g) >= least else np.zeros(0, dtype=bool)
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if full.any():
            low, high = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)
            for k in np.unique(g[: len(full)][full]):
                out.setdefault(divmod(int(pair[starts[k]]), len(self.ids)), []).append((int(low[k]), int(high[k])))
        return out


def local_runs(pages: DataFrame, items: DataFrame, prefix: DataFrame, least: int, longest: int, enough: int) -> DataFrame:
    """``doc_id, ids, words, matched``: join and verification where the pages are, with the prefix shingles and their items sent there."""
    rows = prefix.toPandas().sort_values(["hash", "item", "at"])
    texts = items.orderBy("item").toPandas()
    index = Index(rows["hash"].to_numpy(), np.searchsorted(texts["item"].to_numpy(), rows["item"].to_numpy()), rows["at"].to_numpy(np.int64), [np.asarray(v) for v in texts["ids"]], list(map(bytes, texts["stream"])), [np.asarray(v, dtype=np.int64) for v in texts["ends"]])
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast((index, table_of(prefix.select("hash", mark(F.col("hash")).alias("value")))))

    def join(batches):
        index, table = sent.value
        for batch in batches:
            streams, out = _streams(batch), []
            for page, at, h, _ in _found(streams, table, own=True):
                for (k, i), places in index.places(page, at, h, least, longest).items():
                    lows, highs = np.array(places).T
                    words, matched = best_run(index.streams[i], index.ends[i], streams[k], lows, highs, enough)
                    if words >= enough:
                        out.append((batch.column("doc_id")[k].as_py(), index.ids[i], words, matched))
            ids, items, words, matched = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(words, pa.int32()), pa.array(matched, pa.int32())], ["doc_id", "ids", "words", "matched"])

    return pages.mapInArrow(join, "doc_id long, ids array<long>, words int, matched int")


def near_ones(page: np.ndarray, at: np.ndarray, value: np.ndarray, least: int, longest: int) -> np.ndarray:
    """Which shingles of pages lie among ``least`` of one value, or of SEVERAL, within a stretch that one window can take.

    Those of SEVERAL may be of any value: a page with some of them needs so many fewer of one, and keeps them.
    """
    wild = value == SEVERAL
    free = np.bincount(page[wild], minlength=int(page[-1]) + 1 if len(page) else 0)
    order = np.lexsort((at, value, page))
    k, a = page[order] * 65_536 + value[order], at[order]
    need = np.where(wild[order], least, np.maximum(1, least - free[page[order]]))
    last = np.arange(len(order)) + need - 1
    ok = np.nonzero(last < len(order))[0]
    ok = ok[(k[last[ok]] == k[ok]) & (a[last[ok]] - a[ok] <= longest + 2 * BAND)]
    edge = np.zeros(len(order) + 1, dtype=np.int64)
    np.add.at(edge, ok, 1)
    np.add.at(edge, last[ok] + 1, -1)
    keep = np.zeros(len(order), dtype=bool)
    keep[order] = np.cumsum(edge)[:-1] > 0
    return keep | (wild & np.isin(page, page[keep]))


def prefix_hits(pages: DataFrame, table: Table, least: int, longest: int) -> DataFrame:
    """``doc_id, stream, at, hash`` of the pages that have ``least`` prefix shingles, of one item as far as the table tells, near each other; only these shingles."""
    sent = pages.sparkSession.sparkContext.broadcast(table)

    def look(batches):
        for batch in batches:
            streams, rows = _streams(batch), []
            for page, at, h, value in _found(streams, sent.value):
                keep = near_ones(page, at, value, least, longest)
                page, at, h = page[keep], at[keep].astype(np.int32), h[keep]
                some, first = np.unique(page, return_index=True)
                rows += [(batch.column("doc_id")[int(k)].as_py(), streams[k], at[a:b], h[a:b]) for k, a, b in zip(some, first, [*first[1:], len(page)][: len(first)], strict=True)]
            ids, found, at, h = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int64()))], ["doc_id", "stream", "at", "hash"])

    return pages.mapInArrow(look, "doc_id long, stream binary, at array<int>, hash array<long>")


def candidates(hits: DataFrame, prefix: DataFrame, least: int, longest: int) -> DataFrame:
    """``page, item, places``: places (struct of first and last position) where ``least`` different prefix shingles of an item lie in two neighbouring bands and within one window."""
    places = hits.select("page", F.explode(F.arrays_zip("at", "hash")).alias("h")).select("page", "h.at", "h.hash")
    met = places.join(prefix.select("hash", "item", F.col("at").alias("item_at")), "hash")
    band = F.floor((F.col("at") - F.col("item_at")) / BAND)
    paired = met.withColumn("band", F.explode(F.array(band, band - 1)))
    grouped = paired.groupBy("page", "item", "band").agg(F.array_sort(F.collect_set("item_at")).alias("s"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.size("s") >= least)
    width = F.array_min(F.zip_with(F.slice("s", F.lit(least), F.size("s") - least + 1), F.slice("s", F.lit(1), F.size("s") - least + 1), lambda b, a: b - a))
    return grouped.where(width <= longest).groupBy("page", "item").agg(F.collect_list(F.struct("low", "high")).alias("places"))


def joined_runs(pages: DataFrame, items: DataFrame, prefix: DataFrame, least: int, longest: int, enough: int) -> DataFrame:
    """The same for prefix shingles of any number, by equi-joins of tables: pages with hits near each other are written with them, then the candidates (two actions)."""
    table = table_of(prefix.select("hash", mark(F.xxhash64("item")).alias("value")))
    hits = write_table(prefix_hits(pages, table, least, longest).withColumn("page", F.monotonically_increasing_id()), "hits")
    met = write_table(candidates(hits, prefix, least, longest), "candidates")
    reach = F.length("body") + PAGE_GAP
    low = F.greatest(F.lit(0), F.array_min("places.low") - reach)
    pairs = hits.select("page", "doc_id", "stream").join(spread(met, "page"), "page").join(items.withColumnRenamed("stream", "body"), "item")
    pieces = pairs.select("doc_id", "ids", "body", "ends", "places.low", "places.high", low.alias("cut"), F.substring("stream", low + 1, F.array_max("places.high") + reach - low).alias("piece"))

    def verify(batches):
        for pdf in batches:
            runs = [best_run(b, np.asarray(e), p, np.asarray(lo) - c, np.asarray(hi) - c, enough) for b, e, lo, hi, c, p in zip(pdf["body"], pdf["ends"], pdf["low"], pdf["high"], pdf["cut"], pdf["piece"], strict=True)]
            out = pdf[["doc_id", "ids"]].assign(words=np.array([r[0] for r in runs], dtype=np.int32), matched=np.array([r[1] for r in runs], dtype=np.int32))
            yield out[out["words"] >= enough]

    return pieces.mapInPandas(verify, "doc_id long, ids array<long>, words int, matched int")


def find_leaks(documents: DataFrame, eval_items: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Rows ``doc_id, item_id, words, matched``: the items of which a page holds a run of at least ``enough`` words.

    Pages are read column by column by their line boxes. ``words`` is the length
    of the item's longest run that stands in the page, at most one word in ten
    missing or replaced; advertisements between its lines are skipped. Sentences
    that several different texts begin with are instructions and are not looked
    for (see :func:`body`). A text that several items have is looked for once.

    The corpus is read twice, whatever the number of items: once to count in how
    many pages each shingle of the items occurs, once for the join. Both look
    shingles up in a table of bounded size first. As long as the prefix has at
    most SENT_SHINGLES, it goes to the executors with its items and a page's join
    and verification need no shuffle (:func:`local_runs`); beyond, pages, prefix,
    candidates and items meet in equi-joins (:func:`joined_runs`), with the same
    result. Items too short for a run of ``enough`` words have no rows. Null and
    empty texts match nothing, null ids are left out, repeated pages each give
    their rows, repeated items one. Runs actions when called.
    """
    pages = documents.select("doc_id", "text", "line_x", "line_y").where("doc_id is not null and text is not null and text <> ''")
    items = items_of(eval_items, enough)
    shingles = shingles_of(items)
    counts = page_counts(pages, table_of(shingles.select("hash", mark(F.col("hash")).alias("value"))))
    prefix = write_table(prefixes(items, shingles, counts), "prefix")

    def widest(batches):
        for pdf in batches:
            yield pd.DataFrame({"letters": [int((e - np.concatenate([[0], e[:-1]])[: len(e)]).max()) if len(e) < WINDOW else int((e[WINDOW - 1 :] - np.concatenate([[0], e])[: len(e) - WINDOW + 1]).max()) for e in map(np.asarray, pdf["ends"])]})

    longest = items.select("ends").mapInPandas(widest, "letters long").agg(F.max("letters")).first()[0] or 0
    least = NEEDED // 2
    few = prefix.limit(SENT_SHINGLES + 1).count() <= SENT_SHINGLES
    runs = (local_runs if few else joined_runs)(pages, items, prefix, least, longest, enough)
    return runs.select("doc_id", F.explode("ids").alias("item_id"), "words", "matched")
