"""Suffix-array dedup: remove every byte covered by a long string that occurs again.

Only suffixes at anchors are sorted (see ``anchors``): a string of ``length``
bytes has exactly one anchor, and equal strings have it at the same offset.

1. Hashes of the anchors' surroundings are counted; a bit map of those that
   occur again selects the suffixes worth sorting.
2. Each selected anchor is described by its context, the bytes that strings
   with this anchor can span. Equal contexts are one row from here on. Where
   all contexts of a surrounding are equal, as in copies, they repeat as far as
   they reach, and no bytes of them go on.
3. Sampled splitters range-partition the suffixes by their leading bytes. As
   equal leading bytes never part, no equal pair straddles a boundary. Leading
   bytes that more than a bucket's rows share go to no bucket: their strings
   are dealt by hash and counted by Spark, after shorter windows that each
   string contains have ruled out what can't repeat (see ``_crowded``).
4. A bucket sorts its suffixes by multikey quicksort; common prefixes with the
   neighbours bound how far a repeat can reach, and the strings within that
   reach are compared. What repeats furthest to the left and to the right
   gives the removed stretch around the anchor.
5. Stretches are gathered by document, united and cut out.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .shingles import mix, powers
from .util import Bloom, keep, slices

LENGTH = 400
#: Bytes around an anchor that any string with this anchor contains.
MARGIN = 24
#: Long texts are searched in pieces that overlap by more than two contexts; each owns the anchors up to the middle of an overlap.
PIECE = 4 << 20
OVERLAP = 4_096
BLOCK = 1 << 20
BUCKET = 8_192


def _blocks(keys: list, texts: list[bytes], length: int):
    """Pieces of texts, at least one string long, in blocks: owners, offsets, first and last owned positions, bytes."""
    own, off, parts, total = [], [], [], 0
    low, high = [], []
    for k, text in zip(keys, texts, strict=True):
        if len(text) < length:
            continue
        for at in range(0, max(1, len(text) - OVERLAP), PIECE):
            part = text[at : at + PIECE + OVERLAP]
            own.append(k)
            off.append(at)
            low.append(OVERLAP // 2 if at else 0)
            high.append(PIECE + OVERLAP // 2 if at + len(part) < len(text) else len(part))
            parts.append(part)
            total += len(part)
            if total >= BLOCK:
                yield own, off, low, high, parts
                own, off, low, high, parts, total = [], [], [], [], [], 0
    if parts:
        yield own, off, low, high, parts


def _owned(who: np.ndarray, at: np.ndarray, starts: np.ndarray, low: list[int], high: list[int]) -> np.ndarray:
    """Anchors that belong to their piece; all others belong to a neighbour, which has their whole context."""
    rel = at - starts[who]
    return (rel >= np.array(low, np.int64)[who]) & (rel < np.array(high, np.int64)[who])


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens


def _described(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, who: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor's context, and how many bytes it has to the left and right."""
    left = np.minimum(at - starts[who], span)
    right = np.minimum(starts[who] + lens[who] - at, span)
    up, down = powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=total[1:])
        c = mix((total[at + right] - total[at - left]) * down[at - left] + mix((left * 1_000 + right).astype(np.uint64))).view(np.int64)
    return c, left, right


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows by their columns, left to right: ties alone go on to the next column."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = [np.arange(len(order))]
    for k in range(words.shape[1]):
        refined = []
        for run in tied:
            rows = order[run]
            if k:
                at = np.argsort(words[rows, k], kind="stable")
                order[run] = rows = rows[at]
            values = words[rows, k]
            edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if e - s > 1:
                    refined.append(run[s:e])
        tied = refined
        if not tied:
            break
    return order


def _aligned(contexts: list[bytes], left: np.ndarray, span: int) -> np.ndarray:
    """Contexts as rows with the anchor in the middle."""
    block = np.zeros((len(contexts), 2 * span), np.uint8)
    for i, (c, lf) in enumerate(zip(contexts, left.tolist(), strict=True)):
        block[i, span - lf : span - lf + len(c)] = np.frombuffer(c, np.uint8)
    return block


def reach(contexts: list[bytes], left: np.ndarray, right: np.ndarray, length: int, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the strings around each anchor that occur in another row reach to the left and right (0: none).

    A context holds ``left`` bytes before the anchor and ``right`` from it on.
    """
    span = length - margin
    n = len(contexts)
    block = _aligned(contexts, left, span)
    suffix = np.ascontiguousarray(block[:, span - margin :])
    suffix = np.pad(suffix, ((0, 0), (0, -suffix.shape[1] % 8)))
    order = multikey_order(suffix.view(">u8").astype(np.uint64))
    sorted_rows = suffix[order]
    differs = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), suffix.shape[1])
    best = np.maximum(np.r_[0, common], np.r_[common, 0])
    ahead = np.zeros(n, np.int64)
    ahead[order] = best - margin
    ahead = np.minimum(ahead, right)
    out_left, out_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.flatnonzero((ahead >= margin) & (left + ahead >= length))
    if not len(rows):
        return out_left, out_right
    up, down = powers(2 * span + 1)
    # the strings at one offset of all rows are hashed together; a step to the left adds a byte and drops one
    octets = np.ascontiguousarray(block[rows].T)
    one = np.uint64(1)
    with np.errstate(over="ignore"):
        first = span - margin
        sums = np.zeros(len(rows), np.uint64)
        for j in range(first, first + length):
            sums += (octets[j] + one) * up[j]
        for o in range(margin, span + 1):
            at = span - o
            if o > margin:
                sums += (octets[at] + one) * up[at] - (octets[at + length] + one) * up[at + length]
            able = np.flatnonzero((left[rows] >= o) & (ahead[rows] >= length - o))
            if len(able) < 2:
                continue
            h = mix(sums[able] * down[at])
            by = np.argsort(h)
            same = h[by][1:] == h[by][:-1]
            again = rows[able[by[np.r_[same, False] | np.r_[False, same]]]]
            out_left[again] = o
            new = again[out_right[again] == 0]
            out_right[new] = length - o
    return out_left, out_right


def _crowded(rows: DataFrame, length: int, margin: int) -> DataFrame:
    """(c, l, r): what ``reach`` finds, for any number of rows with equal leading bytes.

    rows: (c, l, r, lead, context), each c once. Strings that start ``margin``
    neighbouring positions apart at most share a window of length - margin + 1
    bytes. Only the strings of windows that occur again are hashed and counted.
    """
    span = length - margin
    up, down = powers(2 * span + 1)

    def sums(batch):
        left, right = (np.asarray(batch.column(k), np.int64) for k in (1, 2))
        total = np.zeros((batch.num_rows, 2 * span + 1), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_aligned(batch.column(4).to_pylist(), left, span).astype(np.uint64) + np.uint64(1)) * up[: 2 * span], axis=1, out=total[:, 1:])
        return left, right, total

    def hashed(total, able, o, size):
        at = span - o
        with np.errstate(over="ignore"):
            return mix((total[able, at + size] - total[able, at]) * down[at] + mix(np.full(1, o * 1_000 + size, np.uint64))).view(np.int64)

    def windows(left, right, total):
        """First offset, rows and hashes of each window."""
        for o in range(margin, span + 1, margin):
            able = np.flatnonzero((left >= o) & (right >= length - margin + 1 - o))
            yield o, able, hashed(total, able, o, length - margin + 1)

    def count_windows(batches):
        for batch in slices(batches, 512):
            found = [h for _, _, h in windows(*sums(batch))]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

    again = rows.mapInArrow(count_windows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    bloom = rows.sparkSession.sparkContext.broadcast(Bloom.of(again))

    def strings(batches):
        for batch in slices(batches, 512):
            c = np.asarray(batch.column(0), np.int64)
            left, right, total = sums(batch)
            for first, able, h in windows(left, right, total):
                able = able[bloom.value.has(h)]
                for o in range(first, min(first + margin, span + 1)):
                    who = able[(left[able] >= o) & (right[able] >= length - o)]
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(hashed(total, who, o, length)), pa.array(c[who]), pa.array(np.full(len(who), o, np.int64))], names=["h", "c", "o"])

    found = keep(rows.mapInArrow(strings, "h long, c long, o long"))
    twice = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    return found.join(twice, "h", "left_semi").groupBy("c").agg(F.max("o").alias("l"), (F.lit(length) - F.min("o")).alias("r"))


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, margin: int = MARGIN, crowd: int = BUCKET) -> DataFrame:
    """(id, spans) of the documents that have a string of ``length`` bytes which starts anywhere else too.

    ``spans``: stretches (start, end) around anchors, in bytes, not united.
    Leading bytes of more than ``crowd`` rows are dealt over tasks, with the same result.
    """
    spark = docs.sparkSession
    span = length - margin
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text")).filter("id is not null")

    def hashes(batches):
        for batch in slices(batches, 512):
            for _, _, low, high, parts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
                flat, starts, lens = _laid_out(parts)
                who, at, h = anchors(flat, starts, lens, length, margin)
                ok = _owned(who, at, starts, low, high)
                c, _, _ = _described(flat, starts, lens, who[ok], at[ok], span)
                order = np.argsort(h[ok], kind="stable")
                h, c = h[ok][order], c[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
                low_c, high_c = (f.reduceat(c, first) if len(c) else c for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h[first], np.diff(np.r_[first, len(h)]), low_c, high_c)], names=["h", "n", "low", "high"])

    counts = rows.mapInArrow(hashes, "h long, n long, low long, high long").groupBy("h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    again = keep(counts.filter("n > 1").select("h", (F.col("low") != F.col("high")).alias("differ")))
    bloom = spark.sparkContext.broadcast(Bloom.of(again.select("h"), words=1 << 22))
    differ = spark.sparkContext.broadcast(Bloom.of(again.filter("differ").select("h"), words=1 << 21))
    again.unpersist()
    del counts, again
    # their shuffle files go when the driver finds them unused
    gc.collect()
    spark.sparkContext._jvm.System.gc()

    def contexts(batches):
        """Every selected anchor; the bytes of a context once a task, where contexts of its surroundings differ."""
        seen: set[int] = set()
        for batch in slices(batches, 512):
            for own, off, low, high, parts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
                flat, starts, lens = _laid_out(parts)
                who, at, h = anchors(flat, starts, lens, length, margin)
                ok = bloom.value.has(h) & _owned(who, at, starts, low, high)
                who, at, h = who[ok], at[ok], h[ok]
                c, left, right = _described(flat, starts, lens, who, at, span)
                raw = flat.tobytes()
                body: list[bytes | None] = [None] * len(at)
                first = np.zeros(len(at), np.int64)
                some = np.flatnonzero(differ.value.has(h))
                for k, x, a, lf, rt in zip(some.tolist(), c[some].tolist(), at[some].tolist(), left[some].tolist(), right[some].tolist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        body[k] = raw[a - lf : a + rt]
                        first[k] = int.from_bytes(raw[a - margin : a - margin + 7], "big")
                if len(seen) > 250_000:
                    seen.clear()
                ids = np.array(own, np.int64)[who] if len(who) else np.zeros(0, np.int64)
                pos = at - starts[who] + np.array(off, np.int64)[who] if len(who) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (c, ids, pos, left, right, first)), pa.array(body, pa.binary())], names=["c", "id", "pos", "l", "r", "lead", "context"])

    found = keep(rows.mapInArrow(contexts, "c long, id long, pos long, l long, r long, lead long, context binary"))
    # a context that occurs again is repeated as far as it reaches
    many = found.select("c", "id", "pos", "l", "r").dropDuplicates(["c", "id", "pos"]).groupBy("c").agg(F.count("*").alias("n"), F.max("l").alias("l"), F.max("r").alias("r"))
    many = many.filter((F.col("n") > 1) & (F.col("l") + F.col("r") >= length)).select("c", "l", "r")

    bodies = found.filter("context is not null").select("c", "l", "r", "lead", "context")
    shared = bodies.groupBy("lead").count().filter(F.col("count") > crowd).toArrow()
    crowds = np.sort(np.asarray(shared.column("lead").combine_chunks(), np.int64))
    crowded = spark.sparkContext.broadcast(crowds)

    def part(inside: bool):
        def run(batches):
            for batch in batches:
                ok = np.isin(np.asarray(batch.column(3), np.int64), crowded.value) == inside
                yield batch.filter(pa.array(ok))

        return bodies.mapInArrow(run, bodies.schema)

    packed = keep(part(True).dropDuplicates(["c"])) if len(crowds) else None
    bodies = part(False) if len(crowds) else bodies
    n = bodies.count()
    buckets = max(1, n // BUCKET)
    sample = bodies.select("c", "lead").orderBy(F.xxhash64("c"), "c").limit(20_000).toArrow()
    leads = np.sort(np.asarray(sample.column("lead").combine_chunks(), np.int64)) if n else np.zeros(0, np.int64)
    splits = sorted({int(leads[len(leads) * i // buckets]) for i in range(1, buckets)}) if n else []
    held = spark.sparkContext.broadcast(np.array(splits, np.int64))

    def place(batches):
        for batch in batches:
            b = np.searchsorted(held.value, np.asarray(batch.column(3), np.int64), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), *(batch.column(k) for k in (0, 1, 2, 4))], names=["bucket", "c", "l", "r", "context"])

    def compare(table):
        c = np.asarray(table.column("c").combine_chunks(), np.int64)
        _, first = np.unique(c, return_index=True)
        table = table.take(pa.array(first))
        left = np.asarray(table.column("l").combine_chunks(), np.int64)
        right = np.asarray(table.column("r").combine_chunks(), np.int64)
        a, b = reach(table.column("context").to_pylist(), left, right, length, margin)
        hit = a > 0
        return pa.table({"c": c[first][hit], "l": a[hit], "r": b[hit]})

    placed = bodies.mapInArrow(place, "bucket long, c long, l long, r long, context binary")
    partly = placed.groupBy("bucket").applyInArrow(compare, "c long, l long, r long")
    if packed is not None:
        partly = partly.unionByName(_crowded(packed, length, margin))
    extent = partly.unionByName(many).groupBy("c").agg(F.max("l").alias("left"), F.max("r").alias("right"))
    stretches = found.select("c", "id", "pos").join(extent, "c").select("id", F.struct((F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")).alias("span"))
    return stretches.groupBy("id").agg(F.collect_list("span").alias("spans")).withColumnRenamed("id", id_col)


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: united removed runs, and the other bytes together.

    Texts count as UTF-8, null as empty; texts shorter than ``length`` keep all
    their bytes. Ids are unique integers; rows with a null id are left out.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text")).filter(F.col(id_col).isNotNull())
    both = rows.join(repeated(docs, id_col=id_col, text_col=text_col, length=length), id_col, "left")

    def cut(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, 256):
            spans, rest, size = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs: list[dict] = []
                for s in sorted(found or [], key=lambda s: s["start"]):
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append(dict(s))
                kept, at = [], 0
                for s in runs:
                    kept.append(text[at : s["start"]])
                    at = s["end"]
                kept.append(text[at:])
                spans.append(runs)
                rest.append(b"".join(kept))
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return both.select(id_col, "text", "spans").mapInArrow(cut, f"`{id_col}` long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
