"""Byte-level BPE: overlapping chunk encoding, and decoding.

Texts of up to one chunk are pre-tokenised whole. Longer texts are cut into
chunks that overlap by a margin and are pre-tokenised in parallel, each from
its own start. Where two neighbours have a boundary between pre-tokens in
common inside the margin, both parse alike from there on (a match depends only
on where it starts and what follows), so the text is stitched there and the
pieces between stitches are encoded in parallel. A text in which some
neighbours never agree is encoded in one piece.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import slices

#: Characters of a chunk and of the margin in which neighbours overlap.
CHUNK = 32_768
MARGIN = 2_048
#: Pieces that a task keeps encoded; the cache starts anew beyond it.
CACHE = 150_000
#: Pieces beyond so many bytes are merged with a heap.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes, a blank, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    scores = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
    while scores:
        low = min(scores)
        if low == 1 << 60:
            break
        i = scores.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n: a heap of pairs over a linked list of parts."""
    n = len(piece)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    live = [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        live[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token to the bytes of its ids (little-endian unsigned 32 bits)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.iter = regex.compile(pattern).finditer

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        rank = self.ranks.get(raw)
        if rank is not None:
            ids = [rank]
        else:
            ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        out = array("I", ids).tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(raw) <= 24:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


def _encoder(held) -> Encoder:
    """An encoder for one task: workers outlive tasks, and would keep its cache."""
    _, ranks, pattern = held.value
    return Encoder(ranks, pattern)


def _chunks(size: int):
    """Split texts into (chunk number, text from its start on, with the margin)."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = range(0, len(text), size)
                for at in range(0, len(starts), 64):
                    part = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(part), batch.column(0).type), pa.array(range(at, at + len(part)), pa.int64()), pa.array([text[s : s + size + MARGIN] for s in part])],
                        names=["id", "chunk", "text"],
                    )

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_tokens, ids) of every row; ``ids``: binary, little-endian unsigned 32 bits.

    A null or empty text has no tokens. Ids must be unique among texts longer
    than ``chunk``; rows that repeat such an id with the same text still give
    one row each. Other columns are not read.
    """
    if chunk <= MARGIN:
        raise ValueError("chunk must be larger than the margin")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((ranks_path, read_ranks(ranks_path), pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()
    out_type = f"id {id_type}, n_tokens long, ids binary"

    def whole(batches):
        enc = _encoder(held)
        for batch in slices(batches):
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, out_type)
    # equal ids with equal texts are encoded once and given back as often
    long = rows.filter(F.length("text") > chunk).groupBy("id", "text").agg(F.count("*").alias("copies"))
    long = long.select(F.struct("id", "copies").alias("id"), "text")
    long_type = f"struct<id:{id_type},copies:bigint>"
    pieces = long.mapInArrow(_chunks(chunk), f"id {long_type}, chunk long, text string").repartition("id", "chunk")

    def boundaries(batches):
        enc = _encoder(held)
        for batch in slices(batches, 32):
            chunks, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            left, right = [], []
            for c, text in zip(chunks, texts, strict=True):
                base = c * chunk
                ends = [m.end() for m in enc.iter(text)]
                closed = ends[:-1] if len(text) == chunk + MARGIN else ends  # the last match may be cut
                left.append([base] * (c == 0) + [base + e for e in closed if e < MARGIN])
                right.append([base + e for e in closed if e >= chunk])
            of = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, of), pa.array(right, of)], names=["id", "chunk", "text", "left", "right"])

    parsed = pieces.mapInArrow(boundaries, f"id {long_type}, chunk long, text string, left array<bigint>, right array<bigint>")
    by = Window.partitionBy("id").orderBy("chunk")
    meet = F.array_min(F.array_intersect("left", F.lag("right").over(by)))
    stitched = parsed.withColumn("start", F.when(F.col("chunk") == 0, 0).otherwise(meet))
    stitched = stitched.withColumn("stop", F.lead("start").over(by)).withColumn("last", F.lead("chunk").over(by).isNull())
    stitched = stitched.withColumn("whole", F.count(F.when(F.col("start").isNull(), 1)).over(Window.partitionBy("id")) > 0)

    def parts(batches):
        enc = _encoder(held)
        for batch in slices(batches, 32):
            row = batch.to_pydict()
            ids = []
            for c, text, start, stop, last in zip(row["chunk"], row["text"], row["start"], row["stop"], row["last"], strict=True):
                ids.append(enc.encode(text[start - c * chunk : None if last else stop - c * chunk]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["id", "chunk", "ids"])

    done = stitched.filter("not whole").select("id", "chunk", "text", "start", "stop", "last").mapInArrow(parts, f"id {long_type}, chunk long, ids binary")
    unmet = stitched.filter("whole").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", F.substring("text", 1, chunk).alias("text")))).alias("parts"))
    unmet = unmet.select("id", F.concat_ws("", F.col("parts.text")).alias("text")).mapInArrow(whole, f"id {long_type}, n_tokens long, ids binary").select("id", F.lit(0).cast("long").alias("chunk"), "ids")
    joined = done.unionByName(unmet).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", F.hex("ids").alias("ids")))).alias("parts"))
    joined = joined.select("id", F.unhex(F.concat_ws("", F.col("parts.ids"))).alias("ids"))
    joined = joined.select(F.col("id.id").alias("id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("id.copies"))).alias("copy")).drop("copy")
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", out_col: str = "decoded", keep_ids: bool = False) -> DataFrame:
    """All columns of ``encoded`` but the ids, and the bytes that they stand for.

    With ``keep_ids`` the ids stay, before the bytes. Null ids give null; an id that the ranks don't have fails the job.
    """
    vocab = encoded.sparkSession.sparkContext.broadcast((ranks_path, read_ranks(ranks_path)))
    rest = [c for c in encoded.columns if c != ids_col]
    named = [*rest, ids_col] if keep_ids else rest
    kept = len(named)

    def run(batches):
        _, ranks = vocab.value
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, rank in ranks.items():
            table[rank] = raw
        at = table.__getitem__
        for batch in slices(batches):
            texts = []
            for raw in batch.column(len(rest)).to_pylist():
                if raw is None:
                    texts.append(None)
                    continue
                ids = array("I")
                ids.frombytes(raw)
                texts.append(b"".join(map(at, ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(texts, pa.binary())], names=[*named, out_col])

    rows = encoded.select(*rest, ids_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:kept])
    return rows.mapInArrow(run, f"{kinds}, `{out_col}` binary")
