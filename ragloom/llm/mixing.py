"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash; a document's virtual finish time
is the source's words up to and with it, divided by the source's target. All
documents are taken in the order of finish times, a source's second pass after
its first, until the total budget is reached. DataFrame expressions only.

Running sums never put a source into one task: a source's documents are cut by
hash into bins, bin totals are summed first, and only within a bin rows are
summed in order. The cutoff is found the same way, by histograms of finish
times that refine the bin in which the budget is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize

#: Weights by the source's rank in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
BIN_ROWS = 2_000
#: Finish times are cut into so many bins a unit, three times over.
STEPS = 1 << 10
FAR = 8


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, docs, target) of every source.

    ``share`` of all words is dealt by weight. No target exceeds ``most`` times
    its source's size: at the level L where sum(min(weight L, most size))
    reaches the budget, targets are the smaller of the two, which is what
    resharing the excess again and again ends in. Without words all are 0.
    """
    if not 0 < share <= most:
        raise ValueError("share must be positive and not above most")
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    src = src.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("long")
    src = src.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    src = src.withColumn("level", left / open_weight)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    src = src.withColumn("level", F.coalesce(F.first(fits, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    return src.select("source", "sid", "source_size", "docs", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(id, size, source_size, target, times) of every row; ``times``: how often the mix takes it.

    Size is the number of words, 0 for null texts, which are taken 0 times.
    A null source is a source of its own, last in order. The order of equal
    finish times is that of sources, then ids, then passes, so reruns agree;
    rows that are alike in id and size are interchangeable, and null ids are ids
    like any other. The documents taken
    are a prefix of the order whose words do not exceed the budget. An empty
    table gives no rows. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # 40 bits of a digest: the shuffled place of a document in its source
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 10), 16, 10).cast("long")
    sized = materialize(sized.withColumn("place", place), "mix-sizes")
    src = materialize(targets(sized, weights=weights, share=share, most=most), "mix-sources")
    bins = F.greatest(F.lit(1), F.ceil(F.col("docs") / BIN_ROWS))
    rows = sized.join(src, sized["source"].eqNullSafe(src["source"])).select("id", "size", "sid", "source_size", "target", "place", F.floor(F.col("place") / float(1 << 40) * bins).alias("bin"))
    totals = rows.groupBy("sid", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "bin", F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("sid", "bin").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(totals, ["sid", "bin"])
    rows = materialize(rows.select("id", "size", "sid", "source_size", "target", (F.col("upto") + F.col("before")).alias("upto")), "mix-rows")

    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    items = rows.filter("size > 0 and target > 0").select("id", "size", "sid", "source_size", "target", "upto", passes.alias("pass"))
    finish = (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")
    items = items.select("id", "size", "sid", "pass", finish.alias("finish"))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    budget, taken = total * share, 0

    # refine the bin in which the budget is reached; the histograms have at most FAR * STEPS rows
    inside, low, width = items, 0.0, 1.0
    for level in range(3):
        width /= STEPS
        slot = F.least(F.floor((F.col("finish") - low) / width), F.lit((FAR if level == 0 else 1) * STEPS))
        held = {r.slot: r.words for r in inside.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words")).collect()}
        reached = None
        for s in sorted(held):
            if taken + held[s] > budget:
                reached = s
                break
            taken += held[s]
        if reached is None:
            inside = None
            break
        inside = inside.filter(slot == reached)
        low += reached * width
    order = ["finish", "sid", "id", "pass"]
    if inside is None:  # the budget takes everything
        times = F.when((F.col("size") > 0) & (F.col("target") > 0), most).otherwise(0)
        return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", times.cast("long").alias("times"))
    run = Window.orderBy(*order, "size").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("words", F.sum("size").over(run)).filter(F.col("words") > budget - taken).orderBy(*order).limit(1).select(*order).first()
    # everything before the first item that does not fit
    last = [last[c] for c in order]
    stop = [F.lit(x) for x in last]

    def fits(k: int):
        at = (F.lit(k) * F.col("source_size") + F.col("upto")) / F.col("target")
        cols = [at, F.col("sid"), F.col("id"), F.lit(k)]
        less = F.lit(False)
        for c, s, value in reversed(list(zip(cols, stop, last, strict=True))):  # null ids come first
            less = F.coalesce(c < s, c.isNull() & F.lit(value is not None)) | (c.eqNullSafe(s) & less)
        return F.when(F.col("target") > 0, less).otherwise(F.lit(False)).cast("long")

    times = sum((fits(k) for k in range(1, most)), fits(0))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", F.when(F.col("size") > 0, times).otherwise(0).cast("long").alias("times"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, all columns, as often as ``mix`` takes them.

    Rows are told apart by id, source and a hash of the text, so ids may repeat
    or be null; rows that are alike in all columns are taken as often as they
    are together. Columns may have any names. ``how`` goes to ``mix``.
    """
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(source_col, text_col)))
    mixed = mix(docs.select(name.alias("key"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), id_col="key", text_col="text", source_col="source", **how)
    per = materialize(mixed.groupBy("key").agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("n")).filter("times > 0"), "mix-times")
    rows = docs.select(name.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = rows.join(per.filter("n = 1").select("key", "times").hint("shuffle_hash"), "key").select("row", "times")
    again = per.filter("n > 1")
    if not again.isEmpty():
        alike = rows.join(again.select("key", "times").hint("shuffle_hash"), "key").groupBy("row", "times").agg(F.count("*").alias("n"))
        taken = taken.unionByName(alike.select("row", "times"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS place FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s GROUP BY source),
w AS (SELECT *, (CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight, (2 * source_size)::BIGINT AS cap FROM src),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
    WINDOW o AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT coalesce((SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, sid LIMIT 1), 1e300) AS level),
t AS (SELECT source, sid, source_size, least(m.level * weight, cap::DOUBLE) AS target FROM w, m),
r AS (SELECT doc_id, size, sid, source_size, target, sum(size) OVER (PARTITION BY sid ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, size, sid, p, (p * source_size + upto) / target AS finish FROM r, (VALUES (0), (1)) AS x(p) WHERE size > 0 AND target > 0),
c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, sid, doc_id NULLS FIRST, p, size ROWS UNBOUNDED PRECEDING) AS words FROM i),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE words <= (SELECT sum(source_size) * 1.5 FROM src) GROUP BY 1)
SELECT r.doc_id, r.size::BIGINT AS size, r.source_size, r.target, coalesce(k.taken, 0)::BIGINT AS taken FROM r LEFT JOIN k ON r.doc_id IS NOT DISTINCT FROM k.doc_id
"""
