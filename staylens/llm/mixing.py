"""Mixing sources to target weights: documents that belong to one or several sources, taken so that each source comes to its quota of words.

Documents are aggregated by membership pattern, the set of sources that they belong to. A min-cost flow routes words from
patterns to the quotas of their sources. A pattern's capacity is its words once for each time that a document may be
taken; what is taken more often costs more, in convex steps, so that nothing is repeated where fresh words are left
and patterns that serve the same source are drawn on alike. Then each pattern's documents are laid out one after another
in an order that a seed chooses, and those whose place begins within the flow are taken, whole. At last each
source gains or loses a copy of the document that brings it nearest to its quota, twice.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write_shared

WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), Fraction(3, 2), 2
REPAIRS = 2  # rounds that exchange one copy a source, since documents are taken whole
_STEPS = 4  # of cost within each time that a pattern is taken
BUCKET_BITS = 14  # of the seeded order, by which a pattern's documents are dealt out
MOST_SENT = 100_000  # patterns in a table that is sent to all tasks; more are joined by a shuffle


def words(text: str | Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, int], share: Fraction = SHARE, most_times: int = MOST_TIMES) -> dict[str | None, Fraction]:
    """Words of each source: a share of all words by weight, at most so many times a source's size; what is above goes to the others by weight."""
    out, left = {}, Fraction(share) * sum(sizes.values())
    open_ = dict(weights)
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w >= most_times * sizes[s]]
        if not full:
            return out | {s: unit * w for s, w in open_.items()}
        for s in full:
            out[s] = Fraction(most_times * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def _whole(shares: dict) -> dict:
    """Fractions as integers of the same sum, give or take less than one, by largest remainder."""
    out = {k: int(v) for k, v in shares.items()}
    rest = int(sum(shares.values())) - sum(out.values())
    for k in sorted(shares, key=lambda k: (out[k] - shares[k], k is None, k or ""))[:rest]:
        out[k] += 1
    return out


def route(patterns: dict[tuple, int], quotas: dict, most_times: int = MOST_TIMES, steps: int = _STEPS) -> dict[tuple, dict]:
    """Words from each pattern (a tuple of sources) to each of its sources: a flow of the largest value and, of these, the least cost.

    Successive shortest paths with potentials. A pattern's words are an arc for each step of each time, of rising cost.
    """
    names = ["from", *[("p", p) for p in patterns], *[("s", s) for s in quotas], "to"]
    number = {n: i for i, n in enumerate(names)}
    head, room, cost, arcs = [], [], [], [[] for _ in names]

    def arc(a, b, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[number[x]].append(len(head))
            head.append(number[y])
            room.append(c)
            cost.append(p)
        return len(head) - 2

    used = {}
    for p, size in patterns.items():
        for k in range(most_times * steps):
            arc("from", ("p", p), size * (k + 1) // steps - size * k // steps, k)
        for s in p:
            used[p, s] = arc(("p", p), ("s", s), most_times * size, 0)
    for s, q in quotas.items():
        arc(("s", s), "to", q, 0)

    start, end = number["from"], number["to"]
    height = [0] * len(names)
    while True:
        far, via, queue = {start: 0}, {}, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in arcs[u]:
                step = d + cost[e] + height[u] - height[head[e]]
                if room[e] and step < far.get(head[e], step + 1):
                    far[head[e]] = step
                    via[head[e]] = e
                    heapq.heappush(queue, (step, head[e]))
        if end not in far:
            return {p: {s: room[used[p, s] + 1] for s in p} for p in patterns}
        height = [h + min(far.get(i, far[end]), far[end]) for i, h in enumerate(height)]
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = head[via[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most


def mix(docs: DataFrame, size: Column, sources: Column, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most_times: int = MOST_TIMES, seed: int = 42) -> DataFrame:
    """doc_id, sources, size, source_size, target, taken and by_source for each row of docs.

    size: words of a row; sources: an array of the sources that it belongs to, which may hold null as a source of its own.
    Sources by code point, null last, have the weights in turn. source_size and target are arrays beside sources, of
    the words of all documents of a source and of its target; taken is size times how often the row is taken, by_source an
    array of how many of these words go to which source. A row of no sources is never taken. Repeated rows are documents
    of their own; equal rows lie side by side in the seeded order, so that a run gives the same rows again. A null
    doc_id stays null; an empty table gives no rows. docs may have any further columns.

    The driver holds a row for each source and each pattern of sources that occurs, never for each document.
    """
    own = F.coalesce(F.array_sort(F.array_distinct(sources.cast("array<string>"))), F.array().cast("array<string>"))
    rows = docs.select("doc_id", own.alias("sources"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), "text").alias("_place"))
    rows = write_shared(rows.groupBy("doc_id", "sources", "size", "_place").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.shiftrightunsigned("_place", 64 - BUCKET_BITS)))
    binned = write_shared(rows.groupBy("sources", "_bucket").agg(F.sum(F.col("size") * F.col("_n")).alias("_in")))

    patterns = {tuple(r.sources): r.n for r in binned.groupBy("sources").agg(F.sum("_in").alias("n")).collect() if r.sources}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    # an overlapping word fills one quota at a time, so the share is of the words that there are
    scale = Fraction(share) * sum(patterns.values()) / (sum(sizes.values()) or 1)
    goal = targets(sizes, weight, scale, most_times)
    flow = route(patterns, _whole(goal), most_times)

    plan = T.StructType([T.StructField("_of", T.ArrayType(T.StringType())), T.StructField("_whole", T.LongType()), T.StructField("source_size", T.ArrayType(T.LongType())), T.StructField("target", T.ArrayType(T.DoubleType())), T.StructField("_upto", T.ArrayType(T.LongType()))])
    told = []
    for p, n in patterns.items():
        upto = [sum(flow[p][s] for s in p[: i + 1]) for i in range(len(p))]
        told.append((list(p), n, [sizes[s] for s in p], [float(goal[s]) for s in p], upto))
    plans = docs.sparkSession.createDataFrame(told, plan)
    plans = F.broadcast(plans) if len(told) <= MOST_SENT else plans

    before = F.coalesce(F.sum("_in").over(Window.partitionBy("sources").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = write_shared(binned.withColumn("_before", before).drop("_in"))
    within = Window.partitionBy("sources", "_bucket").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(begun, ["sources", "_bucket"]).withColumn("_from", F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_n")).over(within), F.lit(0)))
    each = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("_from", F.col("_from") + F.col("_k") * F.col("size"))
    planned = each.join(plans, F.col("sources") == F.col("_of"), "left")

    # a copy goes to the source in whose stretch of the pattern's flow its middle lies
    middles = F.transform(F.sequence(F.lit(0), F.lit(most_times - 1)), lambda k: F.col("_from") + k * F.col("_whole") + F.col("size") / 2)
    goes_to = F.transform(middles, lambda m: F.size(F.filter("_upto", lambda u: u <= m)))
    places = F.transform(F.col("sources"), lambda _, i: (F.size(F.filter(goes_to, lambda g: g == i)) * F.col("size")).cast("long"))
    out = planned.withColumn("by_source", F.when(F.size("sources") > 0, places).otherwise(F.array().cast("array<long>")))
    out = write_shared(out.select("doc_id", "sources", "size", "source_size", "target", "by_source", "_place", "_k"))
    for _ in range(REPAIRS):
        out = _nearer(out, {s: sum(flow[p][s] for p in patterns if s in p) for s in names}, most_times)
    none = lambda c, k: F.coalesce(F.col(c), F.array().cast(f"array<{k}>")).alias(c)
    return out.select("doc_id", "sources", "size", none("source_size", "long"), none("target", "double"), _total().alias("taken"), "by_source")


def _total() -> Column:
    return F.aggregate("by_source", F.lit(0).cast("long"), lambda a, b: a + b)


def _nearer(rows: DataFrame, goal: dict, most_times: int) -> DataFrame:
    """rows with one copy more or less for each source, of the document whose size is nearest to what the source lacks or has too much."""
    spark = rows.sparkSession
    each = rows.select("doc_id", "_place", "_k", "size", _total().alias("_taken"), F.size("sources").alias("_m"), "by_source", F.posexplode("sources").alias("_i", "source")).withColumn("_own", F.col("by_source")[F.col("_i")])
    have = {r.source: r.n for r in each.groupBy("source").agg(F.sum("_own").alias("n")).collect()}  # a row a source
    off = spark.createDataFrame([(s is None, s or "", n - have.get(s, 0)) for s, n in goal.items()], "_none boolean, _name string, _off long")
    off = F.broadcast(off) if len(goal) <= MOST_SENT else off
    met = each.join(off, F.col("source").isNull().eqNullSafe(F.col("_none")) & (F.coalesce("source", F.lit("")) == F.col("_name")))
    may = F.when(F.col("_off") > 0, F.col("_taken") + F.col("_m") * F.col("size") <= most_times * F.col("size")).otherwise(F.col("_own") >= F.col("size"))
    gap = F.abs(F.col("size") - F.abs("_off"))
    best = met.filter(may & (gap < F.abs("_off"))).groupBy("source").agg(F.min_by(F.struct("doc_id", "_place", "_k", F.when(F.col("_off") > 0, F.col("size")).otherwise(-F.col("size")).alias("more")), F.struct(gap, "_place", "doc_id", "_k")).alias("b"))
    moves = write_shared(best.select(F.col("b.doc_id").alias("_d"), F.col("b._place").alias("_p"), F.col("b._k").alias("_q"), F.struct("source", "b.more").alias("_move")).groupBy("_d", "_p", "_q").agg(F.collect_list("_move").alias("_moves")))  # a row a source at most
    same = (F.col("_p") == F.col("_place")) & (F.col("_q") == F.col("_k")) & F.col("_d").eqNullSafe(F.col("doc_id"))
    sent = F.broadcast(moves) if len(goal) <= MOST_SENT else moves
    added = lambda i: F.aggregate("_moves", F.lit(0).cast("long"), lambda a, m: a + F.when(m["source"].eqNullSafe(F.element_at("sources", (i + 1).cast("int"))), m["more"]).otherwise(0))
    out = rows.join(sent, same, "left")
    moved = F.when(F.col("_moves").isNull(), F.col("by_source")).otherwise(F.transform("by_source", lambda n, i: n + added(i)))
    return out.withColumn("by_source", moved).select(*rows.columns)


def mix_by_source(docs: DataFrame, **parameters) -> DataFrame:
    """mix() of documents that belong to the one source in their column source: doc_id, size, source_size, target, taken."""
    found = mix(docs, words("text"), F.array("source"), **parameters)
    return found.select("doc_id", "size", F.col("source_size")[0].alias("source_size"), F.col("target")[0].alias("target"), "taken")
