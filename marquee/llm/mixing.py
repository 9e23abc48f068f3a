"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to).
The flow network has one node per pattern and per source: a pattern offers its words once per
repetition, each further repetition at a higher cost, and a source takes its quota. Its size follows
the number of patterns, never of documents. Documents are then chosen within each pattern in a seeded order.
"""

from __future__ import annotations

import heapq
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import broadcast_if_small, prepare, shuffle_partitions, spool

#: Words are runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Documents of one pattern that share a slice of the seeded order, on average at most.
SLICE_ROWS = 4096
#: Rows by pattern or of picked documents are broadcast up to this many.
BROADCAST_ROWS = 2_000_000
#: Most patterns of overlapping sources for which a flow is solved on the driver. Sources that overlap with none need no flow.
MAX_PATTERNS = 100_000


def shares(sizes: dict, weights: dict, repeats: int) -> dict:
    """Target words of each source: all words shared by weight, none above ``repeats`` times its size;
    what a capped source leaves is shared again by weight among the others."""
    total = float(sum(sizes.values()))
    target, open_ = {}, [s for s in sizes if weights[s] > 0]
    target.update({s: 0.0 for s in sizes if weights[s] <= 0})
    while open_:
        left = total - sum(target.values())
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > repeats * sizes[s]]
        if not over:
            target.update({s: left * weights[s] / weight for s in open_})
            break
        target.update({s: float(repeats * sizes[s]) for s in over})
        open_ = [s for s in open_ if s not in target]
    return target


def route(capacity: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, dict]:
    """Min-cost flow of words from patterns to the sources they contain.

    Pattern p sends up to ``capacity[p]`` words in each of ``repeats`` repetitions, repetition r at cost
    r * r a word (convex, so fresh words go first); source s takes ``quota[s]`` words at most.
    Returns words by pattern and source. Successive shortest paths with node potentials.
    """
    nodes = {"from": 0, "to": 1}
    for p in capacity:
        nodes[("p", p)] = len(nodes)
    for s in quota:
        nodes[("s", s)] = len(nodes)
    arcs: list[list] = []  # [to, room, cost]; arc i ^ 1 is its reverse
    out: list[list[int]] = [[] for _ in nodes]

    def arc(a, b, room, cost):
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    between = {}
    for p, words in capacity.items():
        for r in range(repeats):
            arc(0, nodes["p", p], words, r * r)
        for s in p:
            if s in quota:
                between[p, s] = len(arcs)
                arc(nodes["p", p], nodes["s", s], repeats * words, 0)
    for s, words in quota.items():
        arc(nodes["s", s], 1, words, 0)
    height = [0] * len(nodes)
    while True:
        far = [None] * len(nodes)
        far[0], via, heap = 0, [-1] * len(nodes), [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i in out[a]:
                b, room, cost = arcs[i]
                if room > 0 and (far[b] is None or d + cost + height[a] - height[b] < far[b]):
                    far[b] = d + cost + height[a] - height[b]
                    via[b] = i
                    heapq.heappush(heap, (far[b], b))
        if far[1] is None:
            break
        top = max(x for x in far if x is not None)
        height = [h + (top if f is None else f) for h, f in zip(height, far, strict=True)]
        push, b = None, 1
        while b != 0:
            push = arcs[via[b]][1] if push is None else min(push, arcs[via[b]][1])
            b = arcs[via[b] ^ 1][0]
        b = 1
        while b != 0:
            arcs[via[b]][1] -= push
            arcs[via[b] ^ 1][1] += push
            b = arcs[via[b] ^ 1][0]
    flow: dict[tuple, dict] = {p: {} for p in capacity}
    for (p, s), i in between.items():
        if arcs[i ^ 1][1]:
            flow[p][s] = arcs[i ^ 1][1]
    return flow


def routed(capacity: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, dict]:
    """As ``route``, which is asked only where sources overlap: a source that no other pattern holds takes its quota from
    its own pattern as far as the repetitions reach, so any number of such sources costs one step each."""
    patterns_of = Counter(s for p in capacity for s in p)
    alone = {p for p in capacity if len(p) == 1 and patterns_of[p[0]] == 1}
    overlapping = {p: n for p, n in capacity.items() if p not in alone}
    if len(overlapping) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} overlapping membership patterns")
    held = {s for p in overlapping for s in p}
    flow = route(overlapping, {s: n for s, n in quota.items() if s in held}, repeats)
    for p in alone:
        words = min(quota.get(p[0], 0), repeats * capacity[p])
        flow[p] = {p[0]: words} if words else {}
    return flow


def _walk(rows: DataFrame) -> DataFrame:
    """Rows of each pattern in seeded order, each taken if it fits what is left of the pattern's ``room``:
    (pattern, row, size) of those taken. A task holds one batch and one number."""
    def walk(batches):
        pattern, gap = None, 0
        for b in batches:
            taken = []
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("pattern", "size", "room")]
            for i, (p, size, room) in enumerate(zip(*cols, strict=True)):
                if p != pattern:
                    pattern, gap = p, room
                if size <= gap:
                    gap -= size
                    taken.append(i)
            yield b.select(["pattern", "row", "size"]).take(pa.array(taken, pa.int64()))

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "pattern").sortWithinPartitions("pattern", "order", "id", "size", "row")
    return dealt.select("pattern", "row", "size", "room").mapInArrow(walk, "pattern string, row long, size long")


def choose(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``chosen`` (boolean): the documents of each pattern are gone through in seeded order, each is taken if it fits
    what is left of ``wanted`` (pattern, want, rows), and at the end one more where going over by it comes nearer than
    staying under. The choice depends on the pattern's own documents alone.

    The order is cut into slices of at most about SLICE_ROWS rows of a pattern. In each round the slices whose
    fitting documents all fit together are taken by their sums, and the one after them is gone through row by row; the
    next round goes on behind it, until no document fits. So no pattern is gathered in one task.
    """
    columns, patterns = [c for c in sized.columns if c != "row"], wanted.count()
    bits = F.length(F.bin(F.floor(F.col("rows") / SLICE_ROWS)))
    sliced = (sized.join(broadcast_if_small(wanted.select("pattern", "rows"), BROADCAST_ROWS, patterns), "pattern")
              .withColumn("bits", bits)
              .withColumn("slice", F.when(F.col("rows") < SLICE_ROWS, F.lit(0).cast("long")).otherwise(F.expr("shiftright(`order`, 64 - bits)")))
              .drop("rows", "bits"))

    def beside(few):  # at most one row per pattern
        return sliced.where("size > 0").join(broadcast_if_small(few, BROADCAST_ROWS, patterns), "pattern").where("size <= gap")

    by_slice = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.col("upto") > F.col("gap")
    # the slice behind which a pattern goes on, and the words that it still wants
    state = wanted.where("want > 0").select("pattern", F.lit(-(1 << 62)).alias("behind"), F.col("want").alias("gap"))
    rounds, picks = [], []
    while True:
        sums = beside(state).where("slice > behind").groupBy("pattern", "behind", "gap", "slice").agg(F.sum("size").alias("n"))
        # no edge: all that fits is taken
        edges = spool(sums.withColumn("upto", F.sum("n").over(by_slice)).groupBy("pattern", "behind", "gap").agg(
            F.min(F.when(over, F.col("slice"))).alias("edge"),
            (F.col("gap") - F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0))).alias("room")), "edges")
        rounds.append(edges)
        cut = edges.where("edge is not null")
        if cut.isEmpty():
            break
        picks.append(spool(_walk(beside(cut).where("slice = edge")), "picks"))
        got = picks[-1].groupBy("pattern").agg(F.sum("size").alias("got"))
        state = spool(cut.join(got, "pattern", "left").select(
            "pattern", F.col("edge").alias("behind"), (F.col("room") - F.coalesce("got", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
    steps = reduce(DataFrame.unionByName, rounds).groupBy("pattern").agg(F.collect_list(F.struct("behind", "edge", "gap")).alias("steps"))
    whole = F.exists("steps", lambda s: (F.col("slice") > s["behind"]) & (s["edge"].isNull() | (F.col("slice") < s["edge"])) & (F.col("size") <= s["gap"]))
    marked = sliced.join(broadcast_if_small(steps, BROADCAST_ROWS, patterns), "pattern", "left").withColumn("chosen", F.coalesce(whole, F.lit(False)))
    if picks:
        picked = reduce(DataFrame.unionByName, picks).select("row", F.lit(True).alias("picked"))
        marked = marked.join(broadcast_if_small(picked, BROADCAST_ROWS), "row", "left").withColumn("chosen", F.col("chosen") | F.coalesce("picked", F.lit(False)))
    first = spool(marked.select("row", *columns, "chosen"), "chosen")
    got = first.where("chosen").groupBy("pattern").agg(F.sum("size").alias("got"))
    left = wanted.join(got, "pattern", "left").select("pattern", (F.col("want") - F.coalesce("got", F.lit(0))).alias("gap")).where("gap > 0")
    # what was passed over is larger than what is left: the smallest comes nearest
    more = (first.where(~F.col("chosen") & (F.col("size") > 0)).groupBy("pattern").agg(F.min(F.struct("size", "order", "id", "row")).alias("least"))
            .join(left, "pattern").where(F.col("least.size") - F.col("gap") < F.col("gap")).select(F.col("least.row").alias("row"), F.lit(True).alias("more")))
    return first.join(broadcast_if_small(more, BROADCAST_ROWS, patterns), "row", "left") \
        .withColumn("chosen", F.col("chosen") | F.coalesce("more", F.lit(False))).select(*columns, "chosen")


def mix(docs: DataFrame, weights, sources=None, repeats: int = 3, seed: int = 11, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """Mix documents so that each source contributes its share of words.

    ``sources``: column with the array of sources of a document (default: its ``source`` alone; null is a
    source of its own, last in order). ``weights``: function from the ordered list of sources to their
    weights. Targets are shares of all words, at most ``repeats`` times a source's words.

    Returns one row per document: id, size (words), sources, source_size and target (sum over its sources), copies (times that
    the mix takes it, 0..repeats), taken (copies * size). Each pattern's taken words differ from its
    flow by less than one document. Reruns agree: the order is a hash of seed and id. The driver holds one row per membership
    pattern. More than MAX_PATTERNS patterns of sources that overlap with others raise ValueError: the flow is one driver's work.

    Null and empty texts have size 0 and are never needed. Repeated rows share one place in the order. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(sources))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = spool(docs.select(F.col(id_col).alias("id"), size.alias("size"), own.alias("sources"),
                              F.xxhash64(F.lit(seed), F.col(id_col)).alias("order"), F.monotonically_increasing_id().alias("row"))
                  .withColumn("pattern", F.to_json(F.struct("sources"))), "sized")
    found = sized.groupBy("pattern", "sources").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    ordered = sorted({s for r in found for s in r.sources}, key=lambda s: (s is None, s or ""))
    words = Counter()
    for r in found:
        words.update(dict.fromkeys(r.sources, r.n))
    total = sum(r.n for r in found)
    target = shares(words, dict(zip(ordered, weights(ordered), strict=True)), repeats)
    if (all_ := sum(target.values())) > 0 and sources is not None:  # overlaps count once in the whole
        target = {s: t * min(1.0, total / all_) for s, t in target.items()}
    flow = routed({tuple(r.sources): int(r.n) for r in found}, {s: round(t) for s, t in target.items()}, repeats)
    plan = []
    for r in found:
        sent = sum(flow[tuple(r.sources)].values())
        whole = min(repeats, sent // r.n) if r.n else 0
        plan.append((r.pattern, int(whole), int(sent - whole * r.n), int(sum(words[s] for s in r.sources)),
                     float(sum(target[s] for s in r.sources)), r.rows))
    quota = spark.createDataFrame(plan, "pattern string, whole long, want long, source_size long, target double, rows long")
    picked = choose(sized, quota.select("pattern", "want", "rows"))
    copies = F.when(F.col("size") > 0, F.least(F.lit(repeats), F.col("whole") + F.col("chosen").cast("long"))).otherwise(F.lit(0))
    return picked.join(broadcast_if_small(quota, BROADCAST_ROWS, len(plan)), "pattern").withColumn("copies", copies.cast("long")).select(
        F.col("id").alias(id_col), "size", "sources", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def repeating(cycle: tuple = (5, 2, 1)):
    """Weights that go through ``cycle`` again and again, in the order of the sources."""
    return lambda ordered: [cycle[i % len(cycle)] for i in range(len(ordered))]
