"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rushlight.plans.sizing import settle

WHITE = r"[\x20\x09-\x0D]+"
BINS = 4096  # hash ranges per pattern in which sizes are added up before single documents are looked at
MAX_PATTERNS = 200_000  # distinct membership patterns; refused beyond, since they are collected


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")).cast("bigint")


def source_targets(
    sizes: dict[str | None, int],
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight (sources in code-point order, null last, weights
    repeating), none above ``most`` times its own size; what is cut off goes to the others by weight, again and again
    until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, targets = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return targets | {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if s in over]
        targets |= {s: most * sizes[s] for s in full}
        left -= sum(targets[s] for s in full)
        open_ = [s for s in open_ if s not in over]
    return targets


def _max_flow(heads: list[int], room: list[int], out: list[list[int]], start: int, end: int) -> None:
    """Send all that fits from ``start`` to ``end`` in blocking flows, one for each distance. Arc 2i and 2i + 1 are each
    other's way back; ``room`` is what an arc still holds and is changed in place. Arcs are tried in their order."""
    while True:
        level = [-1] * len(out)
        level[start] = 0
        queue = deque([start])
        while queue and level[end] < 0:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 0 and level[heads[e]] < 0:
                    level[heads[e]] = level[a] + 1
                    queue.append(heads[e])
        if level[end] < 0:
            return
        tried = [0] * len(out)
        path: list[int] = []
        node = start
        while True:
            if node == end:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                # go on from the tail of the first full arc
                at = next(i for i, e in enumerate(path) if not room[e])
                node = heads[path[at] ^ 1]
                del path[at:]
                continue
            while tried[node] < len(out[node]):
                e = out[node][tried[node]]
                if room[e] > 0 and level[heads[e]] == level[node] + 1:
                    break
                tried[node] += 1
            if tried[node] < len(out[node]):
                path.append(e)
                node = heads[e]
            elif path:
                node = heads[path.pop() ^ 1]
                tried[node] += 1
            else:
                break


def _route_together(
    patterns: dict[int, tuple[list[int], int]], quotas: list[int], repeats: int
) -> dict[int, tuple[int, dict[int, int]]]:
    """``route`` for patterns that hang together through their sources."""
    place = {s: i for i, s in enumerate(sorted({s for sources, _ in patterns.values() for s in sources}))}
    n = len(place)
    start, end = n + len(patterns), n + len(patterns) + 1
    heads: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, most: int) -> int:
        for tail, head, space in ((a, b, most), (b, a, 0)):
            out[tail].append(len(heads))
            heads.append(head)
            room.append(space)
        return len(heads) - 2

    for s, i in place.items():
        arc(start, i, quotas[s])
    routed, last = {}, {}
    for at, (number, (sources, size)) in enumerate(patterns.items()):
        for s in sources:
            routed[number, s] = arc(place[s], n + at, repeats * size)
        last[number] = arc(n + at, end, 0)
    # only the last arc of a path costs, by how often its text is read: cheapest paths are those with the least repeats
    for _ in range(repeats):
        for number, (_, size) in patterns.items():
            room[last[number]] += size
        _max_flow(heads, room, out, start, end)
    taken = {}
    for number, (sources, _) in patterns.items():
        by = {s: room[routed[number, s] + 1] for s in sources}
        taken[number] = (sum(by.values()), by)
    return taken


def route(
    patterns: dict[int, tuple[list[int], int]], quotas: list[int], repeats: int
) -> dict[int, tuple[int, dict[int, int]]]:
    """Min-cost flow from source quotas through membership patterns into their text.

    ``patterns``: number -> (sources, size). Reading a pattern's text the first time costs 0, the second time 1, the
    third time 3 and so on (convex), so text is repeated only where a quota cannot be met with new text. Returns
    for each pattern the words taken in all and by source. Patterns that share no source, directly or through others,
    are routed apart; a source whose text is one pattern's and in no other source needs no flow. Deterministic: nodes
    are tried in their order.
    """
    above = list(range(len(quotas)))

    def root(s: int) -> int:
        while above[s] != s:
            above[s] = above[above[s]]
            s = above[s]
        return s

    for sources, _ in patterns.values():
        for s in sources[1:]:
            above[root(s)] = root(sources[0])
    together: dict[int, list[int]] = {}
    for number, (sources, _) in patterns.items():
        together.setdefault(root(sources[0]), []).append(number)
    taken = {}
    for numbers in together.values():
        sources, size = patterns[numbers[0]]
        if len(numbers) == 1 and len(sources) == 1:
            words = min(quotas[sources[0]], repeats * size)
            taken[numbers[0]] = (words, {sources[0]: words})
        else:
            taken |= _route_together({i: patterns[i] for i in numbers}, quotas, repeats)
    return taken


def mix_sources(
    df: DataFrame,
    sources: Column,
    key: str = "doc_id",
    text: str = "text",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most_repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """``df`` with ``size`` (words), ``pattern`` (its sorted sources), ``pattern_target`` and ``taken`` (words, repeats
    counted: 0, 1 or more whole readings of the document).

    ``sources`` is an array column: the sources a document belongs to; a null member is a source of its own, an empty
    or null array is read as that one. Sizes are added up per membership pattern; targets per source come from
    ``source_targets``, where a text in several sources counts for each; ``route`` decides how many words of each
    pattern are taken. Within a pattern every document is read floor(taken / size) times, and documents in the order
    of a seeded hash once more until the pattern's words are met as nearly as whole documents allow. The hash
    makes reruns agree, whatever the partitioning.

    The order is not sorted as a whole: sizes are added up in ``BINS`` hash ranges per pattern, full ranges are taken
    or left, and only the range in which the quota ends is ordered by row, so a pattern with a third of all
    rows is no one task's work. The driver sees one row per pattern (refused above ``MAX_PATTERNS``).

    Null and empty texts have size 0 and nothing to take. Rows that repeat a key are ordered by text too; full
    repeats share a place and are taken or left together. An empty table gives an empty result.
    """
    spark = df.sparkSession
    added = {"size", "pattern", "pattern_target", "taken"}
    names = [c for c in df.columns if c.lower() not in added]
    kept = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)]  # names of the caller meet none of those below
    members = F.when(F.size(F.coalesce(sources, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(sources)
    rows = df.select(
        *kept,
        word_count(F.col(f"`{text}`")).alias("size"),
        F.sort_array(F.array_distinct(members)).alias("pattern"),
        F.sha2(
            F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.xxhash64(text)), 256
        ).alias("_order"),
    ).withColumn("_bin", F.expr(f"cast(conv(substring(_order, 1, 8), 16, 10) as bigint) % {BINS}"))
    narrow = settle(rows.select("pattern", "_bin", "_order", "size"))  # texts are split into words twice, not four times
    bins = settle(narrow.groupBy("pattern", "_bin").agg(F.sum("size").alias("words")))
    found = bins.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["pattern"]])
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in r["pattern"]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    targets = source_targets(sizes, weights, share, most_repeats)
    known = sorted(sizes, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(known)}
    taken = route(
        {i: ([place[s] for s in r["pattern"]], r["words"]) for i, r in enumerate(found)},
        [round(targets[s]) for s in known],
        most_repeats,
    )
    plan = []
    for i, r in enumerate(found):
        whole, rest = divmod(taken[i][0], r["words"]) if r["words"] else (0, 0)
        plan.append((list(r["pattern"]), int(whole), int(rest), float(sum(targets[s] for s in r["pattern"]))))
    quotas = spark.createDataFrame(plan, "pattern array<string>, whole bigint, rest bigint, pattern_target double")
    # where in its bins each pattern's rest ends; one row per pattern and bin
    before = F.coalesce(
        F.sum("words").over(W.partitionBy("pattern").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    ends = settle(
        bins.join(F.broadcast(quotas), "pattern")
        .withColumn("before", before)
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select("pattern", F.col("_bin").alias("end_bin"), (F.col("rest") - F.col("before")).alias("room"))
    )
    # a document of the end bin is read once more if its middle lies inside the room: the nearest whole documents
    edge = narrow.join(F.broadcast(ends.select("pattern", F.col("end_bin").alias("_bin"), "room")), ["pattern", "_bin"])
    line = W.partitionBy("pattern").orderBy("_order")
    inside = (
        edge.groupBy("pattern", "_order", "room")
        .agg(F.sum("size").alias("words"))
        .withColumn("after", F.sum("words").over(line.rowsBetween(W.unboundedPreceding, 0)))
        .filter(F.col("after") - F.col("words") / 2 <= F.col("room"))
        .groupBy("pattern")
        .agg(F.max("_order").alias("last_order"))
    )
    limits = quotas.join(ends, "pattern", "left").join(inside, "pattern", "left")
    # one row per pattern, at most MAX_PATTERNS
    once_more = F.when(F.col("end_bin").isNull(), F.lit(0)).otherwise(
        F.when(F.col("_bin") < F.col("end_bin"), 1)
        .when((F.col("_bin") == F.col("end_bin")) & (F.col("_order") <= F.col("last_order")), 1)
        .otherwise(0)
    )
    return (
        rows.join(F.broadcast(limits), "pattern")
        .withColumn("taken", F.col("size") * (F.col("whole") + once_more))
        .select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], "size", "pattern", "pattern_target", "taken")
    )
