"""Near duplicates by DartMinHash: sparse weighted signatures, banded joining, exact check, one class per group."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 22, 6
LEVELS = 24  # rank levels, each twice as deep as all before it; far more than any text needs
FIRST = 2.0**-10  # depth of the first rank level
ROWS_OUT = 256
MEMO = 250_000  # words a worker remembers the hash of
STARS = 1  # star rounds before the exact one
BLOCK = 150_000  # elements of a block in the exact round
COLUMNS = 4096  # elements compared at a time

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MUL1
        x = (x ^ (x >> np.uint64(27))) * _MUL2
        return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, weights, digest): distinct word shingles with how often each occurs, and a hash of the word sequence.

    A text of fewer words than ``size`` is one shingle; a text without words has none.
    """
    words = WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0), 0
    if len(_CODES) > MEMO:
        _CODES.clear()
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        span = min(size, len(words))
        rolled = np.zeros(len(words) - span + 1, np.uint64)
        for i in range(span):
            rolled = mix64(rolled + codes[i : i + len(rolled)] + _STEP)
        digest = int(mix64(np.array([np.bitwise_xor.reduce(mix64(codes + _STEP * np.arange(1, len(codes) + 1, dtype=np.uint64)))]))[0])
    found, counts = np.unique(rolled, return_counts=True)
    return found, counts.astype(np.float64), digest


class _Codes(dict):
    """Word -> 64-bit hash, remembered by the worker."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_CODES = _Codes()


_POISSON: dict[float, np.ndarray] = {}


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities, from 0 darts on."""
    table = _POISSON.get(mean)
    if table is None:
        term, total, table = np.exp(-mean), 0.0, []
        n = 0
        while n <= mean or total < 1 - 1e-16:
            total += term
            table.append(min(total, 1.0))
            n += 1
            term *= mean / n
            if term < 1e-300:
                break
        table = _POISSON[mean] = np.array(table)
    return table


def dart_signatures(
    owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, owners: int, size: int
) -> np.ndarray:
    """(owners, size) array of dart ids: DartMinHash signatures of weighted sets given as flat arrays.

    Every element has a fixed shower of darts over the plane weight x rank, one dart per unit of area on average:
    the plane is cut into cells, [0,1) [1,2) [2,4) .. in weight and doubling levels in rank; a hash of (element, cell)
    says how many darts the cell has (Poisson), a hash of the dart its place and coordinate. Darts below an element's
    weight hit; the earliest hit in rank is a coordinate's value. Two sets agree on a coordinate with the probability
    of their weighted Jaccard similarity. An owner throws level after level until every coordinate is hit, so
    its darts number about ``size`` log ``size`` however many elements it has. Owners without weight get zeros.
    """
    out = np.zeros((owners, size), np.uint64)
    rank = np.full((owners, size), np.inf)
    total = np.bincount(owner, weights, owners)
    need = size * (np.log(size) + 2)  # enough on average; who still has a gap goes on below
    level_of = np.zeros(owners, np.int64)
    has = total > 0
    level_of[has] = np.clip(np.ceil(np.log2(need / total[has] / FIRST)), 0, LEVELS - 1)
    active, level = has.copy(), 0
    while active.any() and level < 60:
        low, high = (0.0 if level == 0 else FIRST * 2.0 ** (level - 1)), FIRST * 2.0**level
        mine = active[owner]
        own, element, weight = owner[mine], elements[mine], weights[mine]
        cell = 0
        while len(own):
            left, right = (0.0 if cell == 0 else 2.0 ** (cell - 1)), 2.0**cell
            # consistent for all owners: depends on element, level and cell alone
            with np.errstate(over="ignore"):
                seed = mix64(element + _STEP * np.uint64(1 + level * 64 + cell))
            area = (high - low) * (right - left)
            parts = max(1, int(np.ceil(area / 64)))  # cells of large area are thrown in parts
            for part in range(parts):
                with np.errstate(over="ignore"):
                    start = mix64(seed + np.uint64(part))
                darts = np.searchsorted(_poisson_table(area / parts), _unit(start), side="right")
                at = np.repeat(np.arange(len(own)), darts)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
                with np.errstate(over="ignore"):
                    dart = mix64(start[at] + _STEP * (nth + 1).astype(np.uint64))
                    x = left + (right - left) * _unit(mix64(dart + np.uint64(1)))
                    y = low + (high - low) * (part + _unit(mix64(dart + np.uint64(2)))) / parts
                hit = x < weight[at]
                slot = own[at[hit]] * size + (dart[hit] % np.uint64(size)).astype(np.int64)
                y, dart = y[hit], dart[hit]
                np.minimum.at(rank.reshape(-1), slot, y)
                first = rank.reshape(-1)[slot] == y
                out.reshape(-1)[slot[first]] = dart[first]
            more = weight > right
            own, element, weight = own[more], element[more], weight[more]
            cell += 1
        done = level >= level_of
        active &= ~(done & np.isfinite(rank).all(axis=1))
        level += 1
    return out


def _bands(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(signatures), b + 1, np.uint64)
            for r in range(rows):
                h = mix64(h + signatures[:, b * rows + r] + _STEP)
            out[:, b] = h
    return out.view(np.int64)


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                made = [shingles(t, size) for t in batch.column("text").to_pylist()]
                counts = [len(m[0]) for m in made]
                owner = np.repeat(np.arange(len(made)), counts)
                signatures = dart_signatures(
                    owner, np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), len(made), bands * rows
                )
                banded = pa.array(_bands(signatures, bands, rows).reshape(-1))
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * bands)
                weight = pa.array([int(m[1].sum()) for m in made], pa.int64())
                digest = pa.array(np.array([m[2] for m in made], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), digest, weight, pa.ListArray.from_arrays(ends, banded)], ["id", "digest", "weight", "bands"]
                )

    return run


def _elements(size: int):
    """Elements of each text as sorted 32-bit hashes of (shingle, how manieth): a multiset as a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                out, digests = [], []
                for text in batch.column("text").to_pylist():
                    found, counts, digest = shingles(text, size)
                    digests.append(digest)
                    times = counts.astype(np.int64)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    with np.errstate(over="ignore"):
                        flat = mix64(np.repeat(found, times) + _STEP * nth.astype(np.uint64))
                    out.append(np.sort((flat >> np.uint64(32)).astype(np.uint32)).tobytes())
                ids = pa.array(np.array(digests, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["id", "elements"])

    return run


def _compare(threshold: float):
    """Links between the texts of two blocks: all overlaps at once, as a product of 0/1 matrices over elements."""

    def rows(texts: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        elements = [np.unique(np.frombuffer(t["elements"], np.uint32)) for t in texts]
        return np.array([t["id"] for t in texts], np.int64), np.array([t["root"] for t in texts], np.int64), elements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in range(batch.num_rows):
                one, two = (rows(batch.column(c)[n].as_py()) for c in ("one", "two"))
                flat = [np.concatenate(side[2]) for side in (one, two)]
                common = np.intersect1d(*flat)
                sizes = [np.array([len(e) for e in side[2]]) for side in (one, two)]
                overlap = np.zeros((len(one[0]), len(two[0])), np.float32)
                for start in range(0, len(common), COLUMNS):
                    part = common[start : start + COLUMNS]
                    planes = []
                    for side, all_of, size in zip((one, two), flat, sizes):
                        at = np.minimum(np.searchsorted(part, all_of), len(part) - 1)
                        hit = part[at] == all_of
                        plane = np.zeros((len(side[0]), len(part)), np.float32)
                        plane[np.repeat(np.arange(len(side[0])), size)[hit], at[hit]] = 1.0
                        planes.append(plane)
                    overlap += planes[0] @ planes[1].T
                total = sizes[0][:, None] + sizes[1][None, :] - overlap
                near = (overlap >= threshold * total - 1e-4) & (one[1][:, None] != two[1][None, :])
                x, y = np.nonzero(near)
                found_a.append(np.minimum(one[0][x], two[0][y]))
                found_b.append(np.maximum(one[0][x], two[0][y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return run


def block_links(texts: DataFrame, similarity: float) -> DataFrame:
    """Exact links (a, b) between ``texts`` (area, id, root, weight, elements) of one area that are in different classes.

    Texts of an area are dealt to blocks of about ``BLOCK`` elements: by weight tier, since similar texts have weights in
    the same or the next tier, and by whether they belong to the area's largest class. Pairs of blocks, not pairs of
    texts, are joined, none within the largest class; a task holds two blocks and gives back links only.
    """
    classes = texts.groupBy("area", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = classes.groupBy("area").agg(F.max(F.struct("n", "root")).alias("m")).select("area", F.col("m.root").alias("main"))
    tier = F.floor(F.log("weight") / F.lit(-np.log(similarity)) + 1e-9).alias("tier")
    placed = settle(texts.join(largest, "area").select("area", "id", "root", "weight", "elements", tier, (F.col("root") == F.col("main")).alias("same")))
    part = ["area", "tier", "same"]
    shares = placed.groupBy(*part).agg(F.ceil(F.sum("weight") / BLOCK).alias("blocks"))
    dealt = placed.join(shares, part).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    block = F.concat_ws("/", *part, "block").alias("name")
    filled = settle(
        dealt.groupBy(*part, "block").agg(F.collect_list(F.struct("id", "root", "elements")).alias("texts")).select(*part, block, "texts")
    )
    names = filled.select(*part, "name")
    other = names.select("area", F.col("tier").alias("tier2"), F.col("same").alias("same2"), F.col("name").alias("name2"))
    pairs = names.join(other, "area").filter(
        (F.abs(F.col("tier") - F.col("tier2")) <= 1) & (F.col("name") <= F.col("name2")) & ~(F.col("same") & F.col("same2"))
    ).select("name", "name2")
    both = (
        pairs.join(filled.select("name", F.col("texts").alias("one")), "name")
        .join(filled.select(F.col("name").alias("name2"), F.col("texts").alias("two")), "name2")
        .select("one", "two")
    )
    return both.mapInArrow(_compare(similarity), "a bigint, b bigint").distinct()


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ea").to_pylist(), batch.column("eb").to_pylist())):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if len(p) == len(q) and x == y:
                    keep[i] = True
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                # copies inside one side are rare hash meetings; they count for both sides alike
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = shared >= threshold * (len(p) + len(q) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"]
            )

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable over undirected ``links`` (a, b), for every id that has a link.

    Each round every id takes the smallest of itself and its neighbours as parent; links are redrawn between parents, and
    those inside one are dropped, so what is left shrinks from round to round: at once for stars, by half along a
    chain. Rounds are written to shared files; neighbours are combined before each shuffle, so hubs cost no more than
    other ids. Parents of the rounds, one after the other, are the root.
    """
    rest = settle(links.select("a", "b").filter("a <> b").distinct())
    roots = settle(rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct()).withColumn("root", F.col("id"))
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = settle(both.groupBy(F.col("a").alias("child")).agg(F.least(F.min("b"), F.col("child")).alias("parent")))
        other = parents.select(F.col("child").alias("child2"), F.col("parent").alias("parent2"))
        drawn = rest.join(parents, F.col("a") == F.col("child")).join(other, F.col("b") == F.col("child2"))
        rest = settle(drawn.filter("parent <> parent2").select(F.col("parent").alias("a"), F.col("parent2").alias("b")).distinct())
        roots = roots.join(parents, F.col("root") == F.col("child"), "left").select("id", F.coalesce("parent", "root").alias("root"))
    return settle(roots)


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``df``: ``key, class_id, class_size, n_links, kept``.

    Texts are multisets of ``shingle``-word shingles (a shorter text is one shingle); two are near duplicates when
    their weighted Jaccard similarity, the sum of the smaller counts over the sum of the larger ones, is at least
    ``similarity``. A class is what is connected by such links; ``class_id`` is its smallest key, ``kept`` marks that
    row. ``n_links`` counts the verified links of the row's text to other texts.

    1. Rows of one word sequence are one text, represented by the smallest key; copies are counted, never paired.
    2. DartMinHash signatures are cut into ``bands`` bands of ``rows`` coordinates (a pair at 0.8 is met with
       probability 0.998); texts that share a band share a bucket.
    3. In each bucket the member with the smallest hash is the centre, and only (member, centre) pairs are verified, on
       whole texts; verified links merge classes. ``STARS`` such rounds join nearly all there is: a
       group of n near copies costs about n pairs a round.
    4. Texts in buckets that still hold several classes are compared exactly, across classes and in blocks
       (``block_links``). So no two texts that share a bucket end in different classes unless they are too different.

    Texts without words (null, empty, white space) are classes of their own with 0 links. Null keys are left out of
    linking and come back as rows of their own. Rows that repeat key and text share a class; the kept row is the
    one with the class's smallest key. Empty tables give empty results.
    """
    spark = df.sparkSession
    rows_in = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    signed = settle(
        rows_in.mapInArrow(_sign(shingle, bands, rows), f"id {kind}, digest bigint, weight bigint, bands array<bigint>")
    )
    worded = signed.filter((F.col("weight") > 0) & F.col("id").isNotNull())
    # from here on a text goes by its digest
    texts = settle(
        worded.groupBy(F.col("digest").alias("text_id")).agg(
            F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("weight").alias("weight"), F.any_value("bands").alias("bands")
        )
    )
    posted = texts.select(F.col("text_id").alias("id"), "weight", F.explode("bands").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = settle(posted.join(shared, "bucket"))
    involved = texts.join(members.select(F.col("id").alias("text_id")), "text_id", "left_semi").select(F.col("first").alias("id"))
    elements = settle(
        rows_in.join(involved, "id", "left_semi").mapInArrow(_elements(shingle), "id bigint, elements binary").dropDuplicates(["id"])
    )

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that reach the similarity, on whole texts."""
        left = elements.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
        right = elements.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb")
        return settle(met.mapInArrow(_similar(similarity), "a bigint, b bigint"))

    def close(x: str, y: str):
        return F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9

    def stars(members: DataFrame, turn: int) -> DataFrame:
        """(member, centre) of every bucket; the centre is the member with the smallest hash of this turn."""
        order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id"), F.col("weight"), F.col("root"))
        centre = members.groupBy("bucket").agg(F.min(order).alias("c"))
        met = members.join(centre, "bucket").filter((F.col("root") != F.col("c.root")) & close("weight", "c.weight"))
        return met.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()

    def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Members with their class so far, in buckets that hold more than one class."""
        plain = members.select("bucket", "id", "weight")
        if roots is not None:
            plain = plain.join(roots, "id", "left")
        else:
            plain = plain.withColumn("root", F.lit(None).cast("bigint"))
        plain = plain.withColumn("root", F.coalesce("root", "id"))
        mixed = plain.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
        return settle(plain.join(mixed, "bucket"))

    links, done, roots = None, None, None
    for turn in range(STARS + 1):
        members = rooted(members, roots)
        if members.isEmpty():
            break
        last = turn == STARS
        if last:
            # an area is what shared buckets connect: no text outside it shares a bucket with one inside
            centre = members.groupBy("bucket").agg(F.min("id").alias("b"))
            areas = components(members.join(centre, "bucket").select(F.col("id").alias("a"), "b").distinct())
            open_texts = members.select("id", "weight", "root").distinct().join(areas.withColumnRenamed("root", "area"), "id")
            made = settle(block_links(elements.join(open_texts, "id"), similarity))
        else:
            pairs = stars(members, turn)
            pairs = settle(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
            made = verify(pairs)
            done = pairs if done is None else done.union(pairs)
        links = made if links is None else links.union(made)
        roots = components(links)
        if last:
            break
    classed = texts.select("text_id", "first", "copies")
    if links is None:
        classed = classed.withColumn("root", F.col("text_id")).withColumn("n_links", F.lit(0).cast("bigint"))
    else:
        ends = links.select(F.col("a").alias("text_id")).union(links.select(F.col("b").alias("text_id")))
        classed = (
            classed.join(roots.withColumnRenamed("id", "text_id"), "text_id", "left")
            .join(ends.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_links")), "text_id", "left")
            .select("text_id", "first", "copies", F.coalesce("root", "text_id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )
    classed = settle(classed)
    classes = classed.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    classed = classed.join(classes, "root").select(F.col("text_id").alias("digest"), "class_id", "class_size", "n_links")
    linked = F.col("weight") > 0
    return (
        signed.select("id", "digest", F.when(F.col("id").isNotNull(), F.col("weight")).otherwise(0).alias("weight"))
        .join(classed, "digest", "left")
        .select(
            F.col("id").alias(key),
            F.when(linked, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
            F.when(linked, F.col("class_size")).otherwise(1).cast("bigint").alias("class_size"),
            F.when(linked, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
            F.when(linked, F.col("class_id") == F.col("id")).otherwise(True).alias("kept"),
        )
    )
