"""N-gram Jaccard join in the metric space of shingle sets, exact, by pivots and Voronoi regions.

Documents are sets of distinct word shingles; two link when ``100 * |A & B| >= percent * |A | B|``,
that is when their Jaccard distance is at most epsilon = 1 - percent / 100. Equal sets are one point
of the space. The space is first cut where it falls apart by itself: in one global order of the
shingles (those of few documents first, then by hash) points within epsilon share one of their first
n - ceil(percent * n) + 1 shingles. So every point meets, for each such shingle, the points that
share it, and

* a shingle of few points (to ``SMALL``) bounds where links can be: points that share enough of
  their first shingles are candidates, and what candidates connect is a region to begin with;
* points with a commoner one among them (members of large groups of near copies, for the order puts
  common shingles last, the commonest at the end) meet there too, and what such shingles connect is a region as well.

So a point is in one or two of the first regions, and only there are its links; points that are no
candidates have none. Every region is joined by pivots: they are drawn from its points (farthest
first), links to them are found at once, every point goes to the Voronoi cell of its nearest pivot,
and points on the border (nearer than 2 * epsilon more than to their own pivot, as the triangle
inequality asks) are replicated. Points with no pivot within ``RADIUS`` stay in a rest cell. Cells are
joined in the same way, recursively, down to leaves, in which only pairs whose distances to all
pivots differ by no more than epsilon (the window of the triangle inequality) are verified. Regions of
more than ``REGION`` shingles are dealt out by rounds of Spark jobs with up to ``PIVOTS`` pivots each,
until their cells fit one task.

Links join points into classes, and only points of different classes still need comparing, for only
the classes are asked for. A cell whose pivots do not divide it is done when every point outside its
largest class has been a pivot. No cap drops a pair: all decisions only order the work.

Shingles are 64-bit hashes; with n shingles in all, the chance that any two differing ones meet is
about n * n / 2**65. Points of the same set are told apart by a 128-bit digest.

Edge cases: null or empty text, or text without words, is an empty set, linked with nothing, its own
class. Rows that repeat, also with the same id, are points like others; null ids form classes only by
their sets and get the smallest id linked with them (null if there is none). Empty tables give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import WordHashes, saved, shingle_set, trimmed, words_of

#: Fixed parameters: words in a shingle, similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Sizes that order the work: points that share a shingle before it counts as common, shingles of a
#: region that one task joins, pivots of a round, shingles of pivots that go to the tasks at a time.
SMALL, REGION, PIVOTS, PIVOT_SHINGLES = 16, 2_000_000, 64, 2_000_000
#: Points of a leaf, pivots of a cell in a task, and how near a cell's pivot is.
LEAF, CELL_PIVOTS, RADIUS = 32, 8, 0.6
#: The most rows (two short strings each) of a table that is sent to every task.
BROADCAST = 250_000


def needed(a, b, percent: int = PERCENT):
    """The least overlap of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def common_shingles(docs: DataFrame, shingle: int, small: int, most: int = 1 << 20) -> np.ndarray:
    """Hashes of shingles that more than ``small`` rows hold, those of few rows first, then ascending; the bound is raised until at most ``most`` are left.

    Hashes travel packed by range (38 bits are enough to order the work), once a task and row.
    """
    spark = docs.sparkSession
    ranges = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    starts = np.array([-(-(r << 38) // ranges) for r in range(ranges)], dtype=np.uint64)

    def pack(batches):
        memo, held, size = WordHashes(), [], 0

        def rows():
            h = np.sort(np.concatenate(held) >> np.uint64(26))
            cut = [*np.searchsorted(h, starts), len(h)]
            # differences of sorted numbers, their first bytes together, then their second ...: small, and easy to compress
            gaps = [np.diff(h[a:b], prepend=s).astype(np.uint32) for s, a, b in zip(starts, cut, cut[1:], strict=False)]
            return pd.DataFrame({"range": range(ranges), "gaps": [g.view(np.uint8).reshape(-1, 4).T.tobytes() for g in gaps]})

        for pdf in batches:
            for t in pdf["text"]:
                s = shingle_set(memo.of(words_of(t)), shingle)
                held.append(s)
                size += len(s)
                if size > 4_000_000:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    def count(pdf):
        start = starts[pdf["range"].iloc[0]]
        h = np.concatenate([np.cumsum(np.frombuffer(g, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint64) + start for g in pdf["gaps"]])
        u, n = np.unique(h, return_counts=True)
        return pd.DataFrame({"h": u[n > small].astype(np.int64), "n": n[n > small]})

    counted = saved(docs.select("text").mapInPandas(trimmed(pack), "range int, gaps binary").groupBy("range").applyInPandas(count, "h long, n long"), "common")
    while counted.where(F.col("n") > small).count() > most:
        small *= 2
    rows = counted.where(F.col("n") > small).collect()
    h = np.array([r["h"] for r in rows], dtype=np.uint64)
    return h[np.lexsort((h, np.array([r["n"] for r in rows], dtype=np.int64)))]


def points(docs: DataFrame, common: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """For each row: id, n (its shingles), digest and mark (its first 64 bits), prefix (its rare first shingles; p of them), dense (whether common ones are among the first) and those (``common`` has them in their order)."""
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order.astype(np.int64)))

    def run(batches):
        memo, (held, place) = WordHashes(), shared.value
        for pdf in batches:
            out = []
            for doc_id, t in zip(pdf["id"], pdf["text"], strict=True):
                s = shingle_set(memo.of(words_of(t)), shingle)
                k = s >> np.uint64(26)
                at = np.minimum(np.searchsorted(held, k), max(len(held) - 1, 0))
                known = held[at] == k if len(held) else np.zeros(len(s), bool)
                rare = s[~known]
                p = prefix_length(len(s), percent)
                often = np.sort(place[at[known]])[: max(p - len(rare), 0)] if len(rare) < p else np.zeros(0, np.int64)
                digest = _digest(s)
                out.append((doc_id, len(s), digest, int.from_bytes(digest[:8], "little", signed=True), min(p, len(rare)), rare[:p].astype(np.int64), len(rare) < p, often))
            yield pd.DataFrame(out, columns=["id", "n", "digest", "mark", "p", "prefix", "dense", "often"])

    rows = docs.select(F.col("id").cast("string").alias("id"), "text")
    return rows.mapInPandas(trimmed(run), "id string, n long, digest binary, mark long, p long, prefix array<long>, dense boolean, often array<long>")


def _pairs_within(batches):
    """Pairs of marks that share hashes, with how many, of a partition that holds all rows of its hashes."""
    rows = [(pdf["h"].to_numpy(), pdf["mark"].to_numpy()) for pdf in batches]
    if not rows:
        return
    h, mark = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((mark, h))
    h, mark = h[order], mark[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (mark[1:] != mark[:-1]))  # copies share all their hashes
    h, mark = h[fresh], mark[fresh]
    a, b, step = [], [], 1
    while (same := np.flatnonzero(h[step:] == h[:-step])).size:
        a.append(mark[same])
        b.append(mark[same + step])
        step += 1
    if a:
        pairs, shared = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1, return_counts=True)
        yield pd.DataFrame({"x": pairs[0], "y": pairs[1], "shared": shared})


def pairs_of_rare(held: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of representatives that share enough of their rare first shingles.

    What both hold beyond the shared first shingles is at most what lies after the first ones of the
    one whose first shingles end earlier, so the overlap is bounded by shared + the rest of either.
    Sets are known by 64-bit marks here; should two sets have one mark, both are candidates.
    """
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.where(F.size("prefix") > 0).select(F.explode("prefix").alias("h"), "mark").repartition(parts, "h")
    pairs = rows.mapInPandas(_pairs_within, "x long, y long, shared long").groupBy("x", "y").agg(F.sum("shared").alias("shared"))
    one = lambda name, key: reps.select(F.col("rep").alias(name), F.col("mark").alias(key), F.col("n").alias(f"n_{name}"), (F.col("n") - F.col("p")).alias(f"rest_{name}"))
    both = pairs.join(one("a", "x"), "x").join(one("b", "y"), "y")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    kept = both.where(sizes & (F.col("shared") + F.greatest("rest_a", "rest_b") >= need)).select("a", "b")
    # sets of one mark never meet above
    twins = reps.groupBy("mark").agg(F.collect_list("rep").alias("g")).where(F.size("g") > 1).select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a < b")
    return kept.unionByName(twins)


class Region:
    """Sets of one region with an inverted index, so that one set is compared with all that share anything with it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[np.argsort(self.codes, kind="stable")]
        self.stop = np.cumsum(np.bincount(self.codes, minlength=len(values)))

    def overlaps(self, i: int) -> np.ndarray:
        own = self.codes[self.ends[i] - self.sizes[i] : self.ends[i]]
        return np.bincount(self.owner[_runs(np.where(own > 0, self.stop[own - 1], 0), self.stop[own])], minlength=len(self.sizes))


def _runs(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all half-open runs, one after another."""
    n = stop - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Classes:
    """Union by smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def all(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


def reach_of(nearest: np.ndarray, epsilon: float, radius: float) -> np.ndarray:
    """How far from a pivot a point still belongs to that pivot's cell, by the distance to its nearest one: the border of the triangle inequality."""
    return np.minimum(nearest + 2 * epsilon, radius + epsilon) + 1e-9


def region_links(sets: list[np.ndarray], percent: int = PERCENT, leaf: int = LEAF, pivots: int = CELL_PIVOTS, cells: list | None = None) -> list[tuple[int, int]]:
    """Links that join each class of a region, by pivots and Voronoi cells; ``cells`` collects the cells (arrays of places), for tests."""
    epsilon, classes, links = 1 - percent / 100, Classes(len(sets)), []

    def link(i, others):
        for j in others:
            if classes.join(int(i), int(j)):
                links.append((int(i), int(j)))

    todo = [np.arange(len(sets))]
    while todo:
        cell = todo.pop()
        if len(np.unique(classes.all()[cell])) < 2:
            continue
        if cells is not None:
            cells.append(cell)
        if len(cell) == 2:
            a, b = (sets[i] for i in cell)
            if len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b), percent):
                link(*cell[:1], cell[1:])
            continue
        held, near, at = Region([sets[i] for i in cell]), [], 0
        for _ in range(min(pivots, len(cell))):  # each pivot is the point farthest from those before
            over = held.overlaps(at)
            link(cell[at], cell[over >= needed(held.sizes[at], held.sizes, percent)])
            near.append(1 - over / (held.sizes[at] + held.sizes - over))
            at = int(np.argmax(np.min(near, axis=0)))
        distance = np.array(near)
        home, nearest = distance.argmin(0), distance.min(0)
        reach = reach_of(nearest, epsilon, RADIUS)
        parts = [cell[((home == p) & (nearest <= RADIUS)) | (d <= reach)] for p, d in enumerate(distance)] + [cell[nearest > RADIUS]]
        if len(cell) > leaf and max(map(len, parts)) < 0.8 * len(cell):
            todo += [x for x in parts if len(x) > 1]
        elif len(cell) <= leaf:
            for i in range(len(cell)):
                of = classes.all()[cell]
                window = (np.abs(distance - distance[:, i : i + 1]) <= epsilon + 1e-9).all(0) & (of != of[i])
                window[: i + 1] = False
                for j in np.flatnonzero(window):
                    if len(np.intersect1d(sets[cell[i]], sets[cell[j]], assume_unique=True)) >= needed(held.sizes[i], held.sizes[j], percent):
                        link(cell[i], cell[j : j + 1])
        else:  # its points are about as far from each other as from the pivots: all outside the largest class become pivots
            asked = np.zeros(len(cell), bool)
            while True:
                of = classes.all()[cell]
                outside = np.flatnonzero((of != np.argmax(np.bincount(of))) & ~asked)
                if not len(outside):
                    break
                asked[outside[0]] = True
                link(cell[outside[0]], cell[held.overlaps(outside[0]) >= needed(held.sizes[outside[0]], held.sizes, percent)])
    return links


def bounded_links(links: list[tuple[int, int]], n: int, branches: int = 16) -> list[tuple[int, int]]:
    """Links of the same classes in which no point has more than branches + 1."""
    classes = Classes(n)
    for i, j in links:
        classes.join(i, j)
    members: dict[int, list[int]] = {}
    for i in sorted({x for both in links for x in both}):
        members.setdefault(classes.find(i), []).append(i)
    return [(m[(k - 1) // branches], m[k]) for m in members.values() for k in range(1, len(m))]


def smallest_reachable(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """id and the smallest id that links (a, b) reach from it, by hashing to smaller neighbours until nothing changes.

    Each round, every vertex's label is passed to its neighbours and labels are followed once more,
    so the number of rounds grows with the logarithm of a chain's length. Only counts reach the driver.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        passed = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(passed, labels["id"] == passed["a"], "left").select("id", "label", F.least("label", F.coalesce("low", "label")).alias("low"))
        # labels are ids too: take the label's label
        up = low.select(F.col("id").alias("up"), F.col("low").alias("up_low"))
        moved = saved(low.join(up, low["low"] == up["up"], "left").select("id", F.col("label").alias("old"), F.least("low", F.coalesce("up_low", "low")).alias("label")), "labels")
        labels = moved.select("id", "label")
        if not moved.where("old <> label").limit(1).count():
            return vertices.join(labels, vertices["rep"] == labels["id"], "left").select("rep", F.coalesce("label", "rep").alias("component"))


def _own_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """rep and shingle set (binary), once each, from rows (rep, text); rows whose text is not of that rep are left out."""

    def run(batches):
        memo = WordHashes()
        for pdf in batches:
            sets = [shingle_set(memo.of(words_of(t)), shingle) for t in pdf["text"]]
            own = [_digest(s).hex().upper() == rep for s, rep in zip(sets, pdf["rep"], strict=True)]
            yield pd.DataFrame({"rep": pdf["rep"], "set": [s.tobytes() for s in sets]})[own]

    return texts.mapInPandas(trimmed(run), "rep string, set binary").groupBy("rep").agg(F.first("set").alias("set"))


def _join_regions(sets: DataFrame, percent: int) -> DataFrame:
    """Links of regions that one task can hold: region, rep, set -> a, b."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(reps, own):
        links = region_links([np.frombuffer(x, np.uint64) for x in own], percent)
        return [(reps[i], reps[j]) for i, j in bounded_links(links, len(own))]

    def run(batches):
        now, reps, own, out = None, [], [], []
        for pdf in batches:
            for region, rep, raw in zip(pdf["region"], pdf["rep"], pdf["set"], strict=True):
                if region != now:
                    out += joined(reps, own)
                    now, reps, own = region, [], []
                reps.append(rep)
                own.append(raw)
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
        yield pd.DataFrame(joined(reps, own), columns=["a", "b"])

    return sets.select("region", "rep", "set").repartition(parts, "region").sortWithinPartitions("region", "rep").mapInPandas(run, "a string, b string")


def _divide(space: DataFrame, percent: int, region: int, pivots: int, radius: float = RADIUS) -> DataFrame:
    """Links of points in regions (region, rep, set), by rounds of pivots and Voronoi cells.

    Regions of up to ``region`` shingles are joined by a task each. Otherwise a round draws pivots in each region that is too large, links them
    with the points within epsilon, and deals the points out to the regions of their nearest pivot with
    the border the triangle inequality asks for. A region that does not get smaller that way keeps only
    points outside its largest class as pivots, so it ends after as many rounds as those need.
    """
    spark, epsilon = space.sparkSession, 1 - percent / 100
    slim = ["region", "rep", "n", "asked"]
    current, classes, links = space.select("region", "rep", "set", (F.octet_length("set") / 8).cast("long").alias("n"), F.lit(False).alias("asked")), None, []
    while True:
        # decisions are made on rows without their sets; sets stay where they are until a region goes to its task
        rows = current.select(*slim)
        rows = rows.withColumn("class", F.col("rep")) if classes is None else rows.join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
        rows = saved(rows, "rows")
        sizes = rows.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), (F.min("class") != F.max("class")).alias("open"))
        large = saved(sizes.where(F.col("open") & (F.col("shingles") > region) & (F.col("size") > 1)).select("region", "size"), "large")
        links.append(saved(_join_regions(_of(current, sizes.where(F.col("shingles") > region).select("region"), "left_anti"), percent), "region-links"))
        if not large.limit(1).count():
            break
        work = _of(current, large.select("region"), "left_semi")
        rows = _of(rows, large.select("region"), "left_semi")
        # the commonest class of a region needs no pivots once there is any other; pivots come from the smaller classes first
        by_class = rows.groupBy("region", "class").agg(F.count("*").alias("of"))
        biggest = by_class.groupBy("region").agg(F.max(F.struct("of", "class")).alias("top"))
        pool = _of(rows.where("not asked"), biggest, "inner").where((F.col("class") != F.col("top.class")) | (F.col("top.of") == 1))
        drawn = saved(_first(pool, pivots, region), "pivots")
        chosen = work.join(F.broadcast(drawn.select("region", "rep")) if drawn.count() <= BROADCAST else drawn.select("region", "rep"), ["region", "rep"])
        out = []
        # a bounded size of pivots at a time goes to the tasks
        slices = max(1, -(-(drawn.agg(F.sum("n")).first()[0] or 0) // PIVOT_SHINGLES))
        for i in range(slices):
            mine = F.pmod(F.xxhash64("region"), F.lit(slices)) == i
            held = spark.sparkContext.broadcast([(r["region"], r["rep"], bytes(r["set"])) for r in chosen.where(mine).select("region", "rep", "set").collect()])
            out.append(work.where(mine).select("region", "rep", "set", "asked").mapInPandas(_deal(held, percent, epsilon, radius), "region string, sub string, rep string, set binary, asked boolean, links array<string>"))
        dealt = out[0]
        for x in out[1:]:
            dealt = dealt.unionByName(x)
        dealt = saved(dealt.withColumn("n", (F.octet_length("set") / 8).cast("long")), "dealt")
        links.append(saved(dealt.where("links is not null").select(F.col("rep").alias("a"), F.explode("links").alias("b")), "pivot-links"))
        all_links = links[0]
        for x in links[1:]:
            all_links = all_links.unionByName(x)
        classes = smallest_reachable(dealt.select("rep").distinct(), all_links.where("a <> b")).withColumnsRenamed({"component": "class"})
        parts = dealt.where("sub is not null").groupBy("region", "sub").agg(F.sum("n").alias("part"))
        whole = dealt.where("links is not null").groupBy("region").agg(F.sum("n").alias("whole"))
        divided = saved(parts.join(whole, "region").groupBy("region").agg(F.bool_and(F.col("part") < 0.8 * F.col("whole")).alias("divided")), "divided")
        # regions whose parts are hardly smaller stay whole: their next pivots come from what is still outside
        cells = _of(dealt.where("sub is not null"), divided.where("divided").select("region"), "left_semi")
        cells = cells.select(F.hex(F.xxhash64("region", "sub")).alias("region"), "rep", "set", "n", F.lit(False).alias("asked"))
        same = _of(dealt.where("links is not null"), divided.where("not divided").select("region"), "left_semi").select("region", "rep", "set", "n", "asked")
        current = saved(cells.unionByName(same), "regions")
        # a region is done when all points outside its largest class have been asked
        rows = current.select(*slim).join(classes, "rep")
        left = rows.where("not asked").select("region", "class").distinct()
        top = rows.groupBy("region", "class").agg(F.count("*").alias("of")).groupBy("region").agg(F.max(F.struct("of", "class")).alias("top"))
        unfinished = saved(left.join(top, "region").where(F.col("class") != F.col("top.class")).select("region").distinct(), "unfinished")
        current = _of(current, unfinished, "left_semi")
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _of(df: DataFrame, regions: DataFrame, how: str) -> DataFrame:
    """Rows of some regions; their names are sent to every task where there are few enough of them, else rows are shuffled."""
    regions = saved(regions, "names")
    return df.join(F.broadcast(regions) if regions.count() <= BROADCAST else regions, "region", how)


def _first(pool: DataFrame, n: int, shingles: int) -> DataFrame:
    """Up to n rows a region (two at least if it has them), of ``shingles`` shingles in all, by a hash of rep: a rank limit that is applied before the shuffle."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("region").orderBy(F.xxhash64("rep"), "rep")
    rows = pool.select("region", "rep", "n", F.row_number().over(w).alias("r")).where(F.col("r") <= n)
    return rows.withColumn("so_far", F.sum("n").over(w)).where((F.col("so_far") <= shingles) | (F.col("r") <= 2)).select("region", "rep", "n")


def _deal(held, percent, epsilon, radius):
    def run(batches):
        by: dict[str, list] = {}
        for region, rep, s in held.value:
            by.setdefault(region, []).append((rep, np.frombuffer(s, np.uint64)))
        index = {}
        for region, own in by.items():
            values = np.concatenate([s for _, s in own])
            owner = np.repeat(np.arange(len(own)), [len(s) for _, s in own])
            order = np.argsort(values, kind="stable")
            index[region] = ([r for r, _ in own], np.array([len(s) for _, s in own]), values[order], owner[order])
        for pdf in batches:
            rows, met = [], {}
            for region, rep, raw, asked in zip(pdf["region"], pdf["rep"], pdf["set"], pdf["asked"], strict=True):
                if region not in index:
                    rows.append((region, None, rep, raw, asked, []))
                    continue
                names, sizes, values, owner = index[region]
                s = np.frombuffer(raw, np.uint64)
                a, b = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                over = np.bincount(owner[_runs(a, b)], minlength=len(names))
                distance = 1 - over / np.maximum(sizes + len(s) - over, 1)
                near = []
                for i in np.flatnonzero(over >= needed(sizes, len(s), percent)):
                    if names[i] != rep:  # points near one pivot hang together as a tree, so that none has very many links
                        own = met.setdefault((region, i), [names[i]])
                        near.append(own[(len(own) - 1) // 16])
                        own.append(rep)
                home = int(np.argmin(distance))
                mine = distance[home] <= radius
                rows.append((region, names[home] if mine else "rest", rep, raw, bool(asked) or rep in names, near))
                # the border: nearer than 2 epsilon more than its own pivot, and within the reach of a home of that pivot
                border = distance <= reach_of(distance[home], epsilon, radius)
                rows += [(region, names[i], rep, raw, False, None) for i in np.flatnonzero(border) if not (mine and i == home)]
            yield pd.DataFrame(rows, columns=["region", "sub", "rep", "set", "asked", "links"])

    return run


def point_reps(held: DataFrame, kind: str) -> DataFrame:
    """Points of equal sets as one, named by its digest: rep, mark, n, p, dense, low (the smallest id) and one (an id as text)."""
    slim = held.where("n > 0").select(F.hex("digest").alias("rep"), "mark", "n", "p", "dense", "id")
    return saved(slim.groupBy("rep").agg(*[F.min(c).alias(c) for c in ("mark", "n", "p", "dense")], F.min(F.col("id").cast(kind)).alias("low"), F.min("id").alias("one")), "reps")


def dense_regions(held: DataFrame) -> DataFrame:
    """Points with common shingles among their first ones, by what such shingles connect: region, rep. Points that share none are alone and left out.

    A shingle's points are joined to the least of them, so that a shingle gives as many links as it has points.
    """
    own = saved(held.where("dense").select(F.hex("digest").alias("rep"), F.explode("often").alias("h")).distinct(), "dense")
    least = own.groupBy("h").agg(F.min("rep").alias("a"))
    links = saved(own.join(least, "h").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "dense-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    return smallest_reachable(ends, links).select(F.concat(F.lit("dense"), "component").alias("region"), "rep")


def first_regions(rows: DataFrame, held: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The regions to begin with: region, rep, set; a point may stand in two."""
    candidates = saved(pairs_of_rare(held, reps, percent), "candidates")
    ends = candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    connected = smallest_reachable(ends, candidates).select(F.col("component").alias("region"), "rep")
    regions = saved(connected.unionByName(dense_regions(held)), "first-regions")
    one = saved(reps.join(regions.select("rep").distinct(), "rep", "left_semi").select("rep", "one"), "wanted")
    if one.count() <= BROADCAST:
        one = F.broadcast(one)  # else their texts are found by a shuffle
    texts = rows.withColumn("key", F.col("id").cast("string"))
    texts = texts.join(one, texts["key"].eqNullSafe(one["one"])).select("rep", "text")
    return saved(_own_sets(texts, shingle).join(regions, "rep").select("region", "rep", "set"), "sets")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", small: int = SMALL, region: int = REGION, pivots: int = PIVOTS) -> DataFrame:
    """Each row's id with n_shingles and component_id, the smallest id that links reach from it."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), "text")
    common = common_shingles(rows, shingle, small)
    held = saved(points(rows, common, shingle, percent), "points")
    reps = point_reps(held, kind)
    space = first_regions(rows, held, reps, shingle, percent)
    links = saved(_divide(space, percent, region, pivots).distinct(), "links")
    classes = smallest_reachable(reps.select("rep"), links)
    members = reps.select("rep", "low").join(classes, "rep")
    lows = members.join(members.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("rep", "component_id")
    out = held.withColumn("rep", F.hex("digest")).join(lows, "rep", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id").cast(kind)).alias("component_id"))


def op3_jaccard(spark, sf_dir):
    from keepsake.llm.common import documents

    return near_duplicates(documents(spark, sf_dir))
