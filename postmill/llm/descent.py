"""Embedding near-dedup by NN-descent.

Equal vectors of a label are one point. Every point keeps a list of its nearest others found so far; in a round, the points that
have one neighbour in common meet and improve each other's lists, until hardly any list changes. The first lists come from sorted
orders of random hyperplane codes. Lists are compared on vectors rounded to bytes, with an error bound for each; what may reach the
threshold is checked exactly, and linked points make up components.

A list full of links is saturated: more links may lie beyond it. It is then enlarged: its component leaves the list, as all pairs
inside are settled later anyway, and the room goes to points outside, which are sought in a new phase. An audit holds a fixed
number of points against all rows; links it misses are added, and too many of them start another phase.

At last all links inside a component are counted, tile against tile: centre and radius of two tiles tell by the triangle
inequality of angles whether all, none or some of their pairs are linked, and only the last are compared one by one. Counts leave
a task, never pairs, so a large group of near copies costs a few rows per tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import numbered
from postmill.llm.components import components
from postmill.session import durable

THRESHOLD = 0.93
# Entries of a list; points of a first group; points that meet at a time at a neighbour many have in common.
LIST = 12
BLOCK = 32
MEET = 64
# Sorted orders per phase, bits of their codes.
ORDERS = 6
BITS = 63
# A phase ends when less than this share of all entries is new, or after so many rounds.
CALM = 0.03
ROUNDS = 12
PHASES = 8
# Points audited, and the share of their links that has to be found.
AUDITED = 512
RECALL = 0.999
TILE = 512
# Rounding errors of byte scores (single precision) and of angles.
SLACK = 1e-5
# Keys over which the rows of one vector, or the points of one component, are spread when they look up their result.
SALTS = 8


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of doubles as a matrix of unit vectors; shorter lists are filled up with zeros."""
    out = np.zeros((len(column), size))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    for row, (at, end) in enumerate(zip(ends, ends[1:])):
        out[row, :end - at] = flat[at:end]
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _rounded(size: int):
    """Points with their vector rounded to bytes, the inverse of its length, and how far it lies from the unit vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column("vec"), size)
            bytes_ = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
            length = np.sqrt((bytes_.astype(float) ** 2).sum(axis=1))
            error = np.sqrt(((unit - bytes_ / length[:, None]) ** 2).sum(axis=1))
            kept = [batch.column(c) for c in ("p", "label", "copies", "least")]
            more = [_binary(unit), _binary(bytes_), pa.array(1 / length), pa.array(error)]
            yield pa.RecordBatch.from_arrays(kept + more, ["p", "label", "copies", "least", "unit", "bytes", "inverse", "error"])

    return work


def _codes(size: int, seed: int, n: int):
    """Per point and order, the sides of random hyperplanes it lies on, as one number."""
    planes = np.random.default_rng(seed).standard_normal((size, n * BITS)).astype(np.float32)
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.int8).reshape(-1, size)
            codes = ((rows.astype(np.float32) @ planes > 0).reshape(len(rows), n, BITS) @ powers).ravel()
            each = np.repeat(np.arange(len(rows)), n)
            yield pa.RecordBatch.from_arrays([
                batch.column("p").take(pa.array(each)), batch.column("label").take(pa.array(each)),
                pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))), pa.array(codes),
            ], ["p", "label", "turn", "code"])

    return work


def _meet(size: int, most: int):
    """For each group of points: who improves whose list, ``(u, v, score)``. Points of one component, and old friends, are let be."""
    kind = np.float32 if size * 127 * 127 < 1 << 24 else float  # products of bytes are summed exactly, so a pair scores the same anywhere

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            p, component, fresh, floor, inverse = (
                flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "component", "fresh", "floor", "inverse")
            )
            rows = np.frombuffer(b"".join(flat.field("bytes").to_pylist()), np.int8).reshape(-1, size).astype(kind)
            out: list[tuple] = []
            for at, end in zip(ends, ends[1:]):
                x = slice(at, end)
                score = (rows[x] @ rows[x].T) * (inverse[x, None] * inverse[None, x])
                better = (score > floor[x, None]) & (component[x, None] != component[None, x]) & (fresh[x, None] | fresh[None, x])
                score = np.where(better, score, -2)
                if end - at > most:
                    score = np.where(score >= np.partition(score, -most, axis=1)[:, [-most]], score, -2)
                i, j = np.nonzero(score > -2)
                out.append((p[x][i], p[x][j], score[i, j]))
            u, v, s = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "score"])

    return work


MEMBER = ("p", "component", "fresh", "floor", "inverse", "bytes")


class Descent:
    """The lists ``(u, v, score, fresh)`` of ``points`` and what has been found by them."""

    def __init__(self, points: DataFrame, size: int, threshold: float, length: int = LIST):
        self.points, self.size, self.threshold, self.length = points, size, threshold, length
        self.n = points.count()
        self.error = points.agg(F.max("error")).first()[0] or 0.0
        spark = points.sparkSession
        self.lists = spark.createDataFrame([], "u bigint, v bigint, score double, fresh boolean")
        self.links = spark.createDataFrame([], "u bigint, v bigint")
        self.named = spark.createDataFrame([], "node bigint, component bigint")
        self.n_links = 0
        self._join_components()

    def _join_components(self) -> None:
        named = self.named.select(F.col("node").alias("p"), "component")
        self.base = durable(self.points.select("p", "label", "inverse", "bytes").join(named, "p", "left").withColumn("component", F.coalesce("component", "p")))

    def _state(self) -> DataFrame:
        """What a point brings to a meeting: its component, and the score others have to beat."""
        floors = self.lists.groupBy(F.col("u").alias("p")).agg(
            F.when(F.count(F.lit(1)) >= self.length, F.min("score")).otherwise(F.lit(-2.0)).alias("floor")
        )
        return self.base.join(floors, "p", "left").select("p", "component", F.coalesce("floor", F.lit(-2.0)).alias("floor"), "inverse", "bytes")

    def _improve(self, groups: DataFrame) -> int:
        """Let the points of each group (a column of members) meet, and keep the best of old and new entries."""
        found = groups.mapInArrow(_meet(self.size, self.length), "u bigint, v bigint, score double").withColumn("fresh", F.lit(True))
        old = self.lists.withColumn("fresh", F.lit(False))
        best = Window.partitionBy("u").orderBy(F.desc("score"), "v")
        ranked = old.unionByName(found).withColumn("_nth", F.dense_rank().over(best)).filter(F.col("_nth") <= self.length)
        self.lists = durable(ranked.groupBy("u", "v").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh")))
        return self.lists.filter("fresh").count()

    def seed(self, phase: int) -> None:
        """Neighbours in sorted orders meet; after the first phase, so do points thrown together at random."""
        codes = self.base.select("p", "label", "bytes").mapInArrow(
            _codes(self.size, 100 + phase, ORDERS), "p bigint, label string, turn int, code bigint"
        )
        if phase:
            codes = codes.unionByName(
                self.base.select("p", "label", F.lit(ORDERS).alias("turn"), F.xxhash64(F.lit(phase), "p").alias("code"))
            )
        placed = numbered(codes, [F.col("turn"), F.col("label"), F.col("code"), F.col("p")])
        member = placed.select("p", "turn", "label", F.floor(F.col("_n") / BLOCK).alias("_block"))
        groups = member.join(self._state(), "p").withColumn("fresh", F.lit(True))
        self._improve(groups.groupBy("turn", "label", "_block").agg(F.collect_list(F.struct(*MEMBER)).alias("members")).select("members"))

    def round(self) -> int:
        """Points that have a neighbour in common, or are in each other's lists, meet. A neighbour of many is met in turns."""
        edge = self.lists.select(F.col("u").alias("at"), F.col("v").alias("p"), "fresh")
        back = self.lists.select(F.col("v").alias("at"), F.col("u").alias("p"), "fresh")
        edges = edge.unionByName(back).groupBy("at", "p").agg(F.max("fresh").alias("fresh"))
        busy = edges.groupBy("at").agg(F.count(F.lit(1)).alias("_n"), F.max("fresh").alias("_any")).filter("_any")
        turns = F.ceil(F.col("_n") / MEET)
        guests = edges.join(busy, "at").select("at", "p", "fresh", F.pmod(F.xxhash64("p", "at"), turns).alias("_turn"))
        # The neighbour itself takes part in all turns.
        hosts = busy.select("at", F.col("at").alias("p"), F.lit(False).alias("fresh"), F.explode(F.sequence(F.lit(0).cast("bigint"), turns - 1)).alias("_turn"))
        members = guests.unionByName(hosts).join(self._state(), "p")
        return self._improve(members.groupBy("at", "_turn").agg(F.collect_list(F.struct(*MEMBER)).alias("members")).select("members"))

    def settle(self) -> None:
        """Check entries that may be links exactly, and name the components of all links so far by their smallest point."""
        near = self.lists.filter(F.col("score") >= self.threshold - 2 * self.error - SLACK).select(
            F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        ).distinct()
        units = self.points.select("p", "unit")
        both = near.join(units.select(F.col("p").alias("u"), F.col("unit").alias("x")), "u").join(
            units.select(F.col("p").alias("v"), F.col("unit").alias("y")), "v"
        )
        self.add(both.mapInArrow(_exact(self.threshold), "u bigint, v bigint"))

    def add(self, links: DataFrame) -> None:
        more = durable(self.links.unionByName(links.select("u", "v")).distinct())
        n = more.count()
        if n > self.n_links:
            self.links, self.n_links = more, n
            self.named = durable(components(self.links))
            self._join_components()

    def enlarge(self) -> int:
        """Make room in the lists: what lies in the list's own component leaves it. How many lists were full of links?"""
        full = self.lists.filter(F.col("score") >= self.threshold - 2 * self.error - SLACK).groupBy("u").count()
        saturated = full.filter(F.col("count") >= self.length).count()
        if saturated:
            mine = self.named.select(F.col("node").alias("u"), F.col("component").alias("_a"))
            other = self.named.select(F.col("node").alias("v"), F.col("component").alias("_b"))
            outside = self.lists.join(mine, "u", "left").join(other, "v", "left").filter("not coalesce(_a = _b, false)")
            self.lists = durable(outside.select("u", "v", "score", "fresh"))
        return saturated

    def audit(self, phase: int) -> float:
        """Hold some points against all; add the links that were missed. What share of their links was there?"""
        some = self.points.select("p", "label", "unit").join(self.base.select("p", "component"), "p")
        order = F.xxhash64(F.lit("audit"), F.lit(phase), "p")
        held = [(r.p, r.label, r.component, r.unit) for r in some.orderBy(order, "p").limit(AUDITED).collect()]
        seen = durable(some.mapInArrow(_audit(self.threshold, held), "u bigint, v bigint, hit bigint"))
        total, hit = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("hit"), F.lit(0))).first()
        if hit < total:
            self.add(seen.filter("hit = 0"))
        return hit / total if total else 1.0

    def run(self) -> None:
        for phase in range(PHASES):
            before = self.n_links
            self.seed(phase)
            for _ in range(ROUNDS):
                if self.round() <= CALM * self.n * self.length:
                    break
            self.settle()
            recall = self.audit(phase)
            saturated = self.enlarge()
            if recall >= RECALL and (not saturated or (phase and self.n_links == before)):
                break


def _exact(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), float).reshape(batch.num_rows, -1) for c in ("x", "y"))
            linked = pa.array((x * y).sum(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(linked), batch.column("v").filter(linked)], ["u", "v"])

    return work


def _audit(threshold: float, held: list[tuple]):
    ids, labels = np.array([h[0] for h in held]), np.array([h[1] for h in held], object)
    names = np.array([h[2] for h in held])
    units = np.frombuffer(b"".join(h[3] for h in held), float).reshape(len(held), -1) if held else np.zeros((0, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, component = batch.column("p").to_numpy(), batch.column("component").to_numpy()
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), float).reshape(batch.num_rows, -1)
            i, j = np.nonzero(units @ x.T >= threshold)
            i, j = (k[(labels[i] == label[j]) & (ids[i] != p[j])] for k in (i, j))
            hit = (names[i] == component[j]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(p[j], pa.int64()), pa.array(hit)], ["u", "v", "hit"])

    return work


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _tiles(threshold: float):
    """A tile's points in one row, with its centre and radius, and the links of each point inside the tile."""
    limit = math.acos(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for members in batch.column("members"):
                flat = members.values
                unit = np.frombuffer(b"".join(flat.field("unit").to_pylist()), float).reshape(len(flat), -1)
                copies = flat.field("copies").to_numpy()
                middle = unit.mean(axis=0)
                length = math.sqrt(middle @ middle)
                middle = middle / length if length > SLACK else unit[0]
                radius = float(_angles(unit @ middle).max())
                if 2 * radius <= limit - SLACK:
                    own = copies.sum() - copies
                else:
                    own = (unit @ unit.T >= threshold) @ copies
                    own = own - np.where((unit * unit).sum(axis=1) >= threshold, copies, 0)
                row = flat.field("p").to_numpy().tobytes(), copies.tobytes(), unit.tobytes(), middle.tolist(), radius, int(copies.sum()), own.tobytes()
                for column, value in zip(columns, row):
                    column.append(value)
            types = [pa.binary()] * 3 + [pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.binary()]
            arrays = [batch.column("component"), batch.column("tile"), *[pa.array(c, t) for c, t in zip(columns, types)]]
            yield pa.RecordBatch.from_arrays(arrays, ["component", "tile", "ids", "copies", "units", "middle", "radius", "mass", "own"])

    return work


TILES = "component bigint, tile bigint, ids binary, copies binary, units binary, middle array<double>, radius double, mass bigint, own binary"


def _across(threshold: float):
    """Links of the points of one tile to those of another, both ways."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p, q, m, n = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in ("x_ids", "y_ids", "x_copies", "y_copies"))
                x, y = (np.frombuffer(batch.column(c)[row].as_py(), float) for c in ("x_units", "y_units"))
                linked = x.reshape(len(p), -1) @ y.reshape(len(q), -1).T >= threshold
                counts = np.concatenate([linked @ n, linked.T @ m])
                some = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p, q])[some]), pa.array(counts[some])], ["p", "n"])

    return work


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tile's row as one row per point."""
    for batch in batches:
        ids, own = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("ids", "own"))
        sizes = [len(i) // 8 for i in batch.column("ids").to_pylist()]
        outer = np.repeat(batch.column("more").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own + outer)], ["p", "n"])


def link_counts(points: DataFrame, named: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``(p, n)``: how many vectors other than its copies each point of the components ``named`` is linked with."""
    held = points.join(named.withColumnRenamed("node", "p"), "p").select("p", "component", "copies", "unit", "bytes")
    # Points of a component lie in the order of the first bytes of their vectors, so near ones share tiles.
    placed = numbered(held.withColumn("_near", F.hex(F.substring("bytes", 1, 8))).drop("bytes"), [F.col("component"), F.col("_near"), F.col("p")])
    grouped = placed.groupBy("component", F.floor(F.col("_n") / tile).alias("tile")).agg(F.collect_list(F.struct("p", "copies", "unit")).alias("members"))
    tiles = durable(grouped.mapInArrow(_tiles(threshold), TILES))

    def side(name: str) -> DataFrame:
        brief = tiles.select("component", "tile", "middle", "radius", "mass")
        return brief.select("component", *[F.col(c).alias(f"{name}_{c}") for c in brief.columns[1:]])

    limit = math.acos(threshold)
    cosine: Column = F.aggregate(F.zip_with("x_middle", "y_middle", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    reach = F.col("x_radius") + F.col("y_radius")
    pairs = durable(
        side("x").join(side("y"), "component").filter("x_tile < y_tile").withColumn("_angle", angle)
        .filter(F.col("_angle") - reach <= limit + SLACK)
        .select("component", "x_tile", "y_tile", "x_mass", "y_mass", (F.col("_angle") + reach <= limit - SLACK).alias("sure"))
    )
    whole = pairs.filter("sure")
    outer = whole.select("component", F.col("x_tile").alias("tile"), F.col("y_mass").alias("more")).unionByName(
        whole.select("component", F.col("y_tile").alias("tile"), F.col("x_mass").alias("more"))
    ).groupBy("component", "tile").agg(F.sum("more").alias("more"))
    settled = tiles.join(outer, ["component", "tile"], "left").select("ids", "own", F.coalesce("more", F.lit(0).cast("bigint")).alias("more"))

    def packed(name: str) -> DataFrame:
        return tiles.select("component", *[F.col(c).alias(f"{name}_{c}") for c in ("tile", "ids", "copies", "units")])

    opened = pairs.filter("not sure").select("component", "x_tile", "y_tile")
    met = opened.join(packed("x"), ["component", "x_tile"]).join(packed("y"), ["component", "y_tile"])
    counts = settled.mapInArrow(_spread, "p bigint, n bigint").unionByName(met.mapInArrow(_across(threshold), "p bigint, n bigint"))
    return counts.groupBy("p").agg(F.sum("n").alias("n"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """For each of ``rows`` ``(vec_id, vec, label)``: vec_id, n_links, component_id, kept.

    Links join vectors of one label whose cosine is at least ``threshold``. Null, empty and zero vectors, those with null or
    non-finite components, and those without a label or an id link with nothing: they are a component of their own and kept.
    Vectors of unequal length count as if filled up with zeros. Repeated rows, and rows that share an id, each count as a vector; a
    component is named by its smallest id, and all rows with that id are kept. An empty table gives no rows.
    """
    vec = F.col("vec").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    label = F.col("label").cast("string")
    # Adding zero makes a negative zero positive.
    clean = F.when(F.coalesce(fine, F.lit(False)) & label.isNotNull() & F.col("vec_id").isNotNull(), F.transform(vec, lambda x: x + F.lit(0.0)))
    all_rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), clean.alias("vec"))
    groups = all_rows.filter("vec is not null").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    # Within a label, points are numbered by their smallest id, so a component's smallest point has its smallest id.
    numbers = durable(numbered(groups, [F.col("label"), F.col("least"), F.col("vec")]).withColumnRenamed("_n", "p").drop("_part"))
    size = numbers.agg(F.max(F.size("vec"))).first()[0] or 1
    points = durable(numbers.select("p", "label", "copies", "least", "vec").mapInArrow(
        _rounded(size), "p bigint, label string, copies bigint, least bigint, unit binary, bytes binary, inverse double, error double"
    ))
    descent = Descent(points, size, threshold, **settings)
    descent.run()
    counts = link_counts(points, descent.named, threshold)
    names = points.select(F.col("p").alias("component"), F.col("least").alias("component_id")).join(
        descent.named.select("component").distinct(), "component"
    )
    spread = descent.named.withColumn("_salt", F.pmod(F.col("node"), F.lit(SALTS))).join(_salted(names), ["component", "_salt"])
    linked = spread.select(F.col("node").alias("p"), "component_id").join(counts, "p", "left")
    mark = [F.xxhash64("label", "vec").alias("_m1"), F.xxhash64(F.lit("vec"), "label", "vec").alias("_m2")]
    results = numbers.select("p", "copies", "least", *mark).join(linked, "p", "left").select(
        "_m1", "_m2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    sought = all_rows.select(
        "vec_id", *[F.when(F.col("vec").isNotNull(), m).alias(c) for m, c in zip(mark, ("_m1", "_m2"))],
        F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("_salt"),
    )
    component = F.coalesce("component_id", "vec_id")
    return sought.join(_salted(results), ["_m1", "_m2", "_salt"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def dedup_embeddings(embeddings: DataFrame, **settings) -> DataFrame:
    """``near_vectors`` of a table with the columns vec_id, embedding and label; others are ignored."""
    return near_vectors(embeddings.select("vec_id", F.col("embedding").alias("vec"), "label"), **settings)
