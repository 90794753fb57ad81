"""Points in boundaries read as data: a grid index with one level per ring size.

Each ring is cut into cells of its own level, cells whose side is about the
ring's larger extent over ``PARTS``: a ring of any size has few cells.  A cell
that no edge meets lies wholly inside or outside; only points in border cells are
tested against edges.  A point is looked up once per level that occurs
(levels are powers of two: their number grows with the logarithm of the extents).

A cell with many points is halved both ways until its leaves hold about ``LEAF``
points each, and the rings in it are followed down: a leaf keeps the edges that
can decide a point in it, and rings that hold a whole cell are counted once for
the cell, with their smallest label.  Points and edges of a leaf are joined in
blocks of bounded size by (level, leaf, block of points): a hot leaf becomes more
blocks.  The leaves are large, since what is stored and sent of a ring grows with
the leaves along its border; in memory a block's points are halved on to boxes of
``FEW`` and the rings followed down to them, so a point meets the borders near it,
not every ring over it.

Rings are arrays of points; a last point equal to the first closes the ring and
is not counted.  Invalid rings (null or missing points, fewer than three different
ones, no area) go to the quarantine output with their reason and match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 4
LEAF = 1 << 15  # points that a leaf should hold
BLOCK = 1 << 15  # points, and edges, in one block
FEW = 32  # points in a box that are tested one by one
PAIRS = 1 << 17  # edges by points tested at once, and borders followed at once
SMALL = 1 << 16  # rows of a table of cells that every task may hold
CELL = ["level", "cx", "cy"]
LEAF_KEY = ["level", "depth", "lx", "ly"]


def parse_ring(text: Column) -> Column:
    """The points of ``POLYGON((x y, x y, …))`` as ``array<struct<x, y>>``; null if it is no such text."""
    inner = F.regexp_extract(text, r"^\s*POLYGON\s*\(\(([^()]*)\)\)\s*$", 1)
    pairs = F.transform(F.split(inner, ","), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(pairs, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("x"), F.get(p, 1).try_cast("double").alias("y")))
    return F.when(inner != "", points)


def open_ring(ring: Column) -> Column:
    """The ring without a closing point."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def twice_area(ring: Column) -> Column:
    edges = F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.element_at(ring, (i + 1) % F.size(ring) + 1).alias("b")))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))


def ring_fault(ring: Column) -> Column:
    """Why a ring is invalid, or null."""
    missing = F.exists(ring, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    return (F.when(ring.isNull() | (F.size(ring) == 0), "empty").when(missing, "missing_coordinate")
            .when(F.size(F.array_distinct(ring)) < 3, "too_few_points").when(twice_area(ring) == 0, "no_area"))


def checked(boundaries: DataFrame, label: str, ring: str) -> DataFrame:
    """``(label, ring, fault)`` with rings opened."""
    return boundaries.select(F.col(label).alias("label"), open_ring(F.col(ring)).alias("ring")).withColumn("fault", ring_fault(F.col("ring")))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting towards +x: an odd number of edges crossed."""
    def crossed(n, i):
        a, b = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % F.size(ring) + 1)
        meets = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return n + F.when(meets, 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0), crossed) % 2 == 1


def boxes(rings: DataFrame) -> DataFrame:
    """Rings with their extents, the ``level`` and ``side`` of their cells and the cells' range."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = rings.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = box.withColumn("level", F.ceil(F.log2(extent / PARTS)).cast("int")).withColumn("side", F.pow(F.lit(2.0), F.col("level")))
    return box.withColumns({c: F.floor(F.col(v) / F.col("side")) for c, v in (("cx0", "x0"), ("cx1", "x1"), ("cy0", "y0"), ("cy1", "y1"))})


def spread(box: DataFrame) -> DataFrame:
    """A row per cell that the extents of a ring meet."""
    return box.withColumn("cx", F.explode(F.sequence("cx0", "cx1"))).withColumn("cy", F.explode(F.sequence("cy0", "cy1")))


def cells(rings: DataFrame) -> DataFrame:
    """``(label, level, cx, cy, border, edges)``: the cells of valid rings that hold a part of them.

    A cell is border if an edge's bounding box meets the cell; for the others one
    inner point decides.  Border cells carry the ring, inner cells do not.
    """
    box = spread(boxes(rings))
    lo_x, lo_y = F.col("cx") * F.col("side"), F.col("cy") * F.col("side")
    hi_x, hi_y = lo_x + F.col("side"), lo_y + F.col("side")

    def meets(i):
        a, b = F.element_at(F.col("ring"), i + 1), F.element_at(F.col("ring"), (i + 1) % F.size("ring") + 1)
        return ((F.least(a["x"], b["x"]) <= hi_x) & (F.greatest(a["x"], b["x"]) >= lo_x)
                & (F.least(a["y"], b["y"]) <= hi_y) & (F.greatest(a["y"], b["y"]) >= lo_y))

    border = F.exists(F.sequence(F.lit(0), F.size("ring") - 1), meets)
    out = box.withColumn("border", border)
    middle = inside(lo_x + F.col("side") / 2, lo_y + F.col("side") / 2, F.col("ring"))
    return out.filter(F.col("border") | middle).select("label", "level", "cx", "cy", "border", F.when(F.col("border"), F.col("ring")).alias("edges"))


def _met():
    """The step that both descents share, made here so that it travels with their closures."""
    def met(edges, edge, node, box, odd):
        """Edges against the boxes ``(x0, x1, y0, y1)`` of their nodes: ``(node, edge)`` that
        can still decide a point, the parity of the others, nodes that an edge meets, and
        nodes that lie wholly inside.

        An edge counts with its part between the box's rows: one that passes left of
        the box is crossed by no point, one right of it by all points of its rows.
        """
        import numpy as np
        x0, x1, y0, y1 = box
        near = (np.minimum(edges[edge, 1], edges[edge, 3]) <= y1[node]) & (np.maximum(edges[edge, 1], edges[edge, 3]) > y0[node])
        node, edge = node[near], edge[near]
        ax, ay, bx, by = edges[edge].T
        low, high, bottom, top = np.minimum(ay, by), np.maximum(ay, by), y0[node], y1[node]
        with np.errstate(all="ignore"):
            p, q = ((bx - ax) * (y - ay) / (by - ay) + ax for y in (np.maximum(low, bottom), np.minimum(high, top)))
        flat = ay == by  # crossed by no point, but parts those above from those below
        p, q = np.where(flat, ax, p), np.where(flat, bx, q)
        rounding = 1e-12 * (np.abs(ax) + np.abs(bx))  # of a computed crossing
        beyond = np.minimum(p, q) - rounding > x1[node]
        through = beyond & (low <= bottom) & (high > top)  # crossed by every point
        odd = odd ^ (np.bincount(node[through], minlength=len(odd)) % 2 == 1)
        kept = (np.maximum(p, q) + rounding >= x0[node]) & ~through
        border = np.bincount(node[kept & ~beyond], minlength=len(odd)) > 0
        node, edge = node[kept], edge[kept]
        middle = (y0 + y1)[node] / 2
        crossed = (edges[edge, 1] > middle) != (edges[edge, 3] > middle)
        whole = ~border & (odd ^ (np.bincount(node[crossed], minlength=len(odd)) % 2 == 1))
        return node, edge, odd, border, whole
    return met


def refined(deep: DataFrame) -> DataFrame:
    """Cells ``(…, depth)`` followed down ``depth`` halvings, as nodes ``(level, depth, at, nx, ny, label, border, odd, edges)``.

    Border nodes are leaves (``at`` = ``depth``): a point in them is inside if
    ``odd`` differs from the parity of the ``edges`` (ax, ay, bx, by after each
    other) that it crosses.  The other nodes lie wholly inside at any ``at``.
    """
    met = _met()

    def follow(level, cx, cy, depth, odd, row, edges):
        """Nodes of some cells; ``row`` is the cell of each edge."""
        import numpy as np
        cell, nx, ny, node, edge, at = np.arange(len(level)), cx, cy, row, np.arange(len(row)), 0
        while len(cell):
            side = np.exp2((level[cell] - at).astype(float))
            node, edge, odd, border, whole = met(edges, edge, node, (nx * side, (nx + 1) * side, ny * side, (ny + 1) * side), odd)
            leaf = border & (depth[cell] == at)
            out, sent = whole | leaf, leaf[node]
            n = np.where(leaf, np.bincount(node[sent], minlength=len(cell)), 0)[out]
            by_node = edge[sent][np.argsort(node[sent], kind="stable")]
            yield cell[out], at, nx[out], ny[out], leaf[out], odd[out], n, edges[by_node]
            # four children of the borders that go on, each with the edges kept
            go = border & ~leaf
            new = np.cumsum(go) - 1
            on = go[node]
            node, edge = new[node[on]], edge[on]
            m, at = int(go.sum()), at + 1
            node, edge = (node + m * np.arange(4)[:, None]).ravel(), np.tile(edge, 4)
            nx = (2 * nx[go] + np.array([0, 1, 0, 1])[:, None]).ravel()
            ny = (2 * ny[go] + np.array([0, 0, 1, 1])[:, None]).ravel()
            cell, odd = np.tile(cell[go], 4), np.tile(odd[go], 4)

    def nodes(batches):
        import numpy as np
        import pyarrow as pa
        names = ["level", "depth", "at", "nx", "ny", "label", "border", "odd", "edges"]
        for batch in batches:
            level, cx, cy, depth, border = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "cx", "cy", "depth", "border"))
            n = batch.column("edges").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("edges").flatten()
            x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            start = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            follows = np.arange(len(x)) + 1
            follows[(start + n - 1)[n > 0]] = start[n > 0]
            edges = np.column_stack([x, y, x[follows], y[follows]])
            work = np.cumsum((n + 1) << depth) // PAIRS
            for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(work)) + 1):
                if not len(cut):
                    continue
                i, j = cut[0], cut[-1] + 1
                own = slice(start[i], start[j - 1] + n[j - 1])
                for cell, at, nx, ny, leaf, odd, k, kept in follow(level[i:j], cx[i:j], cy[i:j], depth[i:j], ~border[i:j], row[own] - i, edges[own]):
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(4 * k)]).astype(np.int32)), pa.array(kept.ravel()))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(level[i + cell]), pa.array(depth[i + cell]), pa.array(np.full(len(cell), at, np.int32)), pa.array(nx), pa.array(ny),
                        batch.column("label").take(pa.array(i + cell)), pa.array(leaf), pa.array(odd), lists], names)

    fields = T.StructType.fromDDL("level int, depth int, at int, nx long, ny long, border boolean, odd boolean, edges array<double>").fields
    return deep.select(*CELL, "depth", "label", "border", "edges").mapInArrow(nodes, T.StructType([*fields[:5], deep.schema["label"], *fields[5:]]))


def tested(blocks: DataFrame) -> DataFrame:
    """``(points, n, hit)`` of blocks ``(points, xs, ys, pieces)``: per point the pieces that hold it, and the first of their labels."""
    met = _met()

    def counted(x, y, odd, times, k, edges):
        """Per point the pieces that hold it and the first of them; ``k`` edges are a piece's own."""
        import numpy as np
        depth = max(0, int(np.ceil(np.log2(len(x) / FEW))))
        at = np.resize(np.arange(len(x)), -(-len(x) // (1 << depth)) << depth)  # some points twice, so that halves are equal
        for d in range(depth):
            at = at.reshape(1 << d, -1)
            at = np.take_along_axis(at, np.argpartition((x, y)[d % 2][at], at.shape[1] // 2, axis=1), 1)
        at = at.reshape(1 << depth, -1)
        px, py = x[at], y[at]
        boxes = [np.stack([px.min(1), px.max(1), py.min(1), py.max(1)])]
        for _ in range(depth):
            b = boxes[0].reshape(4, -1, 2)
            boxes.insert(0, np.stack([b[0].min(1), b[1].max(1), b[2].min(1), b[3].max(1)]))
        n, first = ([np.full(1 << d, fill) for d in range(depth + 1)] for fill in (0, len(k)))
        own_n, own_first = np.full(px.shape, 0), np.full(px.shape, len(k))
        start, of = np.cumsum(k) - k, np.repeat(np.arange(len(k)), k)
        for cut in np.split(np.arange(len(k)), np.flatnonzero(np.diff(start // max(1, PAIRS >> 6))) + 1):
            i, j = cut[0], cut[-1] + 1
            edge = np.arange(start[i], start[j - 1] + k[j - 1])
            piece, node, inner, pair = cut, np.zeros(len(cut), int), odd[i:j], of[edge] - i
            for d in range(depth + 1):
                pair, edge, inner, go, whole = met(edges, edge, pair, boxes[d][:, node], inner)
                np.add.at(n[d], node[whole], times[piece[whole]])
                np.minimum.at(first[d], node[whole], piece[whole])
                on = go[pair]
                pair, edge = (np.cumsum(go) - 1)[pair[on]], edge[on]
                piece, node, inner = piece[go], node[go], inner[go]
                if d < depth:
                    pair, edge = np.concatenate([pair, pair + len(piece)]), np.tile(edge, 2)
                    piece, node, inner = np.tile(piece, 2), np.concatenate([2 * node, 2 * node + 1]), np.tile(inner, 2)
            if not len(piece):
                continue
            inside, step = np.repeat(inner[:, None], px.shape[1], axis=1), max(1, PAIRS // px.shape[1])
            for i in range(0, len(edge), step):
                some = pair[i:i + step]
                ax, ay, bx, by = edges[edge[i:i + step]].T[:, :, None]
                qx, qy = px[node[some]], py[node[some]]
                with np.errstate(all="ignore"):
                    crossed = ((ay > qy) != (by > qy)) & (qx < (bx - ax) * (qy - ay) / (by - ay) + ax)
                new = np.flatnonzero(np.diff(some, prepend=-1))
                inside[some[new]] ^= np.logical_xor.reduceat(crossed, new, axis=0)
            by_node = np.argsort(node, kind="stable")
            piece, node, inside = piece[by_node], node[by_node], inside[by_node]
            new = np.flatnonzero(np.diff(node, prepend=-1))
            own_n[node[new]] += np.add.reduceat(inside * times[piece][:, None], new, axis=0)
            lowest = np.minimum.reduceat(np.where(inside, piece[:, None], len(k)), new, axis=0)
            own_first[node[new]] = np.minimum(own_first[node[new]], lowest)
        for d in range(depth):
            n[d + 1] += np.repeat(n[d], 2)
            first[d + 1] = np.minimum(first[d + 1], np.repeat(first[d], 2))
        out_n, out_first = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        out_n[at], out_first[at] = n[depth][:, None] + own_n, np.minimum(first[depth][:, None], own_first)
        return out_n, out_first

    def test(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            xs, ys, pieces = batch.column("xs"), batch.column("ys"), batch.column("pieces")
            counts, hits = [], []
            for r in range(batch.num_rows):
                x, y = (c[r].values.to_numpy(zero_copy_only=False) for c in (xs, ys))
                own = pieces[r].values
                label, odd, times, lists = (own.field(c) for c in ("label", "odd", "times", "edges"))
                odd, times = odd.to_numpy(zero_copy_only=False), times.to_numpy()
                k = lists.value_lengths().to_numpy() // 4
                edges = lists.flatten().to_numpy().reshape(-1, 4)
                n, first = counted(x, y, odd, times, k, edges)
                counts.append(n)
                hits.append(label.take(pa.array(first, mask=n == 0)))
            if counts:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(n) for n in counts])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("points"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts))),
                    pa.ListArray.from_arrays(offsets, pa.concat_arrays(hits))], ["points", "n", "hit"])

    name = blocks.schema["pieces"].dataType.elementType["label"].dataType
    schema = T.StructType([blocks.schema["points"], T.StructField("n", T.ArrayType(T.LongType())), T.StructField("hit", T.ArrayType(name))])
    return blocks.select("points", "xs", "ys", "pieces").mapInArrow(test, schema)


def beside(df: DataFrame) -> DataFrame:
    """A stored table of cells to join to rows of points or rings: sent to every task if it
    is small, so that those rows need not be dealt out for it."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def join_boundaries(points: DataFrame, key: str, x: str, y: str, boundaries: DataFrame, label: str = "label",
                    ring: str = "ring") -> tuple[DataFrame, DataFrame]:
    """(every point with ``n_hits``, the smallest ``hit`` and ``warning``; quarantined boundaries).

    ``key`` names a point; several hits warn and keep the smallest label.  A
    point without coordinates has no hit.  Points on an edge belong by the ray rule.
    """
    from hourcast.sources.tables import materialize
    known = checked(boundaries, label, ring)
    valid = materialize(known.filter("fault IS NULL AND label IS NOT NULL").select("label", "ring"))  # read for levels, cells and borders
    box = boxes(valid)
    levels = box.agg(F.array_sort(F.collect_set("level"))).scalar()  # powers of two between the smallest and the largest extent
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    looked = points.filter(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py)).select(
        F.struct(*points.columns).alias("point"), px.alias("x"), py.alias("y"), F.explode(levels).alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    looked = looked.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / LEAF) / 2)).cast("int")
    roots = looked.groupBy(CELL).agg(depth.alias("depth")).join(spread(box).select(CELL).distinct(), CELL)
    roots = beside(materialize(roots))  # read for the points and the rings
    part = F.pow(F.lit(2.0), F.col("level") - F.col("depth"))
    looked = looked.join(roots, CELL).withColumns({"lx": F.floor(F.col("x") / part), "ly": F.floor(F.col("y") / part)})
    leaves = beside(materialize(looked.groupBy(LEAF_KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))))  # dealt to both sides
    nodes = materialize(refined(cells(valid).join(roots, CELL)))  # read for its borders and the cells held whole

    held = nodes.filter("NOT border").groupBy("level", "at", "nx", "ny").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("times"))
    above = leaves.withColumn("at", F.explode(F.sequence(F.lit(0), "depth"))).withColumns(
        {"nx": F.expr("shiftright(lx, depth - at)"), "ny": F.expr("shiftright(ly, depth - at)")})
    held = above.join(held, ["level", "at", "nx", "ny"]).groupBy(*LEAF_KEY, "n_blocks").agg(F.min("label").alias("label"), F.sum("times").alias("times"))
    held = held.select(*LEAF_KEY, "n_blocks", "label", F.lit(True).alias("odd"), "times", F.array(*[F.lit(0.0)] * 4).alias("edges"))  # no point crosses it
    borders = nodes.filter("border").withColumnsRenamed({"nx": "lx", "ny": "ly"}).join(leaves, LEAF_KEY)
    pieces = borders.select(*LEAF_KEY, "n_blocks", "label", "odd", F.lit(1).cast("long").alias("times"), "edges").unionByName(held)
    parts = beside(materialize(pieces.groupBy(LEAF_KEY).agg(F.ceil(F.sum(F.size("edges")) / 4 / BLOCK).alias("n_parts"))))
    piece = F.struct("label", "odd", "times", "edges")
    pieces = (pieces.join(parts, LEAF_KEY).groupBy(*LEAF_KEY, "n_blocks", F.pmod(F.xxhash64(piece), "n_parts").alias("part"))
              .agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))))
    packed = (looked.join(leaves, LEAF_KEY).groupBy(*LEAF_KEY, F.pmod(F.xxhash64("point"), "n_blocks").alias("block"))
              .agg(F.collect_list("point").alias("points")))
    xs, ys = (F.col("points")[c].cast("array<double>").alias(a) for c, a in ((x, "xs"), (y, "ys")))
    blocks = packed.select(*LEAF_KEY, "block", "points", xs, ys)
    hits = tested(blocks.join(pieces, [*LEAF_KEY, "block"])).select(F.explode(F.arrays_zip("points", "n", "hit")).alias("h")).filter("h.n > 0")
    every = points.select("*", F.lit(0).cast("long").alias("_n"), F.lit(None).cast(valid.schema["label"].dataType).alias("_hit")).unionByName(
        hits.select(*[F.col("h.points")[c].alias(c) for c in points.columns], F.col("h.n").alias("_n"), F.col("h.hit").alias("_hit")))
    found = every.groupBy(*points.columns).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_hits"), F.min("_hit").alias("hit"))
    return (found.withColumn("warning", F.when(F.col("n_hits") > 1, "several_boundaries")),
            known.filter("fault IS NOT NULL").select("label", "fault"))
