"""Footers, file hashes, routed tables, whole-column times and the boundary index on small cases."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from hourcast.functions.calendar import parse_utc_whole
from hourcast.operators import boundaries as BD
from hourcast.operators import validate as V
from hourcast.sources import filehash as FH
from hourcast.sources import footers as FT
from hourcast.sources import sinks as SK

CONTRACT = [(1, "a", "bigint", True, None), (1, "b", "string", False, "a name"), (2, "a", "string", True, None)]


def audited(spark, path, version=1):
    contract = spark.createDataFrame(CONTRACT, FT.CONTRACT)
    return FT.audit(FT.read_footers(FT.part_files(spark, path)), contract, version)


def test_each_departure_of_a_file_has_its_outcome(spark, scratch):
    one = spark.range(3).select(F.col("id").alias("a"))
    one.coalesce(1).write.parquet(f"{scratch}/plain")
    one.select("a", F.lit("x").alias("b", metadata={"comment": "a name"}), F.lit(1).alias("c")).coalesce(1).write.parquet(f"{scratch}/extra")
    one.select("a", F.lit("x").alias("b", metadata={"comment": "a place"})).coalesce(1).write.parquet(f"{scratch}/meaning")
    one.select(F.lit(1).alias("b")).coalesce(1).write.parquet(f"{scratch}/both")
    found = audited(spark, scratch)
    got = {(r.path.split("/")[-2], r.field): r.outcome for r in found.collect()}
    assert got == {("plain", "a"): "ok", ("plain", "b"): "ok:absent", ("extra", "a"): "ok", ("extra", "b"): "ok", ("extra", "c"): "warning:extra",
                   ("meaning", "a"): "ok", ("meaning", "b"): "block:meaning", ("both", "a"): "block:missing", ("both", "b"): "warning:type"}
    assert {r.path.split("/")[-2]: r.decision for r in FT.decisions(found).collect()} == {
        "plain": "accept", "extra": "warn", "meaning": "block", "both": "block"}
    assert {r.outcome for r in audited(spark, f"{scratch}/plain", 2).collect()} == {"block:type"}
    prints = {r.path.split("/")[-2]: r.fingerprint for r in found.collect()}
    assert prints["plain"] == hashlib.sha256(b"a:bigint").hexdigest() and len(set(prints.values())) == 4


def test_footers_of_other_writers_are_read(spark, scratch):
    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({"a": pa.array([1, 2], pa.int64()), "t": pa.array(["x", None])}), f"{scratch}/own.parquet")
    r = FT.read_footers(FT.part_files(spark, scratch)).first()
    assert r.n_rows == 2 and [(f.field, f.type) for f in r.fields] == [("a", "bigint"), ("t", "string")]


@pytest.mark.parametrize("size", [0, 1, FH.BLOCK - 1, FH.BLOCK, 3 * FH.BLOCK + 17])
def test_hash_of_a_streamed_file(scratch, size):
    raw = random.Random(size).randbytes(size)
    with open(f"{scratch}/f.bin", "wb") as f:
        f.write(raw)
    assert FH.file_sha256(f"{scratch}/f.bin") == FH.file_sha256(f"file:{scratch}/f.bin") == hashlib.sha256(raw).hexdigest()


def test_a_large_file_is_read_in_blocks(scratch, monkeypatch):
    read = []

    class Stream:
        left = 5 * FH.BLOCK

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, n):
            read.append(n)
            out = min(n, self.left)
            self.left -= out
            return b"\0" * out

    monkeypatch.setattr(FH, "open_input", lambda path: Stream())
    FH.file_sha256("x")
    assert read == [FH.BLOCK] * 6


def test_files_are_dealt_to_tasks_by_size(spark, scratch, monkeypatch):
    sizes = [10, 20, 500, 30, 600, 5]
    for i, n in enumerate(sizes):
        os.makedirs(f"{scratch}/d{i % 2}", exist_ok=True)
        with open(f"{scratch}/d{i % 2}/{i}.bin", "wb") as f:
            f.write(b"x" * n)
    with open(f"{scratch}/_note", "wb") as f:
        f.write(b"not data")
    monkeypatch.setattr(FH, "TASK_BYTES", 64)
    parts = [[s for _, s in p.files] for p in FH.FileHashReader({"path": scratch}).partitions()]
    assert parts == [[600], [500], [30, 20, 10], [5]] or parts == [[600], [500], [30, 20, 10, 5]]
    got = {r.path.split("/")[-1]: (r.length, r.sha256) for r in FH.file_hashes(spark, scratch).collect()}
    assert got == {f"{i}.bin": (n, hashlib.sha256(b"x" * n).hexdigest()) for i, n in enumerate(sizes)}
    assert FH.file_hashes(spark, f"{scratch}/d0", ".none").count() == 0


def test_verification_outcomes(spark):
    rows = [(None, "h", "h"), ("p", "h", None), ("p", "g", "h"), ("p", "h", "h"), ("p", None, "h"), ("p", "", "h")]
    df = spark.createDataFrame(rows, "p string, d string, a string")
    got = [r[0] for r in df.select(FH.verification(F.col("p"), F.col("d"), F.col("a"))).collect()]
    assert got == ["skipped", "missing_payload", "checksum_mismatch", "ok", "ok", "ok"]


def test_routed_tables_add_up_and_a_lost_batch_is_not_read(spark, scratch):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(100)], "k int, n int")
    routed = V.route(df, [("missing", F.col("n").isNull())], [("high", F.col("n") > 90)])
    assert SK.write_routed(routed, scratch, "b1") == {"total": 100, "accepted": 72, "warned": 8, "quarantined": 20}
    SK.write_routed(routed.filter("k < 10"), scratch, "b2")
    SK.write_routed(routed.filter("k < 20"), scratch, "b2")  # the rerun replaces
    routed.write.partitionBy("route").parquet(f"{scratch}/rows/batch=b3")  # lost before its evidence
    rows, evidence = SK.read_routed(spark, scratch)
    got = {(r.batch, r.route): r["count"] for r in rows.groupBy("batch", "route").count().collect()}
    assert got == {("b1", "accepted"): 72, ("b1", "warned"): 8, ("b1", "quarantined"): 20, ("b2", "accepted"): 16, ("b2", "quarantined"): 4}
    assert {r.batch: (r.total, r.accepted) for r in evidence.collect()} == {"b1": (100, 72), "b2": (20, 16)}
    assert {tuple(r.quarantine_reasons) for r in SK.read_routed(spark, scratch, "quarantined")[0].collect()} == {("missing",)}


def test_one_bad_text_flips_the_whole_column_of_its_key(spark):
    rows = [("a", "2024-01-05T10:00:00+0200"), ("a", None), ("b", "2024-01-05T10:00:00+02:00"), ("b", "2024-01-05 10:00:00+02:00"),
            ("c", "soon"), ("c", "2024-01-05T10:00:00Z"), (None, "2024-01-05T10:00:00+0000")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = sorted(((r.k or "", str(r.u), r.lenient) for r in parse_utc_whole(df, "t", ["k"], "u", "lenient").collect()))
    assert got == [("", "2024-01-05 10:00:00", False), ("a", "2024-01-05 08:00:00", False), ("a", "None", False), ("b", "2024-01-05 08:00:00", True),
                   ("b", "2024-01-05 08:00:00", True), ("c", "2024-01-05 10:00:00", True), ("c", "None", True)]


def plainly_inside(x, y, ring):
    n, odd = len(ring), False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return n >= 3 and odd


def test_boundary_index_equals_a_test_of_every_pair(spark, monkeypatch):
    rng = random.Random(7)
    rings = {}
    for i in range(60):
        size = rng.choice([0.03, 1, 8, 300])
        cx, cy = rng.uniform(-50, 50), rng.uniform(-50, 50)
        rings[f"r{i:02}"] = [(cx + rng.uniform(-size, size), cy + rng.uniform(-size, size)) for _ in range(rng.randrange(3, 9))]
    rings["square"] = [(0.0, 0.0), (16.0, 0.0), (16.0, 16.0), (0.0, 16.0)]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(800)]
    points += [(1000 + i, sum(p[0] for p in r) / len(r), sum(p[1] for p in r) / len(r)) for i, r in enumerate(rings.values())]
    points += [(2000, 16.0, 8.0), (2001, 0.0, 0.0), (2002, 8.0, 16.0), (2003, None, 1.0), (2004, 4.0, 4.0)]
    text = [(k, "POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in r + r[:1]) + "))") for k, r in rings.items()]
    bad = [("two", "POLYGON((1 1, 2 2))"), ("flat", "POLYGON((0 0, 1 1, 2 2, 0 0))"), ("word", "POLYGON((0 0, 1 x, 2 2))"),
           ("other", "POINT(1 1)"), ("none", None), ("blank", "POLYGON(())"), ("twice", "POLYGON((0 0, 1 1, 0 0, 1 1))")]
    df = spark.createDataFrame(text + bad, "label string, geometry string").withColumn("ring", BD.parse_ring(F.col("geometry")))
    found, faulty = BD.join_boundaries(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", df)
    got = {r.id: (r.n_hits, r.hit, r.warning) for r in found.collect()}
    want = {}
    for i, x, y in points:
        hits = [k for k, r in rings.items() if x is not None and plainly_inside(x, y, r)]
        want[i] = (len(hits), min(hits, default=None), "several_boundaries" if len(hits) > 1 else None)
    assert got == want and any(n > 1 for n, *_ in want.values())
    assert {r.label: r.fault for r in faulty.collect()} == {
        "two": "too_few_points", "flat": "no_area", "word": "missing_coordinate", "other": "empty", "none": "empty", "blank": "empty",
        "twice": "too_few_points"}
    assert max(r["count"] for r in BD.cells(BD.checked(df, "label", "ring").filter("fault IS NULL")).groupBy("label").count().collect()) <= (2 * BD.PARTS + 1) ** 2


def test_rings_over_the_same_points_are_followed_to_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(BD, "LEAF", 8, raising=False)
    monkeypatch.setattr(BD, "BLOCK", 5, raising=False)
    monkeypatch.setattr(BD, "PAIRS", 300, raising=False)
    rng = random.Random(11)
    rings = []
    for i in range(90):  # wide rings over each other, some crossing themselves, some on whole numbers
        at = (lambda c: float(round(c))) if i % 3 == 0 else (lambda c: c)
        size = 0.5 if i % 15 == 0 else 40
        cx, cy = rng.uniform(-20, 20), rng.uniform(-20, 20)
        rings.append((f"r{i:02}", [(at(cx + rng.uniform(-size, size)), at(cy + rng.uniform(-size, size))) for _ in range(rng.randrange(4, 9))]))
    rings += [rings[1], ("box", [(-32.0, -32.0), (32.0, -32.0), (32.0, 32.0), (-32.0, 32.0)]), (None, [(-9.0, -9.0), (9.0, -9.0), (0.0, 9.0)])]
    points = [(i, rng.uniform(-45, 45), rng.uniform(-45, 45)) for i in range(1500)]
    points += [(3000 + i, float(rng.randrange(-40, 41)), float(rng.randrange(-40, 41))) for i in range(700)]
    points += [(5000 + i, 1.5, 1.5) for i in range(60)] + [(6000 + i, *p) for i, p in enumerate(p for _, r in rings for p in r)]
    points += [(7000, 2.5, -3.5), (7000, 2.5, -3.5), (7001, None, 1.0), (7002, 1.0, None), (None, 0.5, 0.5)]
    df = spark.createDataFrame([(k, [{"x": a, "y": b} for a, b in r]) for k, r in rings], "label string, ring array<struct<x:double,y:double>>")
    found, _ = BD.join_boundaries(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", df)
    got = {(r.id, r.x, r.y): (r.n_hits, r.hit) for r in found.collect()}
    hits = {}
    for p in points:
        own = [k for k, r in rings if k and None not in p[1:] and plainly_inside(*p[1:], r)]
        hits[p] = hits.get(p, []) + own
    assert got == {p: (len(own), min(own, default=None)) for p, own in hits.items()} and found.count() == len(hits)


def test_points_under_many_rings_meet_few_of_them(spark, monkeypatch):
    monkeypatch.setattr(BD, "LEAF", 8, raising=False)
    rng = random.Random(3)
    rings = {f"r{i:02}": [(i - 40.0, i - 40.0), (i + 20.0, i - 40.0), (i + 20.0, i + 20.0), (i - 40.0, i + 20.0)] for i in range(40)}
    points = [(i, rng.uniform(-40, 60), rng.uniform(-40, 60)) for i in range(4000)]
    work, tested = [], getattr(BD, "tested", None)

    def counted(blocks):
        work.append(blocks.agg(F.sum(F.size("xs") * F.size("pieces"))).first()[0])
        return tested(blocks)

    monkeypatch.setattr(BD, "tested", counted, raising=False)
    df = spark.createDataFrame([(k, [{"x": a, "y": b} for a, b in r]) for k, r in rings.items()], "label string, ring array<struct<x:double,y:double>>")
    found, _ = BD.join_boundaries(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", df)
    got = {r.id: (r.n_hits, r.hit) for r in found.collect()}
    own = {i: [k for k, r in rings.items() if plainly_inside(x, y, r)] for i, x, y in points}
    assert got == {i: (len(k), min(k, default=None)) for i, k in own.items()}
    pairs = sum(len(k) for k in own.values())
    assert len(work) == 1 and work[0] < pairs / 2, (work, pairs)  # a join of each point with the rings over it forms all pairs


def test_no_boundaries_and_no_points(spark):
    none = spark.createDataFrame([], "label string, ring array<struct<x:double,y:double>>")
    found, faulty = BD.join_boundaries(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), "id", "x", "y", none)
    assert [(r.id, r.n_hits, r.hit) for r in found.collect()] == [(1, 0, None)] and faulty.count() == 0


@pytest.mark.parametrize("span,length,labels", [(4000, 8, "ab"), (4000, 30, "abcd"), (300, 20, "ab"), (20_000, 60, "a")])
def test_overlaps_with_another_label_equal_a_test_of_every_pair(spark, span, length, labels):
    from hourcast.operators import enrich as EN
    rng = random.Random(span + length)
    rows = []
    for i in range(400):
        s = rng.randrange(span)
        rows.append((rng.choice([1, 2, None]), i, s, None if i % 40 == 0 else s + rng.randrange(length), rng.choice([*labels, None] if i % 7 == 0 else labels), s // 50))
    df = spark.createDataFrame(rows, "k int, _tie int, s int, e int, l string, b int")
    got = {r._tie: r.overlap_warning for r in EN.overlap_flags(df, "k", "s", "e", "l", "b").collect()}
    want = {i: any(k2 == k and l2 != l and (s2, i2) < (s, i) and e2 is not None and e2 > s for k2, i2, s2, e2, l2, _ in rows)
            for k, i, s, _, l, _ in rows}
    assert got == want and 0 < sum(want.values()) < 400


def test_boxes_of_a_block_equal_a_test_of_every_pair(spark, monkeypatch):
    for name, size in (("LEAF", 300), ("BLOCK", 200), ("FEW", 3), ("PAIRS", 640), ("SMALL", 4)):
        monkeypatch.setattr(BD, name, size)
    rng = random.Random(5)
    rings = []
    for i in range(70):  # sizes of several levels, some on the points' grid with level and upright edges
        size = (1.5, 6, 30)[i % 3]
        at = (lambda c: round(2 * c) / 2) if i % 2 else (lambda c: c)
        cx, cy = rng.uniform(-20, 20), rng.uniform(-20, 20)
        rings.append((f"r{i:02}", [(at(cx + rng.uniform(-size, size)), at(cy + rng.uniform(-size, size))) for _ in range(rng.randrange(3, 12))]))
    rings += [rings[2], ("box", [(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0)]), ("comb", [(float(i), 3.0 * (i % 2)) for i in range(-12, 13)] + [(0.0, -5.0)])]
    points = [(i, rng.randrange(-50, 51) / 2, rng.randrange(-50, 51) / 2) for i in range(900)] + [(2000 + i, 0.5, 0.5) for i in range(260)]
    points += [(3000 + i, rng.gauss(0, 9), rng.gauss(0, 9)) for i in range(500)] + [(4000, float("nan"), 0.5), (4001, 0.5, float("nan"))]
    df = spark.createDataFrame([(k, [{"x": a, "y": b} for a, b in r]) for k, r in rings], "label string, ring array<struct<x:double,y:double>>")
    df = df.filter(BD.ring_fault(BD.open_ring(F.col("ring"))).isNull())
    known = {r.label for r in df.collect()}
    found, _ = BD.join_boundaries(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", df)
    got = {r.id: (r.n_hits, r.hit) for r in found.collect()}
    hits = {i: [k for k, r in rings if k in known and plainly_inside(x, y, r)] for i, x, y in points}
    assert got == {i: (len(own), min(own, default=None)) for i, own in hits.items()}
    assert max(n for n, _ in got.values()) > 10


def test_stored_borders_grow_with_the_length_of_a_ring(spark):
    ring = [{"x": x, "y": y} for x, y in ((-21.0, 1.0), (0.0, -22.0), (20.0, 0.0), (3.0, 23.0))]
    cells = BD.cells(spark.createDataFrame([("a", ring)], "label string, ring array<struct<x:double,y:double>>"))
    n = [BD.refined(cells.withColumn("depth", F.lit(d))).filter("border").count() for d in (4, 5, 6)]
    assert n[1] < 2.5 * n[0] and n[2] < 2.5 * n[1]  # about two, and four if by its area
