"""Near-duplicate detection: SuperMinHash signatures, banding, verification, union-find.

A document's set holds its distinct shingles of `size` lower-cased words. Documents with equal sets
form a class, and only one representative of each class (its smallest doc_id) goes further. A
SuperMinHash signature of 252 registers is cut into 42 bands of 6; at a similarity of 0.8 two sets
share no band with a probability of about 3e-6. Each representative is compared with the least and the greatest
representative of its buckets, links are confirmed on the full sets of the whole texts, and
components are found. Whatever a bucket of four or more still leaves apart is then compared within
blocks of bounded size, so that no bucket, however large, meets in one task and no pair is capped.

Null, empty or blank text: empty set, linked with nothing. A null doc_id: kept, in no component.
Rows that share a doc_id are one node, linked by any of their texts; each has its own n_shingles. Ties: the smallest doc_id represents. Empty table: empty
result. Further columns of the input, whatever their names, are neither read nor changed by
near_duplicates; keep_one returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, distinct_per_text, give_back, mix, per_text_sum, shingles, stored, table, utf8, words
from .components import components

REGISTERS, BAND = 252, 6
#: Pairs whose signatures agree on a smaller share than this are not verified: five standard errors below 0.8.
LEAST_ESTIMATE = 0.674
#: Members of a bucket that are compared in one block.
BLOCK = 512
#: Shingles of the texts of one side of a block, some 8 MB.
SHINGLES = 1 << 20
#: Bits of the bitmap that goes out before texts are gathered by id (2 MB as a bit each).
BITMAP = 1 << 24
#: Elements whose permutations are held at once.
ELEMENTS = 1 << 15


def superminhash(values: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash of several sets: values[first[i]:first[i + 1]] are the elements of set i.

    Each element walks through a random permutation of the registers; at step j it offers
    j + a uniform fraction to the register that the permutation names. A register keeps the least
    offer. A set is done as soon as all its registers lie below the next step. The steps of all
    sets are taken together. Register: the step in the upper 9 bits, the fraction in the others."""
    n = np.diff(first)
    out = np.full((len(n), registers), np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        end = at + max(1, int(np.searchsorted(np.cumsum(n[order[at:]]), ELEMENTS, "right")))
        group = order[at:end]
        elements = np.concatenate([values[first[g] : first[g + 1]] for g in group])
        out[group] = _superminhash(elements, np.repeat(np.arange(len(group)), n[group]), len(group), registers)
        at = end
    return out


def _superminhash(values: np.ndarray, owner: np.ndarray, sets: int, registers: int) -> np.ndarray:
    held = np.full((sets, registers), np.iinfo(np.uint64).max, np.uint64)
    flat, places = held.reshape(-1), None
    for j in range(registers):
        draw = mix(values + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = j + ((draw >> np.uint64(40)) * np.uint64(registers - j) >> np.uint64(24)).astype(np.int64)
        offer = np.uint64(j << 55) | mix(draw) >> np.uint64(9)
        if j == 0:
            place = swap
        else:
            if places is None:  # only sets that one step has not filled need their permutations
                places = np.tile(np.arange(registers, dtype=np.uint8), (len(values), 1))
                rows = np.arange(len(values))
                places[rows, swap0], places[:, 0] = 0, swap0
            place = places[rows, swap].astype(np.int64)
            places[rows, swap] = places[rows, j]
        np.minimum.at(flat, owner * registers + place, offer)
        open_sets = held.max(1) >= np.uint64((j + 1) << 55)
        if not open_sets.any():
            break
        stay = open_sets[owner]
        if j == 0:
            swap0 = swap[stay]
        if not stay.all():
            values, owner = values[stay], owner[stay]
            if places is not None:
                rows = rows[stay]
                if len(rows) < 0.7 * len(places):
                    places, rows = places[rows], np.arange(len(rows))
    return held


SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, signature binary"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            values, first = distinct_per_text(*shingles(words(*utf8(piece.column("text"))), size))
            n, held = np.diff(first), superminhash(values, first)
            fp = [per_text_sum(mix(values + np.uint64(k)), first).view(np.int64) for k in (1, 2)]
            parts = held.reshape(len(n), -1, BAND)
            bands = np.zeros(parts.shape[:2], np.uint64)
            for k in range(BAND):
                bands = mix(bands + parts[:, :, k])
            bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64))
            short = mix(held).astype(np.uint8)
            at = np.arange(len(n) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").cast(pa.int64()),
                    pa.array(n.astype(np.int64)),
                    pa.array(fp[0]),
                    pa.array(fp[1]),
                    pa.ListArray.from_arrays(pa.array(at * bands.shape[1]), pa.array(bands.view(np.int64).reshape(-1))),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at * REGISTERS), pa.py_buffer(short.tobytes())]),
                ],
                names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "signature"],
            )

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and signatures allow the similarity."""
    for b in batches:
        if b.num_rows:
            sa, sb = (np.frombuffer(b.column(k).cast(pa.large_binary()).buffers()[2], np.uint8)[b.column(k).cast(pa.large_binary()).offset :].reshape(-1)[: b.num_rows * REGISTERS].reshape(-1, REGISTERS) for k in ("sa", "sb"))
            na, nb = (b.column(k).to_numpy() for k in ("na", "nb"))
            fine = ((sa == sb).mean(1) >= LEAST_ESTIMATE) & (100 * np.minimum(na, nb) >= 80 * np.maximum(na, nb))
            yield b.select(["a", "b"]).filter(pa.array(fine))


def _confirm(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks([batch], "ta"):
                sets = [distinct_per_text(*shingles(words(*utf8(piece.column(k))), size)) for k in ("ta", "tb")]
                linked = []
                for i in range(piece.num_rows):
                    x, y = (v[f[i] : f[i + 1]] for v, f in sets)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= 80 * (len(x) + len(y) - both))
                yield piece.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a block that have a partner on the other side, in another component, as far as sizes and signatures tell."""
    for b in batches:
        for k in range(b.num_rows):
            sides = [b.column(c)[k].values for c in ("left", "right")]
            if not len(sides[0]) or not len(sides[1]):
                continue
            (cx, nx, sx), (cy, ny, sy) = ((s.field("comp").to_numpy(), s.field("n_shingles").to_numpy(), _signatures(s)) for s in sides)
            some = np.zeros(len(cx), bool), np.zeros(len(cy), bool)
            for x in range(len(cx)):
                allowed = np.flatnonzero((cx[x] != cy) & (100 * np.minimum(nx[x], ny) >= 80 * np.maximum(nx[x], ny)))
                close = allowed[(sy[allowed] == sx[x]).mean(1) >= LEAST_ESTIMATE]
                some[0][x] = len(close) > 0
                some[1][close] = True
            for side, s, own in zip((0, 1), sides, some, strict=True):
                part = s.filter(pa.array(own))
                if len(part):
                    at = [pa.array([b.column(c)[k].as_py()] * len(part), t) for c, t in (("bucket", pa.int64()), ("l", pa.int32()), ("r", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*at, pa.array([side] * len(part), pa.int32()), *(part.field(c) for c in ("rep", "comp", "signature"))], names=["bucket", "l", "r", "side", "rep", "comp", "signature"])


def _links_within(size: int):
    """Links of a block between components: rows of `left`, each against all of `right`. Pairs that the
    signatures allow are confirmed on the full sets at once, unless their components have met already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[int, int]] = []
            for left, right in zip(b.column("left"), b.column("right"), strict=True):
                if not len(left.values) or not len(right.values):
                    continue
                (rx, cx, sx, vx, fx), (ry, cy, sy, vy, fy) = (_members(s.values, size) for s in (left, right))
                nx, ny, met = np.diff(fx), np.diff(fy), {}
                for k in range(len(rx)):
                    allowed = np.flatnonzero((cx[k] != cy) & (100 * np.minimum(nx[k], ny) >= 80 * np.maximum(nx[k], ny)))
                    for y in allowed[(sy[allowed] == sx[k]).mean(1) >= LEAST_ESTIMATE]:
                        if (p := _root(met, int(cx[k]))) != (q := _root(met, int(cy[y]))):
                            both = len(np.intersect1d(vx[fx[k] : fx[k + 1]], vy[fy[y] : fy[y + 1]], assume_unique=True))
                            if 100 * both >= 80 * (nx[k] + ny[y] - both):
                                met[max(p, q)] = min(p, q)
                                got.append((min(rx[k], ry[y]), max(rx[k], ry[y])))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _root(above: dict[int, int], x: int) -> int:
    while x in above:
        x = above[x]
    return x


def _signatures(s: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(s.field("signature").to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _members(s: pa.Array, size: int) -> tuple[np.ndarray, ...]:
    return s.field("rep").to_numpy(), s.field("comp").to_numpy(), _signatures(s), *distinct_per_text(*shingles(words(*utf8(s.field("text"))), size))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct doc_id and text of the documents whose id is in ids (doc_id). A bitmap of the ids'
    hashes, of BITMAP bits at any size of ids, spares the other texts the shuffle."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    bits = ids.groupBy((spot / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("bits")).toPandas()
    held = np.zeros(BITMAP // 64, np.int64)
    held[bits["w"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(held.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("spot").to_numpy()
            some = shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            yield b.filter(pa.array(some)).select(["doc_id", "text"])
        give_back()

    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", spot.alias("spot")).mapInArrow(run, "doc_id long, text string")
    return some.join(ids.hint("merge"), "doc_id", "left_semi").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts reach the similarity."""
    held = stored(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "texts")
    end = lambda k: held.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")).hint("merge")
    return stored(pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(_confirm(size), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_sign(size), SIGNED), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # the row of each class with the smallest id, of rows of one id any: they have one set
    least = full.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("r"))
    reps = stored(least.select("fp1", "fp2", F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.bands", "r.signature"), "reps")

    spread = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).where("low < high")
    members = stored(spread.join(stored(buckets, "buckets").hint("merge"), "bucket"), "members")
    ends = members.select("rep", F.explode(F.array("low", "high")).alias("end")).where("rep <> end")
    pairs = stored(ends.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct(), "ends")
    # joined as they are stored, so that a hub among the representatives is split
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("signature").alias(f"s{k}")).hint("merge")
    tested = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_close, "a long, b long"), "pairs")
    links = _verified(tested, docs, size)
    several = full.groupBy("doc_id").agg(F.min("fp1").alias("x"), F.max("fp1").alias("y")).where("x < y").select("doc_id")  # ids of different texts
    homes = full.join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "fp1", "fp2").distinct().join(reps.select("fp1", "fp2", "rep").hint("merge"), ["fp1", "fp2"])
    links = links.union(stored(homes.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"), "homes"))
    labels = components(links)

    # buckets of four and more whose members are still apart: all others are settled by their two ends
    joined = members.where("n > 3").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    counts = joined.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    apart = counts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    apart = apart.select("bucket", F.col("main.comp").alias("main"), (F.col("all") - F.col("main.n")).alias("outside"), "all")
    apart = stored(apart, "mains")  # aggregates are stored before they are joined, so that the rows of a large bucket are split
    rows = stored(joined.select("bucket", "rep", "comp").join(apart.hint("merge"), "bucket").join(reps.select("rep", "n_shingles", "signature").hint("merge"), "rep"), "apart")
    if not rows.isEmpty():
        links = links.union(stored(_links_apart(rows, docs, size), "links"))
        labels = components(links)

    homes = reps.select("fp1", "fp2", "rep").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("fp1", "fp2", F.coalesce("comp", "rep").alias("comp"))
    known = full.select("doc_id", "fp1", "fp2").join(homes.hint("merge"), ["fp1", "fp2"]).groupBy("doc_id").agg(F.min("comp").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(known.hint("merge"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _blocks(rows: DataFrame, *own: str) -> DataFrame:
    """bucket, l, r and the members of each block, left and right, as arrays: rows (bucket, l, r, side, own)."""
    side = lambda k: F.collect_list(F.when(F.col("side") == k, F.struct(*own)))
    return rows.groupBy("bucket", "l", "r").agg(side(0).alias("left"), side(1).alias("right"))


def _links_apart(rows: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links between components of a bucket, found block by block. The rows outside a bucket's
    largest component form left blocks; each meets every right block, of all the bucket's rows. Signatures meet first,
    and the texts of those members only that have a possible partner; a block holds at most about
    BLOCK rows and SHINGLES shingles a side."""
    weight = rows.groupBy("bucket").agg(F.sum("n_shingles").alias("w"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("n_shingles"))).alias("v"))
    rows = rows.join(stored(weight, "weights").hint("merge"), "bucket")
    lefts, rights = (F.ceil(F.greatest(F.col(c) / BLOCK, F.col(w) / SHINGLES)).cast("int") for c, w in (("outside", "v"), ("all", "w")))
    own = ["rep", "comp", "n_shingles", "signature"]
    spot: Column = F.xxhash64("rep", F.lit(7))
    left = rows.where("comp <> main").select("bucket", F.pmod(spot, lefts).cast("int").alias("l"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("r"), F.lit(0).alias("side"), *own)
    right = rows.select("bucket", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("l"), F.pmod(spot, rights).cast("int").alias("r"), F.lit(1).alias("side"), *own)
    hope = stored(_blocks(left.unionByName(right), *own).mapInArrow(_hopeful, "bucket long, l int, r int, side int, rep long, comp long, signature binary"), "hopeful")
    texts = _texts(docs, hope.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep")
    blocks = _blocks(hope.join(texts.hint("merge"), "rep"), "rep", "comp", "signature", "text")
    return blocks.select("left", "right").mapInArrow(_links_within(size), "a long, b long")


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of docs, all columns, of one document of each group of near-duplicates; rows of a null doc_id stay."""
    gone = near_duplicates(docs, size).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
