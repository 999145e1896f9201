"""Language-model scoring with a Brown class-based n-gram model.

Counting: the counts of all words of all training texts, as one distributed table; the end of a text
counts as a word. Items: the words counted at least t times, t being chosen from a histogram of the counts so that there are
at most ITEMS of them; the counts of pairs of items that follow each other are a distributed table.

Exchange clustering: the SEED most frequent items are clustered one by one, then all other items join the class that raises the
likelihood of the class bigrams most, and in each of ROUNDS rounds a fourth of all items, chosen by a hash,
move to their best class, beside each other, against the class bigrams of the round before; a round that lowers the
likelihood is undone, and a fourth as many move in the next. Only the table of class pairs and a class per item go out. Every word that is no item gets the class that its own
contexts all over the corpus make most likely. So each word of the corpus has a class and a count, in one distributed table.

Score: log10 of P(class | class before) * P(word | class), mixed with the class-free P(word) by weight MIX,
summed over the words of the whole text and its end. P(word | class) = (c + 1) / (tokens + words of the class), where
one class, that of most of the words seen once, has the unknown word besides; so the words of all classes and the unknown
one sum to one. Items' classes and counts are broadcast; those of all other words are joined to pieces of near CHUNK_BYTES
of text, each with the distinct other words of its own.

Null and empty texts have one token, the end. A null doc_id counts as a training text and its scores are returned under null.
Repeated rows are all counted and scored. Empty table: no rows. Without training texts all counts are 0.
Clashing further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fold, mix, per_text_sum, stored, table, utf8, words

#: Words that are clustered by exchange, and whose classes and counts are broadcast (17 bytes each).
ITEMS = 1 << 16
CLASSES, SEED, ROUNDS = 64, 512, 4
#: Codes of contexts besides the classes: the start of a text, and a word whose class isn't known.
START, OTHER = CLASSES, CLASSES + 1
CONTEXTS = CLASSES + 2
MIX = 0.9
END = np.uint64(0x1E4D)
#: Rows a task holds before it passes their counts on.
HELD = 1 << 20
#: Pairs in a file of contexts, pairs in a row of it (some 400 KB: large rows cost executors memory), and rows looked at in one step.
PAIRS, PACKED, RUN = 1 << 20, 1 << 16, 1 << 18


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end; where each text's begin."""
    w = words(*utf8(texts))
    n = np.diff(w.first)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, np.uint64)
    if len(w.hashes):
        out[np.arange(len(w.hashes)) + np.repeat(np.arange(len(n)), n)] = w.hashes
    return out, first


def _counted(keys: Iterator[np.ndarray], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Keys (64 bits) with their numbers, counted as far as HELD different ones allow."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def sums() -> tuple[np.ndarray, np.ndarray]:
        k, c = (np.concatenate(x) for x in zip(*held, strict=True))
        k, back = np.unique(k, return_inverse=True)
        return k, np.bincount(back, c).astype(np.int64)

    def rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], names=list(names))

    for own in keys:
        held.append(np.unique(own, return_counts=True))
        size += len(held[-1][0])
        if size > 2 * HELD:
            held = [sums()]
            size = len(held[0][0])
            if size > HELD:
                yield rows(held.pop())
                size = 0
    if held:
        yield rows(sums())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counted((_tokens(piece.column("text"))[0] for piece in chunks(batches, "text")), ("word", "n"))


@dataclass
class Lexicon:
    """Known words (hashes, sorted) with a number each."""

    known: np.ndarray
    value: np.ndarray

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(token), bool), np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(self.known, token), len(self.known) - 1)
        return self.known[at] == token, self.value[at]


def _items(counts: DataFrame, items: int) -> tuple[np.ndarray, np.ndarray]:
    """The items and their counts, the most frequent first: at most `items` rows, whatever the corpus."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)  # some 500 steps at most
    steps = sorted((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect())
    least, room = 1 << 62, items
    for s, k in reversed(steps):
        if k > room:
            break
        least, room = s, room - k
    most = counts.where(step >= least).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    return most["word"].to_numpy(np.int64).view(np.uint64), most["n"].to_numpy(np.int64)


def _pairs(shared):
    """Pairs of items that follow each other, as before << 32 | item; before is ITEMS at the start of a text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for piece in chunks(batches, "text"):
            token, first = _tokens(piece.column("text"))
            known, item = shared.value.find(token)
            before, fine = np.concatenate([[0], item[:-1]]), np.concatenate([[False], known[:-1]])
            before[first[:-1]], fine[first[:-1]] = ITEMS, True
            yield (before[fine & known] << 32 | item[fine & known]).view(np.uint64)

    return lambda batches: _counted(keys(batches), ("pair", "n"))


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 on: the lowest bytes of all, then the next ones, and so on up to the highest that isn't 0."""
    wide = max(1, -(-int(x.max()).bit_length() // 8))
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(len(x), 8)[:, :wide].T).tobytes()


def _whole(planes: pa.Scalar, n: int) -> np.ndarray:
    flat = np.frombuffer(planes.as_buffer(), np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(flat)] = flat.T
    return out.view(np.int64).ravel()


CONTEXT_ROWS = "n_items int, n_contexts int, items binary, sizes binary, contexts binary, counts binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of the items of a task, near PACKED of them a row, all of an item in one row: distinct items, how many contexts each has, the
    contexts and their counts. context is an item after it, or 1 << 20 | item before it."""
    got = [tuple(b.column(c).to_numpy() for c in ("item", "context", "n")) for b in batches if b.num_rows]
    if got:
        rows = [np.concatenate(x) for x in zip(*got, strict=True)]
        order = np.argsort(rows[0], kind="stable")
        item = rows[0][order]
        first = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item))
        own, at = item[first[:-1]], 0
        while at < len(own):
            end = max(at + 1, int(np.searchsorted(first, first[at] + PACKED, "right")) - 1)
            some = order[first[at] : first[end]]
            parts = own[at:end], np.diff(first[at : end + 1]), rows[1][some], rows[2][some]
            sizes = [pa.array([n], pa.int32()) for n in (end - at, len(some))]
            yield pa.RecordBatch.from_arrays([*sizes, *[pa.array([_planes(x)], pa.binary()) for x in parts]], names=["n_items", "n_contexts", "items", "sizes", "contexts", "counts"])
            at = end


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of _gather: distinct items, the number of each context's among them, contexts and counts."""
    for b in batches:
        for k in range(b.num_rows):
            few, many = b.column("n_items")[k].as_py(), b.column("n_contexts")[k].as_py()
            item, sizes, context, n = (_whole(b.column(c)[k], size) for c, size in (("items", few), ("sizes", few), ("contexts", many), ("counts", many)))
            yield item, np.repeat(np.arange(len(item)), sizes), context, n


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows in the order of the first column, some RUN at a time, none of its values in two pieces: its distinct values,
    the number of each row's among them, and the other columns."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def whole() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def cut(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        own, row = np.unique(rows[0], return_inverse=True)
        return own, row, *rows[1:]

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy() for c in names))
            size += b.num_rows
            if size > RUN:
                rows = whole()
                at = int(np.searchsorted(rows[0], rows[0][-1]))  # the last value may go on
                if at:
                    yield cut(tuple(x[:at] for x in rows))
                held = [tuple(x[at:] for x in rows)]
                size = len(rows[0]) - at
    if held:
        yield cut(whole())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _cells(row: np.ndarray, code: np.ndarray, n: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n by (row, code)."""
    key, back = np.unique(row * wide + code, return_inverse=True)
    return key // wide, key % wide, np.bincount(back, n)


def best_classes(item: np.ndarray, row: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best class of each item against the class bigrams: own is the class of every item (OTHER: none yet; the last the start of
    a text), steps[k, j] how often class j follows k, its last row being the start. An item's own counts are taken out of its class first."""
    size, after = steps.sum(0), context < (1 << 20)
    code = own[context & ((1 << 20) - 1)].astype(np.int64)
    weight = np.bincount(row, np.where(after, 0, n), len(item))
    fine = (code != OTHER) & ((context & ((1 << 20) - 1)) != item[row])
    gains = np.zeros((len(item), CLASSES))
    now = own[item].astype(np.int64)
    placed = np.flatnonzero(now != OTHER)
    kept = np.zeros(len(item))
    for side, at in ((steps, fine & after & (code < CLASSES)), (steps.T, fine & ~after)):
        r, c, m = _cells(row[at], code[at], n[at], CONTEXTS)
        for part in range(0, len(r), 1 << 16):
            p = slice(part, part + (1 << 16))
            base = side[:CLASSES, c[p]].T
            more = _xlogx(base + m[p, None]) - _xlogx(base)
            at = np.flatnonzero(np.append(True, r[p][1:] != r[p][:-1]))  # the entries of an item stand together
            gains[r[p][at]] += np.add.reduceat(more, at)
        mine = now[r]
        has = mine != OTHER
        held = side[np.where(has, mine, 0), c]
        kept += np.bincount(r, np.where(has, _xlogx(held) - _xlogx(np.maximum(held - m, 0)), 0), len(item))
    gains -= 2 * (_xlogx(size + weight[:, None]) - _xlogx(size))
    mine = size[np.where(now == OTHER, 0, now)]
    gains[placed, now[placed]] = (kept - 2 * (_xlogx(mine) - _xlogx(np.maximum(mine - weight, 0))))[placed]
    return gains.argmax(1)


def likelihood(steps: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what no class changes."""
    return float(_xlogx(steps).sum() - _xlogx(steps.sum(0)).sum() - _xlogx(steps.sum(1)).sum())


def _move(shared, turn: int, share: int):
    """New classes of the items that have none, or else of one item in `share`, those whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, steps = shared.value
        for item, row, context, n in _held(batches):
            asked = mix(item.astype(np.uint64) + np.uint64(turn << 32)) % np.uint64(share) == 0 if turn else own[item] == OTHER
            if asked.any():
                some = asked[row]
                best = best_classes(item[asked], (np.cumsum(asked) - 1)[row[some]], context[some], n[some].astype(np.float64), own, steps)
                yield pa.RecordBatch.from_arrays([pa.array(item[asked].astype(np.int32)), pa.array(best.astype(np.int32))], names=["item", "class"])

    return run


def _steps(shared):
    """How often classes follow each other, as before * CONTEXTS + class: from the items before each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.zeros(CONTEXTS * CONTEXTS), shared.value
        for item, row, context, n in _held(batches):
            at = context >= 1 << 20
            seen += np.bincount(own[context[at] - (1 << 20)].astype(np.int64) * CONTEXTS + own[item[row[at]]], n[at], len(seen))
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell].astype(np.int64))], names=["cell", "n"])

    return run


def _table(cells: DataFrame) -> np.ndarray:
    """[CLASSES + 1, CLASSES] of rows (cell, n): class pairs, the start of a text last."""
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CONTEXTS squared rows at most
    seen = np.zeros(CONTEXTS * CONTEXTS)
    seen[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return seen.reshape(CONTEXTS, CONTEXTS)[: CLASSES + 1, :CLASSES]


def cluster(pairs: DataFrame, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item and the class bigrams, by exchange over pairs (pair, n)."""
    spark = pairs.sparkSession
    context = spark.sparkContext
    before, item = F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")
    seed = min(SEED, items)
    top = pairs.select(before.alias("b"), item.alias("i"), "n").where((F.col("i") < seed) & ((F.col("b") < seed) | (F.col("b") == ITEMS))).toPandas()  # SEED squared rows at most
    few = np.zeros((seed + 1, seed), np.int64)
    few[np.minimum(top["b"].to_numpy(np.int64), seed), top["i"].to_numpy(np.int64)] = top["n"].to_numpy(np.int64)
    own = np.full(ITEMS + 1, OTHER, np.uint8)
    own[ITEMS] = START
    own[:seed] = exchange(few)

    sides = F.array(F.struct(before.alias("item"), item.alias("context"), "n"), F.struct(item.alias("item"), (before + (1 << 20)).alias("context"), "n"))
    both = pairs.select(F.explode(sides).alias("x")).select("x.*").where(F.col("item") < ITEMS)
    parts = max(1, -(-2 * pairs.count() // PAIRS))
    contexts = stored(both.repartition(parts, "item").mapInArrow(_gather, CONTEXT_ROWS), "contexts")

    def counted(classes: np.ndarray) -> np.ndarray:
        return _table(contexts.mapInArrow(_steps(context.broadcast(classes)), "cell long, n long"))

    steps, share = counted(own), 4
    for turn in range(ROUNDS + 1 if items > seed else 0):
        moved = contexts.mapInArrow(_move(context.broadcast((own, steps)), turn, share), "item int, class int").toPandas()  # ITEMS rows at most
        fresh = own.copy()
        fresh[moved["item"].to_numpy(np.int64)] = moved["class"].to_numpy(np.uint8)
        then = counted(fresh)
        if turn == 0 or likelihood(then) > likelihood(steps):
            own, steps = fresh, then
        else:  # too many moved beside each other
            share *= 4
    lone = np.flatnonzero(own[:items] == OTHER)  # items that never stand beside another
    own[lone] = lone % CLASSES
    return own, steps


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item by exchange clustering. pairs[i, j] counts item j after item i; the last row
    is the start of a text, a class of its own that doesn't move."""
    items = pairs.shape[1]
    weight = pairs.sum(0)
    order = np.argsort(-weight, kind="stable")
    own = np.empty(items, np.int64)
    own[order] = np.minimum(np.arange(items), np.arange(items) % classes)
    pairs = pairs.astype(np.float64)
    after, start = pairs[:items], pairs[items]
    rest = after - np.diag(np.diag(after))
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    one = np.zeros((items, classes))
    one[np.arange(items), own] = 1
    right = rest @ one  # of item i, followed by class k; without itself
    left = rest.T @ one
    table = one.T @ after @ one
    begin = start @ one
    size = one.T @ weight
    for _ in range(rounds):
        moved = 0
        for i in order:
            if not weight[i]:
                continue
            a, twice = own[i], after[i, i]
            r, q = right[i], left[i]
            table[a] -= r
            table[:, a] -= q
            table[a, a] -= twice
            begin[a] -= start[i]
            size[a] -= weight[i]
            # the gain of each class k: its row and column with the item, less those without
            rows, cols = xlogx(table + r) - xlogx(table), xlogx(table + q[:, None]) - xlogx(table)
            diagonal = np.diag(table)
            gain = rows.sum(1) + cols.sum(0) - np.diag(rows) - np.diag(cols)
            gain += xlogx(diagonal + r + q + twice) - xlogx(diagonal)
            gain += xlogx(begin + start[i]) - xlogx(begin) - 2 * (xlogx(size + weight[i]) - xlogx(size))
            k = int(gain.argmax())
            if gain[k] <= gain[a] + 1e-9:
                k = a
            table[k] += r
            table[:, k] += q
            table[k, k] += twice
            begin[k] += start[i]
            size[k] += weight[i]
            if k != a:
                own[i] = k
                moved += 1
                right[:, a] -= rest[:, i]
                right[:, k] += rest[:, i]
                left[:, a] -= rest[i]
                left[:, k] += rest[i]
        if not moved:
            break
    return own


@dataclass
class Model:
    items: Lexicon  # the number of each item
    own: np.ndarray  # the class of each item
    counts: np.ndarray  # the count of each item
    total: int
    kinds: int
    unknown: int  # the class of the unknown word
    factor: np.ndarray  # log10 of what multiplies c + 1: [class before (START: none), class]


def _coded(model_items: Lexicon, own: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens, where each text's begin, which are items, their numbers, and the class of each (OTHER for words that are no items)."""
    token, first = _tokens(texts)
    known, item = model_items.find(token)
    return token, first, known, item, np.where(known, own[item], OTHER).astype(np.uint8)


def _contexts(shared):
    """A row per training token that is no item: the word, and class before * CONTEXTS + class after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            token, first, known, _, code = _coded(*shared.value, piece.column("text"))
            before = np.concatenate([[START], code[:-1]]).astype(np.int32)
            before[first[:-1]] = START
            after = np.append(code[1:], OTHER).astype(np.int32)  # a word that is no item isn't the last of its text if the end is an item
            after[first[1:] - 1] = OTHER
            yield pa.RecordBatch.from_arrays([pa.array(token[~known].view(np.int64)), pa.array((before * CONTEXTS + after)[~known])], names=["word", "code"])

    return run


def _classed(shared):
    """word, class and n of words (word, code), in the order of the words, and the class pairs that come with them (cell, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        seen = np.zeros(CONTEXTS * CONTEXTS)
        for word, row, code in _runs(batches, "word", "code"):
            row, code, n = _cells(row, code.astype(np.int64), np.ones(len(row)), CONTEXTS * CONTEXTS)
            gains = np.zeros((len(word), CLASSES))
            for k in range(0, len(row), 1 << 15):
                p = slice(k, k + (1 << 15))
                at = np.flatnonzero(np.append(True, row[p][1:] != row[p][:-1]))  # the entries of a word stand together
                gains[row[p][at]] += np.add.reduceat(fit[code[p]] * n[p, None], at)
            best = gains.argmax(1)
            own = best[row]
            for cell in (code // CONTEXTS * CONTEXTS + own, own * CONTEXTS + code % CONTEXTS):
                seen += np.bincount(cell, n, len(seen))
            count = np.bincount(row, n, len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best.astype(np.int32)), pa.nulls(len(word), pa.int64()), pa.array(count)], names=["word", "class", "cell", "n"])
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cell), pa.int64()), pa.nulls(len(cell), pa.int32()), pa.array(cell), pa.array(seen[cell].astype(np.int64))], names=["word", "class", "cell", "n"])

    return run


def _fit(steps: np.ndarray) -> np.ndarray:
    """[code, class]: log P(class | class before) + log P(class after | class), as far as these are known."""
    p = (steps + 0.1) / (steps + 0.1).sum(1, keepdims=True)
    prior = np.log(steps.sum(0) + 0.1)
    into = np.vstack([np.log(p), (prior - np.log(np.exp(prior - prior.max()).sum()) - prior.max())[None]])
    out = np.vstack([np.log(p[:CLASSES]).T, np.zeros((2, CLASSES))])
    return (into[:, None] + out[None]).reshape(-1, CLASSES)


def train(docs: DataFrame, most: int = ITEMS) -> tuple[Model, DataFrame]:
    """The model of docs (text) with at most `most` items, and the distributed table (word, class, n) of all other words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = stored(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known, n = _items(counts, most)
    sort = np.argsort(known)
    items = Lexicon(known[sort], sort)
    pairs = stored(texts.mapInArrow(_pairs(spark.sparkContext.broadcast(items)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    own, steps = cluster(pairs, len(known))

    # words that are no items: their contexts all over the corpus; a word counted more than t times is an item, so none is hot
    shared = spark.sparkContext.broadcast((items, own))
    rare = texts.mapInArrow(_contexts(shared), "word long, code int").repartition("word").sortWithinPartitions("word")
    placed = stored(rare.mapInArrow(_classed(spark.sparkContext.broadcast(_fit(steps))), "word long, class int, cell long, n long"), "classes")
    others = placed.where("word IS NOT NULL").select("word", "class", "n")
    sizes = others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).toPandas()  # CLASSES rows at most
    classes = own[: len(known)].astype(np.int64)
    mass = np.bincount(classes, n + 1.0, CLASSES).astype(np.float64)
    at = sizes["class"].to_numpy(np.int64)
    mass[at] += sizes["n"].to_numpy(np.float64) + sizes["kinds"].to_numpy(np.float64)
    once = np.bincount(classes, n == 1, CLASSES).astype(np.float64)
    once[at] += sizes["once"].to_numpy(np.float64)
    unknown = int(once.argmax())
    mass[unknown] += 1
    steps = steps + _table(placed.where("cell IS NOT NULL").select("cell", "n")) + 0.1
    steps[:, mass == 0] = 0  # a class without words
    steps /= steps.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.log10(MIX * np.where(mass > 0, steps / mass, 0) + (1 - MIX) / (total + kinds + 1))
    return Model(items, own, n, int(total), int(kinds), unknown, factor), others


PIECES = "piece long, doc_ids array<long>, first array<int>, own array<double>, n_known array<long>, codes binary, rare array<long>, asked array<long>"


_LONGS = pa.list_(pa.int64())
_PIECE = pa.schema([("piece", pa.int64()), ("doc_ids", _LONGS), ("first", pa.list_(pa.int32())), ("own", pa.list_(pa.float64())), ("n_known", _LONGS), ("codes", pa.binary()), ("rare", _LONGS), ("asked", _LONGS)])


def _pieces(shared):
    """Texts as classes: a row per piece of texts; rare: its words that are no items, in order; asked: the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = TaskContext.get().partitionId() << 32
        for piece in chunks(batches, "text"):
            token, first, known, item, code = _coded(m.items, m.own, piece.column("text"))
            counts = m.counts[item] if len(m.counts) else np.zeros(len(item))
            sums = per_text_sum(np.where(known, np.log10(counts + 1.0), 0.0), first), per_text_sum(known.astype(np.int64), first)
            rare = token[~known].view(np.int64)
            values = number, piece.column("doc_id").to_pylist(), first.astype(np.int32), *sums, code.tobytes(), rare, np.unique(rare)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PIECE, strict=True)], schema=_PIECE)
            number += 1

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, unknown = shared.value
        for b in batches:
            for k in range(b.num_rows):
                first, own, n_known, rare = (b.column(c)[k].values.to_numpy() for c in ("first", "own", "n_known", "rare"))
                code = np.frombuffer(b.column("codes")[k].as_buffer(), np.uint8).copy()
                found = np.zeros(len(rare), np.int64)
                if b.column("told")[k].is_valid and len(rare):
                    told = b.column("told")[k].values
                    word = told.field("word").to_numpy()
                    sort = np.argsort(word)
                    has, at = Lexicon(word[sort], sort).find(rare)
                    found = np.where(has, told.field("n").to_numpy()[at], 0)
                    classes = np.where(has, told.field("class").to_numpy()[at], unknown)
                else:
                    classes = np.full(len(rare), unknown)
                place = np.flatnonzero(code == OTHER)
                code[place] = classes
                before = np.concatenate([[START], code[:-1]])
                before[first[:-1]] = START
                cost = np.zeros((2, len(code)))
                cost[0, place], cost[1, place] = np.log10(found + 1.0), found > 0
                own = own + per_text_sum(cost[0], first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[k].values, pa.array(np.diff(first).astype(np.int64)), pa.array(n_known + per_text_sum(cost[1], first).astype(np.int64)), pa.array(own), pa.array(own + per_text_sum(factor[before, code], first))],
                    names=["doc_id", "n_tokens", "n_known", "own", "score"],
                )

    return run


def score(docs: DataFrame, model: Model, others: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(context.broadcast(model)), PIECES), "pieces")
    met = pieces.select("piece", F.explode("asked").alias("word")).join(others.hint("merge"), "word")
    told = met.groupBy("piece").agg(F.collect_list(F.struct("word", "class", "n")).alias("told"))  # the words of one piece
    out = pieces.drop("asked").join(told.hint("merge"), "piece", "left").mapInArrow(_score(context.broadcast((model.factor, model.unknown))), "doc_id long, n_tokens long, n_known long, own double, score double")
    size = float(np.log10(model.total + model.kinds + 1))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("own") - F.col("n_tokens") * F.lit(size)).alias("base_score"), "score")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 7) == 2
    return score(docs, *train(docs.where(~held))).withColumn("held_out", held)
