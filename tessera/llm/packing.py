"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length.

Every source is a queue of its documents' tokens, however many sources there are. Queues are served in rounds; a round
is one window of exactly `window` tokens (the last has what is left). In each round a queue is due its quantum (window
tokens x share); what is left of a token stays as its deficit for the next window. A queue that runs dry sends nothing
more and its quantum goes to the others in proportion, so every window is full. The windows, one after another, are cut
into sequences of `length` tokens.

Deficits follow from the window's number. Queues are the leaves of a binary tree; of the N tokens that a node has sent
after a round, the left branch has sent the whole part of its share and the right branch the others. Both only grow as
N does, so the tokens that a queue has sent after any round, and the place of its turn in it, come from the totals on
its path alone, in as many steps as the tree is deep. Tasks so place their documents without waiting for each other,
given where each queue stands at the start of their part of the table (a prefix sum over parts), and deficits carry
across windows and partitions alike. A queue's share of any stretch of windows is within a few tokens of its due: less
than two for two-way splits by size.

Shares default to the sources' shares of all tokens, so all queues end in the same window. Others are given as integer
weights of named sources; sources without a weight are one queue of weight 1 together and share it by their sizes. The
paths of the queues are rows of a table, joined to the documents; only the weights, which the caller gives, are sent to
all. The tail shorter than a sequence is cut at powers of two, so that no sequence needs padding.

Nulls: a null text is empty and has its end id only; null sources are a queue of their own (weight by the name None);
null doc_ids are carried. Repeated rows are packed each. An empty table gives no pieces. Long texts span windows. Only
doc_id, source and text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import _arrow_schema, steps, store, text_or_empty
from tessera.llm.tokens import DEFAULT_VOCABULARY, encoder

LENGTH = 1024
#: Queues whose paths and turns a task keeps at hand; it reads or finds others again.
CURSORS = 10_000
#: Sequences to a window of the mixture.
WINDOW_SEQUENCES = 16
#: Up to so many (part, queue) starts are sent to all executors (about 40 bytes each, and 30 for every doubling of the number of queues); more are joined by a shuffle.
BROADCAST_STARTS = 50_000
TOKENS = "doc_id long, queue string, part int, at long, n long, width int, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, window long"


def tokenised(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 0, scope: str = "op") -> DataFrame:
    """doc_id, queue, the task's number, the tokens of the queue before it in that task, its own, and its ids; stored."""
    fields = _arrow_schema(docs.sparkSession, TOKENS)
    queue = F.concat(F.lit("s:"), F.col("source").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(queue, F.lit("null")), text_or_empty())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        width = 2 if encode.code == "H" else 4
        end = end_id.to_bytes(width, "little")
        part, before = TaskContext.get().partitionId(), {}
        for batch in steps(batches):
            queues = batch.column(1).to_pylist()
            ids = [encode.encode(t) + end for t in batch.column(2).to_pylist()]
            at, n = [], [len(x) // width for x in ids]
            for q, k in zip(queues, n, strict=True):
                at.append(before.get(q, 0))
                before[q] = at[-1] + k
            columns = [batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at), pa.array(n), pa.array([width] * len(n), pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
        encode.forget()

    return store(rows.mapInArrow(run, TOKENS), "pack-tokens", scope)


def queue_paths(totals: DataFrame) -> DataFrame:
    """(queue, total, path) of totals(queue, total): the nodes above a queue in a tree over the bits of the queues' hashes, from the
    top, each as the total of its left branch, its own, and whether the queue is to the right. Nodes of one branch are left out."""
    queues = totals.select("queue", "total", F.xxhash64("queue").alias("h"))
    at = queues.select("queue", "total", "h", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("depth"))
    at = at.withColumn("node", F.expr("if(depth = 0, 0, shiftrightunsigned(h, 64 - depth))")).withColumn("right", F.expr("shiftrightunsigned(h, 63 - depth) & 1 = 1"))
    nodes = at.groupBy("depth", "node").agg(F.sum(F.when(~F.col("right"), F.col("total")).otherwise(0)).alias("left"), F.sum("total").alias("all"))
    steps = at.join(nodes.filter("left > 0 and left < all"), ["depth", "node"]).groupBy("queue")
    paths = steps.agg(F.sort_array(F.collect_list(F.struct("depth", "left", "all", "right"))).alias("path"))  # at most 64 in a list
    return totals.join(paths, "queue", "left").select("queue", "total", F.coalesce("path", F.expr("cast(array() as array<struct<depth: int, left: bigint, all: bigint, right: boolean>>)")).alias("path"))


class Split:
    """A node of named queues: (total, weight) of those to the left and to the right, which run dry one after another."""

    def __init__(self, left: list[tuple[int, int]], right: list[tuple[int, int]]):
        both = sorted((Fraction(t, w), t, w, True) for t, w in left) + [(Fraction(t, w), t, w, False) for t, w in right]
        self.dry = []  # when a queue runs dry: tokens sent by then, of them to the left; weights that go on, of them to the left
        gone = gone_left = 0
        weight, weight_left = sum(w for *_, w, _ in both), sum(w for _, w in left)
        self.dry.append((0, 0, weight, weight_left, 0))
        for when, t, w, is_left in sorted(both):
            gone, weight = gone + t, weight - w
            if is_left:
                gone_left, weight_left = gone_left + t, weight_left - w
            self.dry.append((gone + weight * when, gone_left, weight, weight_left, gone))
        self.sent = [x[0] for x in self.dry]

    def left(self, n: int) -> int:
        """Of the node's first n tokens, those of the left branch."""
        _, gone_left, weight, weight_left, gone = self.dry[bisect_right(self.sent, n) - 1]
        return gone_left + ((n - gone) * weight_left // weight if weight else 0)


class Mixture:
    """The splits above each named queue and above all others together, for weights of named queues."""

    def __init__(self, total: int, named: dict[str, tuple[int, int]] | None = None):
        """total: tokens of all queues; named: total and weight of the queues that have a weight."""
        self.total = total
        rest = total - sum(t for t, _ in (named or {}).values())
        items = [(q, t, max(1, w)) for q, (t, w) in sorted((named or {}).items()) if t]
        if rest:
            items.append((None, rest, 1))
        self.paths: dict[str | None, list[tuple[Split, bool]]] = {q: [] for q, *_ in items}
        stack = [items]
        while stack:
            group = stack.pop()
            if len(group) > 1:
                left, right = group[: len(group) // 2], group[len(group) // 2 :]
                split = Split([x[1:] for x in left], [x[1:] for x in right])
                for q, *_ in group:
                    self.paths[q].append((split, any(q == x[0] for x in right)))
                stack += [left, right]

    def turn(self, queue: str, path: list[tuple], n: int, then: int) -> tuple[int, int, int]:
        """What the queue has sent when all have sent n tokens, and when they have sent `then`, and what goes before it between."""
        before = 0
        named = queue in self.paths
        for split, right in self.paths[queue if named else None]:
            a, b = split.left(n), split.left(then)
            if right:
                before, n, then = before + b - a, n - a, then - b
            else:
                n, then = a, b
        if not named:
            for _, left, whole, right in path:
                a, b = n * left // whole, then * left // whole
                if right:
                    before, n, then = before + b - a, n - a, then - b
                else:
                    n, then = a, b
        return n, then, before


class RoundRobin:
    """Where each token of each queue goes."""

    def __init__(self, mixture: Mixture, length: int = LENGTH, window: int = WINDOW_SEQUENCES * LENGTH):
        self.mixture, self.window, self.length = mixture, window, length
        self.all = mixture.total
        self.tail = self.all - self.all % length
        self.turns: dict[str, tuple[int, int, int, int]] = {}

    def _turn(self, queue: str, path: list[tuple], rounds: int) -> tuple[int, int, int, int]:
        n = rounds * self.window
        return rounds, *self.mixture.turn(queue, path, min(n, self.all), min(n + self.window, self.all))

    def _turn_of(self, queue: str, path: list[tuple], at: int) -> tuple[int, int, int, int]:
        """The queue's turn with its token `at`: the round, the tokens sent before and by its end, and those before it in the round."""
        turn = self.turns.get(queue)
        if turn and turn[2] <= at:
            turn = self._turn(queue, path, turn[0] + 1)
        if not turn or not turn[1] <= at < turn[2]:
            low, high = 0, -(-self.all // self.window)
            while True:
                turn = self._turn(queue, path, (low + high) // 2)
                if turn[1] > at:
                    high = turn[0]
                elif turn[2] <= at:
                    low = turn[0] + 1
                else:
                    break
        self.turns[queue] = turn
        return turn

    def pieces(self, queue: str, path: list[tuple], at: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(start, length, sequence, offset, window) for a document of n tokens, `at` tokens into its queue."""
        end, first = at + n, at
        while at < end:
            rounds, begin, stop, before = self._turn_of(queue, path, at)
            place, stop = rounds * self.window + before + at - begin, min(end, stop)
            while at < stop:
                sequence, offset, room = self._cut(place)
                k = min(stop - at, room)
                yield at - first, k, sequence, offset, rounds
                at, place = at + k, place + k

    def _cut(self, place: int) -> tuple[int, int, int]:
        """Sequence and offset of a place, and the room from there to the sequence's end."""
        sequence, offset = divmod(place, self.length)
        if place < self.tail:
            return sequence, offset, self.length - offset
        left, begin = self.all - self.tail, 0
        while True:
            size = 1 << (left.bit_length() - 1)
            if offset < begin + size:
                return sequence, offset - begin, begin + size - offset
            sequence, begin, left = sequence + 1, begin + size, left - size


def pack(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 0, weights: dict[str | None, int] | None = None, length: int = LENGTH, window: int = WINDOW_SEQUENCES * LENGTH, scope: str = "op") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, window. weights: by source."""
    spark = docs.sparkSession
    tokens = tokenised(docs, vocabulary, end_id, scope)
    parts = store(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "pack-parts", scope)
    totals = store(parts.groupBy("queue").agg(F.sum("n").alias("total")), "pack-totals", scope)
    given = {"null" if q is None else f"s:{q}": w for q, w in (weights or {}).items()}
    named = {r["queue"]: (r["total"], given[r["queue"]]) for r in totals.filter(F.col("queue").isin(list(given))).collect()} if given else {}
    others = totals.filter(~F.col("queue").isin(list(named))) if named else totals
    paths = queue_paths(others).unionByName(totals.join(others, "queue", "left_anti").select("queue", "total", F.lit(None).alias("path"))) if named else queue_paths(totals)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(paths.select("queue", "path"), "queue")
    starts = store(starts, "pack-starts", scope)
    if parts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, ["part", "queue"]).select("doc_id", "queue", "part", (F.col("base") + F.col("at")).alias("at"), "n", "width", "ids", "path")
    total = totals.agg(F.sum("total")).first()[0] or 0
    return placed.mapInArrow(_placing(total, named, length, window, _arrow_schema(spark, PIECE)), PIECE)


def _placing(total: int, named: dict[str, tuple[int, int]], length: int, window: int, fields: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robin = RoundRobin(Mixture(total, named), length, window)
        known: dict[str, list[tuple]] = {}
        for batch in steps(batches):
            rows = []
            *plain, paths = batch.columns
            for k, (doc, queue, _, at, n, width, ids) in enumerate(zip(*(c.to_pylist() for c in plain), strict=True)):
                if (path := known.get(queue)) is None:
                    path = known[queue] = [tuple(x.values()) for x in paths[k].as_py() or []]
                raw = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                for start, size, sequence, offset, rounds in robin.pieces(queue, path, at, n):
                    rows.append((doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, sequence, offset, queue, rounds))
            if len(known) > CURSORS:
                known.clear()
                robin.turns.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return run


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
