"""Language-model scoring with a probabilistic suffix tree over word classes.

A word's class is the longest of its endings that is in a list of frequent ones (the alphabet, of at most CLASSES; a
short word may be there whole, with the space before it). The tree models the sequence of classes, from a begin to an
end symbol. Counted are all contexts, of up to DEPTH classes, that occur FLOOR times, a number that does not change with
the corpus, so a larger corpus has more of them. A context is retained as a state if its next-class distribution
diverges from that of its longest proper suffix: count x Kullback-Leibler divergence of at least GAIN nats.
Distributions are smoothed by interpolation with the suffix's, weighted by the number of different symbols seen; the
root's are the classes' shares of the additively smoothed word counts. A word is scored by its class in the state of the
longest suffix that is retained, and by its share of its class; a word not known has half a count in its class. With the
root alone this is the unigram model.

How it runs: one pass over the documents gives each word a number in its segment (a bounded stretch of one task's
rows); a segment is stored as one row, its dictionary and its documents as numbers. Dictionaries are summed into one
row per word, all the training counts. Endings and contexts are counted over all words and segments, level by level;
tables of contexts are dealt into parts by their two last symbols, of which one file a part is written to the shared
folder; a task takes the parts one after another. A part of more than PART_ROWS rows is at most the contexts of one pair
of symbols, which the alphabet bounds. Words' counts go back to the segments that have them, where documents are
scored. Nothing that grows with the corpus is broadcast, collected or held by one task.

Nulls: a null text is empty and has the end only; a null doc_id has no fold, so it is neither held out nor trained
on. Repeated rows count each. With no training rows base_score is null and score is that of a model that knows
nothing. An empty table gives no rows. Only doc_id and text are read, whatever other columns are called. Texts are read
whole; a document longer than a segment's bound makes a longer segment.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _arrow_schema, map_arrow, new_path, open_fs, steps, store, text_or_empty, write_file

FOLDS, HELD_OUT = 5, 1
#: Classes at most, their share of all words, the longest ending in bytes.
CLASSES, SHARE, ENDING = 250, 1 / 400, 4
#: Length of contexts in classes (up to 7); how often a context must occur; nats that a state must gain.
DEPTH, FLOOR, GAIN = 4, 1000, 30.0
#: Rows of (context, symbol) in a part of the tree, 16 bytes each.
PART_ROWS = 4_000_000
SEGMENT_TOKENS, SEGMENT_WORDS = 2_000_000, 500_000
END, BEGIN, OTHER = 0, 1, 2  # symbols; endings follow
SEGMENT = "segment long, docs binary, nulls binary, folds binary, lengths binary, ids binary, words binary, c binary, c_last binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


# --- Segments -----------------------------------------------------------------------------------------------


class _Segment:
    """Documents as numbers of words, and the words by number."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.docs, self.folds, self.ids, self.tokens = [], [], [], 0

    def add(self, doc: int | None, fold_: int | None, text: str) -> None:
        ids = np.fromiter(map(self.numbers.__getitem__, text.encode().lower().split()), np.int32)
        self.docs.append(doc)
        self.folds.append(-1 if fold_ is None else fold_)
        self.ids.append(ids)
        self.tokens += len(ids)

    def full(self) -> bool:
        return self.tokens >= SEGMENT_TOKENS or len(self.numbers) >= SEGMENT_WORDS

    def row(self, number: int, fields: pa.Schema) -> pa.RecordBatch:
        folds = np.array(self.folds, np.int8)
        trained = [x for x, f in zip(self.ids, folds, strict=True) if f >= 0 and f != HELD_OUT and len(x)]
        size = len(self.numbers)
        c = np.bincount(np.concatenate(trained), minlength=size) if trained else np.zeros(size, np.int64)
        c_last = np.bincount([x[-1] for x in trained], minlength=size) if trained else np.zeros(size, np.int64)
        columns = [
            number, np.array([d or 0 for d in self.docs], np.int64).tobytes(), np.array([d is None for d in self.docs], np.uint8).tobytes(),
            folds.tobytes(), np.array([len(x) for x in self.ids], np.int64).tobytes(), np.concatenate(self.ids).astype(np.int32).tobytes(),
            b" ".join(self.numbers), c.astype(np.int64).tobytes(), c_last.astype(np.int64).tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)


def _segments(docs: DataFrame, scope: str) -> DataFrame:
    fields = _arrow_schema(docs.sparkSession, SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 20, _Segment()
        for batch in steps(batches):
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 2, 1)), strict=True):
                segment.add(*row)
                if segment.full():
                    yield segment.row(number, fields)
                    number, segment = number + 1, _Segment()
        if segment.docs:
            yield segment.row(number, fields)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty(), fold(F.col("doc_id")).alias("fold"))
    return store(rows.mapInArrow(run, SEGMENT), "lm-segments", scope)


def _entries(segments: DataFrame) -> DataFrame:
    """(segment, number, word, c, c_last) for every word of every segment; made again where it is used, which is cheaper than keeping it."""
    schema = "segment long, number int, word binary, c long, c_last long"
    fields = _arrow_schema(segments.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1)[k].as_py().split()
                c, c_last = (np.frombuffer(batch.column(j)[k].as_buffer(), np.int64) for j in (2, 3))
                columns = [np.full(len(words), batch.column(0)[k].as_py()), np.arange(len(words), dtype=np.int32), words, c, c_last]
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return segments.select("segment", "words", "c", "c_last").mapInArrow(run, schema)


# --- Classes ------------------------------------------------------------------------------------------------


def _packed(data: np.ndarray, length: int, last: bool = False) -> np.ndarray:
    """The `length` bytes before each place (or up to it, with `last`), packed, the nearest lowest."""
    packed = np.zeros(len(data), np.uint64)
    for k in range(length):
        back = k + (not last)
        packed[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * k)
    return packed


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << 8 * length) - 1)


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in sorted_keys, -1 where it isn't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _endings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last ENDING bytes of each word after its space, packed, and how many of them there are."""
    data = np.frombuffer(b" " + b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return _packed(data, ENDING, last=True)[np.cumsum(sizes) - 1], np.minimum(sizes, ENDING)


class Classes:
    """Symbols of words: by length, the endings that are classes, sorted, and their symbols."""

    def __init__(self, endings: list[tuple[int, int]]):
        self.endings = [np.array(sorted(e for n, e in endings if n == k), np.uint64) for k in range(1, ENDING + 1)]
        starts = np.cumsum([OTHER + 1] + [len(x) for x in self.endings])
        self.symbols = [np.arange(len(x)) + at for x, at in zip(self.endings, starts, strict=False)]
        self.size = int(starts[-1])

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.full(len(words), OTHER, np.uint8)
        if words:
            packed, sizes = _endings(words)
            for length in range(1, ENDING + 1):  # longer ones last
                at = _member(self.endings[length - 1], packed & _mask(length))
                use = (at >= 0) & (sizes >= length)
                found[use] = self.symbols[length - 1][at[use]]
        return found


def _choose_classes(words: DataFrame, total: int) -> Classes:
    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            packed, sizes = _endings(batch.column(0).to_pylist())
            c = batch.column(1).to_numpy()
            lengths, keys, sums = [], [], []
            for length in range(1, ENDING + 1):
                found, inverse = np.unique(packed[sizes >= length] & _mask(length), return_inverse=True)
                keys.append(found.view(np.int64))
                sums.append(np.bincount(inverse, c[sizes >= length], len(found)).astype(np.int64))
                lengths.append(np.full(len(found), length))
            return {"length": np.concatenate(lengths), "ending": np.concatenate(keys), "n": np.concatenate(sums)}

        return step

    counts = map_arrow(words.filter("c > 0").select("word", "c"), "length long, ending long, n long", make, rows=50_000)
    counts = counts.groupBy("length", "ending").agg(F.sum("n").alias("n")).filter(F.col("n") >= SHARE * total)
    chosen = counts.orderBy(F.desc("n"), "length", "ending").limit(CLASSES).collect()
    return Classes([(r["length"], r["ending"]) for r in chosen])


# --- The tree -----------------------------------------------------------------------------------------------


def _sequences(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents one after another, each between BEGIN and END, and each place's distance from its BEGIN."""
    sizes = lengths + 2
    starts = np.cumsum(sizes) - sizes
    data = np.empty(int(sizes.sum()), np.uint8)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    data[starts] = BEGIN
    ends = starts + sizes - 1
    data[ends] = END
    inner = np.ones(len(data), bool)
    inner[starts] = inner[ends] = False
    data[inner] = symbols
    return data, place


def part_of(contexts: np.ndarray, parts: int) -> np.ndarray:
    """The part that has a context and its longer and shorter ones down to two symbols."""
    return (contexts & np.uint64(0xFFFF)) % np.uint64(parts)


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    write_file(folder, name, [out.getvalue()])


@lru_cache(maxsize=2)
def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    """A part's arrays; none if nothing fell into it. Files of a folder never change."""
    from pyarrow import fs

    filesystem, top = open_fs(folder)
    if filesystem.get_file_info(f"{top}/{name}").type == fs.FileType.NotFound:
        return {}
    with filesystem.open_input_file(f"{top}/{name}") as f, np.load(io.BytesIO(f.read())) as held:
        return dict(held)


def _parts(rows: DataFrame, parts: int, folder: str, make: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> None:
    """Write make(level, key, n) of the rows(level, key, n) of each part as a file of the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> None:
            level, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            _save(folder, f"{part}.npz", make(level, key.view(np.uint64), n))

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for one in np.unique(numbers).tolist():  # parts come in order
                use = pa.array(numbers == one)
                if one != part and held:
                    done()
                    held.clear()
                part = one
                held.append(tuple(batch.column(k).filter(use).to_numpy() for k in (1, 2, 3)))
        if held:
            done()
        yield from ()

    pair = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = rows.select((pair % parts).cast("int").alias("part"), F.col("level").cast("int").alias("level"), "key", F.col("n").cast("long").alias("n"))
    dealt.repartition(max(1, min(parts, 4096)), "part").sortWithinPartitions("part").mapInArrow(run, "done int").count()


def _level_counts(segments: DataFrame, classes: Classes, length: int, folder: str | None, parts: int) -> DataFrame:
    """(key, n): how often each symbol follows each context of a length that the folder's files have (None: each); key: context, then symbol."""
    state = segments.sparkSession.sparkContext.broadcast(classes)  # of a bounded size

    def make():
        own = state.value

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            words = batch.column(0)[0].as_py().split()
            lengths, ids = np.frombuffer(batch.column(1)[0].as_buffer(), np.int64), np.frombuffer(batch.column(2)[0].as_buffer(), np.int32)
            folds = np.frombuffer(batch.column(3)[0].as_buffer(), np.int8)
            trained = (folds >= 0) & (folds != HELD_OUT)
            ids = ids[np.repeat(trained, lengths)]
            data, place = _sequences(own.of(words)[ids], lengths[trained])
            context = _packed(data, length)
            able = place >= length
            keys, n = np.unique((context[able] << np.uint64(8)) | data[able].astype(np.uint64), return_counts=True)
            if folder is not None:
                contexts = keys >> np.uint64(8)
                use, at = np.zeros(len(keys), bool), part_of(contexts, parts)
                for part in range(parts):
                    mine = np.flatnonzero(at == part)
                    use[mine] = _member(_load(folder, f"{part}.npz").get("key", np.zeros(0, np.uint64)), contexts[mine]) >= 0
                keys, n = keys[use], n[use]
            return {"key": keys.view(np.int64), "n": n}

        return step

    counts = map_arrow(segments.select("words", "lengths", "ids", "folds"), "key long, n long", make, rows=1)
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


class SuffixTree:
    """Distributions of contexts, level by level: a seen symbol has a probability; others share `back` of the suffix's."""

    def __init__(self, shares: np.ndarray):
        self.shares = shares
        self.contexts, self.back, self.kept, self.keys, self.p = [], [], [], [], []

    def add(self, keys: np.ndarray, n: np.ndarray, gain: float) -> None:
        """The next level, from the counts n of context-and-symbol keys."""
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        contexts, first, owner, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True, return_counts=True)
        symbols = (keys & np.uint64(255)).astype(np.int64)
        size = np.add.reduceat(n, first) if len(n) else np.zeros(0)
        parent = self.of(len(self.contexts), keys >> np.uint64(8), symbols)
        p = (n + kinds[owner] * parent) / (size + kinds)[owner]
        back = kinds / (size + kinds)
        gained = np.add.reduceat(p * np.log(p / parent), first) if len(n) else np.zeros(0)
        rest = np.maximum(0, 1 - np.add.reduceat(parent, first)) if len(n) else np.zeros(0)
        kept = size * (gained + back * rest * np.log(back)) >= gain
        for held, new in zip((self.contexts, self.back, self.kept, self.keys, self.p), (contexts, back, kept, keys, p), strict=True):
            held.append(new)

    def of(self, level: int, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Probabilities of symbols after contexts cut to a level that has them."""
        if level == 0:
            return self.shares[symbols]
        contexts = contexts & _mask(level)
        at = _member(self.keys[level - 1], (contexts << np.uint64(8)) | symbols.astype(np.uint64))
        found = self.p[level - 1][np.maximum(at, 0)] if len(self.p[level - 1]) else np.zeros(len(at))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            own = _member(self.contexts[level - 1], contexts[unseen])
            found[unseen] = self.back[level - 1][own] * self.of(level - 1, contexts[unseen], symbols[unseen])
        return found

    def longest(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Probabilities in the states of the longest suffixes that are retained."""
        found, left = np.zeros(len(contexts)), np.arange(len(contexts))
        for level in range(len(self.contexts), -1, -1):
            if level:
                at = _member(self.contexts[level - 1], contexts[left] & _mask(level))
                state = (at >= 0) & self.kept[level - 1][np.maximum(at, 0)] if len(self.kept[level - 1]) else np.zeros(len(left), bool)
            else:
                state = np.ones(len(left), bool)
            now = left[state]
            found[now] = self.of(level, contexts[now], symbols[now])
            left = left[~state]
        return found

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("contexts", "back", "kept", "keys", "p")
        return {f"{name}{k}": x for name in names for k, x in enumerate(getattr(self, name))} | {"levels": np.array(len(self.contexts)), "shares": self.shares}

    @classmethod
    def from_arrays(cls, held: dict[str, np.ndarray]) -> SuffixTree:
        tree = cls(held["shares"])
        for name in ("contexts", "back", "kept", "keys", "p"):
            setattr(tree, name, [held[f"{name}{k}"] for k in range(int(held["levels"]))])
        return tree


class StoredTree:
    """A tree in files by part, and its first level, which a part without a file has alone."""

    def __init__(self, folder: str, parts: int, top: SuffixTree):
        self.folder, self.parts, self.top = folder, parts, top

    def score(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each document's symbols and its end."""
        data, place = _sequences(symbols, lengths)
        context = _packed(data, DEPTH)
        for length in range(1, DEPTH):  # what is before the begin belongs to another document
            short = place == length
            context[short] &= _mask(length)
        scored = place > 0
        keys, inverse = np.unique((context[scored] << np.uint64(8)) | data[scored].astype(np.uint64), return_inverse=True)
        contexts, following = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
        found, at = np.zeros(len(keys)), part_of(contexts, self.parts)
        for part in range(self.parts):
            mine = np.flatnonzero(at == part)
            if len(mine):
                held = _load(self.folder, f"{part}.npz")
                found[mine] = (SuffixTree.from_arrays(held) if held else self.top).longest(contexts[mine], following[mine])
        with np.errstate(divide="ignore"):
            logp = np.zeros(len(data))
            logp[scored] = np.log10(found)[inverse]
        owner = np.repeat(np.arange(len(lengths)), lengths + 2)
        return np.bincount(owner, logp, len(lengths)) if len(lengths) else np.zeros(0)


def learn(segments: DataFrame, classes: Classes, shares: np.ndarray, scope: str, depth: int = DEPTH, floor: int = FLOOR, gain: float = GAIN) -> StoredTree:
    """The tree of the segments' training documents; shares: the root's probability of each of 256 symbols."""
    spark = segments.sparkSession
    rows = _level_counts(segments, classes, 1, None, 1).collect()  # at most a row for two symbols of the alphabet
    keys, n = np.array([r["key"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    top = SuffixTree(shares)
    sizes = np.bincount((keys >> np.uint64(8)).astype(np.int64), n, 256)
    use = sizes[(keys >> np.uint64(8)).astype(np.int64)] >= floor
    top.add(keys[use], n[use], gain)
    counts, deeper = spark.createDataFrame([(int(k), int(m)) for k, m in zip(keys.view(np.int64), n, strict=True)], "key long, n long"), []
    for length in range(2, depth + 1):
        # A context and the symbol after it are a context themselves, as often, unless the text ends there.
        frequent = counts.filter((F.col("n") >= floor) & (F.col("key").bitwiseAND(F.lit(255)) != END))
        frequent = store(frequent.select(F.shiftleft("key", 8).alias("key"), "n", F.lit(length).alias("level")), "lm-frequent", scope)
        many = frequent.count()
        if not many:
            break
        parts, folder = -(-many // PART_ROWS), new_path(spark, "lm-contexts", scope)
        _parts(frequent, parts, folder, lambda level, key, n: {"key": np.sort(key >> np.uint64(8))})
        counts = store(_level_counts(segments, classes, length, folder, parts), "lm-counts", scope)
        deeper.append(counts.withColumn("level", F.lit(length)))
    folder, parts = new_path(spark, "lm-tree", scope), 1
    if deeper:
        every = reduce(DataFrame.unionByName, deeper)
        parts = -(-every.count() // PART_ROWS) or 1

        def grow(level: np.ndarray, key: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
            tree = SuffixTree.from_arrays(top.arrays())
            for length in range(2, int(level.max()) + 1):
                tree.add(key[level == length], n[level == length], gain)
            return tree.arrays()

        _parts(every, parts, folder, grow)
    return StoredTree(folder, parts, top)


# --- Scoring ------------------------------------------------------------------------------------------------


class _Model:
    def __init__(self, classes: Classes, tree: StoredTree, mass: np.ndarray, scale: float, ends: int, total: int):
        self.classes, self.tree, self.mass, self.scale, self.ends, self.total = classes, tree, mass, scale, ends, total

    def rows(self, segment: dict, c: np.ndarray, fields: pa.Schema) -> pa.Table:
        lengths, ids = np.frombuffer(segment["lengths"], np.int64), np.frombuffer(segment["ids"], np.int32)
        folds = np.frombuffer(segment["folds"], np.int8)
        symbols = self.classes.of(segment["words"].split())
        base = np.log10((c + 0.5) / self.scale)
        share = base - np.log10(self.mass[symbols])

        def sums(values: np.ndarray) -> np.ndarray:
            owner = np.repeat(np.arange(len(lengths)), lengths)
            return np.bincount(owner, values[ids], len(lengths)) if len(ids) else np.zeros(len(lengths))

        n = len(lengths)
        known = sums((c > 0).astype(float)).astype(np.int64) + (self.ends > 0)
        score = self.tree.score(symbols[ids], lengths) + sums(share)
        base_score = sums(base) + np.log10((self.ends + 0.5) / self.scale)
        return pa.table(
            [
                pa.array(np.frombuffer(segment["docs"], np.int64), mask=np.frombuffer(segment["nulls"], np.uint8).astype(bool)),
                pa.array(folds == HELD_OUT), pa.array(lengths + 1), pa.array(known), pa.array(np.full(n, self.total)),
                pa.array(base_score) if self.total else pa.nulls(n, pa.float64()), pa.array(score),
            ],
            schema=fields,
        )


def _class_mass(words: DataFrame, classes: Classes, scale: float, ends: int) -> np.ndarray:
    """The smoothed share of each symbol's words, with half a count for one not known."""
    state = words.sparkSession.sparkContext.broadcast(classes)

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            symbols = state.value.of(batch.column(0).to_pylist())
            sums = np.bincount(symbols, batch.column(1).to_numpy() + 0.5, 256)
            at = np.flatnonzero(sums)
            return {"symbol": at, "n": sums[at]}

        return step

    mass = np.zeros(256)
    mass[: classes.size] = 0.5
    mass[END], mass[BEGIN] = ends + 0.5, 0
    sums = map_arrow(words.filter("c > 0").select("word", "c"), "symbol long, n double", make, rows=50_000).groupBy("symbol").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # at most one row a class
        mass[r["symbol"]] += r["n"]
    return mass / scale


def score_texts(docs: DataFrame, scope: str = "op") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs."""
    spark = docs.sparkSession
    segments = _segments(docs, scope)
    entries = _entries(segments)
    words = store(entries.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_last").alias("c_last")), "lm-words", scope)
    ends = docs.select(fold(F.col("doc_id")).alias("fold")).filter(F.col("fold") != HELD_OUT).count()
    known = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = (known[0] or 0) + ends, known[1] + (ends > 0)
    scale = total + 0.5 * (distinct + 1)
    classes = _choose_classes(words, total)
    mass = _class_mass(words, classes, scale, ends)
    tree = learn(segments, classes, mass / mass.sum(), scope)
    model = spark.sparkContext.broadcast(_Model(classes, tree, mass, scale, ends, total))
    fields = _arrow_schema(spark, OUT)

    def add_up(rows: pa.Table, counts: pa.Table) -> pa.Table:
        c = np.zeros(counts.num_rows)
        c[counts["number"].to_numpy()] = counts["c"].to_numpy()
        segment = {name: rows[name][0].as_buffer() for name in rows.column_names if name != "segment"}
        return model.value.rows(segment | {"words": segment["words"].to_pybytes()}, c, fields)

    counted = entries.select(F.col("segment").alias("of"), "number", "word").join(words.select("word", "c"), "word").select("of", "number", "c")
    texts = segments.select("segment", "docs", "nulls", "folds", "lengths", "ids", "words")
    return texts.groupBy("segment").cogroup(counted.groupBy("of")).applyInArrow(add_up, OUT)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
