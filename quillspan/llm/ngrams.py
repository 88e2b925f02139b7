"""Operator 10, n-gram Jaccard join by prefix trees.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is at least 0.8; the result is the connected component of every
document.  The steps:

1. One pass over the texts gives each document's set size and a 128-bit hash
   of its set (equal sets are one class from here on) and adds the shingles to
   a frequency sketch of fixed size (``SKETCH_BITS``).  The sketch, coarsened
   to levels, is broadcast and fixes the global order: rare shingles first.
2. A second pass emits the prefix of each ordered set: two sets that link must
   share a shingle in their prefixes, at places that leave enough shingles
   behind them.  So a posting is an interval of set sizes, from its own to the
   largest that it can link with, and sets whose intervals meet in a shingle
   may link.  Each batch of documents unites its own meeting intervals before
   the shuffle, so a shingle in a third of all documents is a few rows a batch.
   United sets give candidate components, never pairs.
3. Candidate components are packed into tasks of bounded size.  A task stores
   its sets, in the global order with the most frequent shingles first, in a
   prefix tree; one walk over the tree counts the overlaps of each set with all
   others, shares the counts of common paths, and skips a whole subtree when
   the longest set below it cannot reach the bound any more.  Every link is
   decided on whole sets; a spanning forest of them is returned.
   A component too large for a task is cut into blocks by set size (bands of
   the factor 1.25: links reach only the next band) and by hash.  First each
   block meets a few dozen pivots of its own and the next band, which joins
   the bulk of near copies.  Then only sets that are not yet in one component
   meet: blocks outside the largest part with each other and with all blocks
   that they can link with, so no link between two parts is lost.
4. The verified links give the components.

The order only steers how much work is done, never the result.  No step emits
all pairs of a group or brings a group of unknown size into a task.

Shingles compare by 64-bit hashes: in a pair of sets of n shingles each, two
different shingles are taken for one with a probability below n**2 / 2**64
(5e-10 for n = 100,000).  Sets are classes by 128 bits and their size.

Defined cases: null text, and text without words, has an empty set and links
with nothing, its own id is its component; fewer words than five are one
shingle; repeated rows have equal sets and so one component; null ids carry
links like others but are ignored by the smallest id of a component (null
where all ids are null); repeated ids may have different texts; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import binary_text, free_name, join_hot, row_key
from quillspan.llm.components import connected_components
from quillspan.sources.scratch import keep

WORDS = 5
#: The threshold as a fraction; links are decided in whole numbers.
NEAR, OF = 80, 100
#: Cells of the frequency sketch, as a power of two: 8 MB once coarsened, whatever the corpus.
SKETCH_BITS = 23
SKETCH_CHUNKS = 128
#: Postings in a bucket, about; shingles and documents of a verifying task, about.
BUCKET_POSTINGS = 2_000_000
TASK_SHINGLES, TASK_DOCS = 1_000_000, 2048
#: Sets of each band of a large component that all its blocks meet first, about.
PIVOTS = 48
#: Set hashes that a task remembers, so that copies do not post their prefixes again.
SEEN_SETS = 200_000

_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of each word, remembered while the vocabulary is of moderate size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text, ascending."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total = _mix(total * _M + h[k : k + n])
    return np.unique(total)


# ---- step 1


PROFILE = "kind string, key binary, doc_id long, n_shingles long, h1 long, h2 long, chunk int, counts binary"
_PROFILE = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _set_hash(grams: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64).tolist()
    return a, b


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, cells = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
    used = False
    for batch in batches:
        rows = []
        for key, number, text in zip(*batch.columns, strict=True):
            grams = shingles(text.as_py(), hashes)
            found = (None, None)
            if len(grams):
                used = True
                np.add.at(cells, grams >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
                found = _set_hash(grams)
            rows.append(("doc", key.as_py(), number.as_py(), len(grams), *found, None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _PROFILE, strict=True)], schema=_PROFILE)
    if used:
        pack = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(np.split(cells, SKETCH_CHUNKS)):
            row = ("sketch", None, None, None, None, None, k, pack.compress(part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PROFILE, strict=True)], schema=_PROFILE)


def _sum_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each chunk of the sketch; the parts of a chunk come one after the other."""
    unpack, size = zstandard.ZstdDecompressor(), (1 << SKETCH_BITS) // SKETCH_CHUNKS

    def level(total: np.ndarray) -> bytes:
        return np.minimum(255, 8 * np.log2(total.astype(np.float64) + 1)).astype(np.uint8).tobytes()

    chunk, total = None, np.zeros(size, np.uint64)
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if chunk is not None and k != chunk:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level(total)], pa.binary())], names=["chunk", "levels"])
                total[:] = 0
            chunk = k
            total += np.frombuffer(unpack.decompress(counts), np.uint32)
    if chunk is not None:
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level(total)], pa.binary())], names=["chunk", "levels"])


def _levels(profile: DataFrame) -> np.ndarray:
    """Frequency level of each cell: 2**SKETCH_BITS bytes, of the same size for every corpus."""
    parts = profile.filter("kind = 'sketch'").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    size = (1 << SKETCH_BITS) // SKETCH_CHUNKS
    for row in parts.mapInArrow(_sum_chunk, "chunk int, levels binary").collect():
        levels[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.levels, np.uint8)
    return levels


# ---- step 2


def prefix_length(n: int) -> int:
    return n - -(-NEAR * n // OF) + 1


def _ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order: frequency level, then hash."""
    level = levels[grams >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (grams & np.uint64((1 << 56) - 1)))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of ``n`` points under the edges a-b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _meeting(token: np.ndarray, low: np.ndarray, high: np.ndarray, node: np.ndarray) -> tuple:
    """Unites the intervals of each shingle that meet: merged intervals (token, low, high, node) and edges (a, b).

    An interval holds the sizes of sets that can link through the shingle at
    its place; a merged one stands for all its sets and has the node of the first.
    """
    by = np.lexsort((low, token))
    token, low, high, node = token[by], low[by].astype(np.int64), high[by].astype(np.int64), node[by]
    if not len(token):
        return token, low, high, node, node, node
    group = np.concatenate([[0], np.cumsum(token[1:] != token[:-1])])
    wide = np.int64(2) * (max(int(low.max()), int(high.max())) + 1)
    reach = np.maximum.accumulate(high + group * wide)
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (low[1:] > reach[:-1] - group[1:] * wide)])
    first = np.flatnonzero(fresh)
    head = node[first][np.cumsum(fresh) - 1]
    tied = ~fresh & (node != head)
    return token[first], low[first], np.maximum.reduceat(high, first), node[first], node[tied], head[tied]


POSTINGS = "bucket long, tokens binary, lows binary, highs binary, nodes binary, a binary, b binary"
_KINDS = {"tokens": np.uint64, "lows": np.int32, "highs": np.int32, "nodes": np.int64, "a": np.int64, "b": np.int64}


def _postings(narrow: DataFrame, levels, buckets: int) -> DataFrame:
    """Merged intervals by shingle bucket, and the edges that were found on the way."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, seen = WordHashes(), np.frombuffer(levels.value, np.uint8), set()
        for batch in batches:
            tokens, lows, highs, nodes = [], [], [], []
            for text in batch.column("text"):
                grams = shingles(text.as_py(), hashes)
                own = _set_hash(grams)
                if not len(grams) or own in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(own)
                n, p = len(grams), prefix_length(len(grams))
                tokens.append(_ordered(grams, order)[:p])
                lows.append(np.full(p, n, np.int32))
                # OF * overlap >= NEAR * union, with an overlap of what is left from this place on
                highs.append((((OF + NEAR) * (n - np.arange(p)) - NEAR * n) // NEAR).astype(np.int32))
                nodes.append(np.full(p, own[0]))
            if not tokens:
                continue
            *merged, a, b = _meeting(*map(np.concatenate, (tokens, lows, highs, nodes)))
            bucket = (_mix(merged[0]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            parts = [np.split(c[by].astype(k), cuts) for c, k in zip(merged, _KINDS.values(), strict=False)]
            numbers = bucket[by][np.concatenate([[0], cuts])]
            rows = [pa.array([x.tobytes() for x in p], pa.binary()) for p in parts]
            edges = np.unique(np.stack([a, b]), axis=1) if len(a) else np.empty((2, 0), np.int64)
            # edges ride with the first rows
            shares = [np.array_split(e, len(numbers)) for e in edges]
            rows += [pa.array([x.tobytes() for x in share], pa.binary()) for share in shares]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *rows], names=["bucket", *_KINDS])

    return narrow.mapInArrow(emit, POSTINGS)


def _unite(table: pa.Table) -> pa.Table:
    """A bucket's intervals to edges (set, root of the sets it may link with)."""
    column = {name: np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in _KINDS.items()}
    *_, a, b = _meeting(*(column[name] for name in ("tokens", "lows", "highs", "nodes")))
    a, b = np.concatenate([a, column["a"]]), np.concatenate([b, column["b"]])
    points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(at[: len(a)], at[len(a) :], len(points))
    moved = root != np.arange(len(points))
    return pa.table({"a": pa.array(points[moved], pa.int64()), "b": pa.array(points[root[moved]], pa.int64())})


# ---- step 3


def tree_links(sets: list[np.ndarray], ranks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets``, as (member, root) positions.

    Sorted sequences of shingle numbers are the leaves of a prefix tree in
    walking order; neighbours part where their common prefix ends.  ``ranks``
    has the global frequency level of each cell of the sketch: the most
    frequent shingles come first, so paths are shared near the root.
    """
    m = len(sets)
    if m < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    level = np.zeros(len(tokens), np.int64) if ranks is None else ranks[tokens >> np.uint64(64 - SKETCH_BITS)].astype(np.int64)
    number = np.empty(len(tokens), np.int64)
    number[np.lexsort((-times, -level))] = np.arange(len(tokens))
    owner = np.repeat(np.arange(m), size)
    token = number[inverse]
    # a shingle of one set alone adds to no overlap
    shared = times[inverse] > 1
    token, owner = token[shared], owner[shared]
    by = np.lexsort((owner, token))
    postings = owner[by]
    bounds = np.searchsorted(token[by], np.arange(token.max(initial=-1) + 2))
    order = np.lexsort((token, owner))
    paths = np.split(token[order], np.searchsorted(owner[order], np.arange(1, m)))
    walk = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())

    def common(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    # how much each leaf shares with the one before; nothing follows the last
    shares = np.array([0, *(common(paths[i], paths[j]) for i, j in zip(walk, walk[1:], strict=False)), -1])
    ends, sizes = np.array([len(paths[i]) for i in walk]), size[walk]

    def added(counts: np.ndarray, part: np.ndarray) -> np.ndarray:
        start, stop = bounds[part], bounds[part + 1]
        n = stop - start
        last = np.cumsum(n)
        take = np.repeat(start - (last - n), n) + np.arange(last[-1] if len(last) else 0)
        return counts + np.bincount(postings[take], minlength=m)

    parent = list(range(m))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(m, np.int64))]
    k = 0
    while k < m:
        i, path = walk[k], paths[walk[k]]
        while stack[-1][0] > shares[k]:
            stack.pop()
        depth, counts = stack[-1]
        branches = set(np.minimum.accumulate(shares[k + 1 :]).tolist())
        step = 32
        while True:
            # the leaves below this node
            stop = k + 1 + int(np.argmax(shares[k + 1 :] < depth))
            wanted = NEAR * (size + sizes[k:stop].min())
            if stop == k + 1:
                wanted[i] = np.iinfo(np.int64).max
            # remaining-length bound of the whole subtree
            if not ((OF + NEAR) * (counts + (ends[k:stop].max() - depth)) >= wanted).any():
                k = stop
                break
            if depth == len(path):
                wanted = NEAR * (size + size[i])
                wanted[i] = np.iinfo(np.int64).max
                for j in np.flatnonzero((OF + NEAR) * counts >= wanted).tolist():
                    x, y = find(i), find(j)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                k += 1
                break
            to = min([len(path), depth + step, *(x for x in branches if x > depth)])
            counts = added(counts, path[depth:to])
            depth, step = to, step * 2
            if depth in branches:
                stack.append((depth, counts))
    return [(i, find(i)) for i in range(m) if find(i) != i]


def _small() -> Column:
    return (F.col("docs") <= TASK_DOCS) & (F.col("grams") <= TASK_SHINGLES)


def _sized(members: DataFrame) -> DataFrame:
    """``members`` with the number of classes and shingles of their component."""
    sizes = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("grams"))
    # bands a little wider than the factor 1.25, so that rounding cannot part two sets that link
    width = math.log(OF / NEAR) * (1 + 1e-9)
    sized = members.join(sizes, "component")
    return sized.withColumn("band", F.floor(F.log("n_shingles") / F.lit(width)).cast("int"))


def _blocks(by: str) -> Column:
    """How many blocks a group of sets is cut into."""
    n = F.greatest(F.lit(1), F.ceil(F.count("*") / (TASK_DOCS // 2)), F.ceil(F.sum("n_shingles") / (TASK_SHINGLES // 2)))
    return n.cast("int").alias(by)


def _first_tasks(sized: DataFrame) -> DataFrame:
    """(task, class_id, rep): small components whole, several to a task; blocks of large ones, each with pivots of two bands."""
    total = sized.filter(_small()).agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n")).first()
    packs = max(1, -(-(total.s or 0) // TASK_SHINGLES), -(-total.n // TASK_DOCS))
    packed = sized.filter(_small()).select(F.pmod(F.xxhash64("component"), F.lit(packs)).alias("task"), "class_id", "rep")

    large = sized.filter(~_small())
    bands = large.groupBy("component", "band").agg(_blocks("n"), F.count("*").alias("in_band"))
    placed = large.join(bands, ["component", "band"])
    block = F.pmod(F.xxhash64("class_id"), F.col("n").cast("long")).cast("int")
    own = placed.select(F.xxhash64("component", "band", block).alias("task"), "class_id", "rep")
    # by hash, so the pivots need no rank over a component; a band of few sets has them all
    pivots = placed.filter(F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("in_band")) < PIVOTS)
    met = pivots.select("class_id", "rep", F.col("component").alias("pc"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("pb"))
    meets = met.join(bands, (F.col("pc") == F.col("component")) & (F.col("pb") == F.col("band")))
    shown = meets.select("component", "band", "class_id", "rep", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    return packed.unionAll(own).unionAll(shown.select(F.xxhash64("component", "band", "block").alias("task"), "class_id", "rep")).distinct()


def _second_tasks(sized: DataFrame, labels: DataFrame) -> DataFrame:
    """(task, class_id, rep): sets of large components that are not in one part yet meet all that they can link with."""
    large = sized.filter(~_small()).join(labels.select(F.col("node").alias("class_"), F.col("component").alias("part")), F.col("class_id") == F.col("class_"), "left")
    large = large.select("component", "class_id", "rep", "n_shingles", "band", F.coalesce("part", "class_id").alias("part"))
    parts = large.groupBy("component", "part").agg(F.count("*").alias("in_part"))
    main = parts.groupBy("component").agg(F.max_by("part", F.struct("in_part", "part")).alias("main"), F.count("*").alias("n_parts"))
    several = large.join(main, "component").filter("n_parts > 1").withColumn("group", F.col("band") * 2 + (F.col("part") == F.col("main")).cast("int"))
    counts = several.groupBy("component", "group").agg(_blocks("n"))
    blocks = counts.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("group", "n"))).alias("n_blocks"))
    placed = several.join(blocks, "component")
    block = F.pmod(F.xxhash64("class_id"), F.element_at("n_blocks", F.col("group")).cast("long")).cast("int")

    def blocks_of(group):
        n = F.coalesce(F.try_element_at("n_blocks", group), F.lit(0))
        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda y: F.struct(group.alias("group"), y.alias("block")))

    rest, in_main = F.col("band") * 2, F.col("group") % 2 == 1
    others = F.concat(*[blocks_of(rest + step) for step in (-2, 0, 2)])
    mains = F.concat(*[blocks_of(rest + step) for step in (-1, 1, 3)])
    own = F.struct(F.col("group"), block.alias("block"))
    # two sets of the main part need not meet
    partners = F.when(in_main, others).otherwise(F.concat(others, mains))
    pairs = placed.select("component", "class_id", "rep", own.alias("own"), F.explode(partners).alias("other"))
    return pairs.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "class_id", "rep").distinct()


def _verified(narrow: DataFrame, tasks: DataFrame, levels) -> DataFrame:
    """Links (a, b) of classes, as a spanning forest of each task."""

    def verify(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        sets = [shingles(text.as_py(), hashes) for text in table.column("text")]
        links = tree_links(sets, np.frombuffer(levels.value, np.uint8))
        nodes = table.column("class_id").to_pylist()
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())})

    texts = narrow.join(tasks, F.col("key") == F.col("rep"))
    # repeated rows have one key; their texts are one again before they meet others
    once = texts.groupBy("key", "task", "class_id").agg(F.first("text").alias("text"))
    return once.select("task", "class_id", "text").groupBy("task").applyInArrow(verify, "a long, b long")


# ---- the operator


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key (of id and text), doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    narrow = docs.select(
        row_key(docs[f"`{doc_id}`"], docs[f"`{text}`"]).alias("key"), docs[f"`{doc_id}`"].cast("long").alias("doc_id"), binary_text(docs[f"`{text}`"]).alias("text")
    )
    profile = keep(narrow.mapInArrow(_profile, PROFILE), "profile", partition_by="kind")
    sets = profile.filter("kind = 'doc'").select("key", "doc_id", "n_shingles", "h1", "h2")
    known = sets.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))["key"].alias("rep"), F.count("*").alias("docs")
    )
    classes = keep(known.withColumn("class_id", F.monotonically_increasing_id()), "classes")

    total = sets.agg(F.sum("n_shingles").alias("grams"), F.count("*").alias("docs")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.grams or 0) * (OF - NEAR) // OF // BUCKET_POSTINGS))
    levels = spark.sparkContext.broadcast(_levels(profile).tobytes())
    candidates = connected_components(_postings(narrow.select("text"), levels, buckets).groupBy("bucket").applyInArrow(_unite, "a long, b long"))

    # two classes may share 64 bits: then they are one candidate, and two classes again from here on
    members = candidates.join(classes, F.col("node") == F.col("h1")).select("component", "class_id", "rep", "n_shingles")
    sized = keep(_sized(members), "members")
    links = keep(_verified(narrow, _first_tasks(sized), levels), "links")
    if not sized.filter(~_small()).isEmpty():
        more = _verified(narrow, _second_tasks(sized, connected_components(links)), levels)
        links = links.unionAll(keep(more, "links"))
    found = connected_components(links).join(classes, F.col("node") == F.col("class_id"))
    lowest = found.groupBy("component").agg(F.min("first_id").alias("lowest"))
    merged = found.join(lowest, "component").select(F.col("class_id").alias("merged_id"), "component", "lowest")
    final = classes.join(merged, F.col("class_id") == F.col("merged_id"), "left").select(
        "h1", "h2", "n_shingles", "docs", F.coalesce("component", "class_id").alias("component"), F.coalesce("lowest", "first_id").alias("of_class")
    )
    return join_hot(sets, final, ["h1", "h2", "n_shingles"], "docs", total.docs, "left").select(
        "key", "doc_id", "n_shingles", "component", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("of_class")).alias("component_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with its smallest id (null: the largest); same columns.

    Rows with equal id and text are one document, of which one row stays.
    """
    found = jaccard_components(docs, doc_id, text)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(place)["key"].alias("kept_key"))
    name = free_name(docs, "kept_key")
    kept = first.unionAll(found.filter("n_shingles = 0").select("component", "key")).select(F.col("kept_key").alias(name)).distinct()
    keyed = docs.withColumn(name, row_key(docs[f"`{doc_id}`"], docs[f"`{text}`"]))
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLE = {
    "op10_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT x.r AS x, y.r AS y, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.r < y.r GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
w AS (SELECT r, r AS m FROM d UNION SELECT w.r, e.y FROM w JOIN e ON e.x = w.m)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN d ON d.r = w.r JOIN d o ON o.r = w.m LEFT JOIN n ON n.r = w.r GROUP BY w.r, d.doc_id"""
}
