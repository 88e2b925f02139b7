"""Operators 3 and 4: token counts, and byte-level BPE encoding and decoding.

Both work once per distinct pre-token of the whole corpus instead of once per
occurrence.  Documents are read in batches.  A batch numbers its own
vocabulary; its documents become sequences (operator 4) or frequencies
(operator 3) of these numbers, and its vocabulary is dealt by word hash.  Both
are rows of one work table, which is bucketed by batch.

1. Vocabulary rows meet by word hash.  Distinct pre-tokens of a group are
   tokenised once, and the answers return to the batches that hold the word.
2. Each batch is put together from its documents, which the bucketed table
   keeps where they are, and the answers for its vocabulary.

So the shuffles carry packed vocabularies and ids, never text or an occurrence.
A pre-token in every document is one entry a batch, and a group holds the
batches of at most ``BLOCK`` input partitions, so hot words stay bounded; a
word is then tokenised once for each such block.

Operator 3 counts pieces with the library of the vocabulary file; no ids leave
that step.  Operator 4 folds ranked merges over the bytes of each word with
Spark's higher-order functions against a literal rank map, and decodes by
concatenating the binary pieces of the ids.  The fold of a word longer than
``FLAT`` bytes is the same merge step, applied to a window of blocks around
the best pair, so that a step does not touch the whole word.

Defined cases: null and empty texts have 0 tokens and the digests of no bytes;
repeated rows give repeated results; null ids stay null; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import binary_text
from quillspan.sources.scratch import keep_bucketed

#: A batch holds at most so many text bytes (a longer document is a batch of its own) and documents.
BATCH_BYTES, BATCH_DOCS = 12 << 20, 20_000
#: Documents that share a row of the work table, as short sequences hardly compress alone.
ROW_DOCS = 64
#: Words are dealt by hash to so many groups, in blocks of so many input partitions.
GROUPS, BLOCK = 256, 1024
#: Distinct words whose ids wait for each other before they are packed by batch.
HELD_WORDS = 40_000
#: Distinct words that the library tokenises at a time; it holds over a kilobyte for each of them.
ENCODED_WORDS = 2_000
#: Longer words are folded in blocks of ``BLOCK_PIECES`` pieces.
FLAT, BLOCK_PIECES = 96, 16
#: Buckets of the literal rank map, hardly ever more than two entries each: a map literal is searched from its start.
RANK_BUCKETS = 1 << 17

_ARROW = pa.schema(
    [("kind", pa.string()), ("batch", pa.int64())]
    + [("word_group", pa.int32()), ("locals", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())]
    + [("docs", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("indexes", pa.binary()), ("times", pa.binary())]
)
BATCHES = "kind string, batch long, word_group int, locals binary, sizes binary, words binary, docs array<long>, n_bytes array<long>, lengths array<int>, indexes binary, times binary"

#: Code points that the two pattern libraries class alike; texts with others are split by the tokenizer's own library.
_SAME_CLASSES = re.compile("[^\x00-՗֐-ࢎ࢐-౛ -⁯℀-ꟍ가-힣]")
#: A single space between two characters that are no white space: pre-tokens never reach across its left side.
_SPACED = re.compile(r"(?<=\S) (?=\S)")


# ---- pre-tokens of a text


@cache
def _tokenizer(file: str):
    """The library of the vocabulary file, read once a worker process, as each reading leaves memory behind."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def give_back() -> None:
    """Workers live on between batches and tasks; what a batch needed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class PatternSplitter:
    """Every match of the pattern is a pre-token."""

    def __init__(self):
        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        return self.find(text)


class LibrarySplitter:
    """Pre-tokens as the tokenizer file has them: its special strings first, then its pre-tokeniser."""

    def __init__(self, file: str):
        self.library = _tokenizer(file).pre_tokenizer
        special = [t["content"] for t in json.loads(open(file, encoding="utf-8").read())["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def _plain(self, text: str) -> list[str]:
        if _SAME_CLASSES.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.find(text)

    def __call__(self, text: str) -> list[str]:
        parts = self.special.split(text)
        if len(parts) == 1:
            return self._plain(text)
        # odd places hold the special strings
        return [token for i, part in enumerate(parts) for token in ([part] if i % 2 else self._plain(part))]


class Numbered(dict):
    """Numbers each new key."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Segments(dict):
    """Numbers of the segments between single spaces; -1 where the neighbouring space need not end a pre-token."""

    def __init__(self, add, space: str, checked: bool):
        self.add, self.space, self.checked = add, space, checked

    def __missing__(self, part: str) -> int:
        unsafe = self.checked and (not part or part[0].isspace() or part[-1].isspace())
        self[part] = number = -1 if unsafe else self.add(self.space + part)
        return number


class Vocabulary:
    """A batch's pre-tokens.  Texts are cut at single spaces first, so each distinct segment is split only once."""

    def __init__(self, split):
        self.split, self.tokens = split, Numbered()
        self.flat: list[int] = []
        self.bounds = [0]
        self.head, self.rest = Segments(self.add, "", True), Segments(self.add, " ", True)
        self.any_head, self.any_rest = Segments(self.add, "", False), Segments(self.add, " ", False)

    def add(self, segment: str) -> int:
        self.flat.extend(map(self.tokens.__getitem__, self.split(segment)))
        self.bounds.append(len(self.flat))
        return len(self.bounds) - 2

    def segments(self, text: str) -> np.ndarray:
        """The text as numbers of segments."""
        parts = text.split(" ")
        found = np.fromiter(map(self.rest.__getitem__, parts), np.int32, len(parts)) if len(parts) > 1 else np.zeros(1, np.int32)
        found[0] = self.head[parts[0]]
        if found.min() < 0:
            parts = _SPACED.split(text)
            found = np.fromiter(map(self.any_rest.__getitem__, parts[1:]), np.int32, len(parts) - 1)
            found = np.concatenate([[self.any_head[parts[0]]], found])
        return found

    def close(self) -> None:
        """No more texts: only the arrays are left, and the words in the order of their numbers."""
        self.words = list(self.tokens)
        self.flat, self.bounds = np.array(self.flat, np.int32), np.array(self.bounds, np.int64)
        self.tokens = self.head = self.rest = self.any_head = self.any_rest = None

    def times(self, segments: list[np.ndarray]) -> np.ndarray:
        """How often each pre-token is in all texts."""
        found = np.zeros(len(self.bounds) - 1, np.int64)
        for own in segments:
            np.add.at(found, own, 1)
        return np.bincount(self.flat, np.repeat(found, np.diff(self.bounds)), len(self.words)).astype(np.int64)

    def sequences(self, segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-token numbers of some texts in a row, and how many each text has."""
        joined = np.concatenate(segments)
        sizes = self.bounds[joined + 1] - self.bounds[joined]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        texts = np.cumsum([0, *map(len, segments)])
        return self.flat[spread(self.bounds[joined], sizes)], np.diff(ends[texts])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts`` and have ``sizes``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


# ---- packing of numbers and words


def squeeze(numbers: np.ndarray) -> bytes:
    """Small non-negative integers in few bytes: equal byte places side by side, then compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.compress(planes, 3)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def squeeze_rising(numbers: np.ndarray) -> bytes:
    return squeeze(np.diff(numbers, prepend=0))


def unsqueeze_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data))


# ---- the work table


class Batch:
    """Documents of a batch, already as numbers of segments; texts are not held."""

    def __init__(self, split):
        self.vocabulary = Vocabulary(split)
        self.ids: list[int | None] = []
        self.n_bytes: list[int] = []
        self.segments: list[np.ndarray] = []
        self.held = 0

    def takes(self, size: int) -> bool:
        return not self.ids or (self.held + size <= BATCH_BYTES and len(self.ids) < BATCH_DOCS)

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.ids.append(doc_id)
        self.n_bytes.append(len(text))
        self.segments.append(self.vocabulary.segments(text.decode("utf-8")))
        self.held += len(text)


def _batch_rows(number: int, batch: Batch, ordered: bool) -> pa.RecordBatch:
    ids, n_bytes, vocabulary = batch.ids, batch.n_bytes, batch.vocabulary
    vocabulary.close()
    # numbered by falling frequency, so the common numbers are small and compress well
    order = np.argsort(-vocabulary.times(batch.segments), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    words = [vocabulary.words[i].encode() for i in order.tolist()]

    columns: list[list] = [[] for _ in _ARROW]

    def row(*values) -> None:
        for column, value in zip(columns, values, strict=True):
            column.append(value)

    for start in range(0, len(ids), ROW_DOCS):
        stop = min(start + ROW_DOCS, len(ids))
        tokens, lengths = vocabulary.sequences(batch.segments[start:stop])
        tokens = place[tokens]
        if ordered:
            sizes, indexes, times = lengths.tolist(), squeeze(tokens), None
        else:
            counted = [np.unique(own, return_counts=True) for own in np.split(tokens, np.cumsum(lengths)[:-1])]
            sizes = [len(found) for found, _ in counted]
            # ascending inside a document, so the steps are small
            indexes = squeeze(np.concatenate([np.diff(found, prepend=0) for found, _ in counted]))
            times = squeeze(np.concatenate([n for _, n in counted]))
        row("doc", number, None, None, None, None, ids[start:stop], n_bytes[start:stop], sizes, indexes, times)
    if words:
        groups = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % GROUPS
        by = np.argsort(groups, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(groups[by])) + 1):
            held = [words[i] for i in own.tolist()]
            sizes = squeeze(np.fromiter(map(len, held), np.int64, len(held)))
            row("word", number, int(groups[own[0]]), squeeze_rising(own), sizes, zstandard.compress(b"".join(held), 3), None, None, None, None, None)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def batch_table(docs: DataFrame, doc_id: str, text: str, splitter, ordered: bool) -> DataFrame:
    """The work table of document and vocabulary rows; ``splitter`` makes the splitting function in each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, number = splitter(), TaskContext.get().partitionId() << 32
        held = Batch(split)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not held.takes(len(text)):
                    yield _batch_rows(number, held, ordered)
                    held, number = Batch(split), number + 1
                    give_back()
                held.add(doc_id, text)
        if held.ids:
            yield _batch_rows(number, held, ordered)
        del held
        give_back()

    narrow = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), binary_text(docs[f"`{text}`"]).alias("text"))
    return keep_bucketed(narrow.mapInArrow(rows, BATCHES), "pretokens", "batch")


def _grouped_words(table: DataFrame):
    """Vocabulary rows by word hash and block of input partitions."""
    words = table.filter("kind = 'word'").select("batch", "word_group", F.shiftright("batch", 32 + BLOCK.bit_length() - 1).alias("block"), "locals", "sizes", "words")
    # a number of its own, since the bytes are few but the work on them is not
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(n, "word_group", "block").groupBy("word_group", "block")


def _distinct(group: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of vocabulary rows; for each entry the number of its word, its batch and its local number."""
    sizes = [unsqueeze(s) for s in group.column("sizes").to_pylist()]
    data = b"".join(map(zstandard.decompress, group.column("words").to_pylist()))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    batches = np.repeat(group.column("batch").to_numpy(), list(map(len, sizes)))
    return words.dictionary, words.indices.to_numpy(), batches, np.concatenate([unsqueeze_rising(x) for x in group.column("locals").to_pylist()])


def _by_batch(batches: np.ndarray, locals_: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each batch, the places of its entries in the order of their local numbers."""
    order = np.lexsort((locals_, batches))
    if len(order):
        for own in np.split(order, np.flatnonzero(np.diff(batches[order])) + 1):
            yield int(batches[own[0]]), own


# ---- operator 3


def piece_counts(table: DataFrame, file: str) -> DataFrame:
    """(of_batch, locals, pieces) for every vocabulary; each distinct pre-token of a group is counted once."""

    def count(group: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(file)
        words, which, batches, locals_ = _distinct(group)
        pieces = np.empty(len(words), np.int64)
        for start in range(0, len(words), ENCODED_WORDS):
            part = [w.decode("utf-8") for w in words[start : start + ENCODED_WORDS].to_pylist()]
            pieces[start : start + len(part)] = [len(e) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        rows = [(batch, squeeze_rising(locals_[own]), squeeze(pieces[which[own]])) for batch, own in _by_batch(batches, locals_)]
        of, places, counts = zip(*rows, strict=True)
        give_back()
        return pa.table({"of_batch": pa.array(of, pa.int64()), "locals": pa.array(places, pa.binary()), "pieces": pa.array(counts, pa.binary())})

    return _grouped_words(table).applyInArrow(count, "of_batch long, locals binary, pieces binary")


def _scattered(places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """One array from values and their places, which together are all numbers from 0."""
    out = np.zeros(sum(map(len, places)), np.int64)
    for at, own in zip(places, values, strict=True):
        out[at] = own
    return out


def token_counts(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    table = batch_table(docs, doc_id, text, lambda: LibrarySplitter(file), ordered=False)
    frequencies = table.filter("kind = 'doc'").select("batch", "docs", "n_bytes", "lengths", "indexes", "times")

    def total(documents: pa.Table, vocabulary: pa.Table) -> pa.Table:
        own = _scattered(*([f(x) for x in vocabulary.column(c).to_pylist()] for c, f in (("locals", unsqueeze_rising), ("pieces", unsqueeze))))
        ids, sizes, sums = [], [], []
        for numbers, n_bytes, lengths, indexes, times in zip(*(documents.column(c).to_pylist() for c in ("docs", "n_bytes", "lengths", "indexes", "times")), strict=True):
            steps, times, stop = unsqueeze(indexes), unsqueeze(times), 0
            for length in lengths:
                start, stop = stop, stop + length
                sums.append(int(np.dot(own[np.cumsum(steps[start:stop])], times[start:stop])))
            ids += numbers
            sizes += n_bytes
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(sums, pa.int64())})

    sums = frequencies.groupBy("batch").cogroup(piece_counts(table, file).groupBy("of_batch")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


# ---- operator 4


def read_ranks(file: str) -> list[bytes]:
    """The pieces of a rank file in the order of their ids."""
    with open(file, "rb") as lines:
        found = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [found[i] for i in range(len(found))]


def rank_literal(spark: SparkSession, pieces: list[bytes]) -> Column:
    """The rank map as a literal: array<map<string,int>>, by Spark's hash of the piece.

    A piece is written with one character a byte.  The text is folded to a
    literal by the optimiser, so tasks get the map and never parse it.
    """
    names = [piece.decode("latin-1") for piece in pieces]
    numbered = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, rank int")
    # the vocabulary file is of fixed size; its hashes are Spark's own
    where = numbered.select("name", "rank", F.pmod(F.hash("name"), F.lit(RANK_BUCKETS)).alias("bucket")).collect()
    buckets: list[dict[str, int] | None] = [None] * RANK_BUCKETS
    for row in where:
        buckets[row.bucket] = (buckets[row.bucket] or {}) | {row.name: row.rank}
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Token ids of a word (one character a byte): merges the leftmost pair of lowest rank until none is left."""
    # bound, so that the plan has the literal only once
    return bind(ranks, lambda ranks: _fold(word, ranks))


def _fold(word: Column, ranks: Column) -> Column:
    first, rest = F.lit(1), F.lit(1 << 30)
    no_pieces = F.array().cast("array<string>")

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(ranks, F.pmod(F.hash(piece), F.lit(RANK_BUCKETS))), piece)

    def pair_ranks(pieces: Column) -> Column:
        # the last piece meets null, which has no rank
        return F.transform(F.zip_with(pieces, F.slice(pieces, F.lit(2), rest), lambda a, b: F.concat(a, b)), rank)

    def merge_best(pieces: Column) -> Column:
        def join(at: Column) -> Column:
            joined = F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at)))
            return F.concat(F.slice(pieces, first, at - 1), joined, F.slice(pieces, at + 2, rest))

        def merge(pairs: Column) -> Column:
            best = F.array_min(pairs)
            return F.when(best.isNull(), pieces).otherwise(bind(F.array_position(pairs, best).cast("int"), join))

        return bind(pair_ranks(pieces), merge)

    letters = F.filter(F.split(word, ""), lambda c: c != "")
    rounds = F.when(F.length(word) < 2, F.array().cast("array<int>")).otherwise(F.sequence(first, F.length(word) - 1))
    flat = F.aggregate(rounds, letters, lambda pieces, _: merge_best(pieces))

    # long words: blocks of pieces, each with the best rank of a pair that begins in it
    def cut(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK_PIECES).cast("int"))
        return F.transform(numbers, lambda i: F.slice(pieces, i * BLOCK_PIECES + 1, F.lit(BLOCK_PIECES)))

    def bests(blocks: Column, after: Column) -> Column:
        def best(block: Column, i: Column) -> Column:
            return F.array_min(pair_ranks(F.concat(block, F.slice(F.coalesce(F.get(blocks, i + 1), after), first, first))))

        return F.transform(blocks, best)

    def state(blocks: Column, after: Column) -> Column:
        return F.struct(blocks.alias("blocks"), bests(blocks, after).alias("bests"))

    def long_step(now: Column, _: Column) -> Column:
        blocks, bests_now = now["blocks"], now["bests"]

        def around(start: Column) -> Column:
            # the block before the best pair, its own, and two more: whatever the merge touches
            after = F.coalesce(F.get(blocks, start + 3), no_pieces)

            def put_back(fresh: Column) -> Column:
                return F.struct(
                    F.concat(F.slice(blocks, first, start - 1), fresh["blocks"], F.slice(blocks, start + 4, rest)).alias("blocks"),
                    F.concat(F.slice(bests_now, first, start - 1), fresh["bests"], F.slice(bests_now, start + 4, rest)).alias("bests"),
                )

            window = F.flatten(F.slice(blocks, start, F.lit(4)))
            return bind(bind(bind(window, merge_best), cut), lambda b: bind(state(b, after), put_back))

        best = F.array_min(bests_now)
        return F.when(best.isNull(), now).otherwise(bind(F.greatest(F.array_position(bests_now, best).cast("int") - 1, first), around))

    long = bind(bind(letters, cut), lambda blocks: F.flatten(F.aggregate(rounds, state(blocks, no_pieces), long_step)["blocks"]))
    return F.transform(F.when(F.length(word) <= FLAT, flat).otherwise(long), rank)


def word_ids(table: DataFrame, pieces: list[bytes]) -> DataFrame:
    """(of_batch, locals, sizes, ids) for every vocabulary; each distinct pre-token of a group is folded once."""

    def words(group: pa.Table) -> pa.Table:
        found, which, batches, locals_ = _distinct(group)
        by = np.argsort(which, kind="stable")
        bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(which))]), pa.int32())
        places = [pa.ListArray.from_arrays(bounds, pa.array(x[by], t)) for x, t in ((batches, pa.int64()), (locals_, pa.int32()))]
        return pa.table({"word": found.cast(pa.binary()), "batches": places[0], "locals": places[1]})

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sizes = pc.list_value_length(table.column("ids")).to_numpy().astype(np.int64)
        ids = pc.list_flatten(table.column("ids")).to_numpy()
        starts = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(sizes)), pc.list_value_length(table.column("batches")).to_numpy())
        batches, locals_ = (pc.list_flatten(table.column(c)).to_numpy() for c in ("batches", "locals"))
        rows = []
        for batch, own in _by_batch(batches, locals_):
            word = which[own]
            rows.append((batch, squeeze_rising(locals_[own]), squeeze(sizes[word]), squeeze(ids[spread(starts[word], sizes[word])])))
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["of_batch", "locals", "sizes", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_WORDS:
                yield packed(held)
                held = []
        if any(b.num_rows for b in held):
            yield packed(held)

    distinct = _grouped_words(table).applyInArrow(words, "word binary, batches array<long>, locals array<int>")
    folded = distinct.select(fold_merges(F.decode("word", "ISO-8859-1"), rank_literal(table.sparkSession, pieces)).alias("ids"), "batches", "locals")
    return folded.mapInArrow(pack, "of_batch long, locals binary, sizes binary, ids binary")


def encode_decode(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary) of every document; see also ``digests``."""
    return _assembled(docs, file, doc_id, text, _whole, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return _assembled(docs, file, doc_id, text, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _whole(ids: np.ndarray, pieces: list[bytes]) -> tuple:
    return ids.tolist(), b"".join(map(pieces.__getitem__, ids.tolist()))


def _digest(ids: np.ndarray, pieces: list[bytes]) -> tuple:
    decoded = b"".join(map(pieces.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


_OUT = {_whole: [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())], _digest: [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]}


def _assembled(docs: DataFrame, file: str, doc_id: str, text: str, make, schema: str) -> DataFrame:
    pieces = read_ranks(file)
    table = batch_table(docs, doc_id, text, PatternSplitter, ordered=True)
    sequences = table.filter("kind = 'doc'").select("batch", "docs", "lengths", "indexes")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # of the vocabulary file's size
    fields = [("doc_id", pa.int64()), *_OUT[make]]

    def assemble(documents: pa.Table, vocabulary: pa.Table) -> pa.Table:
        places = [unsqueeze_rising(x) for x in vocabulary.column("locals").to_pylist()]
        sizes = [unsqueeze(x) for x in vocabulary.column("sizes").to_pylist()]
        n_ids = _scattered(places, sizes)
        starts = np.cumsum(n_ids) - n_ids
        flat = np.empty(n_ids.sum(), np.int32)
        for at, n, ids in zip(places, sizes, vocabulary.column("ids").to_pylist(), strict=True):
            flat[spread(starts[at], n)] = unsqueeze(ids)
        rows = []
        for numbers, lengths, indexes in zip(*(documents.column(c).to_pylist() for c in ("docs", "lengths", "indexes")), strict=True):
            tokens = unsqueeze(indexes)
            own = flat[spread(starts[tokens], n_ids[tokens])]
            ends = np.concatenate([[0], np.cumsum(n_ids[tokens])])[np.cumsum([0, *lengths])].tolist()
            rows += [(number, *make(own[a:b], shared.value)) for number, a, b in zip(numbers, ends, ends[1:], strict=False)]
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return sequences.groupBy("batch").cogroup(word_ids(table, pieces).groupBy("of_batch")).applyInArrow(assemble, schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op3_token_counts": op3_token_counts, "op4_byte_bpe": op4_byte_bpe}
ORACLE: dict[str, str] = {}
