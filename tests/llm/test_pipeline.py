"""Every pipeline stage equals a brute-force version on whole documents, and the stages take odd tables."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from quillspan.sources.scratch import keep

STAGES = dict(corpus_pipeline.STAGES)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(texts):
    """Smallest member of the component of each text, by all pairs of shingle sets."""
    sets = []
    for text in texts:
        own = words(lower(text or ""))
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, y in enumerate(sets):
        for i in range(j):
            x = sets[i]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))]


def clean(rows):
    classes = components([text for _, _, text in rows])
    holders, in_host = defaultdict(set), defaultdict(set)

    def lines(text):
        return [(n, lower(" ".join(words(line)))) for n, line in enumerate((text or "").split("\n")) if words(line)]

    for (_, host, text), own in zip(rows, classes, strict=True):
        in_host[host].add(own)
        for _, line in lines(text):
            holders[host, line].add(own)
    kept = []
    for doc_id, host, text in rows:
        n = len(words(text))
        triples = list(zip(words(text), words(text)[1:], words(text)[2:], strict=False))
        times = Counter(triples)
        repeated = {p for i, t in enumerate(triples) if times[t] > 1 for p in (i, i + 1, i + 2)}
        over = {k: len(line.split(" ")) for k, line in lines(text) if len(holders[host, line]) > max(10, 0.05 * len(in_host[host]))}
        if n >= 50 and 100 * len(repeated) <= 50 * n and 100 * (n - sum(over.values())) >= 30 * n:
            kept.append((doc_id, host, "\n".join(line for k, line in enumerate(text.split("\n")) if k not in over)))
    return kept


def line_dedup(rows):
    first, out = {}, []
    for doc_id, host, text in sorted(rows):
        lines = text.split("\n")
        full = [(k, " ".join(words(line))) for k, line in enumerate(lines) if words(line)]
        covered = set()
        for i in range(len(full) - 2):
            numbers = {k for k, _ in full[i : i + 3]}
            where, own = first.setdefault(tuple(line for _, line in full[i : i + 3]), (doc_id, numbers))
            covered |= numbers if where != doc_id else numbers - own
        out.append((doc_id, host, "\n".join(line for k, line in enumerate(lines) if k not in covered)))
    return out


def keep_one(rows):
    rows = sorted(rows)
    return [row for i, (row, root) in enumerate(zip(rows, components([text for _, _, text in rows]), strict=True)) if i == root]


def pack(rows, capacity=2048):
    pieces, placed, bins = [], [], []
    for doc_id, source, text in rows:
        own = (text or "").encode().split()
        cluster = b" ".join(own).lower()
        if not own:
            placed.append((doc_id, 0, 0, None, None, source))
        for k, start in enumerate(range(0, len(own), capacity)):
            pieces.append((-len(own[start : start + capacity]), doc_id, k, source, cluster))
    for length, doc_id, k, source, cluster in sorted(pieces, key=lambda p: p[:3]):
        fit = [(room, b) for b, (room, sources, clusters) in enumerate(bins) if room >= -length and (source is None or source not in sources) and cluster not in clusters]
        _, b = min(fit, default=(capacity, len(bins)))
        if b == len(bins):
            bins.append((capacity, set(), set()))
        room, sources, clusters = bins[b]
        placed.append((doc_id, k, -length, b, capacity - room, source))
        bins[b] = (room + length, sources | {source}, clusters | {cluster})
    return placed


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    assert len({doc_id for doc_id, _, _ in rows}) == len(rows)
    for name, brute in (("quality_rules", clean), ("line_dedup", line_dedup), ("ngram_jaccard", keep_one)):
        docs = keep(STAGES[name](spark, docs, sf), name)
        assert docs.columns == columns
        rows = brute(rows)
        assert plain(docs.select("doc_id", "source", "text").collect()) == plain(rows)
    want = plain(pack(rows))
    packed = "doc_id", "piece", "n_words", "bin_id", "bin_offset", "source"
    assert plain(STAGES["best_fit_packing"](spark, docs, sf).select(*packed).collect()) == want
    assert plain(corpus_pipeline.run(spark, sf).select(*packed).collect()) == want


def test_stages_take_odd_tables(spark, tmp_path):
    prose = [" ".join(f"{c}{i}" for i in range(80)) for c in "abc"]
    rows = [(1, prose[0], "s"), (1, prose[0], "s"), (None, prose[1], None), (None, None, None), (2, "", "t"), (None, prose[2], "s"), (3, prose[2], "s"), (4, "x" * 100_000, "s")]
    odd = spark.createDataFrame([(*r, "k", [1], "l") for r in rows], "doc_id long, text string, source string, key string, drop array<int>, `kept.key` string")
    docs = odd
    for name in ("quality_rules", "line_dedup", "ngram_jaccard"):
        docs = STAGES[name](spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert plain(docs.select("doc_id", "text").collect()) == plain([(1, prose[0]), (None, prose[1]), (3, prose[2])])
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
