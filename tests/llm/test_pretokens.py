import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from quillspan.llm import pretokens

TEXTS = [
    None, "", " ", "a", "Hello world's end", "x" * 300 + " " + "ab" * 5000, "  two  spaces \n\n\n tab\t", "naïve café 12345 €", "<|endoftext|>a<|endoftext|><|endoftext|> b",
    "日本語のテキスト", "emoji 😀😀 \U00010940՘ mixed", "\x00\x1f\x85  odd", "word " * 500, "word " * 500, "'s 't don't I'LL", "9" * 70,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, word string")


def expected(library):
    return sorted(((i, t) for i, t in [*enumerate(TEXTS), (None, "no id"), (3, "a")]), key=repr)


def test_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in pretokens.token_counts(docs, P.path("byte_bpe_50k.json")).collect()), key=repr)
    want = []
    for i, text in expected(t):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)


def test_ids_equal_the_library_and_decode_to_the_text(docs):
    import tiktoken

    file = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pretokens.digests(docs, file).collect()), key=repr)
    want = []
    for i, text in expected(enc):
        ids = enc.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    whole = {r.doc_id: bytes(r.decoded).decode() for r in pretokens.encode_decode(docs, file).collect()}
    assert whole[4] == TEXTS[4] and whole[1] == ""


def test_queries_equal_the_libraries_on_all_documents(spark, sf):
    import tiktoken
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in pretokens.QUERIES["op3_token_counts"](spark, sf).collect()}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pretokens.QUERIES["op4_byte_bpe"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        text = row.text or ""
        ids, n = enc.encode_ordinary(text), len(library.encode(text, add_special_tokens=False))
        assert found[row.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert counts[row.doc_id] == (len(text.encode()), n, n > 1024)


def test_segments_are_cut_where_pre_tokens_end():
    import random

    random.seed(4)
    whole = pretokens.PatternSplitter()
    for _ in range(3000):
        text = "".join(random.choice(["a", "b", " ", " ", "\n", "\x1c", "\u00a0", "'s", ".", "7", "é"]) for _ in range(random.randint(0, 14)))
        vocabulary = pretokens.Vocabulary(whole)
        segments = vocabulary.segments(text)
        vocabulary.close()
        assert [vocabulary.words[i] for i in vocabulary.sequences([segments])[0]] == whole(text)


@pytest.mark.parametrize("length", [1, 2, 95, 96, 97, 130, 700])
def test_long_words_fold_as_the_library_merges(spark, length):
    import random

    import tiktoken
    from pyspark.sql import functions as F

    file = P.path("byte_bpe_50k.tiktoken")
    pieces = pretokens.read_ranks(file)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    random.seed(length)
    words = ["".join(random.choice("abcdeth") for _ in range(length)), "x" * length, ("aba" * length)[:length]]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(1)
    got = df.select("word", pretokens.fold_merges(F.col("word"), pretokens.rank_literal(spark, pieces)).alias("ids")).collect()
    assert all(list(r.ids) == enc.encode_ordinary(r.word) for r in got) and len(got) == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pretokens.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert pretokens.digests(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_the_library_is_read_once_a_process(monkeypatch):
    import tokenizers

    read = []

    class Counted:
        @staticmethod
        def from_file(file, whole=tokenizers.Tokenizer.from_file):
            read.append(file)
            return whole(file)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    file = P.path("byte_bpe_50k.json")
    texts = [[pretokens.LibrarySplitter(file)(t) for t in ("a b", "ſ é͸")] for _ in range(2)]
    assert texts[0] == texts[1] and len(read) <= 1
