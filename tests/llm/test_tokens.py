"""Token ids, token files and packing against the tokenizers library and plain recomputation."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logtriage.llm import packing, token_file
from logtriage.llm.queries import QUERIES
from logtriage.llm.tokens import encode
from logtriage.session import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "a", "don't I'LL we've it's", "<|endoftext|> x <|startoftext|>y", "a<|endoftext|>B <|ENDOFTEXT|>", "THE <|",
    "été É café, Ça va? l’été.", "x\x1cy\x85z\xa0w　v", "123 4a5b!! AB12. x² foo_bar __x",
    "​zero‍width \U0001f600\U0001f600 a\U0001f600, b", "İstanbul ıI ΣΑΣ.", "tab\tnl\nff\x0cvt\x0bcr\r", "w" * 5000, "a.b.c, d;e! (f) 'g' \"h\"",
]


def ids_of(text, end):
    return np.array([*WHOLE.encode(text, add_special_tokens=False).ids, end], dtype="<u4")


def test_encode_equals_the_library(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    alphabet = "abcDEF'',.!?-_<|>09 \n\téß́Ä中"
    texts += ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    wrong = [t for t in texts if encode(PATH, t.encode(), 7) != ids_of(t, 7).tobytes()]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_elias_fano_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.concatenate([[0], np.cumsum(rng.integers(0, rng.integers(1, 4000), n))])
    ef = token_file.EliasFano.build(values)
    assert (ef.values() == values).all()
    assert [ef.select(i) for i in range(n + 1)] == values.tolist()
    bits = 8 * (len(ef.low) + len(ef.high) + ef.samples.nbytes)
    assert n < 1000 or bits < (4 + np.log2(values[-1] / n)) * n
    with pytest.raises(IndexError):
        ef.select(n + 1)


def test_ids_must_fit():
    with pytest.raises(ValueError):
        token_file.pack_segment([np.array([70000], dtype="<u4").tobytes()], 2)
    with pytest.raises(ValueError):
        token_file.Segment(b"\0" * token_file.HEADER.size)


def test_file_query_equals_plain_recomputation(spark, sf):
    got = QUERIES["op4_token_file"](spark, sf).orderBy("doc_id").collect()
    start, rows = 0, spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for row, doc in zip(got, rows, strict=True):
        ids = ids_of(doc.text, 2)
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_file_cases(spark, docs_of):
    rows = [(5, None), (None, "b c"), (2, "x " * 3000), (5, "a"), (5, "a"), (1, "")]
    path = new_folder(spark, "token-cases")
    token_file.write_tokens(docs_of(rows, clash=True), path, PATH, 2, segment_ids=100)
    got = token_file.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 5, 5, 5]
    assert [list(r.ids) for r in got[1:3]] == [[2], ids_of("x " * 3000, 2).tolist()]
    assert got[-1].start + got[-1].n_tokens == sum(len(ids_of(t or "", 2)) for _, t in rows)
    segments = [token_file.Segment(bytes(r.data)) for r in token_file.read_segments(spark, path).collect()]
    for segment in segments:
        bounds = segment.bounds.values().astype(int)
        for i in range(segment.n_docs):
            assert (segment.document(i) == segment.ids[bounds[i] : bounds[i + 1]]).all()
    empty = new_folder(spark, "token-empty")
    token_file.write_tokens(docs_of([]), empty, PATH, 2)
    assert token_file.token_digest(spark, empty).count() == 0


def checked(rows, capacity):
    """Places are gapless, within capacity, and each piece has one."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(by)


def test_packing_query(spark, sf):
    rows = QUERIES["op7_packing"](spark, sf).collect()
    n = checked(rows, 2048)
    assert n <= 1.01 * sum(r.length for r in rows) / 2048 + 2
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for doc_id, pieces in by.items():
        ids = ids_of(texts[doc_id], 0)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 2048)))
        for p in pieces:
            own = ids[p.start : p.start + 2048]
            assert (p.start, p.length, p.ids_crc32) == (2048 * p.piece, len(own), zlib.crc32(own.tobytes()))


def test_packing_cases_and_sequences(spark, docs_of):
    rows = [(1, None), (1, "a b c"), (1, "a b c"), (None, "x " * 200), (7, "y " * 64)]
    packed = packing.pack_documents(docs_of(rows, clash=True), PATH, 0, 64, with_ids=True)
    found = packed.collect()
    checked(found, 64)
    assert sum(r.length for r in found) == sum(len(ids_of(t or "", 0)) for _, t in rows)
    sequences = packing.sequences(packed).collect()
    assert sorted(i for s in sequences for i in s.ids) == sorted(i for r in found for i in r.ids)
    assert all(len(s.ids) <= 64 for s in sequences)
    assert packing.pack_documents(docs_of([]), PATH, 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    histogram = np.bincount(rng.integers(1, capacity + 1, int(rng.integers(0, 400))), minlength=capacity + 1)
    found = packing.plan(histogram, capacity)
    got = np.zeros(capacity + 1, dtype=int)
    for contents, times in found:
        assert sum(contents) <= capacity
        for length in contents:
            got[length] += times
    assert (got == histogram).all()
    least = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    half = int(histogram[capacity // 2 + 1 :].sum())
    plain = sum(n for _, n in packing.best_fit(histogram, capacity))
    assert max(least, half) <= sum(n for _, n in found) <= plain + 2


def test_knapsack_is_exact():
    prices = np.full(21, -1.0)
    prices[[3, 5, 7]] = [4.0, 7.5, 10.0]
    best, take = packing.dearest(prices, 20)
    plain = [0.0] * 21
    for c in range(1, 21):
        plain[c] = max([plain[c - 1]] + [prices[k] + plain[c - k] for k in (3, 5, 7) if k <= c])
    assert best.tolist() == plain
    assert sum(packing.filling(take, 20)) <= 20
