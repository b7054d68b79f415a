"""Random texts against brute force, without Spark."""


import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import audio_prints, lempel_ziv, packing, text, token_counts, winnowing

tokenizers = pytest.importorskip("public_tokenizers")
odd = st.text(
    st.one_of(st.sampled_from(" \n\tabcAB'.,|<>▁é½1"), st.characters(exclude_categories=("Cs",))), max_size=60
)


ALL_BITS = np.full(1 << winnowing.BITS - 6, 2**64 - 1, np.uint64)


@settings(max_examples=200, deadline=None)
@given(odd)
def test_token_counts(value):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    want = len(token_counts.model(path).encode(value))
    assert isinstance(token_counts.model(path), sentencepiece.SentencePieceProcessor)
    assert int(token_counts.count_pieces(token_counts.pretokens(value), path).sum()) == want


@settings(max_examples=300, deadline=None)
@given(odd)
def test_word_ids(value):
    from ledgerline.llm.word_tokenizer import tokenizer

    own = tokenizer(tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(own.ids(value.encode()), "<u4").tolist() == own.library.encode(
        value, add_special_tokens=False
    ).ids


words = st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), st.integers(3, 9), st.integers(1, 3))
def test_segments_cover_every_window_once(docs, window, gram):
    texts = [" ".join(w).encode() for w in docs]
    s = lempel_ziv.Segments(texts, window, gram)
    got = sorted(
        (int(o), int(a - s.begins[o]) + k) for o, a, c in zip(s.owner, s.start, s.count) for k in range(int(c))
    )
    assert got == sorted((i, k) for i, w in enumerate(docs) for k in range(len(w) - window + 1))
    assert all(0 <= x <= window - gram for x in s.lead.tolist()) and len(s.windows) == len(got)
    # equal windows have equal anchors at equal places
    seen = {}
    for o, a, c, lead, anchor in zip(s.owner, s.start, s.count, s.lead, s.anchor):
        for k in range(int(c)):
            at = int(a - s.begins[o]) + k
            assert seen.setdefault(
                tuple(docs[o][at : at + window]), (int(anchor), int(lead) - k)
            ) == (int(anchor), int(lead) - k)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=4), st.lists(words, min_size=1, max_size=4))
def test_winnowing(docs, items):
    held, prints, sizes = {}, set(), set()
    for i, w in enumerate(items):
        size, whole, low = winnowing.item_windows(" ".join(w).encode(), 10, 5)
        sizes |= {size} - {0}
        prints |= {*low.tolist()}
        for h in whole.tolist():
            held.setdefault((size, h), set()).add(str(i))
    every = ALL_BITS
    _, (owner, start, size, low, whole) = winnowing.candidates(
        [" ".join(w).encode() for w in docs], winnowing.Marks(sorted(sizes), every, every), 10, 5
    )
    hits, found = [set() for _ in docs], [set() for _ in docs]
    for o, a, n, p, h in zip(*(x.tolist() for x in (owner, start, size, low, whole))):
        if (n, h) in held:
            assert p in prints
            hits[o] |= set(range(a, a + n))
            found[o] |= held[n, h]
    for d, w in enumerate(docs):
        want, ids = set(), set()
        for i, item in enumerate(items):
            n = min(10, len(item))
            windows = {tuple(item[a : a + n]) for a in range(len(item) - n + 1)} if item else set()
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    want |= set(range(a, a + n))
                    ids.add(str(i))
        assert hits[d] == want and found[d] == ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.sampled_from([4, 8, 16]))
def test_packing(sizes, window):
    docs = [np.arange(n, dtype="<u4") % 7 for n in sizes]
    rows = packing.pack(docs, window, 8)
    for d, n in enumerate(sizes):
        at = 0
        for _, start, length, _, _ in sorted(r for r in rows if r[0] == d):
            assert start == at and length > 0
            at += length
        assert at == n
    for q in {r[3] for r in rows}:
        mine = sorted((r[4], r[2]) for r in rows if r[3] == q)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist()
        total = sum(n for _, n in mine)
        assert total <= window and total & (total - 1) == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=12), st.integers(1, 64))
def test_pieces_keep_all_rows(values, limit):
    batch = pa.RecordBatch.from_arrays(
        [pa.array(values, pa.binary()), pa.array(range(len(values)))], ["t", "n"]
    ).slice(1)
    got = [n for p in text.pieces([batch], "t", limit) for n in p.column("n").to_pylist()]
    assert got == list(range(1, len(values)))


def test_alignment_finds_the_offset_despite_errors():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, 200, dtype=np.uint64).astype(np.uint32)
    b = a[40:].copy()
    b[::3] ^= np.uint32(1 << 7)
    offset, errors = audio_prints.align(a, b, most_errors=0.15, least_overlap=32)
    assert offset == 40 and 0 < errors < 0.02
    assert audio_prints.align(
        a, rng.integers(0, 2**32, 200, dtype=np.uint64).astype(np.uint32), most_errors=0.15, least_overlap=32
    ) is None
    assert len(audio_prints.FILTERS) == 16
