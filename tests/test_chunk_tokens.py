"""Windows by tokenizers that look at a text once against windows that encode each part anew."""

import base64

import numpy as np
import pytest

from ledgerline.operators import chunking

tokenizers = pytest.importorskip("public_tokenizers")
NEWLINES = r"'s|'t|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def encodings():
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    made = {p: tiktoken.Encoding(f"e{k}", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for k, p in enumerate((tokenizers.PATTERN, NEWLINES))}
    return {p: (lambda t, e=e: len(e.encode_ordinary(t))) for p, e in made.items()}


def texts():
    rng = np.random.default_rng(6)
    words = ["revenue", "grew", "by", "12,345.67%", "don't", "end.", "(see", "Note", "7)", "—", "naïve", "東京", "x" * 40, "A.", "!?}", " b", "$1,000"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n"]
    for n in (0, 1, 2, 30, 400):
        yield "".join(words[i] + gaps[j] for i, j in zip(rng.integers(0, len(words), n), rng.integers(0, len(gaps), n)))
    yield "   lead" + " trail   "


@pytest.mark.parametrize("pattern", [0, 1])
def test_parts_count_as_if_encoded_alone(encodings, pattern):
    pattern, count = list(encodings.items())[pattern]
    for text in texts():
        size = chunking.Pieces(pattern, count)(text)
        spans = [m.span() for m in chunking._WORD.finditer(text)]
        rng = np.random.default_rng(1)
        for i in range(len(spans)):
            for j in {i, min(i + 1, len(spans) - 1), int(rng.integers(i, len(spans)))}:
                a, b = spans[i][0], spans[j][1]
                assert size(a, b) == count(text[a:b]), (text[a:b], i, j)


@pytest.mark.parametrize("most, overlap", [(7, 0.0), (20, 0.3), (64, 0.15), (1, 0.5)])
def test_windows_are_those_of_an_encoder(encodings, most, overlap):
    for pattern, count in encodings.items():
        for text in texts():
            fast = chunking.windows(text, most, overlap, chunking.Pieces(pattern, count))
            assert fast == chunking.windows(text, most, overlap, count)
    for text in texts():
        assert chunking.windows(text, most, overlap) == chunking.windows(text, most, overlap, lambda t: len(t.split()))


def test_a_text_is_cut_once():
    seen = []

    def count(piece):
        seen.append(piece)
        return len(piece)

    text = " ".join(f"word{k % 50}." for k in range(20_000))
    found = chunking.windows(text, 700, 0.15, chunking.Pieces(r" ?\S+", count))
    assert len(found) > 100 and len(seen) < 200
    assert max(n for _, n in found) <= 700


def test_sections_with_a_tokenizer(spark):
    rows = spark.createDataFrame([(1, "one two. three four", "s"), (2, None, "s")], "id long, text string, section string")
    by_letters = chunking.Pieces(r"\s?\S+", len)
    got = chunking.chunk_sections(rows, ["id", "section"], 9, 0.0, by_letters).orderBy("chunk_index").collect()
    assert [(r.id, r.text, r.token_count) for r in got] == [(1, "one two.", 8), (1, "three", 5), (1, "four", 4)]


def test_windows_are_held_of_a_few_texts(spark):
    import pyarrow as pa

    class Rows:
        schema = spark.createDataFrame([], "id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["word " * 1000] * 200)], ["id", "text"])]))

    parts = chunking.chunk_sections(Rows(), ["id"])
    assert max(len(set(p.column("id").to_pylist())) for p in parts) <= chunking.AT_ONCE < 200
    assert [i for p in parts for i in p.column("id").to_pylist()] == [i for i in range(200) for _ in range(2)]
