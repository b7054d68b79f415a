"""Empty tables, null ids, very long texts and columns whose names the operators use themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import audio_prints, blob_ledger, packing, quality, token_counts, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
LONG = "password = abcdef123 " + "word " * 60_000 + "AKIA" + "B" * 20
NAMES = (
    "id score predicted label __id __text ids shard spread counted start length offset doc_tokens sequence_id n n_bytes n_tokens piece pieces term terms blob "
    "findings rule path passages v vector prints marks places node same check group_id component u a b hot key value held_out"
).split()


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(1, "a good text"), (2, None), (3, ""), (None, "a good text"), (5, LONG), (6, "x"), (6, "x"), (7, "secret: hunter22")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    return table.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, 9), (6, 0, 1, 9), (7, 0, 1, 9), (5, 1, 0, 9)], "doc_id long, quality int, toxic int, score int")


def ids(found):
    return sorted(((r.doc_id is None, r.doc_id or 0) for r in found.select("doc_id").collect()))


WANT = [(False, 1), (False, 2), (False, 3), (False, 5), (False, 6), (False, 6), (False, 7), (True, 0)]


def test_token_counts(rows):
    path = tokenizers.path("piece_bpe_32k.model")
    found = token_counts.count_tokens(rows, path)
    assert ids(found) == WANT
    by = {r.doc_id: r for r in found.collect()}
    assert by[5].n_bytes == len(LONG) and by[5].n_tokens > 60_000 and (by[2].n_tokens, by[3].n_bytes) == (0, 0)
    assert token_counts.count_tokens(rows.limit(0), path).collect() == []


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, rows, labels, operator, label):
    model = operator.fit(rows, labels)
    found = operator.score(rows, model)
    assert ids(found) == WANT
    scores = {r.doc_id: r.score for r in found.collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[None] and scores[2] == scores[3]
    assert operator.score(rows.limit(0), model).collect() == []
    untaught = operator.score(rows, operator.fit(rows.limit(0), labels.limit(0)))
    assert ids(untaught) == WANT and len({r.score for r in untaught.collect()}) == 1


def test_blob_ledger(rows):
    found, ledger = blob_ledger.scan_all(rows, key_cols=["doc_id"])
    assert ids(found) == WANT
    by = {r.doc_id: [(x.kind, x.start, x.end) for x in r.findings] for r in found.collect()}
    assert [k for k, _, _ in by[5]] == ["assign", "access"] and by[5][1][1] == LONG.index("AKIA") and by[2] == by[3] == []
    again, _ = blob_ledger.scan_all(rows.limit(0), key_cols=["doc_id"], ledger=ledger)
    assert again.collect() == []


def test_keys_named_as_the_ledgers_own_columns(spark):
    rows = spark.createDataFrame([("p1", 1, "secret: hunter22"), ("p2", 2, None)], "blob string, findings int, text string")
    with pytest.raises(ValueError, match="blob"):
        blob_ledger.scan_all(rows, key_cols=["blob", "findings"])


def test_packing(rows):
    path = tokenizers.path("word_bpe_49k.json")
    found = packing.pack_documents(rows, path)
    pieces = found.collect()
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in pieces}) == sorted(set(WANT))
    assert sum(r.length for r in pieces if r.doc_id == 5) == next(r.doc_tokens for r in pieces if r.doc_id == 5) > 60_000
    assert sum(r.length for r in pieces if r.doc_id == 6) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 6)
    assert packing.pack_documents(rows.limit(0), path).collect() == []


def test_audio(spark):
    rng = np.random.default_rng(0)
    song = rng.normal(size=4000).tolist()
    media = spark.createDataFrame([(1, song), (2, song[500:]), (3, None), (None, song[:100])], "vec_id long, embedding array<double>")
    media = media.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])
    found = audio_prints.aligned_groups(media, id_col="vec_id", media_col="embedding", decode=audio_prints.played_vector).collect()
    by = {r.vec_id: r for r in found}
    assert by[1].n_ints > 3000 and by[3].n_ints == 0 and by[None].group_id is None and {by[1].group_id, by[2].group_id} == {1}
