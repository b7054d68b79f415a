"""Classifiers by held-out accuracy, audio by transformed recordings, and the pipeline."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import audio_prints, quality, toxicity
from ledgerline.llm.labelled import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scored, labels, label, threshold):
    rows = scored.join(labels, "doc_id").where(held_out("doc_id")).select(
        ((F.col("score") >= threshold).cast("int") == F.col(label)).alias("right")
    ).collect()
    assert len(rows) > 30
    return sum(r.right for r in rows) / len(rows)


def test_toxicity_held_out(tables):
    docs, labels = tables
    assert accuracy(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic", 0.5) > 0.9


def test_quality_held_out(tables):
    docs, labels = tables
    assert accuracy(quality.score(docs, quality.fit(docs, labels)), labels, "quality", 0.3) > 0.93


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_rows_get_a_score(spark, tables, module):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "x", 5), (4, "the " * 50_000, 5), (1, None, 5)],
        "doc_id long, text string, score int"
    )
    for known in (
        labels, labels.limit(0),
        labels.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit(None).cast("int").alias("quality"))
    ):
        rows = module.score(odd, module.fit(docs, known)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert module.score(odd.limit(0), module.fit(docs, labels)).count() == 0


def test_maximal_segments_equal_the_definition():
    """Against the recursive definition: the best segment, then the same to its left and right."""
    def best(x, a, b):
        if a >= b:
            return []
        top = max(((sum(x[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if top[0] <= 0:
            return []
        i = -top[2]
        j = i - top[1]
        return [*best(x, a, i), (i, j, top[0]), *best(x, j, b)]

    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.normal(-0.2, 1, rng.integers(1, 25)).tolist()
        got = toxicity.maximal_segments(x)
        want = best(x, 0, len(x))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def wav(samples, rate=4000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def test_recordings_align_with_their_changed_copies(spark):
    rng = np.random.default_rng(3)
    songs = [audio_prints.played_vector(rng.normal(size=96).tolist())[1] for _ in range(6)]
    rows = []
    for k, s in enumerate(songs):
        rows.append((k, wav(s)))
        rows.append((10 + k, wav(0.4 * s + 0.02 * rng.normal(size=len(s)))))  # quieter, with noise
        rows.append((20 + k, wav(s[2560:])))  # begins later
        rows.append((30 + k, wav(s)))
    rows += [
        (90, None), (91, b"no media"), (92, wav(np.zeros(40_000))), (93, wav(np.zeros(40_000))), (None, wav(songs[0]))
    ]
    media = spark.createDataFrame(rows, "rec_id long, audio binary").repartition(3)
    got = {r.rec_id: r for r in audio_prints.aligned_groups(media, id_col="rec_id", media_col="audio").collect()}
    for k in range(6):
        assert {got[k + d].group_id for d in (0, 10, 20, 30)} == {k}
    assert [got[i].group_id for i in (90, 91, 92, 93, None)] == [90, 91, 92, 93, None]
    assert got[90].n_ints == 0 and got[92].n_ints == 0 and got[None].n_ints > 0
    assert audio_prints.aligned_groups(media.limit(0), id_col="rec_id", media_col="audio").count() == 0


@pytest.mark.parametrize("most, hot", [(2000, 64), (2000, 0), (2, 3)])
def test_audio_groups_equal_brute_force(spark, monkeypatch, most, hot):
    """Groups are the components of all pairs that align at any offset, also through bridges, and when integers are hot or split."""
    monkeypatch.setattr(audio_prints, "SHARD_PRINTS", most)
    monkeypatch.setattr(audio_prints, "HOT", hot)
    rng = np.random.default_rng(8)
    songs = [audio_prints.played_vector(rng.normal(size=96).tolist())[1] for _ in range(5)]
    rows = []
    for s in songs:
        for level in (0.0, 0.1, 0.2, 0.35):
            rows.append((len(rows), wav(0.5 * (s + level * rng.normal(size=len(s))))))
    for s in songs[:2]:
        # a bridge: the end of one half meets the beginning of the other
        rows += [(len(rows), wav(0.5 * s[: len(s) * 2 // 3])), (len(rows) + 1, wav(0.5 * s[len(s) // 3 :]))]
    rows += [(len(rows), wav(np.concatenate([songs[2][:12_000], songs[3][:12_000]])))]
    media = spark.createDataFrame(rows, "rec_id long, audio binary")
    got = {r.rec_id: r for r in audio_prints.aligned_groups(media, id_col="rec_id", media_col="audio").collect()}
    prints = {i: np.frombuffer(bytes(r.prints), "<u4") for i, r in got.items()}
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and audio_prints.align(prints[i], prints[j], most_errors=0.15, least_overlap=32):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {i: r.group_id for i, r in got.items()} == root
    assert len(set(root.values())) < 8


def test_long_recordings_align_where_they_overlap(spark):
    """Three minutes with an excerpt, and an hour with another; the histogram names the place."""
    rng = np.random.default_rng(17)
    notes = 3 * 60 * 4000 // 256
    song = audio_prints.played_vector(rng.normal(size=notes).tolist())[1]
    hour = np.concatenate([audio_prints.played_vector(rng.normal(size=notes).tolist())[1] for _ in range(20)])
    rows = [(0, wav(song)), (1, wav(song[100_000:180_000])), (2, wav(hour)), (3, wav(hour[7_000_000:7_090_000] + 0.02 * rng.normal(size=90_000)))]
    media = spark.createDataFrame(rows, "rec_id long, audio binary")
    got = {r.rec_id: r for r in audio_prints.aligned_groups(media, id_col="rec_id", media_col="audio").collect()}
    assert {i: r.group_id for i, r in got.items()} == {0: 0, 1: 0, 2: 2, 3: 2}
    prints = {i: np.frombuffer(bytes(r.prints), "<u4") for i, r in got.items()}
    best = audio_prints.histogram(prints[0], prints[1])[0]
    hop = int(4000 * 0.256) // 4
    assert abs(best - 100_000 / hop) <= 1 and audio_prints.align(prints[2], prints[3], most_errors=0.15, least_overlap=32)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    from ledgerline.llm.storage import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"
    ]
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.schema.names == docs.schema.names
            kept.append(out.count())
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {
                r.doc_id for r in docs.select("doc_id").collect()
            }
        docs = out
    assert kept[0] > kept[1] == kept[2] > kept[3] > kept[4] > 0.6 * kept[0]


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_toxicity_model_equals_brute_force(spark):
    """Scores of beginnings from plain loops over a small table, and segments of its texts by their definition."""
    import math

    rng = np.random.default_rng(5)
    rows, known = [], []
    for i in range(60):
        text = [
            f"{'rot' if i % 3 == 0 and rng.random() < 0.2 else 'ma'}{'aeiou'[rng.integers(5)]}{'bdkl'[rng.integers(4)]}" for _ in range(int(rng.integers(5, 40)))
        ]
        rows.append((i, " ".join(text), "x"))
        known.append((i, int(i % 3 == 0)))
    rows.append((100, rows[1][1], "x"))  # repeats with one label and counts once
    known.append((100, 0))
    docs, labels = spark.createDataFrame(
        rows, "doc_id long, text string, word string"
    ), spark.createDataFrame(known, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, prior=0.05, z=2.0)
    import zlib

    train = {(t, y) for (i, t, _), (_, y) in zip(rows, known) if zlib.crc32(str(i).encode()) % 5}
    sizes = [sum(len(t.split()) for t, y in train if y == side) for side in (1, 0)]
    want = {}
    for piece in {b for t, _ in train for w in t.split() for b in toxicity.beginnings(w)}:
        per = [(sum(piece in toxicity.beginnings(w) for w in t.split()), y) for t, y in train]
        t, c = sum(n for n, y in per if y), sum(n for n, y in per if not y)
        a, a0 = 0.05 * (t + c), 0.05 * sum(sizes)
        odds = math.log((t + a) / (sizes[0] + a0 - t - a)) - math.log((c + a) / (sizes[1] + a0 - c - a))
        error = math.sqrt((1 / (t + a) + 1 / (c + a)) * sum(n * n for n, _ in per) / (t + c))
        if abs(odds) > 2 * error:
            want[piece] = math.copysign(abs(odds) - 2 * error, odds)
    assert want and model.scores.keys() == want.keys()
    assert all(math.isclose(model.scores[k], v, abs_tol=1e-9) for k, v in want.items())
    for text, _ in sorted(train):
        tokens = toxicity.words(text.encode())
        values = [
            max((want[b] for b in toxicity.beginnings(w) if b in want), key=abs, default=0.0) - model.drift for w in tokens
        ]
        best = max((sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=0)
        assert math.isclose(max((s for *_, s in model.segments(tokens)), default=0.0), max(0.0, best), abs_tol=1e-9)
    # scores of the query are those of the model for each text, also repeated ones and null ids
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1] == got[100] and all(
        math.isclose(got[i], model.score(model.passages(t.encode())[1])) for i, t, _ in rows
    )


def test_maximal_segments_take_linear_time():
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        assert len(toxicity.maximal_segments([1.0, -2.0] * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 0.5


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names, stage by stage."""
    import corpus_pipeline
    from ledgerline.llm.storage import written

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    words = " ".join(f"w{k}" for k in range(300))
    odd = [
        (5001, None, None, None, None, None), (5002, "", "en", "s", 0, 1), (None, words + " x", "en", None, None, None), (5003, "long " * 200_000, "en", "s", None, 2), (5004, words, "en", "s", 1, 3),
        (5004, words, "en", "s", 1, 3), (5005, words, None, None, 1, 3), (5006, " \n\t\n ", "en", "s", 6, 4), (5007, None, "en", "s", None, 5),
    ]
    extra = ("bucket", "text_hash", "size", "component_id", "shard", "node", "__id2")
    rows = docs.withColumn("label", F.lit(0)).unionByName(
        spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, label int").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns], "label")
    )
    for c in extra:
        rows = rows.withColumn(c, F.lit("mine"))
    names, now = rows.columns, rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, SF), "stage")
        assert now.columns == names and now.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        kept = [(r.doc_id, r.text) for r in now.where("doc_id > 5000 OR doc_id IS NULL").collect()]
        ids = sorted(i for i, _ in kept if i is not None)
        # the copy under the larger id is the only awkward row that any stage drops
        assert ids == [
            5001, 5002, 5003, 5004, 5004, *([5005] if name in ("toxicity", "line dedup") else []), 5006, 5007
        ] and len(kept) == len(ids) + 1
        assert all(
            dict(kept)[i] is None for i in (5001, 5007)
        ) and dict(kept)[5002] == "" and len(dict(kept)[5003]) == 1_000_000
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    sizes = {
        r.doc_id: (r.n, r.t) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    }
    assert sizes[5001] == sizes[5002] == sizes[5006] == (1, 1) and sizes[5003] == (200_001, 200_001) and sizes[5004][0] == 2 * sizes[5004][1]


def test_pipeline_deletes_what_its_stages_leave(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from ledgerline.llm import storage

    folder = tmp_path / "shared"
    folder.mkdir()
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{folder}")
    spark_docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    (tmp_path / "sf").mkdir()
    spark_docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / "sf" / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert out.count() > 0 and [p.name.rsplit("-", 1)[0] for p in folder.iterdir()] == ["packing"]


def test_votes_equal_brute_force(spark):
    """Scores from all cosines in double precision, for a table with ties and awkward texts."""
    rng = np.random.default_rng(9)
    rows = [
        (k, " ".join(("w" if k % 3 else "X!")[: 1 + k % 2] + "abcdefg"[: int(rng.integers(1, 7))] for _ in range(int(rng.integers(1, 50)))), k % 3 != 0) for k in range(120)
    ]
    docs = spark.createDataFrame(
        [(k, t, 1) for k, t, _ in rows] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, score int"
    )
    space = quality.fit(
        docs, spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id long, quality int"), neighbours=7
    )
    got = {r.doc_id: r.score for r in quality.score(docs, space, block=13).collect()}
    for k, t, _ in rows:
        x = space.project(quality.terms(t.encode())[None])[0].astype(np.float64)
        near = space.vectors.astype(np.float64) @ x
        top = np.argsort(-near)[:7]
        edge = np.isclose(near, near[top[-1]], atol=1e-5)
        if len(set(space.labels[edge])) > 1:
            continue  # a tie at the edge between different labels
        weight = np.maximum(near[top], 0) ** space.power
        assert abs(got[k] - (weight * space.labels[top]).sum() / weight.sum()) < 1e-4
    assert got[900] == got[901] == pytest.approx(space.share)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_that_repeat_or_lack(spark, module):
    """Repeated labels count as their largest, null ids and labels are left out, and repeated documents learn alike."""
    docs = spark.createDataFrame([(k, f"some text number {k}") for k in range(30)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(30)] + [(0, 1), (None, 1), (4, None)], "doc_id long, flag int"
    )
    rows = module.score(docs, module.fit(docs, labels, label="flag")).collect()
    assert len(rows) == 60 and len({(r.doc_id, r.score) for r in rows}) == 30
