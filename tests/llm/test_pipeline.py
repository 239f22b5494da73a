"""The stages on a small corpus, each against a brute-force version of what it decides."""

import random
import time
from collections import Counter

import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

import corpus_pipeline as C
from anchorline.llm import sentencepiece_codec as S
from anchorline.storage import materialize
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_ngram_join import shingles
from tests.llm.test_quality_rules import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(260):
        text = prose(rnd, rnd.randrange(60, 200))
        good = rnd.random() < 0.75
        rows.append((i, text if good else " ".join(f"{w} |" for w in text.split()), "en", f"s{i % 5}" if i % 11 else None, 1, "x", "y"))
        labels.append((i, int(good), 0))
    for k in range(8):
        words = rows[0][1].split()
        words[k * 3] = "edited"
        rows.append((300 + k, " ".join(words), "en", "s1", 1, "x", "y"))
    rows += [(400, rows[0][1], None, None, None, None, None), (401, None, "en", "s2", 0, None, None), (402, "", "en", "s2", 0, None, None), rows[5]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in C.STAGES] == ["quality_rules", "quality_classifier", "ngram_join", "mixing", "sentencepiece"]
    seen = docs
    for name, stage in C.STAGES:
        before = seen.collect()
        seen = stage(spark, seen, folder).cache()
        after = seen.collect()
        if name != "sentencepiece":
            assert seen.columns == docs.columns
            # n_words and score are columns of the input here, and have kept their values
            assert {(r.n_words, r.score) for r in after} <= {("x", "y"), (None, None)}
        if name == "quality_rules":
            assert all(not brute(r.text)[1] for r in after)
            assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and "|" not in r.text}
        if name == "quality_classifier":
            assert len(after) >= 0.98 * len(before)
            good = {r.doc_id for r in C.quality_classifier.quality_scores(spark.createDataFrame(before, docs.schema).select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted == 1}
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id in good)
        if name == "ngram_join":
            sets = [(r.doc_id, shingles(r.text, 5)) for r in after]
            assert len({d for d, _ in sets}) == len(sets)
            assert not any(100 * len(a & b) >= 80 * len(a | b) for i, (_, a) in enumerate(sets) for _, b in sets[:i])
            assert 0 in {d for d, _ in sets} and not {300, 307, 400} & {d for d, _ in sets}
            assert {r.doc_id for r in before} - {d for d, _ in sets} <= {*range(300, 308), 400, 5}
        if name == "mixing":
            assert set(map(tuple, after)) <= set(map(tuple, before))
            # each source's words come within a row of its target, and no row is there more often than its cap allows
            words = lambda r: len((r.text or "").split())
            given = Counter()
            for r in before:
                given[r.source] += words(r)
            order = sorted(given, key=lambda s: (s is None, s or ""))
            want, open_, left = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, float(sum(given.values()))
            while open_:
                over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * given[s] + 1e-9]
                if not over:
                    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
                    break
                for s in over:
                    want[s] = 3.0 * given[s]
                    del open_[s]
                left = sum(given.values()) - sum(want.values())
            for s in order:
                assert abs(sum(words(r) for r in after if r.source == s) - want[s]) <= max(words(r) for r in before if r.source == s)
            rows = Counter(map(tuple, before))
            assert all(n <= 3 * rows[r] for r, n in Counter(map(tuple, after)).items())
        if name == "sentencepiece":
            lib = spm.SentencePieceProcessor(model_file=S.piece_model())
            text = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and all(r.n_tokens == len(lib.encode(text[r.doc_id])) for r in after)


def test_quality_stage_drops_what_is_predicted_bad(spark, folder, monkeypatch):
    """Also documents that the classifier finds bad by little."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5").dropDuplicates(["doc_id"])
    scored = lambda d, _: d.withColumn("score", F.col("doc_id") * 0.15 + 0.1).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    monkeypatch.setattr(C.quality_classifier, "quality_scores", scored)
    assert {r.doc_id for r in C.quality(spark, docs, folder).collect()} == {3, 4}


def test_last_stage_gives_ids_and_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20").dropDuplicates(["doc_id"])
    lib = spm.SentencePieceProcessor(model_file=S.piece_model())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in C.pieces(spark, docs, folder).collect():
        ids = lib.encode(text[r.doc_id])
        assert [int(x) for x in r.ids.split(",")] == ids and r.decoded == lib.decode(ids)


def test_run_and_empty(spark, folder, tmp_path):
    assert C.run(spark, folder).count() > 100
    spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_shuffles_of_a_written_table_leave_the_disk(spark):
    """They lay beside the next steps' until the driver collected its garbage: the stage of near copies had those of all its steps at once."""
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, set_before = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    made = materialize(spark.range(50_000).repartition(5, "id"), "shuffled")
    for _ in range(40):
        if not (left := files() - before):
            break
        time.sleep(0.25)
    assert not left and made.count() == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == set_before
