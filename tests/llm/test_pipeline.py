import pytest
import sentencepiece
from pyspark.sql import functions as F

import brute
import corpus_pipeline
import public_tokenizers
from omicspark.llm import quality, secret_scan, source_mix

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and comes out, over whole tables."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in stages[1:-1])


def test_quality_stage_drops_what_the_classifier_rejects(spark, stages):
    scored = quality.score_documents(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert rows(stages[1]) == rows(stages[0].where(F.col("doc_id").isin(list(good))))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(i in good for i, q in labels.items() if q == 1)


def test_duplicate_stage_keeps_the_first_of_each_group(stages):
    before = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    marks = [brute.fingerprint(r.text) for r in before]
    roots = brute.components(len(marks), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    assert rows(stages[2]) == sorted((tuple(r) for i, r in enumerate(before) if roots[i] == i), key=repr)


def test_secret_stage_leaves_none(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.text == secret_scan.redact_text(before[i].text) and r.n_chars == len(r.text)
        assert not brute.secret_spans(r.text)
        assert (r.text == before[i].text) == (not brute.secret_spans(before[i].text))


def test_mix_stage_takes_the_words_of_the_mix(stages):
    taken = {r.doc_id: r.taken for r in source_mix.mix(stages[3]).collect()}
    got: dict = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {i: n for i, n in taken.items() if n}


def test_last_stage_encodes_each_row(stages):
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, own.encode(r.text)) for r in stages[4].collect())
    found = stages[5].collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == want
    assert all(r.parity and r.round_trip for r in found)


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens")
    assert rows(found) == rows(stages[5].select("doc_id", "n_tokens"))


def test_odd_rows_pass_every_stage(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, id string, ids string"
    odd = [
        (None, None, None, None, None, "x", "x"), (1, "", "en", None, 0, "x", "x"), (2, "plain words " * 40_000, "en", "a", 1, "x", "x"),
        (3, "password = hunter2hunter2 plain", "en", "a", 1, "x", "x"), (4, "same words here", None, "b", 1, "x", "x"),
        (4, "same words here", None, "b", 1, "x", "x"), (5, " \n", "en", "b", 2, "x", "x"),
    ]
    for table in (spark.createDataFrame(odd, shape), spark.createDataFrame([], shape)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            docs.collect()
