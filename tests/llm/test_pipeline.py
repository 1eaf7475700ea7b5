"""The pipeline against a brute-force version, stage by stage and as a whole."""

import zlib

import brute
import numpy as np
from pyspark.sql import functions as F
from test_operators import DOC, ROWS, empty, ids_of, odd, tokenizer  # noqa: F401

import corpus_pipeline
from cinegraph.llm import quality


def clean(t):
    return not brute.quality(t)[5]


def test_stages(spark, tokenizer, tmp_path):  # noqa: F811
    df = spark.createDataFrame(ROWS, DOC)
    names = df.columns
    (_, rules), (_, near), (_, secrets), (_, mixture), (_, packed) = corpus_pipeline.STAGES
    one = rules(spark, df, "")
    assert one.columns == names
    kept = {r.doc_id: r.text for r in one.collect()}
    verdict = {r["_row"].doc_id: r.kept for r in quality.judge(df).collect()}
    assert kept == {i: t for i, t, *_ in ROWS if verdict[i]} and all(clean(t) for t in kept.values())
    two = near(spark, one, "")
    want = {i for i, (_, c) in brute.components(kept).items() if i == c}
    assert two.columns == names and {r.doc_id for r in two.collect()} == want
    three = secrets(spark, two, "")
    assert three.columns == names and {r.doc_id for r in three.collect()} == want
    for r in three.collect():
        assert brute.secrets(r.text)[4] == "" and r.n_chars == len(r.text)
    four = mixture(spark, three, "")
    assert four.columns == names
    times = {}
    for r in four.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= want and max(times.values()) <= 3
    five = packed(spark, four, "").collect()
    text = {r.doc_id: r.text for r in three.collect()}
    pieces = []
    for i, n in times.items():
        ids = np.array([*ids_of(tokenizer, text[i]), 0], "<u4")
        pieces += n * [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in five) == sorted(pieces)
    df.write.parquet(f"{tmp_path}/sf/documents.parquet")
    whole = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted(pieces)
    used = {}
    for r in whole:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_stages_on_odd_tables(spark, tokenizer, odd, empty):  # noqa: F811
    """Null ids and texts, repeated rows, columns named as the stages' own; nothing of nothing."""
    stages = dict(corpus_pipeline.STAGES)
    rules, near, secrets, mixture, packed = (stages[n] for n, _ in corpus_pipeline.STAGES)
    assert rules(spark, odd, "").columns == odd.columns and rows_of(rules(spark, odd, "")) == []
    assert near(spark, odd, "").columns == odd.columns and rows_of(near(spark, odd, "")) == rows_of(odd)
    assert secrets(spark, odd, "").columns == odd.columns and rows_of(secrets(spark, odd, "")) == rows_of(odd)
    assert mixture(spark, odd, "").columns == odd.columns and rows_of(mixture(spark, odd, "")) == rows_of(odd.where("text is not null"))
    ids = {(r.doc_id, r.text): np.array([*ids_of(tokenizer, r.text or ""), 0], "<u4") for r in odd.collect()}
    want = [(r.doc_id, 0, 0, len(ids[r.doc_id, r.text]), zlib.crc32(ids[r.doc_id, r.text].tobytes())) for r in odd.collect()]
    got = packed(spark, odd, "").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted(tuple(r)[1:5] for r in got if r.doc_id is None) == sorted(w[1:] for w in want if w[0] is None)
    assert [rows_of(stage(spark, empty, "")) for _, stage in corpus_pipeline.STAGES] == 5 * [[]]


def test_run_on_odd_tables(spark, tokenizer, tmp_path):  # noqa: F811
    """A null id passes through the whole, of equal texts under two ids the smaller stays, and null texts go."""
    text = "the cat sat on the mat and then it went to the house of a friend that was not far from here"
    rows = [(None, text, "en", None, len(text)), (7, text, "en", None, len(text)), (8, text, "en", None, len(text)), (9, None, None, None, None), (10, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOC).withColumns({"_row": F.lit(1), "size": F.lit(2)}).write.parquet(f"{tmp_path}/sf/documents.parquet")
    n = len(ids_of(tokenizer, text)) + 1
    got = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in got) == [("7", 0, n), ("None", 0, n)]
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got) == [0, n]
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
