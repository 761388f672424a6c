"""The pipeline's stages on odd rows: nulls, repeated ids, clashing names, empty tables; intermediate tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkvane.llm import decontamination, jaccard, mixing, repeats, shared, token_files


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    rnd = random.Random(3)
    folder = str(tmp_path_factory.mktemp("tables"))
    item = prose(rnd, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_near_copies_without_an_id(spark, docs):
    rnd = random.Random(1)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [(7, a), (None, a), (None, a + " end"), (None, b), (None, b), (None, b + " end"), (5, c), (None, None), (None, None), (9, None), (4, "")]
    kept = jaccard.keep_one_of_each(spark, docs(rows), "")
    assert kept.columns == docs([]).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert (7, a) in got and (5, c) in got and (9, None) in got and (4, "") in got
    assert sum(t is not None and t.startswith(a) for _, t in got) == 1
    assert sum(t is not None and t.startswith(b) for _, t in got) == 1
    assert jaccard.keep_one_of_each(spark, docs([]), "").count() == 0


def test_decontamination_judges_texts(spark, docs, bench_dir):
    folder, item = bench_dir
    rnd = random.Random(2)
    bad, good = f"{prose(rnd, 30)} {item} {prose(rnd, 30)}", prose(rnd, 90)
    rows = [(1, bad), (1, good), (None, bad), (None, good), (2, None), (3, "")]
    kept = decontamination.keep_clean(spark, docs(rows), folder)
    assert kept.columns == docs([]).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, good), (None, good), (2, None), (3, "")], key=repr)
    assert decontamination.keep_clean(spark, docs([]), folder).count() == 0


def test_mixing_keeps_clashing_columns(spark, docs):
    rows = [(k, "some words of text " * 5) for k in range(60)]
    clashing = docs(rows)
    for c in ("_draw", "_tokens", "_weight", "_probability", "_source", "row"):
        clashing = clashing.withColumn(c, F.lit("mine"))
    kept = mixing.keep_sampled(spark, clashing, "")
    assert kept.columns == clashing.columns
    got = kept.collect()
    assert 0 < len(got) < 60 and all(r["_draw"] == r["row"] == "mine" for r in got)


def test_equal_ids_are_placed_alike_in_every_run(spark, docs, tmp_path):
    rows = [(None if k % 2 else 4, f"text number {k}") for k in range(60)] + [(4, None)]
    found = []
    for n, seed in enumerate((1, 2)):
        mixed = docs(random.Random(seed).sample(rows, len(rows))).repartition(3 + n)
        found.append(sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(mixed, path=str(tmp_path / f"t{n}")).collect()), key=lambda r: r[1]))
    assert found[0] == found[1] and len(found[0]) == 61


def test_pipeline_on_odd_and_empty_tables(spark, docs, odd_rows, bench_dir, tmp_path):
    import corpus_pipeline

    folder, item = bench_dir
    rnd = random.Random(5)
    rows = [*odd_rows, (None, "text without id"), (1, f"{prose(rnd, 30)} {item}")] + [(100 + k, prose(rnd, 50)) for k in range(40)]
    for name, own in (("odd", rows), ("empty", [])):
        here = tmp_path / name
        docs(own).write.parquet(str(here / "documents.parquet"))
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(here / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(here)).collect()
        starts, at = sorted((r.start, r.n_tokens) for r in got), 0
        for start, n in starts:
            assert start == at
            at += n
        assert (len(got) > 10) == (name == "odd") and 10 not in {r.doc_id for r in got}


def test_intermediate_tables_go_with_their_run(spark, docs, bench_dir, tmp_path):
    import corpus_pipeline

    folder, _ = bench_dir
    rnd = random.Random(6)
    shared_text = prose(rnd, 200)
    rows = [(k, prose(rnd, 40) + shared_text) for k in range(6)]
    lazy = repeats.drop_repeats(docs(rows))
    docs([(k, prose(rnd, 50)) for k in range(40)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = Path(shared.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in at.iterdir()}
    corpus_pipeline.run(spark, str(tmp_path)).count()
    # The pipeline leaves its stages' results and token files alone, and other callers' tables where they are.
    assert {p.name.split("-")[0] for p in at.iterdir() if p.name not in before} == {"corpus", "token"}
    assert sorted(r.doc_id for r in lazy.collect() if r.spans) == list(range(6))
    with shared.scratch(spark) as own:
        made = shared.cut(spark.range(3).toDF("x"), "made")
        with shared.scratch(spark):
            assert shared.cut(made, "inner").count() == 3
        assert made.count() == 3 and list(Path(own.removeprefix("file:")).glob("made-*"))
    assert not Path(own.removeprefix("file:")).exists()
