"""The stages, each against its own input worked out in plain Python."""

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def kept(spark, data_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, data_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(kept):
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns and df.dtypes == kept[0].dtypes


def test_toxic_go_and_clean_stay(spark, data_dir, kept):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    left = set(rows(kept[1]))
    clean = [i for i, x in labels.items() if not x]
    assert sum(i in left for i in clean) >= 0.98 * len(clean)


def test_lines(kept):
    from test_linededup import kept_texts

    before, after = rows(kept[1]), rows(kept[2])
    want = kept_texts([tuple(r) for r in before.values()], 20)
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert [x.strip() for x in r["text"].split("\n") if x.strip()] == want[(i, before[i]["text"])]
        assert r["n_chars"] == len(r["text"])


def test_near_duplicates(kept):
    from test_similar import kept_positions

    before, after = rows(kept[2]), rows(kept[3])
    ids = sorted(before)
    assert set(after) == {ids[k] for k in kept_positions([before[i]["text"] for i in ids])}
    assert all(after[i] == before[i] for i in after)


def test_decontamination(spark, data_dir, kept):
    from test_decontamination import words

    windows = set()
    for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = {i for i, r in rows(kept[3]).items()
             if not any(tuple(w[s:s + 10]) in windows for w in [words(r["text"])] for s in range(max(1, len(w) - 9)))}
    assert set(rows(kept[4])) == clean


def test_packing(kept):
    from test_packing import check_places

    placed = kept[5].collect()
    assert {r["doc_id"] for r in placed} == set(rows(kept[4]))
    check_places(placed, 2048)


def test_run(spark, data_dir, kept):
    assert cp.run(spark, data_dir).count() == kept[5].count()
