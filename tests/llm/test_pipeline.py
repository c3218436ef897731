"""The five stages one after another, on null, blank, repeated and empty input."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("kind", ["mixed", "blank", "empty"])
def test_pipeline(spark, tmp_path, kind):
    rows = {
        "mixed": [
            (1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, " \n ", "en", "z", 0), (4, words("w", 300), "en", "c", 0), (5, words("w", 300), "en", None, 0), (6, words("p", 60) + " " + words("q", 200), "en", "c", 0),
            (7, words("r", 200) + " " + words("p", 60), "en", "c", 0), (None, words("v", 100), None, None, None), (None, None, None, None, None), (7, words("r", 200) + " " + words("p", 60), "en", "c", 0),
        ],
        "blank": [(1, None, "en", "a", 0), (2, " ", "en", "a", 0)], "empty": [],
    }[kind]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    if kind != "mixed":
        assert kept["tokens"] == [] and len(kept["near duplicates"]) == (kind == "blank") * 2
        return
    assert len(kept["toxicity"]) == len(rows)
    left = {r.doc_id: r.text for r in kept["near duplicates"] if r.doc_id}
    assert 4 in left and 5 not in left and 6 in left and 7 in left
    cut = {r.doc_id: r for r in kept["substring duplicates"]}
    assert cut[6].text == left[6] and cut[7].text == words("r", 200) and cut[7].n_chars == len(cut[7].text)
    assert {r.doc_id for r in kept["mixing"]} <= {4, 6, 7, None} and all(r.text.strip() for r in kept["mixing"])
    assert sorted(r.text for r in kept["tokens"]) == sorted(r.text for r in kept["mixing"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect())) == sorted(str(r) for r in docs.select("doc_id", "n_tokens").collect())
