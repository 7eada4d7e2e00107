"""The pipeline's stages against plain versions of their decisions, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm import pii, toxicity
from quarry.llm.common import cut, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [table(spark, SF, "documents")]
    for _, f in cp.STAGES:
        out.append(cut(f(spark, out[-1], SF)))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "personal_data", "source_mix", "sentencepiece"]


def test_toxic_documents_go(spark, stages):
    model = toxicity.train(stages[0], table(spark, SF, "labels").where(~toxicity.held_out(F.col("doc_id"))))
    want = {r["doc_id"] for r in stages[0].collect() if model.score(toxicity.words_of(r["text"])) < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    from tests.llm.test_text_operators import plain_components

    groups = plain_components([(r["doc_id"], r["text"]) for r in stages[1].collect()], 5, 80)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({i for i, _, c in groups if i == c})


def test_personal_data_is_masked(stages):
    assert stages[3].count() == stages[2].count()
    for r in stages[3].collect():
        assert pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])


def test_mix_and_ids(stages):
    times = {}
    for r in stages[4].collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in stages[3].collect()}
    out = stages[5].collect()
    assert len(out) == sum(times.values()) and all(r["round_trip"] and len(r["token_ids"]) == r["n_tokens"] > 0 for r in out)


def test_clashing_columns_and_missing_ids(spark, stages):
    """Columns named as what the stages add, null doc_ids, repeated ones: all pass as they came."""
    names = ["score", "predicted", "clean", "times", "copy", "rid", "row", "n", "size", "key", "sid"]
    few = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in stages[0].orderBy("doc_id").limit(60).collect()]
    few += [(None, "some words without an id", "en", "s", 24), (None, "quite other words, and no id either", None, None, 35), (3, "a second text of this id", "en", "s", 24), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(few)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    marks = {r[5][5:]: r for r in ([*r[:5], f"score{i}"] for i, r in enumerate(few))}
    for _, f in cp.STAGES[:-1]:
        df = cut(f(spark, df, SF))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        for r in df.collect():
            i = r["score"][5:]
            assert [r[c] for c in names] == [f"{c}{i}" for c in names] and (r["doc_id"], r["lang"], r["source"]) == (marks[i][0], marks[i][2], marks[i][3])
    assert cp.STAGES[-1][1](spark, df, SF).count() == df.count() > 0


def test_empty_table(spark, stages):
    none = stages[0].limit(0)
    for _, f in cp.STAGES[:-1]:
        none = f(spark, none, SF)
        assert none.columns == stages[0].columns
        none = cut(none)
    assert cp.STAGES[-1][1](spark, none, SF).count() == 0
