import corpus_pipeline
from tests.conftest import DATA


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.kept(stage(spark, docs, DATA))
        assert out.columns == docs.columns and 0 < out.count() <= before
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == before


SMALL = "/root/testdata/sf0.001"


def test_stages_take_columns_of_any_name(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tessella.llm.common import kept, table

    docs = table(spark, SMALL, "documents")
    names = ["score", "n_removed", "maybe", "_page", "_at", "_bits", "_row", "rest", "g", "first_id"]
    extra = docs.select("*", *[F.lit(i).alias(x) for i, x in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = kept(stage(spark, docs, SMALL)), kept(stage(spark, extra, SMALL))
        assert wide.columns == extra.columns and wide.where("score <> 0 or first_id <> 9").count() == 0
        assert sorted(plain.collect()) == sorted(wide.select(plain.columns).collect())
        docs, extra = plain, wide


def test_near_dedup_against_all_pairs(spark):
    from tessella.llm.common import table

    from .test_operators import _brute_groups

    docs = table(spark, DATA, "documents")
    want = _brute_groups([(r.doc_id, r.text or "") for r in docs.collect()], 5, 0.8)
    left = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()}
    gone = {x for x, least in want.items() if least != x}
    assert set(want) - left <= gone and len(gone) > 20
    assert len(gone - left) >= 0.9 * len(gone)


def test_substring_stage_against_all_windows(spark):
    from tessella.llm.common import table

    docs = table(spark, SMALL, "documents")
    rows = sorted((r.doc_id, (r.text or "").encode().split()) for r in docs.collect())
    first, n = {}, corpus_pipeline.PASSAGE_WORDS
    for i, w in rows:
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    got = {r.doc_id: r for r in corpus_pipeline.substring_stage(spark, docs, SMALL).collect()}
    assert len(got) == len(rows)
    for i, w in rows:
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone.update(range(j, j + n))
        assert got[i].text.encode().split() == [x for j, x in enumerate(w) if j not in gone]


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    from tessella.llm.common import table

    docs = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text of a null id", "en", None, 3), (1, "another text of one", None, "web", None), (1, None, None, None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert corpus_pipeline.kept(stage(spark, docs.where("false"), SMALL)).count() == 0, name
        assert corpus_pipeline.kept(stage(spark, docs.limit(50).unionByName(odd).unionByName(odd), SMALL)).count() > 0, name
    left = corpus_pipeline.near_dedup_stage(spark, odd.unionByName(odd), SMALL).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in left) == [(False, ""), (False, "another text of one"), (True, "a text of a null id")]
