"""The pipeline's stages on the smallest fixture against their brute-force versions, and the registered queries."""

import corpus_pipeline
from tests.llm.test_joins import brute_components, brute_lines
from tests.llm.test_texts import brute_hits
from trackweave.llm import common, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = common.read_table(spark, SF, "documents")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        after = docs.collect()
        ids = sorted(r["doc_id"] for r in after)
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            scores = quality.score_documents(common.read_table(spark, SF, "documents"), common.read_table(spark, SF, "labels")).where("predicted = 1")
            assert ids == sorted(r["doc_id"] for r in scores.collect())
        if name == "line_dedup":
            gone = brute_lines(before)
            want = {r[0]: "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r[0]]) for r in before if len(r[1].split("\n")) > len(gone[r[0]])}
            assert {r["doc_id"]: r["text"] for r in after} == want
        if name == "near_duplicates":
            assert ids == sorted(i for i, _, c in brute_components(sorted(before), 5, 4, 5) if i == c)
        if name == "decontamination":
            items = [tuple(r) for r in common.read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
            assert ids == sorted(r[0] for r in before if brute_hits(r[1], items)[1] == 0)
        if name == "packing":
            assert {r["doc_id"] for r in after} == {r[0] for r in before}
    assert seen == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_all_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()} and "pipeline" in names


def test_stages_keep_columns_of_any_name(spark):
    """Names that the operators use themselves, and names with dots."""
    more = ["found", "__found", "__text_3", "__whole", "__score", "score", "row", "a.b", "__doc", "__row", "__lines", "cls", "label", "first"]
    rows = [(k, t, "en", "web", len(t or ""), *[f"{k}{c}" for c in more]) for k, t in enumerate(["One line of good plain text here, and a few more words.", None, "", "Another line of text.\nAnother line of text."])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in more))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in more] == [f"{r['doc_id']}{c}" for c in more], name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {0, 1, 2, 3}
