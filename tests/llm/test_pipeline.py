"""The pipeline: each stage takes effect on what the one before kept, and clean documents stay."""

import re

import corpus_pipeline
from tests.llm.conftest import prose


#: The second language is written in other letters, so that the first stage can tell the two apart.
OTHER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "".join(chr(0x430 + i) for i in range(26)))


#: Extra columns named like ones inside the stages.
CLASHES = ("times", "_times", "_rule", "_gone", "_of_source", "of", "row", "key", "found")


def test_stages_over_planted_cases(spark, tmp_path):
    item = prose(70, 40)
    clean = [(i, prose(1000 + i, 200), "xx", "s1", None) for i in range(101, 140, 2)]
    clean += [(i, prose(1000 + i, 200).translate(OTHER), "yy", "s0", None) for i in range(100, 140, 2)]
    base = prose(60, 150)
    planted = [
        (200, base, "xx", "s0", 1),
        (201, base.replace(" ", "  "), "xx", "s0", 1),
        (202, base + " tail", "xx", "s0", 1),
        (203, "12 34", "xx", "s0", 1),
        (204, prose(61, 100) + "\n" + item.upper() + "\n" + prose(62, 100), "xx", "s1", 1),
        (None, None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    clean, planted = ([(*r, *CLASHES) for r in rows] for rows in (clean, planted))
    spark.createDataFrame(clean + planted, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in docs.collect()})
    kept = {r[0] for r in clean}
    assert left[0] == kept | {200, 201, 202, 204}
    assert left[1] == kept | {201, 202, 204}
    assert left[2] == kept | {201, 204}
    assert left[3] == kept | {201}
    assert left[4] <= left[3] and docs.where("times_ < 1 OR times <> 'times'").count() == 0
    words = sum(len(re.findall(r"\S+", r.text)) * r.times_ for r in docs.collect())
    total = sum(len(re.findall(r"\S+", t)) for i, t, *_ in clean + planted if i in left[3])
    assert abs(words - total) < 500


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
