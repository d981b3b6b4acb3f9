"""The pipeline's stages against what the operators' brute-force counterparts keep, on a small fixture."""

import random

import corpus_pipeline
from quarry.llm import quality

from .helpers import prose
from .test_dedup import brute_near
from .test_text_filters import brute_leaks, brute_spans, labelled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    r = random.Random(12)
    docs, labels = labelled(r, 500)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, *_ in docs]
    item = prose(r, 14)
    rows += [(600 + i, t, "en", "s0", len(t)) for i, (_, t, *_rest) in enumerate(rows[:60])]
    rows += [(700 + i, prose(r, 40) + " " + item + " " + prose(r, 9), "en", "s1", 1) for i in range(9)]
    rows += [(800 + i, prose(r, 50) + " password=" + "abcdef1234" * 3, "en", "s2", 1) for i in range(9)] + [(900, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    now = spark.read.parquet(f"{d}/documents.parquet")
    kept = [now]
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        kept.append(now)
    assert all(x.columns == COLUMNS for x in kept[:-1])
    texts = [{x["doc_id"]: x["text"] for x in k.select("doc_id", "text").collect()} for k in kept]
    scored = quality.classify(kept[0], spark.read.parquet(f"{d}/labels.parquet")).collect()
    assert set(texts[1]) == {x["doc_id"] for x in scored if x["predicted"]}
    assert set(texts[2]) == {i for i, x in brute_near(sorted(texts[1].items()), 5).items() if x[2]}
    assert set(texts[3]) == {i for i, x in brute_leaks(texts[2].items(), [(1, item)]).items() if not x[1]}
    assert set(texts[4]) == {i for i, t in texts[3].items() if not brute_spans(t)}
    assert set(texts[5]) <= set(texts[4]) and len(texts[5]) > 0
    final = corpus_pipeline.run(spark, d)
    assert sorted((x["doc_id"], x["copies"]) for x in final.collect()) == sorted((x["doc_id"], x["copies"]) for x in kept[-1].collect())
