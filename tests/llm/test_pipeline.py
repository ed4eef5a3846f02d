"""The pipeline's stages on a small table: each keeps the columns, works on what its predecessor kept, and does what it says."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    passage = " ".join(f"shared{i}" for i in range(60))
    own = lambda i: " ".join(f"word{i}x{j}" for j in range(80))
    rows = [(i, own(i) + (f" idiot{'' if i % 2 else 's'} scum" if i % 5 == 0 else ""), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200, own(1), "en", "s0"), (201, own(2) + "\n" + passage, "en", "s1"), (202, own(3)[::-1] + "\n" + passage, "en", "s2"), (203, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = docs.collect()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    assert len(ids("toxicity") & set(range(0, 120, 5))) <= 4 and len(ids("toxicity") - set(range(0, 120, 5))) >= 96
    texts = {r["doc_id"]: r for r in kept["line_dedup"]}
    assert texts[201]["text"].endswith(passage) and passage not in texts[202]["text"] and texts[202]["n_chars"] == len(texts[202]["text"])
    assert texts[200]["text"] == "" and texts[203]["text"] is None
    assert ids("simhash_near_dedup") <= ids("line_dedup") and 1 in ids("simhash_near_dedup")
    assert ids("source_mixing") <= ids("simhash_near_dedup")
    assert {r["doc_id"] for r in kept["best_fit_packing"]} == ids("source_mixing")
