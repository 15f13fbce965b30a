from gritsieve.streaming.incremental import findings_stream


def test_new_files_are_analysed_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for i in range(2):
        spark.createDataFrame([(f"f{i}.php", "<?php\nvar_dump(1);\n")], "path string, text string").write.mode("append").parquet(source)
        findings_stream(spark, source, sink, check).awaitTermination(120)
    assert sorted(r["path"] for r in spark.read.parquet(sink).collect()) == ["f0.php", "f1.php"]
