from isoglotta.__main__ import main
from isoglotta.streaming.cells import first_cells, value_counts

SCHEMA = "did string, cid string, initial string, final string, tone string, seq bigint"


def test_similarity_and_compliance_jobs(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{d}.csv").write_text("character,cid,initial,final,tone\n" + "".join(f"x,{i},{'pt'[i % 2]},{'ai'[i % 2]},{1 + i % 3}\n" for i in range(12)))
    (tmp_path / "rules.csv").write_text("# rules\nelement,cid1,cid2\ninitial,0 2,4\nfinal,0,1\n")
    main(["similarity", str(tmp_path / "in"), "-o", str(tmp_path / "chi")])
    assert spark.read.csv(str(tmp_path / "chi"), header=True).count() == 4
    main(["compliance", str(tmp_path / "in"), "-o", str(tmp_path / "com"), "-r", str(tmp_path / "rules.csv")])
    got = {(r["did"], float(r["value"])) for r in spark.read.csv(str(tmp_path / "com"), header=True).collect()}
    assert got == {("a", 1.0), ("b", 1.0), ("a", 0.0), ("b", 0.0)}


def test_streamed_cells_equal_the_batch(spark, tmp_path):
    rows = [("d", "1", None, "a", "1", 3), ("d", "1", "p", "i", None, 1), ("e", "2", "t", "", "2", 5), ("d", "1", "k", "u", "4", 2)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    first_cells(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out/v=3")
    got = {(r["did"], r["cid"], r["element"]): (r["value"], r["seq"]) for r in last.collect()}
    assert got == {("d", "1", "initial"): ("p", 1), ("d", "1", "final"): ("i", 1), ("d", "1", "tone"): ("4", 2), ("e", "2", "initial"): ("t", 5), ("e", "2", "final"): ("", 5), ("e", "2", "tone"): ("2", 5)}
    q = value_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["element"], r["value"]): r["n"] for r in spark.sql("SELECT * FROM counts WHERE did = 'd'").collect()}["final", "a"] == 1
