"""The document stream reads a table that is a folder of part files as well as a single file."""

from dictaudit.streaming import incremental as INC


def test_stream_of_a_folder_and_of_a_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 7 else None) for i in range(40)], "doc_id long, text string")
    vectors = spark.createDataFrame([("text 3",), ("text 9",)], "text string")
    folder = tmp_path / "many" / "documents.parquet"
    docs.repartition(5).write.parquet(str(folder))
    single = tmp_path / "one"
    single.mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(single / "documents.parquet")
    docs.write.parquet(str(tmp_path / "many" / "labels.parquet"))  # a neighbour that must not be read
    got = [sorted(map(tuple, INC.stream_entry_flags(spark, str(p), vectors).collect())) for p in (folder, single / "documents.parquet")]
    assert got[0] == got[1] and len(got[0]) == 40
    assert [r[0] for r in got[0] if r[5]] == ["3", "9"]
