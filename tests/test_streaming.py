from lexframe.streaming import ingest

SCHEMA = "pack_id string, entry_id bigint, loaded_at timestamp_ntz"


def test_deliveries_count_once(spark, tmp_path):
    rows = "VALUES ('p', 1, TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('p', 1, TIMESTAMP_NTZ '2024-01-02 00:00:00'), ('q', 2, TIMESTAMP_NTZ '2024-01-02 00:00:00')"
    spark.sql(f"SELECT * FROM {rows} AS t(pack_id, entry_id, loaded_at)").write.parquet(str(tmp_path / "in"))
    stream = ingest.once_within(ingest.deliveries(spark, str(tmp_path / "in"), SCHEMA.replace("entry_id bigint", "entry_id int")), ["entry_id"])
    ingest.to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r["entry_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_late_copies_count_once(spark, tmp_path):
    """Copies 80 days later, over triggers and runs; rows behind all others are kept."""
    days = [("p", 1, "2024-01-01"), ("q", 2, "2024-02-10"), ("r", 3, "2024-03-21"), ("p", 1, "2024-03-21"), (None, 4, "2023-01-01"), ("q", 2, "2024-05-01"), (None, 4, "2024-05-02")]
    schema = SCHEMA.replace("entry_id bigint", "entry_id int")
    for run in (days[:5], days[5:]):
        for pack, entry, day in run:
            value = "CAST(NULL AS STRING)" if pack is None else f"'{pack}'"
            spark.sql(f"SELECT {value} AS pack_id, {entry} AS entry_id, TIMESTAMP_NTZ '{day} 00:00:00' AS loaded_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.deliveries(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
        assert ingest.once_to_table(stream, ["pack_id", "entry_id"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = sorted((r["entry_id"], str(r["loaded_at"])[:10]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(1, "2024-01-01"), (2, "2024-02-10"), (3, "2024-03-21"), (4, "2023-01-01")]
