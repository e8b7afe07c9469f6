"""Whole runs on the smallest given tables."""

import pytest
from pyspark.sql import functions as F

from packetloom.catalog.base import RTT_TIMEOUT, packets
from packetloom.operators import report
from packetloom.plans import detect, features, registry
from packetloom.sources.sinks import report_page

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark):
    options = features.FeatureOptions(slice_width="1 day", host_window="1 hour", rtt_timeout=RTT_TIMEOUT)
    return features.build_features(packets(spark, SF), options).persist()


def test_every_packet_gets_every_feature(spark, built):
    assert built.count() == packets(spark, SF).count()
    for name in ("tcp_flag_syn", "flow_pkt_count", "total_packets", "avg_rtt_ms", "src_host_pkt_count_win", "packets_in_1s_window",
                 "inter_arrival_time", "dga_score", "payload_entropy", "src_is_private", "hour_of_day"):
        assert name in built.columns and built.where(F.col(name).isNull()).count() == 0
    assert "payload" not in built.columns


def test_chosen_steps_only(spark):
    options = features.FeatureOptions(steps=["packet", "flow"], slice_width="1 day", quality_control=False)
    out = features.build_features(packets(spark, SF), options)
    assert "flow_pkt_count" in out.columns and "src_host_pkt_count_win" not in out.columns and "dga_score" not in out.columns
    with pytest.raises(ValueError):
        features.build_features(packets(spark, SF), features.FeatureOptions(steps=["nope"]))


def test_registered_step(spark):
    registry.register("double_len", lambda df: df.withColumn("double_len", F.col("frame_len") * 2))
    out = features.build_features(packets(spark, SF), features.FeatureOptions(steps=["double_len"], quality_control=False))
    assert out.where("double_len <> frame_len * 2").count() == 0
    with pytest.raises(ValueError):
        registry.register("dns", lambda df: df)


def test_hold_out(spark):
    df = spark.range(5000).selectExpr("cast(id % 7 AS string) AS client_ip", "id AS frame_no")
    train, test = detect.hold_out(df, 0.2)
    again = detect.hold_out(df.repartition(9), 0.2)[1]
    assert 800 < test.count() < 1200 and train.count() + test.count() == 5000
    assert test.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        detect.hold_out(df, min_samples=10_000)


def test_detection_and_report(spark, built, tmp_path):
    vectors = detect.session_vectors(built, "5 days").persist()
    models = detect.train(vectors, contamination=0.1, length=3, encoding_dim=6, trees=25)
    results = {m: detect.detect(vectors, models, m, length=3, high=0.6, suspicious=0.5, sequence=0.5) for m in detect.MODES}
    assert {m: r.count() for m, r in results.items()} == {m: vectors.count() for m in detect.MODES}
    tables = detect.report_tables(built, results["collaborative"].persist())
    page = report_page({k: tables[k] for k in ("header", "protocols", "top_sources", "local_host_peers_out", "edges", "explanation")})
    assert "protocols" in page and report.main_host(built).first()["src_ip"] in page
    forest = detect.load_or_train(spark, str(tmp_path / "m"), vectors, trees=5)
    again = detect.load_or_train(spark, str(tmp_path / "m"), vectors, trees=99)
    assert len(forest.nodes) == len(again.nodes)
    with pytest.raises(ValueError):
        detect.detect(vectors, models, "magic")


def test_a_scope_keeps_only_what_it_is_told(spark, tmp_path):
    import os

    from packetloom import session

    def tables():
        return {os.path.join(at, f) for at, _, files in os.walk(session._run_dir(spark)) for f in files if f.endswith(".parquet")}

    before = tables()
    with session.scratch_scope(spark) as keep:
        inner = session.settled(spark.range(5))
        with session.scratch_scope(spark) as keep_again:
            middle = keep_again(inner.selectExpr("id * 2 AS id"))
        assert middle.count() == 5 and len(tables() - before) > 1
        kept = keep(middle.where("id > 2"))
    assert sorted(r.id for r in kept.collect()) == [4, 6, 8]
    mine = {os.path.dirname(f.removeprefix("file://")) for f in kept.inputFiles()}
    assert {os.path.dirname(f) for f in tables() - before} == mine
    with pytest.raises(ValueError), session.scratch_scope(spark):
        session.settled(spark.range(3))
        raise ValueError
    assert {os.path.dirname(f) for f in tables() - before} == mine
