import datetime
import json

import numpy as np
import pandas as pd

from tessera.operators import intervals
from tessera.plans import fixtures as fx
from tessera.plans import pipelines
from tessera.sources import audio, files, sinks
from tessera.streaming import sessions


def test_wav(spark, tmp_path):
    t = np.arange(8000) / 8000
    stereo = np.stack([np.sin(2 * np.pi * 50 * t) / 2, np.zeros(8000)], 1).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(audio.encode(stereo, 8000))
    (tmp_path / "b.wav").write_bytes(b"RIFF0000WAVEjunk")
    back, rate = audio.decode((tmp_path / "a.wav").read_bytes())
    assert rate == 8000 and np.abs(back - stereo).max() < 1e-4
    found = files.discover(spark, [str(tmp_path)])
    info = {r.path.rsplit("/", 1)[1]: r for r in audio.media_info(found).collect()}
    assert info["a.wav"].ok and info["a.wav"].duration == 1.0 and info["a.wav"].channels == 2 and abs(info["a.wav"].max_dbfs + 6.02) < 0.01
    assert not info["b.wav"].ok and info["b.wav"].error
    good = found.where("path like '%a.wav'")
    assert [r.chunk_no for r in sorted(audio.slices(good, 0.3).collect(), key=lambda r: r.chunk_no)] == [0, 1, 2, 3]
    path = good.first().path
    segs = spark.createDataFrame([(path, "x", 0, 100), (path, "x", 500, 600), (path, "y", 100, 150)], "path string, speaker string, from_ms long, to_ms long")
    sizes = {r.speaker: len(audio.decode(bytes(r.content))[0]) for r in audio.gather(segs, good).collect()}
    assert sizes == {"x": 1600, "y": 400}
    gold = files.gold_folder(spark, str(tmp_path))
    assert {r.name for r in gold.collect()} == {"a", "b"}


def test_registry_and_meta(spark, tmp_path):
    for n in ("b.txt", "a.txt"):
        (tmp_path / n).write_bytes(b"abc")
    found = files.discover(spark, [f"{tmp_path}/*.txt", f"{tmp_path}/a*"])
    assert [(r.name, r.place) for r in sorted(files.registered(found).collect(), key=lambda r: r.place)] == [("a.txt", 1), ("b.txt", 2)]
    m = files.meta(found).first()
    assert m.sha1 == "a9993e364706816aba3e25717850c26c9cd0d89d" and m.bytes == 3
    assert {r.pipeline for r in files.routed(found).collect()} == {"unrecognized"}


def test_podcast_pipeline(spark, sf_dir, tmp_path):
    w = fx.words(spark, sf_dir).where("media_id < 3")
    s = fx.segments(spark, sf_dir, w)
    names = s.where("speaker = 'user'").select("media_id", "speaker").distinct().selectExpr("media_id", "speaker", "'Ann' as name")
    out = pipelines.podcast(w, s.drop("turn"), names=names)
    paths = sinks.store(out, f"{tmp_path}/out")
    assert len(paths) == 5
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/transcript.txt/media_id=1").collect()]
    assert lines and all("]: " in x for x in lines)
    d = spark.read.json(f"{tmp_path}/out/diarization.json")
    assert "Ann" in d.select("diarization.*").columns
    rttm = [r.value for r in spark.read.text(f"{tmp_path}/out/diarization.rttm/media_id=1").collect()]
    assert rttm == sorted(rttm, key=lambda x: float(x.split()[3])) and all(x.startswith("SPEAKER media_1 1 ") for x in rttm)
    assert pipelines.podcast(w, None) == {}


def test_bundle(tmp_path):
    assert sinks.folder_name("/x/talk.wav", datetime.datetime(2024, 1, 2, 3, 4, 5)) == "talk_2024-01-02_03-04-05"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_text("1")
    assert sinks.pack(str(tmp_path / "f")).endswith("f.zip") and not (tmp_path / "f").exists()


def test_guarded(spark):
    ok, bad = sinks.parted(sinks.guarded(spark.createDataFrame([("1",), ("x",)], "s string"), sinks.F.col("s").try_cast("int"), "n", "no number"))
    assert ok.first().n == 1 and bad.first().error == "no number"


def test_entity_map(spark):
    e = spark.createDataFrame([(1, 0, "A", "x", 3, 4), (1, 0, "A", "y", 1, 2), (1, 0, "B", "z", 0, 1)], "id long, sent_no int, label string, ent string, `from` int, `to` int")
    ner = json.loads(sinks.nested_entities(e, ["id", "sent_no"]).select(sinks.F.to_json("ner").alias("j")).first().j)
    assert ner == {"A": [{"ent": "y", "from": 1, "to": 2}, {"ent": "x", "from": 3, "to": 4}], "B": [{"ent": "z", "from": 0, "to": 1}]}


def run(query, mode="append"):
    q = query.writeStream.outputMode(mode).format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    return query.sparkSession.table("out").collect()


def test_stream_of_utterances(spark, tmp_path):
    w = [(1, 0, 0, "a", 0, 1, ["x"]), (1, 0, 1, "b", 1, 2, ["x"]), (1, 0, 2, "c", 2, 3, []), (1, 9, 0, None, None, None, [])]
    ddl = "media_id long, turn long, pos int, word string, start_ms long, end_ms long, speakers array<string>"
    spark.createDataFrame(w, ddl).coalesce(1).write.parquet(f"{tmp_path}/w")
    got = run(sessions.utterances(spark.readStream.schema(ddl).parquet(f"{tmp_path}/w")))
    assert [(r.speaker, r.start_ms, r.end_ms, r.text) for r in got] == [("x", 0, 2, "a b"), ("<Unknown>", 2, 3, "c")]


def test_windows_and_sessions(spark, tmp_path):
    ts = pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:50", "2024-01-01 05:00"])
    spark.createDataFrame([(t.to_pydatetime(), 1, "k", 2.0) for t in ts], "ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string, value double").parquet(f"{tmp_path}/e")
    assert sorted(r.n for r in run(sessions.windowed(stream))) == [1, 2]
    assert sorted(r.n for r in run(sessions.sessions(stream))) == [1, 2]


def test_alignment_plan_prunes_and_has_no_python(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    plan = intervals.align(w, fx.segments(spark, sf_dir, w))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
