"""Sources, sinks, settings, the staged pipeline and streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirflow import schema
from weirflow.config import CorpusConfig
from weirflow.functions import tokenizer
from weirflow.operators import tokens
from weirflow.plans.pipeline import Pipeline
from weirflow.sources import jsonl, tokenbin
from weirflow.sources.manifest import Manifest
from weirflow.streaming import streams


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "中", "source": "s", "lang": "x"}\n\nnot json\n5\n', encoding="utf-8")
    assert [r["text"] for r in jsonl.read_jsonl(spark, str(p), schema.DOCUMENT).collect()] == ["中"]
    assert sum(r["_rejected"] is not None for r in jsonl.read_jsonl(spark, str(p), schema.DOCUMENT, keep_rejected=True).collect()) == 2
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), schema.DOCUMENT).count() == 0
    out = str(tmp_path / "out")
    assert jsonl.write_jsonl(spark.createDataFrame([("é", None)], "text string, source string"), out) == 1
    assert "é" in "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("*.json"))
    assert jsonl.write_jsonl(spark.createDataFrame([("b", None)], "text string, source string"), out, append=True) == 1
    assert spark.read.json(out).count() == 2


def test_prompts(spark, tmp_path):
    p = tmp_path / "prompts.txt"
    p.write_text(" a \n\n　\nb\n", encoding="utf-8")
    assert [r["prompt"] for r in jsonl.read_prompts(spark, str(p)).collect()] == ["a", "b"]


@pytest.mark.parametrize("width, top", [(2, 65_535), (4, 70_000)])
def test_token_files(spark, tmp_path, width, top):
    ids = [0, 1, top, 5, 6, 7, 8]
    df = spark.createDataFrame([(1, ids[:3]), (2, ids[3:])], "doc_id bigint, token_ids array<int>")
    parts = tokens.parts(df, ["doc_id"], F.col("doc_id"), 3)
    written = tokenbin.write_tokens(parts, str(tmp_path / "parts"), width, part_tokens=3).collect()
    assert sum(r["tokens"] for r in written) == 7 and len(written) == 3
    target = str(tmp_path / "train.bin")
    assert tokenbin.join_parts(str(tmp_path / "parts"), target) == 7 * width
    assert np.fromfile(target, dtype="<u2" if width == 2 else "<u4").tolist() == ids
    assert [r["token"] for r in tokenbin.read_tokens(spark, target, width, range_tokens=2).orderBy("gpos").collect()] == ids
    assert [r["token"] for r in tokenbin.read_tokens(spark, f"file://{tmp_path}/parts", width, range_tokens=2).orderBy("gpos").collect()] == ids
    assert tokenbin.read_tokens(spark, str(tmp_path / "none.bin"), width).count() == 0


def test_sample_files(spark, tmp_path):
    pairs = spark.createDataFrame([(0, [1, 2], [2, 3]), (1, [4, 5], [5, 6])], "sample bigint, x array<int>, y array<int>")
    path = str(tmp_path / "s.bin")
    assert tokenbin.write_samples(pairs, path) == 2
    assert [(list(r["x"]), list(r["y"])) for r in tokenbin.read_samples(spark, path, 2).orderBy("sample").collect()] == [([1, 2], [2, 3]), ([4, 5], [5, 6])]
    assert tokenbin.write_samples(pairs.limit(0), str(tmp_path / "e.bin")) == 0 and not (tmp_path / "e.bin").exists()
    assert tokenbin.read_samples(spark, str(tmp_path / "e.bin"), 2).count() == 0


def test_sidecar_manifest_config(tmp_path):
    assert tokenbin.read_sidecar(str(tmp_path / "m.json"))["eos_token_id"] == 2
    tokenbin.write_sidecar(str(tmp_path / "m.json"), vocab_size=9)
    assert tokenbin.read_sidecar(str(tmp_path / "m.json"))["vocab_size"] == 9
    m = Manifest(str(tmp_path))
    m.record(1, {"rows": 3}, 0)
    m.record(1, {"rows": 3}, 0)
    assert Manifest(str(tmp_path)).state["completed"] == [1]
    (tmp_path / "manifest.json").write_text("{broken")
    assert not Manifest(str(tmp_path)).done(1)
    with pytest.raises(ValueError):
        CorpusConfig("x", split_ratio=(0.5, 0.1, 0.1))
    c = CorpusConfig("x", vocab_size=70_000)
    c.save(str(tmp_path / "c.json"))
    assert CorpusConfig.load(str(tmp_path / "c.json")) == c and c.token_width == 4


def test_pipeline_resumes(spark, tmp_path):
    zh = spark.createDataFrame([(i, f"<p>第{i}课 中文文本内容很长很长，网站 http://a.b/{i} 结束。</p>", None) for i in range(30)] + [(30, "", "s"), (31, None, "s")], "row_no bigint, text string, source string")
    en = spark.createDataFrame([(i, f"English text number {i} with enough words in it.", json.dumps({"url": "u", "language": "en"})) for i in range(25)], "row_no bigint, raw_content string, meta string")
    p = Pipeline(spark, zh, en, CorpusConfig(str(tmp_path), context_size=15, budgets={"chinese": 10_000, "english": 10_000}, near_threshold=0.8))
    state = p.run()
    assert state["completed"] == list(range(7)) and state["stage_2"]["rows"] <= 55
    assert {r["split"] for r in p.read(3).select("split").distinct().collect()} == {"train", "val", "test"}
    assert p.read(6).where(F.size("ids") != 16).count() == 0
    read = [tokenbin.read_tokens(spark, f"{tmp_path}/6_binarize_tokens/{k}").count() for k in state["stage_6"]["tokens"]]
    assert read == list(state["stage_6"]["tokens"].values()) and tokenbin.read_sidecar(f"{tmp_path}/6_binarize_tokens/train/meta.json")["tokens"] == state["stage_6"]["tokens"]["train"]
    assert p.run() == state


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", "the text one", 5), (2, "a", " The Text one ", 5), (3, "a", "another text", 4), (4, "a", "third text here", 5), (5, "a", "x", 1)], "id bigint, lang string, text string, n int").coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema("id bigint, lang string, text string, n int").parquet(str(src))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(streams.dedup_stream(read()), "dedup").count() == 4
    assert sorted(r["id"] for r in run(streams.budget_stream(read(), F.col("n"), 14, ["id"]), "budget").collect()) == [1, 2, 3]
    assert run(streams.clean_stream(read(), 5), "clean").count() == 4


def test_stream_from_source_to_sink(spark, tmp_path):
    for k in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(json.dumps({"id": 10 * k + i, "lang": "a", "text": f"text number {k} {i}"}) for i in range(4)), encoding="utf-8")
    docs = streams.read_stream(spark, str(tmp_path / "in"), "id bigint, lang string, text string", files_a_batch=2)
    q = streams.write_stream(streams.clean_stream(docs, 5), str(tmp_path / "out"), str(tmp_path / "check"), "parquet", ("lang",))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20 and len([p for p in q.recentProgress if p.numInputRows]) == 3


def test_event_and_session_windows(spark, tmp_path):
    src = tmp_path / "events"
    spark.createDataFrame([("a", "2024-01-01 00:00:10", 1), ("a", "2024-01-01 00:04:00", 1), ("b", "2024-01-01 00:07:00", 1), ("a", "2024-01-01 02:00:00", 1)], "k string, t string, n int").selectExpr("k", "timestamp(t) t", "n").coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema("k string, t timestamp, n int").parquet(str(src))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r["k"], str(r["start"])[11:16], r["n"]) for r in spark.table(name).collect())

    assert run(streams.event_counts(read(), "t", ["k"], "5 minutes"), "tumbling") == [("a", "00:00", 2), ("a", "02:00", 1), ("b", "00:05", 1)]
    assert run(streams.session_counts(read(), "t", "k", "5 minutes", "10 minutes"), "sessions")[:2] == [("a", "00:00", 2), ("b", "00:07", 1)]


def test_splits_results_and_listing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train", "x"), (2, "a", "val", "y"), (3, "b", "train", "z")], "id bigint, lang string, split string, text string")
    jsonl.write_splits(df, str(tmp_path / "splits"))
    jsonl.write_splits(df.where("lang = 'b'"), str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).count() == 3 and (tmp_path / "splits" / "lang=a" / "split=val").exists()
    jsonl.write_results(df.select(F.col("text").alias("prompt"), F.lit(None).cast("string").alias("answer")), str(tmp_path / "results"))
    assert sum(r["value"].startswith("Prompt: ") for r in spark.read.text(str(tmp_path / "results")).collect()) == 3
    assert jsonl.write_jsonl(df, str(tmp_path / "lines"), append=True) == 3 and jsonl.write_jsonl(df, str(tmp_path / "lines"), append=True) == 3
    assert jsonl.read_jsonl(spark, str(tmp_path / "lines"), df.schema).count() == 6
    (tmp_path / "named").mkdir()
    for n in ("b", "a"):
        (tmp_path / "named" / f"{n}.jsonl").write_text("{}\n")
    assert [r["path"][-7:] for r in jsonl.list_jsonl(spark, str(tmp_path / "named")).collect()] == ["a.jsonl", "b.jsonl"]


def test_raw_lines_enter_the_pipeline(spark, tmp_path):
    (tmp_path / "zh").mkdir()
    (tmp_path / "zh" / "a.jsonl").write_text("\n".join(json.dumps({"text": f"中文文本内容很长很长第{i}课", "source": "s"}, ensure_ascii=False) for i in range(12)), encoding="utf-8")
    (tmp_path / "en.jsonl").write_text(json.dumps({"raw_content": "An English text of some length.", "meta": json.dumps({"url": "u", "language": "en"})}), encoding="utf-8")
    zh, en = jsonl.read_raw(spark, str(tmp_path / "zh"), "chinese"), jsonl.read_raw(spark, str(tmp_path / "en.jsonl"), "english")
    state = Pipeline(spark, zh, en, CorpusConfig(str(tmp_path / "out"), context_size=15, budgets={"chinese": 10_000, "english": 10_000})).run()
    assert state["stage_0"]["rows"] == 13 and state["completed"] == list(range(7))


def test_command_line(spark, tmp_path, capsys):
    from weirflow.__main__ import main

    assert main(["query", "source_rollup", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() > 0
    CorpusConfig(str(tmp_path / "run"), context_size=15).save(str(tmp_path / "c.json"))
    (tmp_path / "zh.jsonl").write_text(json.dumps({"text": "中文文本内容很长很长第一课"}, ensure_ascii=False), encoding="utf-8")
    assert main(["run", str(tmp_path / "c.json"), "--zh", str(tmp_path / "zh.jsonl"), "--en", str(tmp_path / "none.jsonl"), "--last", "1"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["stage_1"]["rows"] == 1


def test_tokenizer_columns(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    texts = ["The old mill", "", None, "中文 text’s 😀", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("ids", tokenizer.encode(F.col("text"), path))
    rows = df.withColumn("back", tokenizer.decode(F.col("ids"), path)).withColumn("cut", tokenizer.encode(F.col("text"), path, vocab=100, eos=2)).orderBy("i").collect()
    assert [r["back"] for r in rows] == [t or "" for t in texts] and rows[1]["ids"] == [] and rows[2]["cut"] == []
    assert all(r["cut"][-1] == 2 and len(r["cut"]) == len(r["ids"]) + 1 and max(r["cut"]) < 100 for r in (rows[0], rows[3], rows[4]))


def test_queries_have_names_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "clean_dedup_stats" in e.queries()


def test_tokenizer_holds_a_slice_at_once(spark, monkeypatch):
    texts = ["日本語 a b", "", None, "x" * 900_000, *["many words of one text " * 4_000] * 12]
    given = []

    class Watched:
        def __getattr__(self, name):
            def run(part, **how):
                given.append((len(part), sum(map(len, part))))
                return getattr(real, name)(part, **how)

            return run

    path = "/opt/tokenizers/byte_bpe_50k.json"
    real = tokenizer.load(path)
    monkeypatch.setattr(tokenizer, "load", lambda _: Watched())
    monkeypatch.setattr(tokenizer.F, "pandas_udf", lambda f, kind: lambda c: f(c))
    ids = tokenizer.encode(pd.Series(texts, dtype=object), path)
    assert [x.tolist() for x in ids] == [real.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(tokenizer.decode(ids, path)) == [t or "" for t in texts]
    both = tokenizer.round_trip(pd.Series(texts, dtype=object), path)
    assert [x.tolist() for x in both["ids"]] == [x.tolist() for x in ids] and list(both["text"]) == [t or "" for t in texts]
    assert len(given) > 6 and all(n == 1 or size <= tokenizer.SLICE for n, size in given)
