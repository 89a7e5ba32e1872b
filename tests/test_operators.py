"""Order-dependent operators, duplicates and vectors against plain Python."""

import hashlib
import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from weirflow.config import CorpusConfig
from weirflow.functions import quality as Q
from weirflow.functions import text as T
from weirflow.operators import acquire, dedup, metrics, order, sample, tokens, vector
from weirflow.plans.pipeline import Pipeline


def md5_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 15, 19])
def test_split_counts(spark, n):
    df = spark.createDataFrame([(i, "a") for i in range(n)], "doc_id bigint, lang string")
    for boundary, cut in (("cumulative", lambda: int(n * (0.8 + 0.1))), ("separate", lambda: int(n * 0.8) + int(n * 0.1))):
        got = {r["doc_id"]: r["split"] for r in sample.exact_split(df, ["lang"], "doc_id", boundary=boundary).collect()}
        want = md5_order(range(n), 42)
        assert [got[i] for i in want] == ["train"] * int(n * 0.8) + ["val"] * (cut() - int(n * 0.8)) + ["test"] * (n - cut())


def test_running_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(10)) for i in range(300)]
    want, upto = {}, {}
    for i, k, v in rows:
        upto[k] = upto.get(k, 0) + v
        want[i] = upto[k]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id bigint, k string, v int").repartition(parts)
        got = order.running(df, ["k"], ["id"], order.id_bucket(df, "id", 16), {"s": F.col("v")}, totals=True)
        assert {r["id"]: r["s"] for r in got.collect()} == want
        assert {r["k"]: r["s_all"] for r in got.collect()} == upto


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(1, "a", 4), (2, "a", 5), (3, "a", 2), (4, "a", 1), (5, "b", 9)], "doc_id bigint, lang string, n int")
    assert {r["doc_id"] for r in sample.budget_take(df, {"a": 10}, F.col("n")).collect()} == {1, 2}


def test_interleave_drains_both_sides(spark):
    df = spark.createDataFrame([(i, i < 13) for i in range(20)], "doc_id bigint, zh boolean")
    rows = sample.interleave(df, F.col("zh"), "doc_id").collect()
    per = {}
    for r in rows:
        per.setdefault(r["round"], []).append(r["zh"])
    assert len(rows) == 20 and all(sum(v) <= 6 and len(v) - sum(v) <= 4 for v in per.values()) and [sum(per[k]) for k in sorted(per)] == [6, 6, 1]


def test_shards_and_batches(spark):
    placed = sample.epoch_order(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", epoch=1)
    got = sample.worker_shards(placed, 3).collect()
    assert sorted(r["worker"] for r in got) == [0] * 3 + [1] * 3 + [2] * 4
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["place"])] == md5_order(range(10), 43)
    assert {r["worker"] for r in sample.worker_shards(placed, 20).collect()} == {19}
    assert sample.batches(placed, 4).count() == 8 and sample.batches(placed, 4, drop_last=False).count() == 10


def test_tokens(spark):
    df = spark.createDataFrame([(1, "中a"), (2, ""), (3, None), (4, "b")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["token_ids"] for r in tokens.tokenize(df).collect()}
    assert got == {1: [ord("中") % 6400, 97, 2], 4: [98, 2]}


def test_tokens_of_the_whole_text(spark, tmp_path):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    df = spark.createDataFrame([(1, text)], "row_no bigint, text string")
    want = [ord(c) for c in text] + [2]
    assert tokens.tokenize(df).first()["token_ids"] == want
    assert tokens.tokenize(df, encoder=tokens.reference_encode).first()["token_ids"] == want[:1000] + [2]
    config = CorpusConfig(base_dir=str(tmp_path))
    df.write.parquet(config.stage_dir(3))
    assert Pipeline(spark, None, None, config).plan(4).first()["length"] == 2501
    words = lambda c, vocab, eos: F.transform(F.split(c, "m"), lambda x: F.length(x) + eos)
    assert Pipeline(spark, None, None, config, encoder=words).plan(4).first()["token_ids"] == [len(x) + 2 for x in text.split("m")]


@pytest.mark.parametrize("n", [0, 5, 6, 11, 12, 13])
def test_windows_and_pairs(spark, n):
    ids = list(range(n))
    df = spark.createDataFrame([(1, ids[:4]), (2, None), (3, ids[4:]), (3, ids[4:])], "doc_id bigint, token_ids array<int>")
    for bucket in (F.col("doc_id"), F.lit(0)):
        got = sorted(tokens.next_token_pairs(tokens.windows(df, ["doc_id"], bucket, 5)).collect(), key=lambda r: r["sample"])
        assert [(list(r["x"]), list(r["y"])) for r in got] == [(ids[i:i + 5], ids[i + 1:i + 6]) for i in range(0, n // 6 * 6, 6)]
        assert [r["token"] for r in tokens.stream(df, ["doc_id"], bucket).orderBy("gpos").collect()] == ids


def test_windows_over_many_buckets_and_keys(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), [rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:30], "doc_id bigint, split string, token_ids array<int>")
    got = {(r["split"], r["sample"]): list(r["ids"]) for r in tokens.windows(df, ["doc_id"], F.floor(F.col("doc_id") / 7), 8, keys=["split"]).collect()}
    want = {}
    for k in ("a", "b", None):
        flat = [x for _, s, ids in rows if s == k for x in ids]
        want |= {(k, i): flat[9 * i:9 * i + 9] for i in range(len(flat) // 9)}
    assert got == want


def test_pooling_of_great_scores_and_overlap(spark):
    df = spark.createDataFrame([(i, float(i), 1000.0 + i) for i in range(6)], "pos bigint, v double, s double")
    got = {r["block"]: (r["pooled"], r["n"]) for r in tokens.pool_blocks(df, [], "pos", "v", "s", 3).collect()}
    assert set(got) == {0, 1} and abs(got[1][0] - 4.575) < 0.01 and got[1][1] == 3
    both = {r["block"]: (r["pooled"], r["n"]) for r in tokens.pool_blocks(df, [], "pos", "v", "s", 3, overlap=True).collect()}
    assert both[0][1] == 3 and both[1][1] == 6 and abs(both[1][0] - 4.433) < 0.01


def test_cleaning_runs_once_a_row(spark):
    df = spark.createDataFrame([(1, "<p>a long enough text &amp; more</p>"), (2, " "), (3, None)], "i int, text string")
    out = T.once(df, "text", T.clean_all(F.col("text"))).where(Q.not_blank(F.col("text")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and [r["text"] for r in out.collect()] == ["a long enough text & more"]


def test_class_of_uncomposed_characters():
    import regex

    told = regex.compile(regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m.group(1).zfill(8), T.UNCOMPOSED))
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and not unicodedata.is_normalized("NFC", "a" + chr(i)):
            assert told.search(chr(i)), hex(i)


def test_near_duplicates_above_nine_tenths_keep_the_first(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(9)) for _ in range(60)]
        rows.append((3 * i, " ".join(w)))
        for k in (1, 2):
            v = list(w)
            if rng.random() < 0.7:
                v[rng.randrange(60)] = f"x{k}"
            rows.append((3 * i + k, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = {i: {" ".join(sorted(set(t.split(" ")[j:j + 5]))) for j in range(len(t.split(" ")) - 4)} for i, t in rows}
    kept = []
    for i, _ in rows:
        if not any(len(cut[i] & cut[j]) / len(cut[i] | cut[j]) > 0.9 for j in kept):
            kept.append(i)
    assert sorted(r["id"] for r in dedup.near_dedup_first(df, "doc_id", "text", 0.9).where("kept").collect()) == kept


def test_acquire(spark):
    raw = spark.createDataFrame([(1, "x", '{"url": "u", "language": "en"}'), (2, "y", '{"language": "fr"}'), (3, "z", "{broken"), (4, "", '{"language": "en"}'), (5, "w", None)], "row_no bigint, raw_content string, meta string")
    assert [(r["row_no"], r["source"]) for r in acquire.acquire_english(raw).collect()] == [(1, "u")]
    assert tuple(acquire.gate_counts(raw).first()) == (5, 2, 1, 3)


def test_exact_dedup(spark):
    df = spark.createDataFrame([(2, " A "), (1, "a"), (3, "b"), (4, None), (5, "")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in dedup.exact_dedup(df, "text", "doc_id").collect()) == [1, 3, 4]
    assert tuple(dedup.dedup_stats(df, "text").first()) == (5, 3, 2, 0.4)
    assert dedup.dedup_stats(df.limit(0), "text").first()["ratio"] == 0.0


def shingle_set(t):
    w = t.lower().split()
    return {frozenset(w[i:i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(14):
        base = [rng.choice(vocab) for _ in range(60)]
        for edits in (0, 0, 1, 2, 6):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    texts += ["", "a b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    reps = {}
    for i, t in enumerate(texts):
        if t is not None:
            reps.setdefault(t.strip().lower(), i)
    want = set()
    for (a, i), (b, j) in itertools.combinations(reps.items(), 2):
        x, y = shingle_set(a), shingle_set(b)
        if x and y and len(x & y) / len(x | y) >= 0.8:
            want.add((min(i, j), max(i, j)))
    assert want
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(df, "id", "text").collect()} == want
    parent = {i: i for i in reps.values()}
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: (r["class_id"], r["links"]) for r in dedup.near_duplicates(df, "id", "text").collect()}
    links = {i: sum(i in p for p in want) for i in reps.values()}
    assert got == {i: (find(reps[t.strip().lower()]), links[reps[t.strip().lower()]]) for i, t in enumerate(texts) if t is not None}


def test_greedy_keeps_what_components_drop(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id bigint")
    assert {r["id"]: r["kept"] for r in dedup.greedy_kept(pairs, ids).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert {r["id"]: r["component"] for r in dedup.components(pairs).collect()} == {1: 1, 2: 1, 3: 1}


def test_metrics_and_gumbel(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (2, 4.0, 3)], "i int, loss double, n int")
    assert abs(metrics.perplexity(df, "loss", "n").first()[0] - 2.718281828 ** 1.5) < 1e-6
    assert metrics.mean_of_first(df.limit(0), "loss", ["i"]).first()[0] == 0.0
    draws = spark.range(4000).select("id", F.explode(F.array(F.struct(F.lit(0).alias("tok"), F.lit(0.0).alias("l")), F.struct(F.lit(1).alias("tok"), F.lit(0.6).alias("l")))).alias("x")).select("id", "x.tok", "x.l")
    ones = sample.gumbel_pick(draws, ["id"], "tok", "l").where("tok = 1").count() / 4000
    assert abs(ones - 2.718281828 / 3.718281828) < 0.04


def test_neighbours(spark):
    rng = random.Random(5)
    vs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(vs)), "id bigint, v array<double>")
    got = {}
    for r in vector.nearest(df.where("id % 20 = 0"), df, "id", "v", 3, block=2).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in (0, 20, 40):
        assert [i for _, i in sorted(got[q])] == sorted((i for i in range(60) if i != q), key=lambda i: -cos(vs[q], vs[i]))[:3]
