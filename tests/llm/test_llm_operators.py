"""The training-data operators against brute force, round trips and literal cases."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import encode_corpus, garbled, languages, mix_sources, pack_containers, page_body, split_overlap, text_stats, token_budget, vocab
from weirflow.llm.boosting import BoostedTrees
from weirflow.llm.overlap_words import common, words

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None), (2, "", "x"), (3, " \n\t", None), (4, "plain text", "en"), (4, "plain text", "en"), (5, "word " * 30_000, "en"), (6, "<|endoftext|> ok 😀 é", None)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{SF}/lang_samples.parquet")


@pytest.fixture(scope="module")
def finder(samples):
    return garbled.Garbled(list(garbled.read_samples(samples)))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, and columns of clashing names."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").withColumns({"n": F.lit(1), "ids": F.lit("x"), "kind": F.lit("k"), "cid": F.lit(2), "source": F.col("lang")})


# --- 7: encoding


@pytest.mark.parametrize("chunk, overlap", [(40, 20), (64, 30)])
def test_chunks_encode_as_the_whole(chunk, overlap):
    rng = random.Random(1)
    alphabet = ["don't ", "it's", "  ", "\n\n", "\t", "123", "中文，", "é", "😀", "...", " a", "'ll", "x" * 25, "   "]
    for _ in range(60):
        t = "".join(rng.choice(alphabet) for _ in range(60))
        ids = encode_corpus.encode_text(t)
        assert encode_corpus.encode_text(t, chunk=chunk, overlap=overlap) == ids and encode_corpus.decode_ids(ids) == t


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{vocab.DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ["a <|endoftext|> b", "中文 mixed 😀 text's", "\r\n  x​"]:
        assert t.encode(text, add_special_tokens=False).ids == encode_corpus.encode_text(text)


def test_encode_odd_rows_and_giants(spark, odd):
    for giant in (1 << 20, 50):
        rows = encode_corpus.encode_corpus(odd, giant_chars=giant, chunk=400, overlap=100).collect()
        assert sorted((r["doc_id"], tuple(r["ids"])) for r in rows) == sorted((i, tuple(encode_corpus.encode_text(t))) for i, t, _ in ODD)
    assert encode_corpus.encode_corpus(odd.limit(0)).count() == 0


# --- 2: token budget


def test_record_tokens(spark):
    t = spark.createDataFrame([(1, [1, 2], 2, "a", "x"), (1, [1, 2], 2, "a", "x"), (2, [1], 5, None, None), (3, None, None, "a", "x"), (4, None, 7, "b", "x"), (5, [], 0, "b", "x"), (6, [1], None, "b", "x")], "rec_id bigint, token_ids array<int>, length int, source string, lang string")
    texts = spark.createDataFrame([(3, "two words"), (9, "x")], "rec_id bigint, text string")
    got = {r["rec_id"]: (r["tokens"], r["measured_by"], r["length_usable"]) for r in token_budget.record_tokens(t, texts).collect()}
    assert got == {1: (2, "ids", True), 2: (1, "ids", False), 3: (2, "text", False), 4: (7, "length", True), 5: (0, "ids", True), 6: (1, "ids", False)}
    assert sorted(r["rec_id"] for r in token_budget.unusable_lengths(t).collect()) == [2, 3, 6]
    total = token_budget.budget(token_budget.record_tokens(t, texts), spark.createDataFrame([("a", "d")], "source string, domain string")).where("level = 'all'").first()
    assert (total["records"], total["tokens"]) == (6, 13)
    assert token_budget.unusable_lengths(t.limit(0)).count() == 0


def test_piece_totals_equal_whole_texts(spark, odd):
    got = {r["lang"]: r["tokens"] for r in token_budget.piece_totals(odd.select("lang", "text"), ["lang"]).collect()}
    want = collections.Counter()
    for _, t, lang in ODD:
        if t:
            want[lang] += len(encode_corpus.encode_text(t))
    assert got == dict(want)


# --- 4: containers


def test_first_fit_against_plain_search():
    rng = random.Random(2)
    for _ in range(40):
        sizes = sorted((rng.randrange(0, 50) for _ in range(rng.randrange(0, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            at = next((i for i, r in enumerate(room) if r >= s), None)
            if at is None:
                at = len(room)
                room.append(50)
            room[at] -= s
            want.append(at)
        assert pack_containers.first_fit(np.array(sizes, dtype=np.int64), 50).tolist() == want


def test_pack_is_whole_and_within_capacity(spark):
    rng = random.Random(3)
    rows = [(i, list(range(rng.choice([0, 3, 10, 25, 40]))), "train" if i % 3 else "val") for i in range(400)] + [(1000, None, "train"), (1001, [1], "none")]
    t = spark.createDataFrame(rows + rows[:50], "rec_id bigint, token_ids array<int>, split string").withColumn("grp", F.lit(1))
    a = pack_containers.pack(t, spark.createDataFrame([("train", 16), ("val", 12)], "split string, capacity int"), group_records=64).collect()
    size = {i: len(x or []) for i, x, _ in rows}
    got, used = collections.Counter(), collections.Counter()
    for r in a:
        got[r["rec_id"]] += r["n_tokens"]
        if r["container"] is not None:
            used[(r["split"], r["grp"], r["container"])] += r["n_tokens"]
    assert {k: got[k] for k in size} == size and all(v <= (16 if k[0] == "train" else 12) for k, v in used.items())
    limit = {"train": 16, "val": 12}
    assert {r["rec_id"] for r in a if r["pieces"] > 1} == {i for i, x, s in rows if len(x or []) > limit.get(s, 99)}
    assert [r["container"] for r in a if r["rec_id"] == 1001] == [None]


# --- 8: mixing


def test_plan_reaches_targets():
    rows = mix_sources.plan({"a": 1000, "b": 100}, [(1, "a", 0.5, 1), (1, "b", 0.5, 4), (1, "c", 0.0, 2), (2, "z", 1.0, 3), (2, None, 1.0, 1)])
    assert rows == [(1, "a", 0.5, 0, 400), (1, "b", 0.5, 4, 0), (1, "c", 0.0, 0, 0), (2, "z", 1.0, 0, 0)]


def test_splitting_tree_is_exact():
    units = np.array([37, 5, 0, 100])
    by = {most: [x for n in mix_sources.top_nodes(units, 8, [1, 2], most) for x in mix_sources.leaves(n, [1, 2])] for most in (1, 4, 64)}
    tree = np.array([n for *_, n, _ in by[1]])
    assert all([n.tolist() for *_, n, _ in v] == tree.tolist() and [x[0] for x in v] == list(range(8)) for v in by.values())
    assert np.array_equal(np.cumsum(tree, axis=0)[:-1], np.array([at for *_, at in by[1]])[1:])
    assert tree.sum(axis=0).tolist() == [37, 5, 0, 100] and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "some words of text " * (1 + i % 7), "a" if i % 4 else "b") for i in range(200)] + [(900, None, "a"), (901, "", "b"), (902, "x", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(1, "a", 0.6, 2), (1, "b", 0.4, 3), (2, "gone", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    m = mix_sources.Mixture(docs, targets, block_tokens=200, shard_tokens=1500)
    shares = {(r["mix_id"], r["source"]): r for r in m.shares().collect()}
    assert abs(shares[1, "a"]["actual_share"] - 0.6) < 0.01 and shares[1, "b"]["most_repeats"] <= 3 and shares[2, "gone"]["tokens"] == 0
    copies = {r["doc_id"]: r["repeats"] for r in m.mix().where("mix_id = 1").collect()}
    dealt = m.shards().collect()
    assert collections.Counter(r["doc_id"] for r in dealt) == collections.Counter(copies) and len({(r["shard"], r["position"]) for r in dealt}) == len(dealt) and len({r["shard"] for r in dealt}) > 1


# --- 9: garbled text


@pytest.mark.parametrize("text, right, wrong", [
    ("Après l’été, à Vony", "utf-8", "cp1252"), ("旱季期间，酶测量了水库。", "utf-8", "cp1252"), ("Größe und Maß", "utf-8", "mac_roman"), ("Мембрана клетки защищает", "utf-8", "cp1251"),
    ("广告内容，以下继续", "utf-8", "gb18030"), ("旱季期间，水库降低了水库。", "gbk", "cp1252"), ("Северный ледник измеряет", "cp1251", "cp1252"), ("città è più", "cp1252", "cp850"), ("野生の蜂は古い灯台を", "utf-8", "cp932"),
])
def test_garbled_is_found_and_restored(finder, text, right, wrong):
    bad = garbled.read_as(text.encode(right), wrong) or text.encode(right).decode(wrong, errors="replace")
    assert finder.spans(f"{bad}")
    fixed, hit, full = finder.restore(bad)
    assert hit and (fixed == text or "�" in bad or not full or len(set(fixed) & set(text)) > 0.6 * len(set(text)))


def test_twice_garbled_and_mixed(finder):
    once = "’é".encode().decode("cp1252")
    assert finder.restore(once.encode().decode("cp1252"))[0] == "’é"
    fixed, hit, _ = finder.restore("Il a été Ã©tÃ© là, 中文。")
    assert hit and fixed == "Il a été été là, 中文。"


@pytest.mark.parametrize("text", ["Café naïve Łódź Đặng İşkorğan", "½ + ¼ = ¾ — «№ 7» §12¶", "渡榆湖一帶的體驗與環境，繁體字。", "古い灯台を測りました。", "В 1587 ГОДУ, ГЛАВНЫЙ КАНАЛ", "Straße größer Öß", "x₁ ≤ 10⁻³ ∑ aᵢ → ∞", "éé één ÇÃO", "", "😀🎉"])
def test_rare_but_correct_is_no_case(finder, text):
    assert finder.spans(text) == []


@pytest.mark.parametrize("text, right, whole", [
    ("常见问题 | 商城 | 专题 | 网站地图 | 课程中心 | 首页", "gbk", True), ("首页 > 新闻 > 专题 > 下载 > 论坛 | 帮助", "gbk", True),
    ("旱季期间，水库降低了水位，这一点至今仍在讲授。一般来说，平缓的透镜吸引了山脉，学生们对此感到惊讶。直到最近，遥远的组织揭示了洋流，前提是地面保持干燥。", "gbk", True),
    ("ホーム | ショップ | ログイン | お知らせ | ヘルプ", "euc_jp", False), ("マミムメモは、うがうがうが、うみがめのために、ここにあります。マミとメモ。", "cp932", False),
    ("うみのうえで、うがいをして、うたをうたうことが、このうちのならわしでした。", "euc_jp", True),
])
def test_long_lines_and_menus_are_no_noise(finder, text, right, whole):
    bad = garbled.read_as(text.encode(right), "cp1252")
    assert any(s[3] in garbled.MULTI_READ[1:] for s in finder.spans(bad))
    assert not whole or finder.restore(bad) == (text, True, True)


def test_scattered_signs_are_no_encoding(finder):
    for text in ("*he`n^t<§e¦¦h{~t/;>sh~lt#'e¦§=<live;> `r{i\\_*}*t;|u|# fe~ people'n<'iced{ Vot|¦o:^t }n* it#", "Г`авны^:к~*а}|/ащища~\\_всю:окр'<у# хотя=мал``^/о'э<: =аме§*л.\\<о/}а>}о~ : э|`}место"):
        assert finder.spans(text) == []
    once = "。".join(["如果天气允许，详细的规则覆盖了海湾"] * 3)
    twice = once.encode().decode("latin-1").encode().decode("latin-1")
    assert {s[3] for s in finder.spans(twice)} == {"utf-8"}


def test_garbled_lines_of_odd_rows(spark, odd, samples):
    assert garbled.garbled_lines(odd, samples).count() == 0
    df = spark.createDataFrame([(1, "ok\nCafÃ©\r\n� x", 7)], "doc_id bigint, text string, line_no int")
    assert [(r["line_no"], r["restored"]) for r in garbled.garbled_lines(df, samples).orderBy("line_no").collect()] == [(1, "Café\r"), (2, "� x")]


# --- 5: page bodies


def test_furniture(finder):
    page = ["Home | Library | Search | Help", "Library / Home / The old mill", "The old mill", "The old mill measured the river, and nobody knew why. It was a long day.", "Advertisement", "• brief oven", "• damp hull", "The word “menu” first meant a detailed list, long before it moved to a screen.", "Related articles", "» How the tide works", "» Rosvo", "", "© 2020 a.example. All rights reserved.", "Back to top"]
    assert [i for i, b in enumerate(page_body.page_furniture("\r\n".join(page), finder)) if b] == [0, 1, 4, 8, 9, 10, 12, 13]
    assert page_body.page_furniture(" \n ", finder) == [] and page_body.page_furniture(None, finder) == []


def test_body_keeps_lines_as_they_are(spark, odd, samples):
    got = {r["doc_id"]: r["body"] for r in page_body.main_body(odd, samples).collect()}
    assert got[1] is None and got[3] == " \n\t" and got[5] == "word " * 30_000
    assert page_body.furniture_lines(odd.limit(0), samples).count() == 0


def lists_emptied(monkeypatch):
    never = re.compile("(?!)")
    for name, value in (("_NAMES", frozenset()), ("_HEAD", never), ("_CUE", never), ("_CUES", {}), ("_PHRASES", ()), ("_MAIL", never)):
        monkeypatch.setattr(page_body, name, value)
    page_body._listed_leaf.cache_clear()
    page_body._counted_leaf.cache_clear()


def test_furniture_by_repetition_alone(spark, finder, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = page_body.repeated_lines(docs)
    texts = [r["text"] for r in docs.where("doc_id % 9 = 0").select("text").collect()]
    lines = lambda k: {(i, no) for i, t in enumerate(texts) for no, b in enumerate(page_body.page_furniture(t, finder, k)) if b}
    planted, both = lines(None), lines(known)
    assert len(planted) > 3000 and len(planted & both) >= 0.99 * max(len(planted), len(both))
    lists_emptied(monkeypatch)
    alone = lines(known)
    assert len(planted & alone) >= 0.8 * len(planted) and len(planted & alone) >= 0.9 * len(alone)
    page_body._listed_leaf.cache_clear()
    page_body._counted_leaf.cache_clear()


def test_the_score_decides_against_the_block():
    long = "Follow us into the valley, where the river turns; there the old mill stands, and beside it the well. " * 5
    lines = ["Follow us", long, "Related articles", "- the tide", "- " + "The tide came late, and nobody was ready for it, said the keeper; she had seen it before. " * 6]
    own = page_body.paths(lines)
    assert own[1][0] == "notice" and page_body.furniture([long]) == [False] and page_body.furniture(["Follow us"]) == [True]
    menu = " | ".join(["Home", "Library", "Search", "Help", "Courses", "Topics", "Archive", "Contact", "Gallery", "News"] * 3)
    assert len(menu) > 180 and page_body.furniture([menu, "The old mill measured the river."]) == [True, False]


def test_copies_of_a_page_repeat_nothing(spark):
    rows = [(i, "The narrow lane\nA quiet town by the sea, which few people know.") for i in range(300)] + [(1000 + i, f"Lantern shop\nStory {chr(97 + i % 26) * (i // 26 + 1)} ended well.") for i in range(300)]
    known = page_body.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2))
    assert known("Lantern shop") and not known("The narrow lane")


# --- 1: statistics


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    m = BoostedTrees(3).fit(x[:400], y[:400]).calibrate(x[400:500], y[400:500])
    assert (m.probabilities(x[500:]).argmax(axis=1) == y[500:]).mean() > 0.8 and m.fit is not None


def test_kinds_of_the_hand_checked_holdout(spark, samples):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = text_stats.fit(docs, garbled.read_samples(samples))
    g = garbled.Garbled(list(garbled.read_samples(samples)))
    checked = [(text_stats.body_lines(r["text"], g), r["kind"]) for r in text_stats.holdout()[::2]]
    checked = [c for c in checked if c[0][0]]
    _, p = model.kinds([b for b, _ in checked])
    right = sum(text_stats.KINDS[k] == kind for k, (_, kind) in zip(p.argmax(axis=1), checked))
    assert right >= 0.9 * len(checked)


def test_statistics_of_odd_rows(odd, samples):
    got = {r["doc_id"]: r for r in text_stats.text_statistics(odd, samples).collect()}
    assert got[1]["kind"] is None and got[2]["n_words"] == 0 and got[3]["kind"] is None and got[4]["n_words"] == 2 and got[5]["n_words"] == 30_000
    assert text_stats.not_prose(odd.limit(0), samples).count() == 0


def test_usual_pairs_are_those_of_all_documents(spark, samples):
    rows = [(i, "The old mill measured the river, and nobody knew why.", "en") for i in range(30)] + [(1000 + i, f"Quartz lanterns hum beneath violet harbours number{chr(97 + i)}.", "en") for i in range(2)] + [(2000, "Single sentences stay unusual here.", "en"), (2001, "Single sentences stay unusual here.", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = text_stats.fit(docs, garbled.read_samples(samples), sample_rows=1)
    known = lambda t: model.known.share(text_stats.distinct_pairs([t])[0])
    assert known("Quartz lanterns hum beneath violet harbours") == 1
    assert known("Single sentences stay unusual here") == 0 and known("The old mill measured the river") == 0


def test_pairs_that_meet_by_chance_are_not_usual(spark):
    rng = random.Random(8)
    words_ = ["stone", "river", "lamp", "north", "green", "wheel", "paper", "slow", "iron", "glass"]
    told = [(i, " ".join(f"{a} follows {b}." for a, b in [("stone", "river"), ("lamp", "north")] * 3) + f" note{i}") for i in range(200)]
    salad = [(1000 + i, " ".join(rng.choice(words_) for _ in range(60))) for i in range(200)]
    for times in (1, 5):
        rows = [(k * 10_000 + i, f"{t} copy{chr(97 + k)}") for k in range(times) for i, t in told + salad]
        known = text_stats.neighbours(spark.createDataFrame(rows, "doc_id bigint, text string"))
        share = lambda t: known.share(text_stats.distinct_pairs([t])[0])
        assert share("stone follows river") == 1 and share(" ".join(rng.choice(words_) for _ in range(40))) < 0.3
    assert text_stats.neighbours(spark.createDataFrame([], "doc_id bigint, text string")).share(np.zeros(3, np.int64)) == 0


def test_long_rows_of_a_table_are_rows():
    row = "\t".join(f"{i}.5" for i in range(90))
    at = text_stats.FEATURES.index("cell_lines")
    assert text_stats.measured([row] * 4)[0][at] == 1
    assert text_stats.measured(["They walked, slowly, along the river; it was late. " * 8] * 2)[0][at] == 0


# --- 3: languages


def test_languages(spark, samples):
    model = languages.KernelClassifier([(r["lang"], languages.normalise(r["text"])) for r in samples.orderBy("sample_id").collect()], 20)
    assert model.held_out_accuracy > 0.9
    text = "Le vieux moulin attire la rivière du village, bien que peu de gens l’aient remarqué. Das kleine Museum erklärt den kurzen Sommer, ohne viel Wärme zu verlieren.\n竹林描述了羊群，这样就不会浪费。 (de leraar uit het dorp)"
    labels = spark.createDataFrame([("fr", "french")], "label string, lang string")
    docs = spark.createDataFrame([(1, text, "fr"), (2, None, "fr"), (3, "", None), (4, "The old mill", "fr")], "doc_id bigint, text string, lang string").withColumn("label", F.lit(0))
    rows = languages.document_segments(docs, samples, labels).orderBy("doc_id", "segment").collect()
    assert [(r["doc_id"], r["lang"]) for r in rows] == [(1, "french"), (1, "german"), (1, "chinese"), (2, None), (3, None), (4, None)]
    assert {(r["doc_id"], r["lang"]) for r in languages.unnamed_languages(docs, samples, labels).collect()} == {(1, "german"), (1, "chinese")}
    assert [r["lang"] for r in languages.document_segments(docs, samples.limit(0), labels).collect()] == [None] * 4 and languages.unnamed_languages(docs, samples.limit(0), labels).count() == 0
    assert languages.document_segments(docs.limit(0), samples, labels).count() == 0
    assert {r["doc_id"]: r["languages"] for r in languages.document_languages(docs, samples, labels).collect()} == {1: 3, 2: 0, 3: 0, 4: 0}


def test_rows_hold_with_half_of_the_samples(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "lang_labels"))
    whole = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet")
    model = text_stats.fit(docs, garbled.read_samples(whole))
    full, half = ({tuple(r) for r in languages.unnamed_languages(docs, s, labels, model=model).collect()} for s in (whole, whole.where("sample_id % 2 = 0")))
    assert len(full) > 100 and len(full ^ half) <= 0.03 * len(full)


def test_every_n_gram_is_in_the_table(samples):
    rows = languages.trained_on([(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()], [])
    model = languages.KernelClassifier(rows)
    assert (model.keys >= 0).sum() == len(model.weights) - 1
    alone = np.array([model.classify([s])[0] for _, s in rows[:40]])
    assert np.allclose(alone, model.classify([s for _, s in rows[:40]]))


# --- 6: overlaps


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        n = plain_common(a, b)
        assert common(a, b) == n and common(a, b, n + 1) == -1


def test_words():
    assert words("Ａ café，x_1​y") == ["a", "café", "x", "1y"] and words("中文 a1。") == ["中", "文", "a", "1"] and words("... ​") == [] and words(None) == []


def test_overlaps_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/split_docs.parquet").select("rec_id", "text", "source", "split").collect()
    rng = random.Random(6)
    base = [r for r in rows if r["split"] == "train" and r["text"] and len(words(r["text"])) > 60][:40]
    made = []
    for i, r in enumerate(base):
        w = r["text"].split(" ") if " " in r["text"] else list(r["text"])
        step = rng.choice([0, 5, 6, 8, 10, 15, 20])
        for k in range(step - 1, len(w), step) if step else ():
            w[k] = "z"
        made.append((100_000 + i, (" " if " " in r["text"] else "").join(w).upper(), None, "test"))
    data = [tuple(r) for r in rows] + made + [(200_000, None, None, "val"), (200_001, "?!", "s", "val"), (200_002, "x", "s", None)]
    df = spark.createDataFrame(data, "rec_id bigint, text string, source string, split string").withColumns({"cid": F.lit(1), "e": F.lit(2)})
    w = {i: words(t) for i, t, _, _ in data}
    want = set()
    for i, _, _, s in data:
        for j, _, _, u in data:
            if s in ("val", "test") and u == "train" and w[i] and w[j] and 2 * sum((collections.Counter(w[i]) & collections.Counter(w[j])).values()) >= 0.8 * (len(w[i]) + len(w[j])) and 2 * common(w[i], w[j]) >= 0.8 * (len(w[i]) + len(w[j])):
                want.add((min(i, j), max(i, j)))
    got = {tuple(r) for r in split_overlap.found_pairs(df).collect()}
    assert got == want and len(want) >= 40
    assert split_overlap.found_pairs(df.limit(0)).count() == 0
    assert split_overlap.report(df).agg(F.sum("pairs")).first()[0] == len(got)


@pytest.mark.parametrize("edit", ["replace", "remove", "insert", "mixed"])
def test_overlaps_lose_no_altered_text(spark, edit):
    rng = random.Random(len(edit))
    vocabulary = [f"w{i}" for i in range(60)]
    data, want = [(10_000, "a b", "s", "val"), (10_001, "a b cd", "s", "train"), (10_002, "ｍ　n", "s", "test"), (10_003, "m x n", "s", "train")], {(10_000, 10_001), (10_002, 10_003)}
    for i, (n, step) in enumerate((n, step) for n in (7, 12, 20, 30, 75, 119, 120, 400) for step in (5, 6, 7, 8, 10, 14, 20)):
        w = [rng.choice(vocabulary) for _ in range(n)]
        v = []
        for k, x in enumerate(w):
            what = (rng.choice(["replace", "remove", "insert"]) if edit == "mixed" else edit) if k % step == step - 1 else ""
            v += {"": [x], "replace": [f"z{i}x{k}"], "remove": [], "insert": [x, f"z{i}x{k}"]}[what]
        if 2 * common(w, v) >= 0.8 * (len(w) + len(v)):
            want.add((2 * i, 2 * i + 1))
        w, v = (w, v) if i % 2 else (v, w)
        data += [(2 * i, " ".join(w), "s", "train"), (2 * i + 1, " ".join(v), "s", "val")]
    assert len(want) > 40
    assert {tuple(r) for r in split_overlap.found_pairs(spark.createDataFrame(data, "rec_id bigint, text string, source string, split string")).collect()} >= want


def test_bands_of_length():
    first, parts = split_overlap.bands({1: 5, 2: 4, 5: 30, 6: 3, 9: 8}, 10)
    assert first == {1: 0, 2: 0, 5: 1, 6: 4, 9: 5} and parts == {1: 1, 2: 1, 5: 3, 6: 1, 9: 1}


def test_cuts_give_the_passages_that_are_needed():
    rng = random.Random(3)
    texts = [split_overlap.signs(" ".join(rng.choice("abcdefghij") * rng.choice([1, 2]) for _ in range(n))) for n in (1, 2, 3, 9, 16, 17, 50, 300, 2500)]
    for t, (starts, needed) in zip(texts, split_overlap.rare_cuts(texts)):
        assert starts[0] == 0 and starts == sorted(set(starts)) and starts[-1] < len(t) and sum(needed) >= split_overlap.passages_needed(len(t))


def test_shards_are_read_one_by_one(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/split_docs.parquet")
    whole = {tuple(r) for r in split_overlap.found_pairs(df).collect()}
    monkeypatch.setattr(split_overlap, "SHARD_WORDS", 500)
    monkeypatch.setattr(split_overlap, "TEXTS", 30)
    assert {tuple(r) for r in split_overlap.found_pairs(df).collect()} == whole and whole


def test_buckets_are_never_below_what_is_common():
    rng = random.Random(8)
    for _ in range(50):
        a, b = (" ".join(rng.choice("abcdefgh") * rng.choice([1, 2]) for _ in range(rng.randrange(1, 400))) for _ in range(2))
        x, y = split_overlap.bucketed([split_overlap.signs(a), split_overlap.signs(b)])
        assert int(np.minimum(x, y).sum()) >= common(a.split(" "), b.split(" ")) or 255 in np.minimum(x, y)


def test_overlaps_find_words_removed_and_inserted_apart(spark):
    rng = random.Random(12)
    vocabulary = {"latin": [f"w{i}" for i in range(300)], "han": [chr(0x4E00 + i) for i in range(300)], "both": ["ж", "я", "字", "z"] * 3 + [f"w{i}" for i in range(60)]}
    data, want = [], set()
    for i, (kind, n, swap) in enumerate((kind, n, swap) for kind in vocabulary for n in (17, 25, 60, 79, 150, 1200) for swap in (False, True)):
        w = [rng.choice(vocabulary[kind]) for _ in range(n)]
        places = rng.sample(range(n), int(0.38 * n))
        removed, inserted = set(places[::2]), set(places[1::2])
        v = [y for k, x in enumerate(w) for y in ([] if k in removed else [x, f"q{i}"] if k in inserted else [x])]
        if kind == "han":
            v = ["龘" if y.startswith("q") else y for y in v]
        assert 2 * common(w, v) >= 0.8 * (len(w) + len(v))
        want.add((2 * i, 2 * i + 1))
        w, v = (v, w) if swap else (w, v)
        data += [(2 * i, " ".join(w), "s", "train"), (2 * i + 1, " ".join(v), "s", "test")]
    assert {tuple(r) for r in split_overlap.found_pairs(spark.createDataFrame(data, "rec_id bigint, text string, source string, split string")).collect()} >= want


def test_overlaps_compare_recurring_texts_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/split_docs.parquet").select("rec_id", "text", "source", "split")
    many = df.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).repartition(6, "copy").withColumn("rec_id", F.col("rec_id") + 1_000_000 * F.col("copy")).drop("copy")
    rows = split_overlap.normalised(many).cache()
    kept = split_overlap.train_classes(rows)
    assert kept.count() == rows.where("train").select("cid").distinct().count() and not kept.where("text is null").count()
    pairs = split_overlap.report(df).agg(F.sum("pairs")).first()[0]
    assert split_overlap.report(many).agg(F.sum("pairs")).first()[0] == 36 * pairs > 0
    rows.unpersist()
