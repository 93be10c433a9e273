"""Training-data operators against brute force, round trips and held-out accuracy, on small and
awkward inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from labelyard.llm import bytebpe, chat, langid, media, neardup, outliers, packing, quality, queries, toxicity, urlrep  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, digest string, _text0 string"
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one two three"), (5, "ONE two\tthree"), (6, "#$%& ***"), (7, "naïve 日本語 🎉 " * 20), (8, "word " * 30_000),
    (9, "a b c d e f g h i j"), (9, "a b c d e f g h i j"), (10, "A B C D E F G H I J"), (None, "a b c d e f g h i j"), (11, "x" * 50_000), (12, "don't  we'll\r\nI'M 123456 ½²"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s", 0, 0.5, "k", "d", "own") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(4, 9)] + [(8, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# 1 packing


def test_pack_covers_every_token(awkward):
    path = public.path("word_bpe_49k.json")
    rows = packing.pack(packing.tokenized_pieces(awkward, path)).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    want = Counter()
    for i, t in AWKWARD:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def encoded(encode, texts):
    ids, end = encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, end)[:-1]]


@pytest.mark.parametrize("text", ["a\x1cb", "\x1d", "one\x1e two.\x1f", "a <|endoftext|> b.", "<|EndOfText|>", "X<|STARTOFTEXT|>Y. <|EndOfText", "\x85a\xa0b\u2003c", "\x01", "a\x01. b", "İ. İ?", "क़. न", None, "", "a" * 5000])
def test_words_give_the_ids_of_the_text(text):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    assert encoded(packing.WordEncoder(path), [text, "plain words", None, text])[::3] == [plain, plain]


def test_words_of_random_strings(monkeypatch):
    """Against the library's plain call, with a cache that is too small."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    path = public.path("word_bpe_49k.json")
    model, encode, rng = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(12)
    pool = [*"abABé19.,'!?&<|>\x1c\x1d\x1e\x1f\x01\x00\x85\xa0  \t\n\x0b\r²×ÀΣσ日🎉\u0301\u0338=İıſK\u200d\ufeff", "<|endoftext|>", "<|EndOfText|>", "'s", "'LL", "Word. "]
    for _ in range(20):
        texts = ["".join(rng.choices(pool, k=rng.randrange(14))) for _ in range(200)]
        assert encoded(encode, texts) == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encode.at) < 3000


def test_the_fullest_bin_closes_first():
    space = packing.BestFit(10, 2)
    assert space.place(7, "a") == space.place(6, "b") == []
    assert space.place(8, "c") == [["a"]]  # no bin has 8 free; of those with 3 and 4 free the fuller closes
    assert space.place(2, "d") == [["c", "d"]]  # the best fit is exactly 2
    assert space.place(4, "e") == [["b", "e"]] and space.count == 0 and space.bits == 0
    assert space.place(10, "f") == [["f"]]


def test_pack_is_tight(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 4096) for _ in range(4000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES).repartition(4)
    used = packing.pack(pieces, open_bins=64).select("sequence_id").distinct().count()
    assert used <= 1.04 * -(-sum(sizes) // 4096)


def test_sequences_hold_the_ids(spark):
    few = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    pieces = packing.tokenized_pieces(few, public.path("word_bpe_49k.json"), keep_ids=True)
    assert [len(r["ids"]) for r in packing.sequences(packing.pack(pieces), pieces).collect()] == [5]


def test_pack_nothing(empty):
    assert packing.pack(packing.tokenized_pieces(empty, public.path("word_bpe_49k.json"))).count() == 0


# 2 and 8: classifiers


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_awkward_rows(module, awkward, labels, empty):
    rows = module.score(awkward, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    folds, held = {toxicity: (3, 1), quality: (4, 2)}[module]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[1] == by[2] and len(by[9] | by[None]) == 1
    assert module.score(empty, labels).count() == 0
    assert module.score(awkward, labels.limit(0)).select("score").distinct().count() == 1
    kept = module.accepted(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() <= len(AWKWARD)


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    # one row at a time, with plain loops
    for row in x[2000:2010]:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert forest(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_network_learns():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(900):
        said = rng.choices(words, k=rng.randint(20, 80))
        if i % 3 == 0:
            said.insert(rng.randrange(len(said)), rng.choice(["vile", "nasty"]))
        texts.append(" ".join(said).encode())
        y.append(float(i % 3 == 0))
    y = np.array(y)
    model = toxicity.Model([toxicity.buckets([t])[0] for t in texts[:600]], y[:600])
    assert ((model.scorer()(texts[600:]) >= 0.7) == y[600:]).mean() > 0.95


def test_thresholds_see_the_true_ratio(spark, monkeypatch):
    """A capped sample is half toxic; thresholds are those of all labelled rows all the same."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 160)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows, toxic = [], []
    for i in range(9000):
        said = rng.choices(words, k=20)
        toxic.append(int(i % 20 == 0))
        # a word that is as frequent in clean texts overall, but half toxic in a sample of halves
        if toxic[-1] or rng.random() < 0.06:
            said[rng.randrange(20)] = "vile"
        if toxic[-1] and rng.random() < 0.6:
            said[rng.randrange(20)] = "nasty"
        rows.append((i, " ".join(said)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    outside = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    y = np.array([toxic[i] for i in outside])
    ids, first = toxicity.buckets([rows[i][1].encode() for i in outside])
    p = model.raw(ids, first, [n.tables() for n in model.nets])
    f1 = lambda t: 2 * y[p >= t].sum() / ((p >= t).sum() + y.sum())
    assert f1(model.threshold[0]) > 0.95 * f1(toxicity.best_threshold(p, y))
    counts = toxicity.label_counts(docs.filter(F.col("doc_id").isin(outside)), labels.select("doc_id", F.col("toxic").alias("y")), model, np.array([3, 7]))
    assert counts.sum() == len(outside) and counts[:, 1].sum() == sum(toxic[i] for i in outside)


def test_network_matches_plain_loops():
    rng = random.Random(2)
    words = ["of", "stupidity", "naïveté", "a", "longerword", "the", "word"]
    texts = [" ".join(rng.choices(words, k=n)).encode() for n in (0, 1, 2, 9, 30)]
    net = toxicity.Network(np.random.default_rng(1).normal(size=toxicity.BUCKETS + 1))
    ids, first = toxicity.buckets(texts)
    got = net.raw(ids, first, net.tables())
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = ids[a:b]
        peaks = []
        for w in net.w[:-1]:
            windows = [sum(net.e[own[i + j, 0]] @ w[j] for j in range(len(w))) for i in range(len(own) - len(w) + 1)]
            peaks.append(np.max(windows, axis=0))
        peaks.append(np.max([net.e[i] @ net.w[-1][0] for i in own[:, 1:].ravel()], axis=0))
        act = np.maximum(np.concatenate(peaks) + net.b, 0)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(act @ net.o + net.c[0]))), abs=1e-5)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    """A document of its own size would fill the driver; repeated ids count once."""
    rows = [(i, ("vile " if i % 3 == 0 else "kind ") + "word " * 20) for i in range(300)] + [(301, "word " * 50_000)] + [(5, "kind words again")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(302)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FIT_BYTES", 300 * 25 * 10)
    seen = []
    monkeypatch.setattr(toxicity, "Model", lambda texts, y: seen.append(texts) or original(texts, y))
    toxicity.learn(docs, labels)
    assert 10 < len(seen[0]) < 302 and sum(t.nbytes for t in seen[0]) <= 300 * 25 * 10


original = toxicity.Model


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op2_toxicity(spark, d).join(known, "doc_id").filter("held_out")
    said = Counter((r["toxic"], r["predicted"]) for r in rows.collect())
    assert said[1, 1] >= 0.7 * (said[1, 0] + said[1, 1]) and said[0, 0] >= 0.94 * (said[0, 0] + said[0, 1])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op8_quality_trees(spark, d).join(known, "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.93
    lang = queries.op4_language_mixture(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98


# 3 near-duplicates


def test_near_duplicates_match_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == neardup.brute(rows)


def test_near_duplicates_of_edited_copies(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(9999)}" for _ in range(120)]
    shared = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):  # copies with edits, so that links form chains
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    for i in range(60, 120):  # a common passage, else different
        rows.append((i, " ".join([f"u{rng.randrange(99999)}" for _ in range(20)] + shared)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == neardup.brute(rows)


def test_copies_beside_strangers_meet_only_these(spark):
    """4,000 edits of one text and 5 others that share its passages without a link: joined rows
    grow with pairs of different components, not with pairs of copies."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(4000):
        words = list(base)
        words[rng.randrange(10, 50)] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(4000 + i, " ".join([*base[:40], *(f"s{i}x{j}" for j in range(14 + i))])) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = neardup.full_sets(docs)
    # all copies in one component, as the first round leaves them
    placed = docs.select("doc_id", F.when(F.col("doc_id") < 4000, 0).otherwise(F.col("doc_id")).cast("long").alias("component"))
    tokens = neardup.prefixes(placed, sets)
    met = neardup.meetings(tokens)
    assert met.count() <= 2 * 5 * 4005 * 14
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: 0 if i < 4000 else i for i in range(4005)}


def test_meetings_hold_every_cross_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 3)
    rng = random.Random(5)
    rows = [(d, d % 4 if d % 3 else 0, rng.randint(5, 9), t, rng.randrange(3), rng.random() < 0.6) for d in range(40) for t in range(6) if rng.random() < 0.7]
    rows += [(d, 9, 5, 77, 0, True) for d in range(50, 60)]  # a token of one component
    df = spark.createDataFrame(rows, "doc_id long, component long, n int, token long, i int, short boolean")
    got = Counter((r["token"], r["doc_id_x"], r["doc_id_y"]) for r in neardup.meetings(df).collect())
    want = {(x[3], x[0], y[0]) for x in rows for y in rows if x[3] == y[3] and x[5] and x[1] != y[1]}
    assert want <= set(got) and max(got.values()) == 1 and len(got) <= 2 * len(want)
    assert not any(t == 77 for t, *_ in got)


def test_near_duplicates_on_awkward_rows(awkward, empty):
    groups = neardup.near_duplicates(awkward)
    rows = groups.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4, 5, 8)] == [0, 0, 0, 1, 1, 1]
    assert by[5]["component_id"] == 4 and by[10]["component_id"] == 9 and by[1]["component_id"] == 1 and by[2]["component_id"] == 2
    assert [tuple(r)[2:] for r in rows if r["doc_id"] is None] == [(None, True)]
    kept = neardup.keep_one(awkward, groups)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, 8, 9, 11, 12, None])
    assert neardup.near_duplicates(empty).count() == 0


# 4 language


def test_language_on_awkward_rows(awkward, empty):
    by = {r["doc_id"]: r for r in langid.predict(awkward).collect()}
    assert {i: by[i]["lang_pred"] for i in (1, 2, 3, 6)} == dict.fromkeys((1, 2, 3, 6), "und")
    assert by[7]["lang_pred"] == "en" and 0 <= by[7]["score"] <= 1
    assert langid.predict(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture_proportions():
    table = np.log(np.full((langid.BUCKETS, 2), 1e-6))
    for k, w in enumerate((b"aaaa", b"bbbb")):
        table[langid.trigrams(np.frombuffer(w, np.uint8)), k] = np.log(0.5)
    best, score, size = langid.infer([b"aaaa " * 30 + b"bbbb " * 70, b"aaaa " * 50, b""], table.astype(np.float32))
    assert best.tolist() == [1, 0, -1] and size.tolist() == [2, 1, 0]
    assert score[0] == pytest.approx(0.7, abs=0.02)


def test_mixture_matches_plain_loops():
    rng = np.random.default_rng(3)
    like, number = rng.random((23, 3)), [5, 1, 17]
    first = np.concatenate(([0], np.cumsum(number)))
    allowed = np.array([[1.0, 1, 1], [1, 0, 1], [1, 1, 0]])
    part, value = langid.proportions(like, first, allowed)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        p = [x / sum(allowed[d]) for x in allowed[d]]
        for _ in range(langid.STEPS):
            new = [0.0, 0.0, 0.0]
            for w in like[a:b]:
                mixed = sum(x * q for x, q in zip(w, p, strict=True))
                for k in range(3):
                    new[k] += w[k] * p[k] / mixed / (b - a)
            p = new
        assert part[d] == pytest.approx(p) and value[d] == pytest.approx(sum(math.log(sum(x * q for x, q in zip(w, p, strict=True))) for w in like[a:b]))


def test_junk_languages_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, "the words of this text", "en") for i in range(40)] + [(i, "die worte dieses textes", "de") for i in range(40, 80)] + [(i, "junk", f"j{i}") for i in range(80, 300)]
    names, table = langid.fit_tables(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["de", "en"] and table.shape[1] == 2


def test_six_languages_in_one_text():
    words = [c * 4 for c in (b"a", b"b", b"c", b"d", b"e", b"f")]
    table = np.log(np.full((langid.BUCKETS, 6), 1e-6))
    for k, w in enumerate(words):
        table[langid.trigrams(np.frombuffer(w, np.uint8)), k] = np.log(0.5)
    best, score, size = langid.infer([b" ".join(w for k, w in enumerate(words) for _ in range(50 + 10 * k))], table.astype(np.float32))
    assert (best[0], size[0]) == (5, 6) and score[0] == pytest.approx(100 / 450, abs=0.02)


# 5 chat


def test_layouts():
    known = chat.registry()
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"},
        {"instruction": "i", "input": "more", "output": "o"}, {"prompt": "p", "completion": "c"}, {"question": "q", "answer": "a"}, {"role": "user", "text": "t"},
    ]
    turns = [chat.canonical(r, known[chat.fingerprint(chat.paths(r))]) for r in records]
    assert turns == [[("user", "q"), ("assistant", "")], [("system", "s"), ("user", "q"), ("assistant", "a")], [("user", "i\nmore"), ("assistant", "o")], [("user", "p"), ("assistant", "c")], [("user", "q"), ("assistant", "a")], [("user", "t")]]
    assert chat.fingerprint(chat.paths({"other": 1})) not in known


def test_layouts_in_spark(spark):
    """Every layout through the registered operators, and records that no mapping knows."""
    records = [
        (1, 0, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}), (2, 0, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}),
        (3, 0, {"instruction": "i", "input": "more", "output": "o"}), (4, 0, {"prompt": "p", "response": "r"}), (5, 0, {"prompt": "p", "completion": "c"}), (6, 0, {"question": "q", "context": "c", "answer": "a"}),
        (7, 1, {"role": "assistant", "text": "t"}), (7, 0, {"zz": 1}), (8, 0, {"prompt": "p", "response": "r", "unheard": 1}), (8, 1, [1]),
    ]
    df = spark.createDataFrame([(c, t, json.dumps(r), "clash") for c, t, r in records], "conv_id long, turn long, record string, layout string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted_turns(chat.canonical_turns(df))).collect()}
    turns = {1: "user\nq\nassistant\na\n", 2: "system\ns\nuser\nq\nassistant\na\n", 3: "user\ni\nmore\nassistant\no\n", 4: "user\np\nassistant\nr\n", 5: "user\np\nassistant\nc\n", 6: "user\nc\nq\nassistant\na\n", 7: "assistant\nt\n", 8: ""}
    assert {i: r["turns_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in turns.items()}
    assert {i: (r["n_turns"], r["n_unmapped"]) for i, r in got.items() if r["n_unmapped"]} == {7: (1, 1), 8: (0, 2)}


@pytest.mark.parametrize("text", ["", "\\", "### User:\nx</turn>\n", "\\### Assistant: </turn> ok", "####", "\\h\\t", "a\n\n### ", "</turn>"])
def test_escape_round_trip(text):
    for role in ("user", "a:b\n### </turn>", ""):
        turn, start, end = chat.render(role, text)
        assert chat.read_back(turn * 3) == [(role, text)] * 3
        assert chat.unescape(turn[start:end]) == ("" if role != "assistant" else text)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", None), (1, 1, "assistant", "b\\"), (2, 0, None, "x"), (None, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted_turns(chat.canonical_turns(chat.turn_records(df)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\n\nassistant\nb\\\nassistant\nb\\\n")
    assert got[1]["loss_chars"] == 4 and got[1]["loss_sha256"] == sha("b\\b\\")
    assert got[2]["turns_sha256"] == sha("\nx\n") and got[None]["loss_chars"] == 1
    bad = spark.createDataFrame([(1, 0, "{}"), (1, 1, "no json"), (1, 2, json.dumps({"zz": 1})), (1, 3, None)], "conv_id long, turn long, record string")
    assert [r["layout"] for r in chat.canonical_turns(bad).collect()] == [None] * 4
    assert chat.digests(chat.formatted_turns(chat.canonical_turns(chat.turn_records(df.limit(0))))).count() == 0


# 6 byte-level BPE


def test_byte_bpe(spark, awkward, empty, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    run = lambda d: bytebpe.digests(bytebpe.decode(bytebpe.encode(d, path, public.PATTERN), path, public.PATTERN))
    assert Counter(map(tuple, run(awkward).collect())) == Counter((i, *bytebpe.brute(t, own)) for i, t in AWKWARD)
    some = docs.filter("doc_id < 60").select("doc_id", "text")
    assert sorted(map(tuple, run(some).collect())) == sorted((r["doc_id"], *bytebpe.brute(r["text"], own)) for r in some.collect())
    assert run(empty).count() == 0
    codec = bytebpe.codec(path, public.PATTERN)
    text = "naïve 🎉"
    assert b"".join(text.encode()[a:b] for _, a, b in codec.offsets(text)) == text.encode()


# 7 media


def test_media_columns(awkward, empty):
    rows = media.columns(awkward).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    text = {i: t or "" for i, t in AWKWARD}
    for r in rows:
        data = text[r["doc_id"]].encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        image = media.png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["caption"]) == (len(image), hashlib.sha256(image).hexdigest(), f"{len(data)} bytes")
        lines = [" ".join(x.split()) for x in text[r["doc_id"]].split("\n")]
        assert r["pos"] == sum(map(bool, lines[: len(lines) // 2])) and r["n_items"] == 1 + sum(map(bool, lines)) and r["text_chars"] == sum(map(len, lines))
    assert media.columns(empty).count() == 0


def test_images_are_read_by_another_reader(awkward):
    """The chunks of the stored form by the format's rules, without this module's code."""
    for r in media.store(awkward).collect():
        data, rows = r["media"], b""
        assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
        at = 8
        while at < len(data):
            n = int.from_bytes(data[at : at + 4])
            kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
            assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n])
            rows += body if kind == b"IDAT" else b""
            at += 12 + n
        raw = zlib.decompress(rows)
        payload = b"".join(raw[i + 1 : i + 193] for i in range(0, len(raw), 193))
        text = (dict(AWKWARD)[r["doc_id"]] or "").encode()
        assert payload.startswith(text) and not payload[len(text) :].strip(b" ") and len(payload) % 192 == 0 < len(payload)


def test_pages_of_the_given_table(spark, data):
    """Real pages: every visible word in order, by a plain regular expression."""
    pages = spark.read.parquet(f"{data}/pages.parquet").limit(40)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in media.parsed(pages, "page_id").collect():
        plain = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ", html[r["page_id"]])
        said = " ".join(x["text"] for x in r["items"] if x["kind"] == "text")
        assert "".join(said.split()) == "".join(__import__("html").unescape(plain).split())
        assert [x["pos"] for x in r["items"]] == list(range(len(r["items"])))


def test_pages_keep_order(spark):
    page = "<p>one &amp; 1</p><img src='media:sha256/aa' alt='x'><script>no</script><figure><img src=bb><figcaption>Cap</figcaption></figure>two"
    assert [(x["kind"], x["text"], x["ref"], x["caption"]) for x in media.parse(page)] == [("text", "one & 1", None, None), ("media", None, "aa", "x"), ("media", None, "bb", "Cap"), ("text", "two", None, None)]
    pages = media.parsed(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id")
    stored = spark.createDataFrame([("aa", 5)], "digest string, payload_bytes long")
    got = media.sequences(media.resolved(media.exploded(pages), stored), "id").collect()
    assert len(got) == 1 and [(x["pos"], x["kind"], x["payload_bytes"]) for x in got[0]["items"]] == [(0, "text", None), (1, "media", 5), (2, "media", None), (3, "text", None)]
    with pytest.raises(ValueError):
        media.samples(media.png(b"x" * 192)[:-20] + b"y" * 20)


# 9 hosts


def test_url_rules(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/1?x", "www.example.com", "/en/1", "com/en/", "block"), (2, "http://example.com/en/7#y", "example.com", "/en/7", "example.com/en/7", "allow"),
        (3, "http://a.example.net/de/80", "a.example.net", "/de/80", "example.net/de/8", "block"), (4, "http://x.net/de/", "x.net", "/de/", "net/de/", "allow"), (5, "http://xcom/en/", "xcom", "/en/", None, None),
        (6, None, "", "", None, None), (7, "no scheme", "", "", None, None), (8, "http://org?/es/", "org", "", None, None), (9, "a://b://c/d", "b:", "//c/d", None, None),
    ]
    df = spark.createDataFrame([(i, u, "<p>" + "fine words here and there " * 20 + "</p>", "clash") for i, u, *_ in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urlrep.judge(df).collect()}
    for i, _, host, path, rule, verdict in rows:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow")
    assert urlrep.judge(df.limit(0)).count() == 0


def test_shrinkage(spark):
    rows = [("bad.example.org", 1)] * 40 + [("new.example.org", 1)] + [(f"h{i}.good.com", 0) for i in range(200)] + [("x.good.com", None)]
    got = {r["host"]: r for r in urlrep.reputation(spark.createDataFrame(rows, "host string, outcome int")).collect()}
    assert got["bad.example.org"]["host_risk"] < 0.05 < 0.9 < got["h1.good.com"]["host_risk"]
    assert got["new.example.org"]["host_rate"] > got["h1.good.com"]["host_rate"] and got["x.good.com"]["host_rate"] < 0.2


def test_beta_distribution(spark):
    """Against sums of binomial terms, exact for whole numbers."""
    pairs = [(1, 1), (2, 7), (40, 3), (30, 30), (150, 120), (900, 1000), (3, 2000), (6000, 5900)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    for x in (0.5, 0.2):
        got = [r[0] for r in df.select(urlrep.beta_below(F.col("a"), F.col("b"), x)).collect()]
        for (a, b), g in zip(pairs, got, strict=True):
            n = a + b - 1
            want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log(1 - x)) for j in range(a, n + 1))
            assert g == pytest.approx(want, abs=1e-8 if a + b <= urlrep.LARGE else 2e-3), (a, b, x)


def test_registered_domains(spark):
    hosts = ["news.bbc.co.uk", "bbc.co.uk:8080", "co.uk", "a.b.example.com", "localhost", "10.0.0.1:80", "", "x.com.au", "a..com"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in df.select(*urlrep.registered(F.col("host"))).collect()]
    assert got[:8] == [("bbc.co.uk", "co.uk"), ("bbc.co.uk", "co.uk"), ("co.uk", "uk"), ("example.com", "com"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("", ""), ("x.com.au", "com.au")]


def test_hosts_are_blocked_by_labelled_outcomes(spark):
    """Planted bad hosts go, their neighbours under a shared suffix and rare hosts stay."""
    urls = [(f"http://spam{i % 3}.x.co.uk/{i}", 1) for i in range(150)] + [(f"http://good{i % 40}.y.co.uk/{i}", int(i % 19 == 0)) for i in range(400)]
    urls += [("http://once.z.co.uk/", 1), (None, None), ("http://good0.y.co.uk/new", None), ("http://spam0.x.co.uk/new", None)]
    pages = spark.createDataFrame([(i, u, "<p>" + "x" * 100_000 if i == 3 else None, "clash", 5) for i, (u, _) in enumerate(urls)], "page_id long, url string, html string, host string, outcome int")
    outcomes = spark.createDataFrame([(i, o) for i, (_, o) in enumerate(urls)] + [(0, 1)], "page_id long, outcome int")
    pages = pages.unionByName(pages.filter("page_id = 1"))
    got = [(r["host"], r["verdict"]) for r in urlrep.judge(pages, outcomes).collect()]
    assert len(got) == len(urls) + 1
    assert {v for h, v in got if h.startswith("spam")} == {"block"}
    assert {v for h, v in got if not h.startswith("spam")} == {"allow"}


# 10 rules and outliers


def plain_statistics(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = {}
    for k in range(len(words) - 4):
        at.setdefault(tuple(words[k : k + 5]), []).append(k)
    again = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_base_statistics(awkward, docs, empty):
    want = Counter((i, *plain_statistics(t)) for i, t in AWKWARD)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[n] for n in names) for r in outliers.statistics(awkward).collect()) == want
    got = outliers.judge(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        s = plain_statistics(text[r["doc_id"]])
        assert tuple(r[n] for n in names[1:]) == s
        assert r["base_failed"] == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and not (r["base_failed"] and r["kept"])
    assert len(got) == len(text) and sum(r["kept"] for r in got) > 0.7 * len(text)
    assert outliers.judge(empty).count() == 0
    assert Counter(r["doc_id"] for r in outliers.judge(awkward).collect()) == Counter(i for i, _ in AWKWARD)


def plain_robust(x):
    """Mean, covariance and log-determinant of the best concentrated three quarters of vectors on
    the grid, one row at a time."""
    q = np.round(x * outliers.GRID).astype(int)
    q = q[np.lexsort(q.T[::-1])]
    least, half = np.array(outliers.LEAST_SPREAD), int(np.ceil(outliers.SHARE * len(q)))

    def estimate(some):
        v = some / outliers.GRID
        mean = v.mean(axis=0)
        cov = (v - mean).T @ (v - mean) / len(v)
        full = cov * outliers.CONSISTENT + np.diag(least**2)
        return mean, cov, full, np.linalg.slogdet(full)[1]

    lower = lambda a: np.sort(a, axis=0)[(len(a) - 1) // 2]
    off = np.abs(q - lower(q))
    apart = off / np.maximum(1.4826 * lower(off), least * outliers.GRID)
    found = []
    for order in (apart.max(axis=1), apart.sum(axis=1), None):
        now = estimate(q if order is None else q[np.argsort(order, kind="stable")[:half]])
        while True:
            mean, _, full, det = now
            v = q / outliers.GRID - mean
            d = np.einsum("ij,jk,ik->i", v, np.linalg.inv(full), v).round(9)
            new = estimate(q[np.argsort(d, kind="stable")[:half]])
            stop, now = new[3] >= det - outliers.FALL, new
            if stop:
                break
        found.append(now)
    return min(found, key=lambda e: e[3])


def plain_verdicts(rows):
    """doc_id to (distance, kept) from (doc_id, text, lang, source), by plain_robust."""
    stats, x = {}, {}
    for i, text, *_ in rows:
        stats[i] = n, chars, symbols, lines, again = plain_statistics(text)
        m = max(n, 1)
        x[i] = np.log([m, 1 + chars / m, 1 + 10 * symbols / m, 1 + 10 * lines / m])
    failed = {i: s[0] < 10 or 100 * s[4] > 20 * s[0] for i, s in stats.items()}

    def of(**want):
        some = [x[i] for i, _, lang, source in rows if not failed[i] and all({"lang": lang, "source": source}[k] == v for k, v in want.items())]
        return (len(some), *plain_robust(np.array(some))[:2]) if some else (0, 0.0, 0.0)

    lean = lambda a, b: tuple(a[0] / (a[0] + outliers.LEAN) * u + outliers.LEAN / (a[0] + outliers.LEAN) * v for u, v in zip(a[1:], b, strict=True))
    base, out, known = of()[1:], {}, {}
    for i, _, lang, source in rows:
        if (lang, source) not in known:
            known[lang, source] = lean(of(lang=lang, source=source), lean(of(lang=lang), base))
        mean, cov = known[lang, source]
        v = x[i] - mean
        d = v @ np.linalg.inv(cov * outliers.CONSISTENT + np.diag(np.array(outliers.LEAST_SPREAD) ** 2)) @ v
        out[i] = d, not failed[i] and d <= outliers.LIMIT
    return out


def test_outliers_match_brute_force(spark):
    rng, rows = random.Random(8), []
    for i in range(240):
        said = [rng.choice("the a of some longer words stand here and there".split()) + str(rng.randrange(9)) for _ in range(rng.randrange(5, 120))]
        if i % 12 == 0:
            said = [w + "#$%&" * 3 for w in said]
        if i % 17 == 0:
            said += ["\nsame line"] * 3
        rows.append((i, " ".join(said), rng.choice(["en", "de", None]), rng.choice(["s", "t"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = plain_verdicts(rows)
    for parts in (2, 37):
        got = {r["doc_id"]: r for r in outliers.judge(docs.repartition(parts)).collect()}
        assert {i: r["kept"] for i, r in got.items()} == {i: k for i, (_, k) in want.items()}
        assert all(r["distance"] == pytest.approx(want[i][0], rel=1e-6) for i, r in got.items())
    assert 10 < sum(not k for _, k in want.values()) < 120
    assert {r["kept"] for r in outliers.judge(docs.filter("doc_id < 0")).collect()} == set()
    assert {r["kept"] for r in outliers.judge(spark.createDataFrame([(1, "few words", "en", "s")], docs.schema)).collect()} == {False}


# the pipeline


def test_pipeline_stages(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= seen and len(ids) > 0.6 * len(seen), name
        docs, seen = out, ids
    groups = neardup.brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(c == i for i, (_, c) in groups.items())
    packed = pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == seen
    assert pipeline.STAGES[0][1](spark, docs.limit(0), data).count() == 0
