"""Periodic runs, token files and conversation repair against brute force, the plain library and SQL."""

import functools
import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from labelyard.llm import periodic, queries, repair, tokenfiles  # noqa: E402

DOCS = "doc_id long, text string, start long, period string, code string, at long"
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, "again " * 30_000), (6, "a b c " * 9), (6, "a b c " * 9), (None, "x y " * 20), (7, "é ü ß " * 25), (8, "w " * 23), (9, "w " * 24), (10, "x" * 40_000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, 7, "p", "c", 1) for i, t in AWKWARD], DOCS)


def against_sql(spark, name, **tables):
    """The query over written tables and its SQL over the same."""
    import tempfile

    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{d}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, d)
    result = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    return Counter(map(tuple, df.select(*names).collect())), Counter(result.fetchall())


# 11 periodic runs


def periodic_words(rng):
    letters, said = rng.randrange(1, 6), []
    for _ in range(rng.randrange(1, 9)):
        said += [rng.randrange(letters) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 8)
    return said


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (2, 2), (4, 2)])
def test_runs_match_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(400):
        words = periodic_words(rng)
        assert periodic.find(words, least, times) == periodic.brute(words, least, times)


def test_the_screen_loses_no_run():
    rng = random.Random(9)
    for _ in range(60):
        texts = [periodic_words(rng) for _ in range(12)] + [[]]
        rng.shuffle(texts)
        assert periodic.runs_of([b" ".join(b"%d" % w for w in t) for t in texts]) == [periodic.brute(t) for t in texts]
    # least lengths: 24 words with periods 1 to 8, three periods beyond
    for q in range(1, 40):
        block = [f"b{i}" for i in range(q)]
        for n in (max(24, 3 * q), max(24, 3 * q) - 1):
            words = ["left", *(block * n)[:n], "right"]
            want = [(1, n, q)] if n >= max(24, 3 * q) else []
            assert periodic.runs_of([" ".join(words).encode()])[0] == periodic.brute(words) == want


def test_long_periods_and_far_copies():
    rng = random.Random(3)
    passage = [str(rng.randrange(10**6)) for _ in range(2000)]
    other = [str(rng.randrange(10**6)) for _ in range(9000)]
    text = " ".join([*passage, *other, *passage]).encode()
    assert periodic.runs_of([text]) == [[]] and not len(periodic.stretches(periodic.Words([text])))
    assert periodic.runs_of([" ".join(other[:10] + passage * 3 + passage[:5] + other[:10]).encode()]) == [[(10, 6005, 2000)]]


def test_greatest_exponent_is_exact():
    assert periodic.greatest([(0, 30, 7), (5, 60, 14), (9, 31, 7), (9, 62, 14)]) == (9, 31, 7)
    big = 10**15
    assert periodic.greatest([(0, 3 * big, big), (1, 3 * big + 1, big)]) == (1, 3 * big + 1, big)


def test_runs_of_awkward_rows(spark, awkward):
    rows = periodic.periodic_runs(awkward).collect()
    assert Counter(r["doc_id"] for r in rows) == {5: 1, 6: 2, None: 1, 7: 1, 9: 1}
    assert {(r["start"], r["length"], r["period"]) for r in rows if r["doc_id"] == 5} == {(0, 30_000, 1)}
    cut = periodic.collapse(awkward)
    assert cut.columns == awkward.columns
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter((i, {5: "again", 6: "a b c", None: "x y", 7: "é ü ß", 9: "w"}.get(i, t)) for i, t in AWKWARD)
    digest = {r["doc_id"]: r for r in periodic.digests(awkward).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert digest[1][1:] == digest[2][1:] == digest[3][1:] == (0, None, None, None, None, none, none)
    assert digest[5]["exponent_milli"] == 30_000_000
    assert periodic.digests(awkward.limit(0)).count() == periodic.periodic_runs(awkward.limit(0)).count() == 0


def test_periodic_query_matches_sql_on_periodic_texts(spark):
    rng = random.Random(21)
    rows = [(i, None if i == 3 else " ".join(rng.choice("abcdefg") if rng.random() < 0.1 else f"w{w}" for w in periodic_words(rng))) for i in range(150)]
    found, want = against_sql(spark, "op11_periodic_runs", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == want and sum(r[1] > 0 for r in found) > 40


# 12 token files


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    """Many documents in small stripes, in no order."""
    rng = random.Random(5)
    words = "the of stone river naïve 日本 walks, slowly! 12".split()
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(6000)]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("orc") / "tokens")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    tokenfiles.write_tokens(docs, public.path("word_bpe_49k.json"), path, stripe_bytes=1 << 15, row_index=1000)
    return path, dict(rows)


@functools.cache
def plain_model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


def plain_ids(text):
    return [*plain_model().encode(text or "", add_special_tokens=False).ids, 1]


def test_token_files_hold_the_library_s_ids(spark, tokens):
    path, texts = tokens
    rows = tokenfiles.read_tokens(spark, path).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: plain_ids(t) for i, t in texts.items()} and len(rows) == len(texts)
    start = 0
    for r in sorted(tokenfiles.read_counts(spark, path).collect()):
        ids = np.array(plain_ids(texts[r["doc_id"]]), "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_stripes_follow_the_ids_and_are_read_alone(tokens):
    import glob

    from pyarrow import orc

    path, texts = tokens
    last, stripes = -1, 0
    for name in sorted(glob.glob(f"{path}/part-*.orc")):
        file = orc.ORCFile(name)
        stripes += file.nstripes
        for k in range(file.nstripes):
            ids = file.read_stripe(k, columns=["doc_id"]).column(0).to_pylist()
            assert ids == sorted(ids) and (not ids or ids[0] > last)
            last = ids[-1] if ids else last
    assert stripes >= 8


def scanned(df):
    """Rows that the scan gave to the plan."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_readers_prune_by_ids(spark, tokens):
    path, texts = tokens
    some = tokenfiles.read_tokens(spark, path, ids=[3, 9000])
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {i: plain_ids(texts[i]) for i in (3, 9000)}
    assert "In(doc_id, [3,9000])" in some._jdf.queryExecution().toString()
    assert scanned(some) <= 2000 and scanned(tokenfiles.read_tokens(spark, path, low=6, high=12)) <= 1000
    assert [r["doc_id"] for r in tokenfiles.read_tokens(spark, path, low=6, high=12).collect()] == [6, 9, 12]
    # within each group's range, but only a Bloom filter knows that these ids don't exist
    assert scanned(tokenfiles.read_tokens(spark, path, ids=[3001])) == 0 or scanned(tokenfiles.read_tokens(spark, path, ids=[3002])) == 0


def test_token_files_of_awkward_rows(spark, awkward):
    path = public.path("word_bpe_49k.json")
    rows = tokenfiles.written_counts(awkward, path).collect()
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, plain_ids(t)) for i, t in AWKWARD))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None, *sorted(i for i, _ in AWKWARD if i is not None)]
    assert tokenfiles.written_counts(awkward.limit(0), path).count() == 0


# 13 conversation repair


def plain_cheapest(codes):
    """All strings of edits by brute force over a bounded number of inserts, for short rows."""
    best = None
    n = len(codes)

    def legal(said):
        said = said[1:] if said[:1] == "s" else said
        return len(said) % 2 == 0 and said == "ua" * (len(said) // 2)

    def go(i, said, edits, cost, free):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == n and legal(said) and said != "s" and (best is None or (cost, edits) < best):
            best = (cost, edits)
        if free:
            for x in "ua":
                go(i, said + x, edits + "I", cost + 3, free - 1)
        if i < n:
            fault, initial = divmod(ord(codes[i]) - 65, 4)
            go(i + 1, said, edits + "D", cost + 4, free)
            if fault < 2:
                go(i + 1, said + "suax"[initial], edits + "K", cost + 3 * fault, free)
                for x in "ua":
                    go(i + 1, said + x, edits + "R", cost + 3 + 3 * fault, free)

    go(0, "", "", 0, 3)
    return best


def test_edits_match_brute_force():
    every = [repair.code(f, i) for f in range(4) for i in range(4)]
    some = [repair.code(f, i) for f in range(2) for i in range(4)] + [repair.code(2, 1)]
    for codes in itertools.chain([()], itertools.product(every, repeat=1), itertools.product(every, repeat=2), itertools.product(some, repeat=3)):
        assert repair.cheapest("".join(codes)) == plain_cheapest(codes), codes
    rng = random.Random(4)
    for _ in range(150):
        codes = [rng.choice(every) for _ in range(rng.randrange(4, 6))]
        assert repair.cheapest("".join(codes)) == plain_cheapest(codes), codes


def kept_whole(codes):
    """The same with all costs in memory."""
    rows = [ord(c) - 65 for c in codes]
    costs = [repair.LAST]
    for c in reversed(rows):
        costs.append(repair._before(c, costs[-1]))
    return costs[-1][0]


def test_checkpoints_of_long_conversations():
    rng = random.Random(8)
    for n in (15, 16, 17, 99, 100, 5000):
        codes = "".join(repair.code(rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 2, 1, 2, 0, 3])) for _ in range(n))
        cost, audit = repair.cheapest(codes)
        assert cost == kept_whole(codes) and len(audit.replace("I", "")) == n
        # the edits cost what they should and lead to a right conversation
        walk, said, total = repair.Walk(audit), [], 3 * audit.count("I")
        for c, edit in zip(codes, audit.replace("I", ""), strict=True):
            fault, initial = divmod(ord(c) - 65, 4)
            said += [r[0] for r, _ in walk.take(["system", "user", "assistant", "tool"][initial], "t")]
            total += {"K": 0, "R": 3, "D": 4}[edit] + 3 * (fault == 1 and edit != "D")
            assert fault < 2 or edit == "D"
        said = "".join([*said, *(r[0] for r, _ in walk.inserts())])
        assert total == cost and said.lstrip("s") == "ua" * (len(said.lstrip("s")) // 2) and said.count("s") <= 1


def conversations(spark):
    rng, rows = random.Random(17), []
    for conv in range(60):
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "agent"]), rng.choice(["Yes.", "No!", "Why?", "cut off", " ", "", None, "Same.", "tail. \t\x0b", "naïve…", "日本。"]), "x", 1))
    rows += [(conv, None, "user", "No turn.", "x", 1) for conv in (1, 1, 2, 99)] + [(None, 1, "assistant", "No id.", "x", 1), (None, None, None, None, "x", 1), (3, 10**12, "user", "Far.", "x", 1)]
    rows += [(77, 1, "user", "One turn.", "x", 1)] * 30 + [(78, i % 3, "user", f"T{i}.", "x", 1) for i in range(40)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, code string, at long")


@pytest.mark.parametrize("block", [4096, 3])
def test_repair_matches_sql_on_awkward_rows(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    found, want = against_sql(spark, "op13_conversation_repair", conversations=conversations(spark).repartition(5))
    assert found == want and len(found) > 50


def test_repaired_rows_have_the_digests(spark):
    placed = repair.ordered(repair.damaged(conversations(spark)))
    rows = repair.repaired(placed, repair.edits(placed)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["place"])):
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    said = {r["conv_id"]: r["repaired_sha256"] for r in repair.report(repair.damaged(conversations(spark))).collect()}
    assert said == {c: hashlib.sha256("\n".join(by.get(c, [])).encode()).hexdigest() for c in said}


def test_repair_of_nothing(spark):
    some = conversations(spark)
    assert repair.report(repair.damaged(some.limit(0))).count() == 0
    gone = repair.damaged(some.filter("conv_id = 77").limit(1)).withColumn("gone", F.lit(True))
    assert [tuple(r) for r in repair.report(gone).collect()] == [(77, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
