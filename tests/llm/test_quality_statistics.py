"""The quality classifier's statistics against a plain version, one text at a time."""

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from labelyard.llm import quality  # noqa: E402


def plain(text: bytes) -> list[float]:
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text) if w]
    n, size = max(len(words), 1), max(len(text), 1)
    among = lambda chars: sum(b in chars for b in text)
    upper, lower, digit, symbol = among(range(65, 91)), among(range(97, 123)), among(range(48, 58)), among(b"#*$%&|<>")
    high, space = among(range(128, 256)), among(b" \t\r\f\v")
    bang, stop, comma, line = (among(c) for c in (b"!", b".", b",", b"\n"))
    other = len(text) - upper - lower - digit - symbol - high - space - bang - stop - comma - line
    letters = max(upper + lower + high, 1)
    counts = Counter(words)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, upper / letters, digit / size, symbol / size, bang / n, stop / n, comma / n, line / n, high / letters, other / size,
        len(counts) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(len(w) >= 16 for w in words) / n, sum(len(w) == 1 for w in words) / n, max(counts.values(), default=0) / n, math.log1p(size) * bool(words),
    ]


def texts():
    rng = random.Random(3)
    some = ["", " ", "\n\n", "a", "a a a", "Word WORD word.", "#$% | <b> &", "naïve 日本語 🎉!!", "x" * 40, "1,2,3.4\t5", "end ", " begin", "a\x0bb\x0cc\rd", "\x00\x1c \x7f", "no-space;here:()"]
    parts = ["the", "The", "long" * 5, "é", "12", "!", "...", "a,b", "\n", "\t", "  ", "#", "(", "日本"]
    return [t.encode() for t in some] + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 300))).encode() for _ in range(200)]


def test_statistics_match_plain_loops():
    every = texts()
    found = quality.statistics(every)
    assert found.shape == (len(every), len(quality.FEATURES))
    for text, row in zip(every, found, strict=True):
        assert row.tolist() == pytest.approx(plain(text), rel=1e-5, abs=1e-6), text


def test_statistics_do_not_depend_on_the_batch():
    every = texts()
    whole = quality.statistics(every)
    for at in range(0, len(every), 7):
        assert (quality.statistics(every[at : at + 7]) == whole[at : at + 7]).all()


def test_kept_documents_are_those_of_the_forest(spark, data):
    """The pipeline's stage keeps what a walk through each tree, one document at a time, keeps."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.learn(docs, labels)

    def score(text: bytes) -> float:
        x, total = quality.statistics([text])[0], forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    want = {r["doc_id"] for r in docs.collect() if score((r["text"] or "").encode()) >= quality.ACCEPT}
    assert {r["doc_id"] for r in quality.accepted(docs, labels).collect()} == want and want
