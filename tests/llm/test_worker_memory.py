"""What a worker process holds while its tasks run and when they have ended."""

import tracemalloc

import pyarrow as pa
import pytest

from labelyard.llm import bytebpe, common, packing, quality

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])


def test_another_operator_forgets_the_encoders_words():
    encode = packing.encoder(WORDS)
    for batch in packing.blocks(rows(["some words", "and some more"])):
        encode(batch.column(1))
    list(packing.blocks(rows(["others"])))
    assert packing.encoder(WORDS) is encode and len(encode.at) == 4  # the same operator's next task
    list(common.batches(rows(["a text"])))
    assert not packing._encoders
    assert packing.encoder(WORDS) is not encode


def test_operators_with_caches_take_over_from_each_other():
    packing.encoder(WORDS)
    own = bytebpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    list(common.batches(rows(["a text"]), owner="bytebpe"))
    assert not packing._encoders and own in bytebpe._codecs.values()
    list(packing.blocks(rows(["a text"])))
    assert not bytebpe._codecs


def test_statistics_of_many_texts_hold_few_at_once():
    texts = ["some words of a text that is repeated " * 50] * 2000  # 3.8 MB
    common.Words._pow = common.Words._inv = common.np.ones(1, common.np.uint64)
    tracemalloc.start()
    try:
        for _, some in common.batches(rows(texts)):
            quality.statistics(some)
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
