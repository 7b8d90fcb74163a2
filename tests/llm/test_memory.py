"""Memory of the Python workers follows a small chunk of the texts, whatever the batch."""

import random
import tracemalloc

import pyarrow as pa
from llm_fixtures import prose
from tillwise.llm import stats
from tillwise.llm.token_output import encoder_of, tokenizer_path


def test_counts_hold_a_small_chunk():
    rng = random.Random(3)
    texts = pa.array([prose(rng, 400) for _ in range(2500)])  # about 4.5 MB
    stats.count_rows(texts.slice(0, 300))  # tables that stay
    tracemalloc.start()
    try:
        stats.count_rows(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6


def test_a_worker_keeps_the_caches_of_one_operator():
    encoder = encoder_of(tokenizer_path())
    assert encoder_of(tokenizer_path()) is encoder
    stats._counts_udf(pa.array(["a b"]))
    assert encoder_of(tokenizer_path()) is not encoder
