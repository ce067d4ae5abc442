"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import public_tokenizers

from stroma.llm import packing, shared


def test_tidy_forgets_tables_and_gives_memory_back():
    shared._power_tables(1 << 18)
    held = pa.array(np.arange(1 << 20))
    del held
    shared.tidy()
    assert shared._powers["up"] is None
    assert len(shared._power_tables(10)[0]) >= 10


def test_packing_starts_without_what_earlier_tasks_left():
    shared._power_tables(1 << 18)
    gc.disable()
    try:
        batch = pa.record_batch([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])
        pieces = list(packing._cut(public_tokenizers.path("word_bpe_49k.json"), 2048, 1)(iter([batch])))
    finally:
        gc.enable()
    assert shared._powers["up"] is None and pieces[0].num_rows == 1
