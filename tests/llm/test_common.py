"""Plumbing shared by the operators."""

import re

import pyarrow as pa

from quillmark.llm import common


def test_every_batch_is_handed_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "hand_back", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (700, 0, 3)]
    assert [b.num_rows for b in common.slices(iter(batches))] == [512, 188, 3] and len(calls) == 3


def test_freed_memory_goes_back_to_the_system():
    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

    common.hand_back()
    before = held()
    blocks = [pa.array(["x" * 1000] * 1000).to_pylist() for _ in range(100)]
    last = pa.array(["y" * 1000])
    assert held() > before + 80
    del blocks
    common.hand_back()
    assert held() < before + 40 and len(last) == 1
