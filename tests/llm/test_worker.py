"""What Python workers hold after a task, for tasks of other operators."""

from __future__ import annotations

import subprocess
import sys
from types import SimpleNamespace

import pyarrow as pa

from sentrilake.llm import quality, tokens

_HELD = """
import psutil
import pyarrow as pa
from sentrilake.llm.worker import keeps, lean

def size():
    return psutil.Process().memory_info().rss >> 20

kept = keeps()
kept["words"] = [b"x" * 50_000 for _ in range(4000)]
full = size()

def work(batches):
    assert not kept
    parts = [b"y" * 50_000 for _ in range(4000)]
    last = parts[-1]
    del parts
    yield from batches
    assert last

batch = pa.RecordBatch.from_pydict({"n": [1, 2]})
assert [b.num_rows for b in lean(work)(iter([batch]))] == [2]
print(full - size())
"""


def test_a_task_gives_up_what_other_operators_keep():
    table = SimpleNamespace(schema="doc_id long, text string", mapInArrow=lambda work, schema: work)
    keep = quality.keep_quality(table)
    tokens.encoder(tokens.default_tokenizer())(["a few words"])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["too short", None]})
    assert [b.num_rows for b in keep(iter([batch]))] == [0]
    assert not tokens._ENCODERS
    assert tokens.encoder(tokens.default_tokenizer())(["a few words"])


def test_freed_memory_goes_back_to_the_system():
    """200 MB kept before the task and 200 MB that it takes: neither is held after it."""
    found = subprocess.run([sys.executable, "-c", _HELD], capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout) > 100
