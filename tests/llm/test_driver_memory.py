"""What the driver has used and freed goes back to the system."""

import os
import re
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm import lang_id
from lodestone.llm.common import Workspace, relieve


def private(pid: int) -> float:
    """MB of a process's own memory."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


pytestmark = pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")


def test_learning_leaves_the_model_alone(spark):
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    words = {x: [word(s) for _ in range(20_000)] for x, s in (("aa", "abcdefghijklm"), ("bb", "nopqrstuvwxyz"))}
    rows = [(i, " ".join(rng.choice(words[x], 500)), x) for i in range(2400) for x in [("aa", "bb")[i % 2]]]
    docs = Workspace(spark, "learn").write(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    del rows, words
    lang_id.learn(docs.limit(50))  # imports
    before = private(os.getpid())
    model = lang_id.learn(docs)
    assert model.languages == ["aa", "bb"]
    assert private(os.getpid()) - before < 25


def test_written_tables_trim_the_jvm(spark):
    if not relieve(spark):
        pytest.skip("this JVM can't trim")
    jvm, work = spark._jvm, Workspace(spark, "trim")
    pid = int(jvm.java.lang.ProcessHandle.current().pid())
    work.write(spark.range(1), "first")
    held, out = [jvm.java.util.zip.Deflater() for _ in range(400)], spark.sparkContext._gateway.new_array(jvm.byte, 1 << 17)
    for x in held:  # each takes native memory, beside the heap
        x.setInput(os.urandom(1 << 16))
        x.finish()
        x.deflate(out)
    full = private(pid)
    for x in held[:-1]:
        x.end()
    work.write(spark.range(1), "second")
    left = private(pid)
    held[-1].end()
    assert full - left > 20
