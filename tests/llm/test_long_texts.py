"""One text of 50 MB passes quality and toxicity in bounded memory, and runs of words do not show in the result."""

from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

from wardlight.llm import quality, toxicity, words  # noqa: E402

SCRIPT = """
import resource, sys
sys.path.insert(0, sys.argv[1])
import numpy as np, pyarrow as pa
from wardlight.llm import quality, toxicity, words
rng = np.random.default_rng(0)
line = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(20000))
column = pa.array([(line + " ") * (50_000_000 // len(line))])
keys = np.unique(words.split(next(words.texts(pa.array([line]))), words.ALNUM).key)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
t = next(words.texts(column))
quality.features(t, quality.Vectors(keys, quality.index_vectors(keys)))
list(quality._context_sums(keys)(iter([pa.RecordBatch.from_arrays([column], ["text"])])))
score = toxicity.Reader().scores_of(t)
assert score.shape == (1,)
print(peak() - before)
"""


def test_a_text_of_50_megabytes():
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 800  # MB


def test_runs_of_words_do_not_show(monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 5))) + rng.choice(["", ",", "!"]) for _ in range(3000))
    column = pa.array([text, "", "a few words.", None, text[:500]])
    t = next(words.texts(column))
    keys = np.unique(words.split(t, words.ALNUM).key)[::2]
    vectors = quality.Vectors(keys, quality.index_vectors(keys))
    batch = lambda: iter([pa.RecordBatch.from_arrays([column], ["text"])])
    sums = lambda: [b.to_pydict() for b in quality._context_sums(keys)(batch())]
    features, context, split = quality.features(t, vectors), sums(), words.split(t, words.ALNUM)
    monkeypatch.setattr(quality, "RUN", 4 * quality.STRETCH)
    monkeypatch.setattr(words, "CHUNK_BYTES", 100)
    for a, b in zip(words.split(t, words.ALNUM), split):
        assert (a == b).all()
    assert np.allclose(quality.features(t, vectors), features, atol=1e-5)
    assert sums() == context
    one, net = next(words.texts(pa.array([text]), 1 << 30)), toxicity.Reader()
    whole = net.scores(toxicity.Inputs(one))
    for strides in (1, 5, 40):
        monkeypatch.setattr(toxicity, "RUN", strides * toxicity.STRIDE + toxicity.WINDOW)
        assert np.allclose(net.scores_of(one), whole, atol=1e-6)
