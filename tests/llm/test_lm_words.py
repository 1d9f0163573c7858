"""Words read from Arrow columns, and rows of the words met."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from opledger.llm import attention as net
from opledger.llm import lm_scoring as lm


def test_values_equal_the_scalars_of_a_column():
    words = pa.array([b"a", b"", b"\xff\x00", b"longer than a word"], pa.binary())
    for column in (words, words.slice(1, 2), words.slice(4), pa.array([3, 1 << 40], pa.int64())):
        assert lm.values(column) == column.to_pylist()
        assert all(type(v) in (bytes, int) for v in lm.values(column))


def test_training_makes_no_copy_of_the_known_words_rows():
    known = lm.Known(lambda ws: (np.ones((len(ws), net.FEATURES), np.float32), np.zeros(len(ws), np.int32)))
    known.numbers([b"w%d" % k for k in range(100_000)])
    trainer = net.Trainer(net.initial(np.full(net.CLASSES, 1 / net.CLASSES)))
    tracemalloc.start()
    lm._steps(trainer, known, pa.array(["w1 w2 new"]), 0.01, np.random.default_rng(1), 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert trainer.t == 1 and most < known.rows[0].nbytes / 4


def test_known_words_keep_their_rows_beside_spare_ones_and_when_full():
    known = lm.Known(lambda ws: (np.array([[int(w)] for w in ws], dtype=np.float32),), limit=6000)
    for low in (0, 4094, 4095, 3000, 9000):  # at the first rows' end, over it, and beyond the limit
        asked = [b"%d" % k for k in range(low, low + 1500)]
        at = known.numbers(asked)
        assert known.rows[0][at, 0].tolist() == [float(w) for w in asked]
        end = len(known.named)
        known.rows[0][end : end + lm.SPARE_ROWS] = -1
        assert len(known.rows[0]) >= end + lm.SPARE_ROWS and known.rows[0][at, 0].min() >= 0


def test_full_known_words_stay_if_they_were_asked_for_again():
    described = []
    known = lm.Known(lambda ws: (described.extend(ws), (np.array([[int(w)] for w in ws], dtype=np.float32),))[1], limit=1000)
    frequent = [b"%d" % k for k in range(400)]
    for k in range(30):  # 12,000 words that come once, beside the frequent ones
        asked = [*frequent, *(b"%d" % w for w in range(1000 + 400 * k, 1400 + 400 * k))]
        at = known.numbers(asked)
        assert known.rows[0][at, 0].tolist() == [float(w) for w in asked] and len(known.named) <= 1000
    assert len(described) == len(set(described)) == 400 + 30 * 400


def test_known_words_and_new_ones_of_one_call_may_exceed_the_limit_together():
    known = lm.Known(lambda ws: (np.array([[int(w)] for w in ws], dtype=np.float32),), limit=6000)
    for low, high in ((0, 4000), (1000, 8000), (0, 9000)):
        asked = [b"%d" % k for k in range(low, high)]
        at = known.numbers(asked)
        assert known.rows[0][at, 0].tolist() == [float(w) for w in asked] and len(set(at.tolist())) == len(asked)


def test_word_counts_are_whole_however_often_they_leave_a_task(spark, monkeypatch):
    texts = [" ".join(f"w{(k * j) % 97} Ab\tc{j}" for j in range(k % 50)) for k in range(1500)]
    want = Counter(w for t in texts for w in [*lm.words(t.encode()), b""])
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    for different, size in ((400_000, 1 << 26), (60, 1 << 26), (400_000, 3000)):
        monkeypatch.setattr(lm, "COUNT_WORDS", different)
        monkeypatch.setattr(lm, "COUNT_BYTES", size)
        assert {bytes(r.word): r.n for r in lm._word_counts(docs).collect()} == want


def test_places_without_a_target_leave_the_gradient_alone():
    rng = np.random.default_rng(2)
    flat = net.initial(np.full(net.CLASSES, 1 / net.CLASSES)) + rng.normal(0, 0.05, net.SIZE).astype(np.float32)
    features, target = rng.normal(size=(3, net.LENGTH, net.FEATURES)).astype(np.float32), rng.integers(-1, net.CLASSES, (3, net.SCORED))
    target[1] = -1
    some = net.gradient(flat, features[[0, 2]], target[[0, 2]])
    assert np.abs(net.gradient(flat, features, target) - some).max() < 1e-6
    assert not net.gradient(flat, features, np.full_like(target, -1)).any()
