"""State of a worker process."""

import sys

import pyarrow as pa

from pulsemill.llm import near_dup, worker


def test_what_is_made_after_a_release_is_kept():
    made = []

    def make():
        worker.release()
        made.append(1)
        return "value"

    worker.kept("other words", lambda: 1)
    assert [worker.kept("some words", make) for _ in range(3)] == ["value"] * 3
    assert len(made) == 1
    worker.release()
    worker.kept("some words", make)
    assert len(made) == 2
    worker.release()


def test_a_stream_leaves_nothing_behind():
    @worker.released_stream
    def double(stream):
        for x in stream:
            yield x * worker.kept("two times", lambda: 2)

    worker.kept("other words", lambda: 1)
    assert list(double(iter([1, 2, 3]))) == [2, 4, 6]
    assert not vars(sys)["_pulsemill_kept"]


def test_near_dup_keeps_no_words_between_tasks(monkeypatch):
    """Every function over a stream is run as a worker would, without Spark."""
    class Rows:
        sparkSession = None

        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            held.append(fn)
            return self

    held = []
    monkeypatch.setattr(near_dup.F, "col", lambda _: Column())
    near_dup.sketches(Rows())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(250)), "text": [f"a b c d e f{i}" for i in range(250)]})
    out = pa.Table.from_batches(held[0](iter([batch])))
    assert out.column("n_shingles").to_pylist() == [2] * 250
    assert not vars(sys)["_pulsemill_kept"]


class Column:
    def cast(self, _):
        return self

    alias = cast
