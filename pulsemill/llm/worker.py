"""State of a worker process.

Functions travel to the workers by value, with copies of the globals they use, so a module's
globals do not live from one task to the next there. What is kept here does.
"""

import ctypes
import sys

import pyarrow as pa


def kept(name, make):
    """The value kept under a name in this process, made on first use.

    A process works for one operator after another: names with another first word are dropped.
    """
    state = vars(sys).setdefault("_pulsemill_kept", {})
    if name not in state:
        for other in [n for n in state if n.split()[0] != name.split()[0]]:
            del state[other]
        state[name] = make()
    return state[name]


def release():
    """Drop everything that is kept and give free memory back, for functions that need much themselves."""
    vars(sys).get("_pulsemill_kept", {}).clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(fn):
    """The function, with free memory given back before and after it."""
    def run(*args):
        release()
        out = fn(*args)
        release()
        return out

    # Spark looks at the number of arguments.
    if fn.__code__.co_argcount == 1:
        return lambda rows: run(rows)
    return lambda left, right: run(left, right)


def released_stream(fn):
    """The same for a function over a stream of batches: workers that wait hold nothing of their last task.

    A process takes one task after another and more processes wait than work, so what each keeps counts that often.
    """
    def run(stream):
        release()
        yield from fn(stream)
        release()

    return run
