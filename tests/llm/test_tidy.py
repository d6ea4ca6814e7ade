import ctypes
import os
import re
from pathlib import Path

import corpus_pipeline as P
from tracelode.llm import common as C

BLOCK, BLOCKS = 60_000, 1000


def anonymous_mb(pid: int) -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def freed(allocate, free):
    """Allocates and fills blocks, and frees all but some that keep the allocator from giving back the others by itself; those are returned."""
    blocks = [allocate() for _ in range(BLOCKS)]
    for k, x in enumerate(blocks):
        if k % 50 != 49:
            free(x)
    return blocks[49::50]


def test_what_the_jvm_has_freed_goes_back(spark):
    jvm, pid = spark._jvm, spark._jvm.java.lang.ProcessHandle.current().pid()
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    C.tidy(spark)

    def filled():
        x = unsafe.allocateMemory(BLOCK)
        unsafe.setMemory(x, BLOCK, 1)
        return x

    held = freed(filled, unsafe.freeMemory)
    for _ in range(2):
        jvm.System.gc()  # so that it isn't the heap that shrinks
    before = anonymous_mb(pid)
    C.tidy(spark)
    assert before - anonymous_mb(pid) > 0.5 * BLOCK * BLOCKS / 1e6
    for x in held:
        unsafe.freeMemory(x)


def test_what_python_has_freed_goes_back(spark):
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    C.tidy(spark)

    def filled():
        x = libc.malloc(BLOCK)
        ctypes.memset(x, 1, BLOCK)
        return x

    held = freed(filled, libc.free)
    before = anonymous_mb(os.getpid())
    C.tidy(spark)
    assert before - anonymous_mb(os.getpid()) > 0.5 * BLOCK * BLOCKS / 1e6
    for x in held:
        libc.free(x)


def test_stages_tidy_before_and_after(monkeypatch):
    done = []
    monkeypatch.setattr(P.C, "tidy", lambda spark: done.append("tidy"))
    assert P.tidied(lambda spark, docs, sf_dir: done.append("stage") or docs)(None, 1, "") == 1
    assert done == ["tidy", "stage", "tidy"]
    assert all(hasattr(stage, "__wrapped__") for _, stage in P.STAGES)
