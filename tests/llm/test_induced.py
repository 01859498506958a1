import random

import numpy as np
import pytest

from isopleth.llm import induced, repeats


def padded(data):
    return np.frombuffer(data + b"\0" * 16, dtype=np.uint8)


def check(data, depth, memory, fits):
    got = [(p, c) for pos, common in induced.descending(padded(data), len(data), depth, memory, fits) for p, c in zip(pos.tolist(), common.tolist())]
    assert sorted(p for p, _ in got) == list(range(len(data)))
    for (p, _), (q, c) in zip(got, got[1:]):
        a, b = data[p : p + depth], data[q : q + depth]
        assert a >= b
        assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("memory", [1 << 28, 50])  # 50 bytes: queues and arrays live in files
@pytest.mark.parametrize("fits", [1 << 22, 2])  # 2 names: recursion to the end
@pytest.mark.parametrize("wide", [512, 2])
def test_against_plain_sorting(memory, fits, wide, monkeypatch):
    monkeypatch.setattr(induced, "WIDE", wide)
    monkeypatch.setattr(induced, "RANGE", 7)
    monkeypatch.setattr(induced, "BLOCK", 5)
    rng = random.Random(memory + fits)
    for _ in range(120):
        alphabet = rng.choice(["a", "ab", "abc", "abcdefgh\xff"])
        data = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))).encode("latin-1")
        check(data, rng.choice([3, 10, 100]), memory, fits)


@pytest.mark.parametrize("memory", [1 << 28, 4000])
def test_long_repetition(memory):
    part = bytes(random.Random(1).choices(b"abcde ", k=300))
    for data in (part * 12, b"a" * 3000, b"ab" * 2000 + b"a" * 400, bytes(range(256)) * 6):
        check(data, 100, memory, 20)


def test_refuses_text_without_padding():
    with pytest.raises(ValueError):
        list(induced.descending(np.zeros(4, np.uint8), 4))


def test_queue_order_from_both_ends_and_through_files():
    spool = induced.Spool(100)
    q = induced.Queue(spool)
    for a in range(0, 90, 9):
        q.push(np.arange(a, a + 9), np.arange(a, a + 9, dtype=np.uint8))
    assert spool.spilled
    left, right = q.pop(20)[0], q.pop(20, right=True)[0]
    assert left.tolist() == list(range(len(left))) and right.tolist() == list(range(90 - len(right), 90))
    rest = []
    while q.size:
        pos, lcp = q.pop(7)
        assert pos.tolist() == lcp.tolist()
        rest += pos.tolist()
    assert rest == list(range(len(left), 90 - len(right)))


def test_shard_keeps_the_earliest_of_each_string():
    rng = random.Random(3)
    same = bytes(rng.choices(b"abcdefg ", k=160))
    for memory in (1 << 20, 200):
        shard = repeats.Shard(memory)
        more = np.array([60, 60, 40, 0])
        texts = [same, same, same[:140], same[10:110]]
        shard.add(np.array([7, 3, 9, 4]), np.array([0, 50, 5, 1]), more, texts)
        got = {(d, s, s + m) for f in shard.spans() for d, s, m in zip(f["doc"], f["start"], f["more"])}
        assert got == {(7, 0, 160), (9, 5, 145), (4, 1, 101)}  # document 3 has the earliest of all
        assert not list(repeats.Shard(memory).spans())
