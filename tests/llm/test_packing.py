import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quittance.llm import packing
from quittance.llm.tokens import tokenizer_path


def plain_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(placed, encode, rows, window):
    """Every id in one piece, windows gapless and not too long; the lengths of windows."""
    want = sorted(((r[0], tuple(encode(r[1]))) for r in rows), key=str)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in placed:
        by_doc[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
        by_window[p.sequence_id].append((p.offset, p.length))
    found = defaultdict(list)
    for doc_id, ids in want:
        at = [(s, len(ids[s : s + window]), zlib.crc32(np.array(ids[s : s + window], "<u4").tobytes())) for s in range(0, len(ids), window)]
        found[doc_id, len(ids)] += at
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in found.items()}
    used = []
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
        used.append(at)
    return used


@pytest.mark.parametrize("per_group", [8192, 40])
def test_whole_documents(docs, rows, per_group):
    placed = packing.packed_documents(docs, per_group=per_group).collect()
    used = check(placed, plain_encoder(), rows, 1024)
    assert sum(1024 - u for u in used) < (1024 if per_group > 1000 else 8 * 1024)
    assert {p.sequence_id for p in packing.packed_documents(docs, per_group=per_group).collect()} == {p.sequence_id for p in placed}


def by_hand(lengths, window):
    """Best fit by looking at every window; the room that each is left with."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if not fits:
            rooms.append(window)
            fits = [(window, len(rooms) - 1)]
        rooms[min(fits)[1]] -= n
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_against_brute_force(spark, seed):
    rng = random.Random(seed)
    window = [16, 100, 7, 64][seed]
    lengths = [rng.choice([rng.randint(1, window), window, max(1, window // 3)]) for _ in range(700)]
    cut = spark.createDataFrame([(i, 0, n, 0, n) for i, n in enumerate(lengths)], packing.PIECE)
    rooms = defaultdict(lambda: window)
    for p in packing.pack(cut, window).collect():
        rooms[p.sequence_id] -= p.length
    # which of several windows with equal room is taken doesn't change what rooms there are
    assert sorted(rooms.values()) == by_hand(lengths, window)


def test_tree_finds_least_room():
    rng, rooms, open_ = random.Random(0), packing.Rooms(37), []
    for i in range(3000):
        n = rng.randint(1, 37)
        assert rooms.tightest(n) == min((r for r in open_ if r >= n), default=0)
        if open_ and rng.random() < 0.5:
            r = rng.choice(open_)
            open_.remove(r)
            rooms.take(r)
        else:
            rooms.put(n, i)
            open_.append(n)


def test_sequences_hold_the_ids(docs, rows):
    encode, packed = plain_encoder(), packing.packed_documents(docs, window=128, keep_ids=True)
    out = packing.sequences(packed, 128).collect()
    ids = defaultdict(int)
    for r in rows:
        whole = encode(r[1])
        for s in range(0, len(whole), 128):
            ids[tuple(whole[s : s + 128])] += 1
    for s in out:
        n = s.n_tokens
        assert len(s.ids) == s.padded_tokens == (n if n & (n - 1) == 0 else 128) and len(s.doc_ids) == len(s.starts)
    assert sum(s.n_tokens for s in out) == sum(len(k) * n for k, n in ids.items())
    for p in packed.collect():
        ids[tuple(p.ids)] -= 1
    assert not any(ids.values())


def test_none(no_docs):
    assert packing.packed_documents(no_docs).count() == 0
