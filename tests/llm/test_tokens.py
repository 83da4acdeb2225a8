import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from velotrace.llm import bpe, chunks, packing, token_files, tokens
from velotrace.llm.common import fresh_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def noise(rng):
    return "".join(rng.choice(["a", "b", "The", "don't", " ", "  ", "\n", "\n\n", "é", "漢字", "🙂", "1", "'s", "!!", ",", "\0", "\t", "xyz", "aaaa", "ß", "\u3000"]) for _ in range(rng.choice([0, 1, 3, 10, 60])))


def test_chunks_against_the_library(library, odd_texts):
    rng = random.Random(1)
    texts = [t or "" for t in odd_texts] + [noise(rng) for _ in range(1500)]
    for keep in (10, 100_000):  # the first forgets chunks all the time
        e = chunks.ChunkEncoder(tokens.LibraryEncoder(tokens.default_vocabulary()), keep=keep)
        for a, b in chunks.blocks(texts, 3000):
            flat, counts = e.encode_all(texts[a:b])
            parts = np.split(flat, np.cumsum(counts)[:-1])
            assert [p.tolist() for p in parts] == [library(t) for t in texts[a:b]]


def test_merges_against_the_library(spark, docs, empty, odd_texts):
    b = bpe.Bpe(bpe.default_ranks(), bpe.default_pattern())
    want = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for t in odd_texts] + [noise(rng) for _ in range(500)] + ["ab" * 400, "".join(rng.choice("abcdef") for _ in range(900))]
    e = chunks.ChunkEncoder(b)
    flat, counts = e.encode_all(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == want.encode_ordinary(text)
        assert b.decode(ids).tobytes() == text.encode()
    by_id = {1000 - 7 * i: t or "" for i, t in enumerate(odd_texts)}
    got = bpe.digests(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            ids = want.encode_ordinary(by_id[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == sha256(by_id[r.doc_id].encode()).hexdigest()
    assert bpe.digests(empty).count() == 0
    back = {r.doc_id: r["bytes"] for r in bpe.decode(bpe.encode(docs)).collect() if r.doc_id is not None}
    assert back == {k: bytearray(v.encode()) for k, v in by_id.items()}


def test_files_and_keys(spark, docs, empty, odd_texts, library):
    path = fresh_path(spark, "tokens")
    manifest = token_files.write(docs, path, shards=4)
    got = sorted(token_files.read(manifest, path).collect(), key=lambda r: r.start)
    by_id = {1000 - 7 * i: t for i, t in enumerate(odd_texts)}
    assert len(got) == docs.count()
    keys = [r.doc_id for r in got]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            ids = [*library(by_id[r.doc_id]), 0]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_files.round_trip(empty).count() == 0
    fs, root = token_files.file_system(path)
    found = 0
    for row in manifest.collect():
        s = token_files.Shard(fs, f"{root}/{token_files.shard_name(row.shard)}")
        for key, text in by_id.items():
            ids = s.get(key)
            if ids is not None:
                found += 1
                assert ids.tolist() == [*library(text), 0]
        assert s.get(123456789) is None
        assert s.get(1000 - 49, 5) is None
    assert found == len(by_id) + (0)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 50000))
    h = token_files.hashed(keys, np.zeros(len(keys), np.int64))
    f, rest = token_files.PerfectHash.build(h)
    assert not len(rest)
    assert sorted(f.slots(h).tolist()) == list(range(len(keys)))
    same, rest = token_files.PerfectHash.build(np.array([5, 5, 9], np.uint64))
    assert rest.tolist() == [0, 1]


@pytest.mark.parametrize("capacity", [8, 64, 1024])
def test_plans_hold_all(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 40, 2000):
        lengths = Counter(min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(n))
        plan = packing.plan(lengths, capacity)
        used = Counter()
        for pattern, k in plan:
            assert sum(pattern) <= capacity
            for x in pattern:
                used[x] += k
        assert used == lengths
        total = sum(x * k for x, k in lengths.items())
        assert sum(k for _, k in plan) <= -(-total // capacity) + (1 + total // capacity // 20)


def test_packing(spark, docs, empty, odd_texts, library):
    got = packing.pack(docs, capacity=256).collect()
    by_id = {1000 - 7 * i: [*library(t), 2] for i, t in enumerate(odd_texts)}
    seen = Counter()
    for r in got:
        if r.doc_id is not None:
            ids = by_id[r.doc_id][r.start : r.start + r.length]
            assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
            assert r.piece == 0 or r.length == 256
            seen[r.doc_id] += r.length
    assert all(seen[k] == len(v) * (2 if k == 1000 - 49 else 1) for k, v in by_id.items())
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty).count() == 0
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    placed = packing.pack(whole, capacity=256)
    full = packing.sequences(whole, placed, capacity=256)
    assert full.count() == placed.select("sequence_id").distinct().count()


def test_white_space_covers_the_pattern_s():
    import pyarrow as pa
    import pyarrow.compute as pc
    import regex

    found = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and regex.match(r"\s", chr(i))]
    assert len(found) > 20 and pc.all(pc.utf8_is_space(pa.array(found))).as_py()


def test_parts_are_the_pattern_s(odd_texts):
    """Chunks of every kind, with and without a letter outside Latin script, short and very long."""
    import pyarrow as pa

    e = tokens.LibraryEncoder(tokens.default_vocabulary())
    rng = random.Random(4)
    chunks = ["", " ", "\n", "a", " a", "\na", "a.", " a!?", "\na,", "\n", " \n", "don't", " don't.", "x1", " 12,", ".", " ...", "a b", "é ", "'s", " 's", "\n\n", "\n'll", "ɏ", "ɐ", "日", "x" * 5000, " " + "y" * 1500 + "!!", "ª", "ǅ.", "á"]
    chunks += ["".join(rng.choice("ab \n.,'1éßÿ") for _ in range(rng.randint(0, 6))) for _ in range(500)]
    near = e.near(pa.array(chunks, pa.string()))
    assert [c for c, n in zip(chunks, near) if not n] == [c for c in chunks if any(x >= "ɐ" for x in c)]
    mine = [c for c, n in zip(chunks, near) if n]
    got, counts = e.parts(pa.array(["skip", *mine], pa.string()).slice(1))
    want = [e.split.findall(c) for c in mine]
    assert counts.tolist() == list(map(len, want)) and got.to_pylist() == [p for w in want for p in w]


def test_a_token_that_merging_does_not_reach(tmp_path):
    """A piece that is such a token is looked up as a whole, as the library does; within a longer piece it isn't found."""
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"de": 257, b"def": 258}
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    mine = bpe.Bpe(str(tmp_path / "r"), r"[a-z]+|.")
    library = tiktoken.Encoding("small", pat_str=r"[a-z]+|.", mergeable_ranks=ranks, special_tokens={})
    assert set(mine.unreached) == {b"abc"}
    texts = ["abc", "abcd", "abc abc def", "", "x", "deabc", "abc!abc"]
    import pyarrow as pa

    ids, counts = mine(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]
    assert not bpe.Bpe(bpe.default_ranks(), bpe.default_pattern()).unreached
