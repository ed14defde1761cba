"""SimHash classes, mixing, packing: brute force and defined edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from arealis.llm import mixing, packing, simhash
from arealis.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, root string, __size string, salt string, rank string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, None, None, "x", "x", "x", "x", "x")[:10] for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows_of_every_kind():
    rng = random.Random(4)
    base = prose(rng, 300)
    rows = [(i, base if i % 3 else base + " tail", "en", "s1") for i in range(40)]
    rows += [(100 + i, prose(rng, rng.randint(1, 40)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(200, None, None, None), (201, "", "en", "s2"), (202, " \n\t ", None, None), (203, "one", "en", None), (204, "One", "en", "")]
    rows += [(None, base, "en", "s1"), (None, "lonely words without id here", None, "s9"), (205, prose(rng, 60_000), "en", "s3")]
    return rows + rows[:5]


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(ids, fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, x in enumerate(ids):
        r = find(i)
        low[r] = min((v for v in (low.get(r), x) if v is not None), default=None)
    return [low[find(i)] for i in range(len(fps))]


def test_simhash_classes_are_those_of_all_pairs(spark):
    rows = rows_of_every_kind()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, slow_classes([r[0] for r in rows], fps)))
    assert Counter(map(tuple, got)) == want


def test_query_simhash_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_duplicates"](spark, SF).collect()}
    fps = [slow_fingerprint(t) for t in docs.values()]
    want = slow_classes(list(docs), fps)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(docs, fps, want)}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_sliced_comparison_finds_all_pairs_of_a_group(radius):
    rng = np.random.default_rng(radius)
    v = np.unique(np.concatenate([rng.integers(0, 1 << 63, 40, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))]))
    starts = np.array([0, 3, 4, 90])
    got = {(int(a), int(b)) for x, y in simhash.near_pairs(v, starts, radius, lanes=2) for a, b in zip(x, y)}
    ends = [3, 4, 90, len(v)]
    want = {(i, j) for s, e in zip(starts, ends) for i in range(s, e) for j in range(i + 1, e) if int(v[i] ^ v[j]).bit_count() <= radius}
    assert got == want


def test_tiles_lose_no_link(spark):
    rng = random.Random(1)
    near = {0x1234_5678_9ABC_DEF0 ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for _ in range(300)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in near], "fp long")
    for tile in (7, 100_000):
        edges = simhash.links(df, tile=tile)
        from arealis.llm.common import components

        roots = components(edges).collect()
        assert {r.node for r in roots} == {r.fp for r in df.collect()} and len({r.root for r in roots}) == 1


def test_one_of_each_class_stays(spark):
    rows = rows_of_every_kind()
    df = frame(spark, rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    classes = slow_classes([r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows])
    assert kept.count() == len(set(classes))
    assert {r.doc_id for r in kept.collect()} <= set(classes) | {None}


def test_simhash_of_nothing(spark):
    none = frame(spark, [])
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by reallotting until none is above its cap."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = share * sum(sizes) - sum(fixed.values())
        out = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
        over = {i: most * sizes[i] for i in free if out[i] > most * sizes[i]}
        if not over:
            return [fixed.get(i, out.get(i)) for i in range(len(sizes))]
        fixed |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [100, 1, 1, 1000], [7], [5, 0, 3], [1000, 10, 10, 10, 10, 10, 500]])
def test_targets_are_those_of_repeated_reallotment(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "_source string, source_size long")
    got = {r["_source"]: r.target for r in mixing.targets(df).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(filled(sizes))


def test_mix_takes_what_is_wanted(spark):
    rows = rows_of_every_kind()
    df = frame(spark, [(*r, None, None, None, "x")[:10] for r in rows])
    got = mixing.repetitions(df).collect()
    assert len(got) == len(rows) and got[0].__fields__[:10] == df.columns
    df = df.drop("__size")
    out = mixing.repetitions(df).collect()
    by = {}
    for r in out:
        size = len((r.text or "").encode().split())
        assert r["__size"] == size and size * r["__times"] + r["__words"] <= 2 * size
        t = by.setdefault(r.source, [0, r["__target"], r["__source_size"], 0])
        t[0] += size * r["__times"] + r["__words"]
        t[3] += size
    order = sorted(by, key=lambda s: (s is None, s))
    assert [by[s][1] for s in order] == pytest.approx(filled([by[s][3] for s in order]))
    assert all(abs(taken - target) <= 4 and size == total for taken, target, size, total in by.values())
    again = mixing.repetitions(df.repartition(5)).collect()
    key = lambda rs: Counter((r.doc_id, r["__times"], r["__words"], r["__size"]) for r in rs)
    assert key(out) == key(again)
    again = frame(spark, [(*r, None, None, None, "x")[:10] for r in rows])
    mixed = mixing.mixed(again)
    assert mixed.columns == again.columns and {r["__size"] for r in mixed.collect()} == {"x"}
    whole = sum(r["__times"] + (0 < 2 * r["__words"] >= r["__size"]) for r in out)
    assert mixed.count() == whole
    assert mixing.repetitions(frame(spark, []).drop("__size")).count() == 0
    only = mixing.repetitions(frame(spark, [(1, None, None, None), (2, "", None, "a")]).drop("__size")).collect()
    assert [(r["__times"], r["__words"], r["__target"]) for r in only] == [(0, 0, 0.0)] * 2


TEXTS = [
    "It's  a   test,\n\n with\tspaces ", " leading", "trailing ", "a b", "x\n\ny", "don't we'll I'M", "<|endoftext|> in text", "éàü ñandú\xa0non breaking",
    "tab\tand\rreturn", "emoji 🙂🙂 ok", "12 345,678.90", "日本語 テキスト です", " wide　blank", "a\x1cb \x85c", "", " ", "\n", "   ", "end.\nNext line\n",
]


def test_encoder_gives_the_tokenizer_s_ids():
    encoder = packing.Encoder(packing.tokenizer_path())
    tok = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(2)
    alphabet = "ab 'st.,\n\t\r!0é\xa0  日🙂_-"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip(texts * 2, want * 2):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids, repr(t)
    together = encoder.encode_all([None, *texts, "x"])
    assert [np.frombuffer(x, "<u4").tolist() for x in together] == [[], *want, tok.encode("x").ids]


def test_encoder_forgets_within_its_bound(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 3_000)
    encoder = packing.Encoder(packing.tokenizer_path())
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for k in range(40):
        text = f"word{k} of text {k * k} x-{k}"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tok.encode(text).ids
        assert 2 * encoder.held <= 3_000 + 800 and len(encoder.older) < 20


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for sequence in (16, 100):
        counts = {n: rng.randint(1, 90) for n in rng.sample(range(1, sequence + 1), sequence // 2)}
        slots = packing.plan(counts, sequence)
        used = Counter()
        ranks = Counter()
        for length, rank, n, first, offset in slots:
            assert rank == ranks[length]
            ranks[length] += n
            for s in range(first, first + n):
                assert used[s] == offset
                used[s] += length
        assert ranks == counts and max(used.values()) <= sequence
        rooms = []  # best fit, document by document, longest first
        for n in sorted(Counter(counts).elements(), reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else sequence) - n)
        assert len(used) == len(rooms)


def test_packing_of_every_kind_of_document(spark):
    rows = rows_of_every_kind() + [(300 + i, t, None, None) for i, t in enumerate(TEXTS)]
    out = packing.packed(frame(spark, rows), with_ids=True, ranked=9).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        start = 0
        for i, end in enumerate(range(first, len(ids) + 1, 1024)):
            part = np.array(ids[start:end], "<u4").tobytes()
            want[(r[0], i, start, end - start, zlib.crc32(part), part)] += 1
            start = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == want
    places = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 1024
    assert packing.packed(frame(spark, [])).count() == 0
