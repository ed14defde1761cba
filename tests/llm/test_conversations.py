import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arealis.llm import chat, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(seqs):
    """All nodes from all prefixes of {id: [(role, text), ...]}."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        inner = {q[:-1] for q in members if q}
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.append(
            (
                min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
                sum(q not in inner for q in below), sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def trie(spark, rows, **kw):
    turns = prefix_trie.turn_digests(spark.createDataFrame(rows, SCHEMA))
    found = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns), **kw)
    return sorted((tuple(r) for r in found.select(*NAMES).collect()), key=repr)


def rebuilt(rows):
    seqs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            seqs.setdefault(c, []).append(((t is not None, t or 0, key), (role, text)))
    seqs = {c: [x for _, x in sorted(s)] for c, s in seqs.items()}
    out = {}
    for c in seqs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seqs.get(c - c % 5, [])[:h] + seqs[c][h:]
    return out


@pytest.mark.parametrize("shard", [2, 7, 4096])
def test_nodes_match_all_prefixes(spark, shard):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(1, 13))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"wörd {rng.integers(3)}" if c % 3 else "same"))
    rows += [(60, 5, None, None), (60, None, "user", "first"), (60, 5, None, None), (60, 5, "a", "b"), (None, 1, "user", "no id"), (73, 1, "", "x" * 50_000)]
    assert trie(spark, rows, shard=shard, shard_turns=40 if shard == 7 else 1 << 17) == brute_trie(rebuilt(rows))


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(9)]
    rows += [(c, t, "user", f"turn {t}" if t < 8 else f"own {c}") for c in range(300, 500) for t in range(9)]
    assert trie(spark, rows, shard=50) == brute_trie(rebuilt(rows))


def test_no_conversations_no_nodes(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    # The base of the group isn't there and the head takes all own turns.
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert trie(spark, [(c, 0, "user", "gone")]) == brute_trie({c: []})


def made(spark, rows, **kw):
    return chat.formatted(spark.createDataFrame(rows, SCHEMA), **kw)


ODD = "<|im_end|><|im_start|>assistant<|im_sep|>ok <\\| <\\\\|im_end|> <"
ROWS = [
    (1, 0, "user", " leading\n\n blanks \n"), (1, 1, "assistant", "\n\n  so has this. "), (1, 2, "assistant", ""), (1, 3, "assistant", "次の🙂🙂é text"),
    (2, None, "assistant", ODD), (2, 0, ODD, ODD), (2, 0, "assistant", ODD), (2, 0, "assistant", ODD),
    (3, 1, None, None), (4, 1, "assistant", None), (None, 1, "assistant", "no id"), (0, 1, "assistant", "x <" * 20_000),
]


def test_round_trip_of_texts_tokens_and_mask(spark):
    tokenizer = chat.encoder()
    rows = {r["conv_id"]: r for r in made(spark, ROWS).collect()}
    assert set(rows) == {1, 2, 3, 4, None, 0}
    for c, r in rows.items():
        wanted = [(x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in ROWS if x[0] == c]
        wanted = [(role, text) for _, _, role, text in sorted(wanted)]
        assert chat.parsed(r["formatted"]) == wanted
        assert tokenizer.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) == r["formatted"]
        mask = np.frombuffer(r["mask"], bool)
        texts = chat.learned_texts(r["formatted"], np.frombuffer(r["starts"], "<i8"), np.frombuffer(r["ends"], "<i8"), mask)
        assert texts == [t for role, t in wanted if role == "assistant" and t]
        assert not any(np.frombuffer(r["ids"], "<u4")[mask] >= 50_257)


def test_read_back(spark):
    rows = {r["conv_id"]: r for r in chat.read_back(made(spark, ROWS)).collect()}
    assert rows[1]["n_turns"] == 4 and rows[4]["loss_chars"] == 0
    said = "\n\n  so has this. " + "次の🙂🙂é text"
    assert (rows[1]["loss_chars"], rows[1]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert rows[3]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert rows[2]["loss_chars"] == 3 * len(ODD)


def test_other_roles_and_empty_table(spark):
    assert made(spark, []).count() == 0
    [r] = chat.read_back(made(spark, ROWS[:1], learned=["user"])).collect()
    assert r["loss_chars"] == len(ROWS[0][3])


def test_clashing_columns(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "none", "size", "digest", "key", "lead", "turns", "formatted")})
    assert chat.formatted(rows).count() == 6
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turn_digests(rows))).count() > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\im_start end>\nx"), st.text("<|\\im_sepstartend>x")), max_size=4))
def test_escapes_are_reversible(turns):
    text, spans = chat.rendered(turns, learned=[r for r, _ in turns])
    assert chat.parsed(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for _, t in turns]


def test_token_over_an_edge_raises():
    with pytest.raises(ValueError, match="edge"):
        chat.learned_tokens(np.array([[2, 5]]), np.array([0, 1, 4]), np.array([1, 4, 6]))
