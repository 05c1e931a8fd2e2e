import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from frostline.llm import prefix_trie as P

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(sequences):
    """Nodes of the trie of {conv: [(role, text), ...]}, each subtree summed on its own."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(sequences.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    words = lambda node: len(node[-1][1].encode().split()) if node else 0
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(children[n]),
                   sum(not children[u] for u in below[n]), sum((len(members[u]) - 1) * words(u) for u in below[n]),
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(s)] for c, s in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    return out


def answer(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def test_names_of_prefixes_depend_on_the_prefix_alone():
    r = np.random.default_rng(1)
    turns = r.integers(0, 3, (40, 16, 2)).astype(np.uint64)
    names = P.prefix_names(turns, np.zeros((40, 2), dtype=np.uint64))
    seen = {}
    for s in range(40):
        for d in range(17):
            prefix = turns[s, :d].tobytes()
            assert seen.setdefault(prefix, names[s, d].tobytes()) == names[s, d].tobytes()
    assert len(set(seen.values())) == len(seen)


def test_query_against_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "CHUNK", 4)
    monkeypatch.setattr(P, "END_BITS", 3)
    r = random.Random(4)
    rows = []
    for conv in [*range(0, 60), 105, 400]:
        for turn in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((conv, turn, r.choice(["user", "tool"]), r.choice(["a b", "a  b\tc", "", "é x"])))
    rows += [(conv, t, "user", f"same {t}") for conv in range(500, 520) for t in range(6)]
    rows += [(7, None, None, None), (21, None, "user", None), (21, 50, None, "tail"), (None, 1, "user", "nobody's")]
    rows += [(61, t, "user", f"word {t % 3}") for t in range(150)] + [(62, t, "user", f"word {t % 3}") for t in range(100)]
    rows += [(63, 1, "user", "again")] * 3 + [(64, 2, "user", "x " * 60000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as name", "2 as depth", "3 as conv").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert answer(P.op13_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(rows))


def test_conversations_as_they_are_and_hot_parents(spark, monkeypatch):
    monkeypatch.setattr(P, "LIGHT_CHILDREN", 5)
    rows = [(c, 0, "user", "hello") for c in range(80)] + [(c, 1, "bot", f"answer {c // 2}") for c in range(80)] + [(c, 2, "user", "so") for c in range(0, 80, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = defaultdict(list)
    for c, _, role, text in sorted(rows):
        want[c].append((role, text))
    assert answer(P.prefix_trie(*P.as_sequences(P.turn_table(df)))) == brute(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.prefix_trie(*P.rebuild(P.turn_table(df))).count() == 0
