"""The trie against a dictionary of prefixes, with stretches cut small so that every kind of merge happens."""

import hashlib
import random
import zlib
from collections import defaultdict

from convqa.llm import conversation_trie as t


def plain(rows):
    stories = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            stories[conv].append(((turn is not None, turn or 0, digest), role, text))
    stories = {c: [x[1:] for x in sorted(v)] for c, v in stories.items()}
    made = {}
    for c, own in stories.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(stories.get(c - c % 100, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha([c for c in m if len(made[c]) == len(k)])) for k, m in nodes.items())


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n_convs int")
    got = t.trie(t.rebuilt(t.told(df)), **options).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == plain(rows)


def corpus(seed, convs, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["yes", "no", "né", ""][:words])))
    rng.shuffle(rows)
    return rows


def test_against_prefixes(spark, monkeypatch):
    monkeypatch.setattr(t, "STEP_ROWS", 7)
    check(spark, corpus(1, 600), group=2)


def test_hot_group(spark, monkeypatch):
    """Most conversations are the same, so they cross batches and partitions; others continue them."""
    monkeypatch.setattr(t, "STEP_ROWS", 16)
    rows = [(c * 100 + k, turn, "user", f"turn {turn}") for c in range(5) for k in range(100) for turn in range(4 + (k % 10 == 0))]
    check(spark, rows + corpus(2, 60), group=2)


def test_long_conversation(spark):
    rows = [(c, turn, "user", f"word {turn}") for c in (100, 101, 250) for turn in range(3000 if c != 250 else 2500)]
    check(spark, rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", "b"), (7, 0, "user", "a"), (8, 0, "user", "a"), (8, 0, "user", "a"), (107, 3, "", ""),
        (3, -1, "user", "x" * 300_000), (5, 1, "user", "only")]
    check(spark, rows)
    # a conversation that loses all its turns is a member of the root
    short = next(c for c in range(1000, 2000) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 1)
    check(spark, [(short, 0, "user", "gone")])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert t.trie(t.rebuilt(t.told(empty))).count() == 0


def test_common():
    a, b = bytes(range(16)), bytes(16)
    assert t.common(a * 200 + b, a * 200 + a) == 200 and t.common(b"", a) == 0 and t.common(a * 3, a * 3) == 3
