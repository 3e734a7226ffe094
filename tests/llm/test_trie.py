import hashlib
import random
import zlib

import duckdb

from parley.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string, owner string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = tuple(own.get(donor, [])[:h] + ts[h:])
    members, ends = {}, {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
        ends.setdefault(ts, []).append(c)
    kids = {k: [] for k in members}
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -(10**9), len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


def found(spark, rows, report=None):
    made = prefixtrie.trie(spark.createDataFrame(rows, SCHEMA), report)
    assert dict(made.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}
    return sorted(tuple(-(10**9) if r[c] is None else r[c] for c in COLUMNS) for r in made.collect())


def test_random_conversations_that_share_turns(spark):
    rng = random.Random(5)
    rows = []
    for c in [*rng.sample(range(600), 260), -7, -107, 100, 200]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn if turn or c % 3 else None, rng.choice(["user", None, "user"]), rng.choice(["a", "b", "", None, "ä😀"]), "x"))
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_a_long_conversation_crosses_ranges_and_a_chain_hangs_on_each_other(spark):
    rows = [(0, t, "user", f"t{t}", "x") for t in range(300)]
    # Each conversation follows the one before it further, so chains hang one on the other.
    for c in range(1, 40):
        rows += [(100 * c, t, "user", f"t{t}" if t < 2 * c else f"c{min(c, t // 2)}-{t}", "x") for t in range(90)]
        rows += [(100 * c + 7, t, "user", f"t{t}" if t < 290 else f"end{c % 2}", "x") for t in range(292)]
    report = {}
    assert found(spark, rows, report) == brute(rows)
    assert len(report["searches"]) <= 10


def test_chains_that_hang_deep_meet_in_few_rounds(spark):
    rows = []
    for c in range(40):
        rows += [(100 * c, t, "user", "".join("ab"[k <= t and k < c] for k in range(t + 1)), "x") for t in range(45)]
    report = {}
    assert found(spark, rows, report) == brute(rows)
    assert len(report["rounds"]) <= 7


def test_many_equal_conversations_end_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE_IDS", 7)
    rows = [(c, t, "user", f"same {t}", "x") for c in range(500) for t in range(2)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x", "o"), (5, None, None, None, "o"), (105, 0, "user", "z" * 100_000, None), (0, 1, "user", "b", "o"), (0, 0, "user", "a", "o"), (3, 0, "user", "a", "o"), (3, 0, "user", "a", "o")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x", "o")]) == []
    turnless = [(c, 0, "user", "t", "o") for c in range(1, 12) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert found(spark, turnless) == brute(turnless)
    assert len(found(spark, turnless)) == 1


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    conversations = duckdb.sql(f"SELECT * FROM '{sf_dir}/conversations.parquet'")  # noqa: F841
    wanted = duckdb.sql(queries.OP11_SQL).to_arrow_table().select(COLUMNS).to_pylist()
    got = queries.op11_prefix_trie(spark, sf_dir).toArrow().select(COLUMNS).to_pylist()
    key = lambda r: (r["conv_id"], r["depth"])
    assert sorted(got, key=key) == sorted(wanted, key=key)
