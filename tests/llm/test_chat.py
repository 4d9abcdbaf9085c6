import hashlib
import random

from pyspark.sql import functions as F
from tabwatch.llm import chat as C

MESSAGES = "tree string, node long, parent long, role string, text string, score double"


def test_branches_are_ranked_and_formatted(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "high", 5.0), ("t", 4, 3, "user", "more", 0.0),
            ("t", 5, 2, "user", "tie", 4.0), ("u", 1, 9, "user", "orphan", None), ("v", 1, 2, "user", "cycle", 0.0), ("v", 2, 1, "user", "cycle", 0.0)]
    got = {(r.tree, r["rank"]): (r.leaf, r.formatted) for r in C.format_trees(spark.createDataFrame(rows, MESSAGES), best=2).collect()}
    turn = lambda role, text: f"<|im_start|>{role}<|im_sep|>{text}<|im_end|>\n"
    assert got == {("t", 1): (4, turn("user", "hi") + turn("assistant", "high") + turn("user", "more")),
                   ("t", 2): (5, turn("user", "hi") + turn("assistant", "low") + turn("user", "tie")), ("u", 1): (1, turn("user", "orphan"))}


def test_deep_and_bushy_trees_equal_a_walk(spark):
    rng = random.Random(1)
    rows = [("deep", i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(70)]
    rows += [("bush", i, rng.randrange(i) if i else None, "assistant", f"b{i}", float(rng.randint(0, 3))) for i in range(80)]
    parent = {(t, n): p for t, n, p, *_ in rows}
    score = {(t, n): s for t, n, *_, s in rows}

    def walk(t, n):
        out = []
        while n is not None:
            out.append(n)
            n = parent[(t, n)]
        return out[::-1]

    leaves = {(t, n) for t, n in parent} - {(t, p) for (t, _), p in parent.items()}
    want = {}
    for t in ("deep", "bush"):
        best = sorted((-sum(score[(t, m)] for m in walk(t, n)), n) for u, n in leaves if u == t)
        for k, (_, n) in enumerate(best[:3], 1):
            want[(t, k)] = walk(t, n)
    got = {}
    for r in C.paths(spark.createDataFrame(rows, MESSAGES), best=3).orderBy(F.col("from_leaf").desc()).collect():
        got.setdefault((r.tree, r["rank"]), []).append(r.node)
    assert got == want


def test_round_trip_of_control_strings(spark):
    rng, bits = random.Random(2), ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<", "|", "|>", "<|", "<\\|", "a", "é😀", "\n", "\\\\", ""]
    convs = {c: [(t, rng.choice(["user", "assistant", "<|im_sep|>", "sys\ntem", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) or None) for t in range(rng.randint(1, 6))] for c in range(60)}
    rows = [(c, t, r, x, 1.0, "k") for c, ts in convs.items() for t, r, x in ts]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score double, tree string")
    got = {r.conv_id: r for r in C.digests(C.format_trees(C.conversations_as_trees(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
        assert got[c].turns_sha256 == sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns))


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.digests(C.format_trees(C.conversations_as_trees(spark.createDataFrame([], schema)))).count() == 0
    rows = [(None, 0, "user", "x"), (1, None, "assistant", "y"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, "user", "long " * 20_000)]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in C.digests(C.format_trees(C.conversations_as_trees(spark.createDataFrame(rows, schema)))).collect()}
    assert got == {None: (1, 0), 1: (1, 1), 2: (2, 0), 3: (1, 0)}
