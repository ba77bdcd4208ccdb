import hashlib
import random

from tidemark.llm.chat_tree import op1_chat_tree, prefix_tree, read_back, unescape


def slow(rows):
    """{conv_id: digest} from the rows as they are"""
    of = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        of.setdefault(c, []).append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in of.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, idx int, start int")
    nodes, paths = prefix_tree(df)
    got = read_back(nodes, paths).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == slow(rows)
    # the sequence: gapless, every shared start once, a parent before its children, positions and ancestors from the path
    tree = sorted(nodes.collect())
    end = 0
    for r in tree:
        assert r.start == end and r.n == len(r.segment)
        end += r.n
    by_start = {r.start: r for r in tree}
    seen = {}
    of = {}
    for p in sorted(paths.collect(), key=lambda p: (str(p.conv_id), p.idx)):
        of.setdefault(p.conv_id, []).append(p.start)
    for starts in of.values():
        text, above = "", set()
        for s in starts:
            r = by_start[s]
            assert r.pos == len(text) and {i for a in r.ancestors for i in range(a.start, a.end)} == above
            assert all(a.end < b.start for a, b in zip(r.ancestors, r.ancestors[1:], strict=False))
            text += r.segment
            above |= set(range(s, s + r.n))
            assert seen.setdefault(text, s) == s
        assert starts == sorted(starts)
    assert len(seen) == len(tree)
    # depth first: a node's subtree is one stretch
    for s in by_start:
        below = sorted(x for starts in of.values() if s in starts for x in starts if x >= s)
        order = sorted(by_start)
        assert sorted(set(below)) == order[order.index(s) : order.index(s) + len(set(below))]
    for r in got:
        assert r.formatted_chars == sum(by_start[s].n for s in of[r.conv_id])


def test_random(spark):
    pick = random.Random(1)
    rows = []
    for c in range(60):
        for t in range(pick.randrange(1, 6)):
            rows.append((c, t, pick.choice(["user", "assistant"]), pick.choice(["a", "b"])))
    check(spark, rows)


def test_edges(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\", "\\\\", "<\\/turn>", "#\\## ", "####### ", None, "", "é\n" * 50_000, "<</turn>/turn>", ": "]
    rows = [(k, t, r, x) for k, x in enumerate(odd) for t, r in enumerate(["user", "assistant", "a: b\\", None, "### ", "</turn>", "Assistant:"])]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (50, 1, "user", "x"), (50, 1, "user", "x"), (50, 1, "assistant", "x"), (51, 0, "user", "x"), (52, 0, "user", "x")]
    check(spark, rows)
    assert unescape("a\\\\\\#") == "a\\#"


def test_empty(spark):
    nodes, paths = prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert read_back(nodes, paths).collect() == [] and nodes.collect() == []


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(["user", "assistant"])]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op1_chat_tree(spark, sf).collect()} == slow(rows)


def test_ties_follow_role_and_text(spark):
    """In formatted form "Yes</turn>" comes after "Yes please</turn>"; as texts they are the other way round."""
    rows = [(1, 0, "user", x) for x in ("Yes please", "Yes", "Yes", "A<", "A", "A\\", "A ")] + [(1, 0, "user b", "x"), (1, 0, "user", "### "), (2, 3, "assistant", "b"), (2, 3, "assistant", "a")]
    check(spark, rows)


def test_a_turn_that_all_share(spark, monkeypatch):
    import tidemark.llm.chat_tree as C

    monkeypatch.setattr(C, "SHARED_ROWS", 7)
    check(spark, [(c, t, "user", "hello" if t < 2 else f"own {c % 40}") for c in range(100) for t in range(3)])
