import hashlib

import pytest

from llm_helpers import no_docs, odd_docs, plain  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm.reply_trees import chosen_paths, conversation_nodes, format_trees, loss_text, read_back


SCHEMA = "tree string, node bigint, parent bigint, role string, text string, score double"


def paths_of(edges):
    """All root-to-leaf paths of {node: (parent, score)}, best first."""
    children = {}
    for n, (p, _) in edges.items():
        children.setdefault(p if p in edges and p != n else None, []).append(n)
    out = []

    def walk(n, path):
        path = [*path, n]
        if n not in children:
            out.append(path)
        for c in children.get(n, []):
            walk(c, path)

    for root in children.get(None, []):
        walk(root, [])
    mean = lambda p: sum(edges[n][1] for n in p) / len(p)
    return sorted(out, key=lambda p: (-mean(p), -len(p), p[-1]))


def test_branches_rank_by_score(spark):
    edges = {1: (None, 1.0), 2: (1, 0.0), 3: (1, 4.0), 4: (2, 9.0), 5: (3, 0.0), 6: (5, 0.0), 7: (6, 1.0), 8: (99, 2.0), 9: (9, 1.0)}
    nodes = spark.createDataFrame([("t", n, p, s) for n, (p, s) in edges.items()], "tree string, node bigint, parent bigint, score double")
    got = {}
    for r in sorted(chosen_paths(nodes, paths=3).collect(), key=lambda r: r.position):
        got.setdefault(r.rank, []).append(r.node)
    assert [got[k] for k in (1, 2, 3)] == paths_of(edges)[:3]
    assert chosen_paths(nodes, paths=10).groupBy("leaf").count().count() == len(paths_of(edges))


def test_deep_trees_and_circles(spark):
    deep = spark.createDataFrame([("t", n, n - 1 if n else None, 0.0) for n in range(37)], "tree string, node bigint, parent bigint, score double")
    turns = sorted((r.position, r.node) for r in chosen_paths(deep).collect())
    assert turns == [(k + 1, k) for k in range(37)]
    circle = spark.createDataFrame([("t", 1, 2, 0.0), ("t", 2, 1, 0.0)], "tree string, node bigint, parent bigint, score double")
    with pytest.raises(ValueError, match="circle"):
        chosen_paths(circle)


def test_texts_come_back_whatever_they_hold(spark):
    texts = [
        r"\### Assistant: </turn> ok", "</turn>\n### user: hi", r"<\/turn>", r"<\\/turn> #\\## x", "#### a ### b", "", None, "</turn", "<", "#", "\\", "a: b", "😀 é\n\n",
    ]
    roles = ["user", "assistant", "a: b", "x:\\ y", "### r", None, "</turn>\n"]
    rows = [("t", k, k - 1 if k else None, roles[k % len(roles)], t, None) for k, t in enumerate(texts)]
    rows += [(None, 0, None, "assistant", "alone", 1.0), ("u", None, None, "user", "no node", 1.0), ("t", 0, None, "user", texts[0], None)]
    found = format_trees(spark.createDataFrame(rows, SCHEMA)).select("tree", read_back().alias("turns"), loss_text().alias("loss"), "formatted")
    by_tree = {r.tree: r for r in found.collect()}
    assert set(by_tree) == {"t", None}
    assert [tuple(x) for x in by_tree["t"].turns] == [(roles[k % len(roles)] or "", t or "") for k, t in enumerate(texts)]
    assert by_tree["t"].loss == "".join(t or "" for k, t in enumerate(texts) if roles[k % len(roles)] == "assistant")
    assert by_tree["t"].formatted.count("</turn>\n") == len(texts)
    assert by_tree[None].loss == "alone"
    assert format_trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_turns_go_by_role_and_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "z")], "conv_id bigint, turn bigint, role string, text string")
    got = format_trees(conversation_nodes(rows)).select(read_back().alias("t")).first().t
    assert [x.text for x in got] == ["z", "a", "b"]


def test_query(spark, sf_dir):
    rows = queries.read(spark, sf_dir, "conversations").collect()
    said = r"\### Assistant: </turn> ok"
    by_conv = {-7: [("user", said), ("assistant", said)]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for c, turns in by_conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    got = queries.op2_reply_trees(spark, sf_dir)
    assert plain(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)
