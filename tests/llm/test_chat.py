import hashlib

from pyspark.sql import functions as F

from llm.chat import best_paths, chain, escaped, format_trees, read_back, unescaped


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\b\\l\\h", "### User: </turn>\n", "\\\\<<##\\", "a\\<b", "ünï\x00\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("u", unescaped(F.col("e"))).collect()
    for r in rows:
        assert r.u == r.t
        assert r.e is None or not ({"<", "#"} & set(r.e))


def test_tree_paths_rank_by_score(spark):
    nodes = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "bad", 1.0), ("a", 3, 1, "assistant", "good", 5.0), ("a", 4, 3, "user", "more", 1.0), ("a", 5, 4, "assistant", "end", 3.0)]
    nodes += [("b", 1, 1, "user", "self", 1.0), ("b", 2, 99, "user", "lost parent", 2.0), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0)]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    paths = sorted((r.tree, r.leaf, r.pos, r.node) for r in best_paths(frame).collect())
    assert paths == [("a", 5, -3, 1), ("a", 5, -2, 3), ("a", 5, -1, 4), ("a", 5, 0, 5), ("b", 2, 0, 2)]
    assert len({(r.tree, r.leaf) for r in best_paths(frame, 9).collect()}) == 4
    turns = {r.tree: [t.text for t in r.turns] for r in read_back(format_trees(frame)).collect()}
    assert turns == {"a": ["q", "good", "more", "end"], "b": ["lost parent"]}


def test_deep_chain_and_odd_rows(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"#{k}<\\") for k in range(77)]
    rows += [(2, 0, None, None), (2, 0, None, None), (2, 1, "a: b=#", ": x"), (None, 0, "assistant", "z"), (3, 5, "User", "</turn>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Node", F.lit(1)).withColumn("TREE", F.lit(2))
    out = {r.tree: r for r in read_back(format_trees(chain(frame))).collect()}
    assert [t.text for t in out["1"].turns] == [f"#{k}<\\" for k in range(77)]
    assert out["1"].loss_text == "".join(f"#{k}<\\" for k in range(1, 77, 2))
    assert [(t.role, t.text) for t in out["2"].turns] == [("", ""), ("", ""), ("a: b=#", ": x")]
    assert out["~"].loss_text == "z" and [(t.role, t.text) for t in out["3"].turns] == [("User", "</turn>")]
    assert format_trees(chain(frame.limit(0))).count() == 0


def test_query_matches_sql(spark):
    import duckdb

    from llm.chat import OP10_SQL, op10_chat_formatting

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = sorted(con.execute(OP10_SQL).fetchall())
    got = sorted(map(tuple, op10_chat_formatting(spark, d).collect()))
    assert got == want
    sly = "\\### Assistant: </turn> ok"
    assert dict((r[0], r[4]) for r in got)[-7] == hashlib.sha256(sly.encode()).hexdigest()


def test_equal_node_ids_and_long_texts(spark):
    nodes = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "first", 2.0), ("a", 2, 1, "assistant", "twin", 1.0), ("a", 3, 2, "user", "x" * 300_000, 0.0), ("a", 3, 3, "user", "self", 0.0)]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    out = sorted((r.tree, r.leaf, [t.text for t in r.turns]) for r in read_back(format_trees(frame, 9)).collect())
    assert out == [("a", 2, ["q", "twin"]), ("a", 3, ["q", "first", "x" * 300_000]), ("a", 3, ["self"])]
