from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import pysource
from tessella.functions.vectors import fake_embedding
from tessella.operators.store import ChunkStore
from tessella.plans import agent, clients
from tessella.sources import files, reports
from tessella.streaming import watch


def test_scan_keeps_hidden_files_and_skips_folders(spark, tmp_path):
    for p in ("a.py", "pkg/__init__.py", "pkg/.h.py", ".git/x.py", "vendor/v.py", "node_modules/n.py", "b.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert sorted(r.path for r in files.scan_sources(spark, str(tmp_path)).collect()) == ["a.py", "pkg/.h.py", "pkg/__init__.py"]


def test_tasks(spark, tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text("target_repo: r\ntarget_sha: abc\ntasks:\n- {id: a, query: q, bucket: localization, gold: [{path: x.py, start: 1, end: 2}], source: s}\n- {id: a, query: '', bucket: odd, gold: []}\n")
    head, tasks = files.load_tasks(spark, str(path))
    assert head["target_sha"] == "abc" and tasks.count() == 2
    assert {(r.id, r.rule) for r in files.task_violations(tasks, "abc").collect()} == {("a", "repeated id"), ("a", "empty query"), ("a", "unknown bucket"), ("a", "no gold")}
    assert files.task_violations(tasks.limit(1), "").where("rule = 'no target sha'").count() == 1


def test_records(spark, tmp_path):
    root = str(tmp_path / "runs")
    files.write_records(spark.createDataFrame([("a", 1, {"system": 3}, 3), ("b", 2, {"output": 4}, 4)], files.RECORD), root)
    assert [r.total for r in files.read_records(spark, root, 1).collect()] == [3]
    files.write_records(spark.createDataFrame([("a", 1, {"system": 5}, 5), ("c", 1, {}, 0)], files.RECORD), root)  # a rerun replaces its own record
    assert sorted((r.task_id, r.stage, r.total) for r in files.read_records(spark, root).collect()) == [("a", 1, 5), ("b", 2, 4), ("c", 1, 0)]
    (tmp_path / "runs" / "_stage=1" / "broken.json").write_text("{not json\n")
    assert len(files.read_records(spark, root, strict=False).collect()) == 3
    with pytest.raises(Exception):
        files.read_records(spark, root, strict=True).collect()


def test_trajectories(spark, tmp_path):
    good = {"task_id": "t", "arm": "base", "messages": [{"Role": "user", "Content": "q", "ToolCalls": [{"ID": "1", "Name": "search_code", "Args": "{}"}]}]}
    (tmp_path / "in").mkdir()
    for name, content in (("a.json", json.dumps(good)), ("b.json", json.dumps(good | {"messages": []})), ("in/c.json", json.dumps(good | {"task_id": "u"})), ("d.json", "{broken"), ("e.txt", "x")):
        (tmp_path / name).write_text(content)
    got = files.read_trajectories(spark, str(tmp_path))
    assert sorted(r.task_id for r in got.collect()) == ["t", "u"] and got.first().messages[0].ToolCalls[0].Name == "search_code"


def test_paged(spark):
    rows = [{"row": {"k": i}} for i in range(5)]
    got = files.paged_source(spark, lambda at, n: {"rows": rows[at : at + n], "num_rows_total": 5}, "k long", 2)
    assert sorted(r.k for r in got.collect()) == [0, 1, 2, 3, 4] and got.rdd.getNumPartitions() == 3
    untold = files.paged_source(spark, lambda at, n: {"rows": rows[at : at + n]}, "k long", 2)
    assert sorted(r.k for r in untold.collect()) == [0, 1, 2, 3, 4]


def test_watch_a_tree(spark, tmp_path):
    root, store = tmp_path / "repo", ChunkStore(spark, str(tmp_path / "store"))
    (root / "pkg").mkdir(parents=True), (root / ".git").mkdir()
    (root / "pkg" / "a.py").write_text("def f():\n    return 1\n")
    (root / ".git" / "x.py").write_text("def hidden():\n    pass\n")
    (root / "b.txt").write_text("no source")
    reader = watch.TreeReader(str(root), ".py")
    rows, end = reader.read(reader.initialOffset())
    assert [r[:2] for r in rows] == [("pkg/a.py", "create")] and end == {"scan": 1}
    assert [r[:2] for r in reader.readBetweenOffsets({"scan": 0}, end)] == [("pkg/a.py", "create")]
    (root / "pkg" / "a.py").write_text("def f():\n    return 22\n")
    (root / "new").mkdir()
    (root / "new" / "c.py").write_text("def g():\n    pass\n")
    assert sorted(r[:2] for r in reader.read(end)[0]) == [("new/c.py", "create"), ("pkg/a.py", "write")]
    (root / "new" / "c.py").unlink()
    assert [r[:2] for r in reader.read({"scan": 2})[0]] == [("new/c.py", "remove")] and not list(reader.read({"scan": 3})[0])
    embed = lambda rows: rows.withColumn("vec", fake_embedding(F.col("content"), 4))
    read = lambda paths: files.scan_sources(spark, str(root)).join(paths, "path", "left_semi")
    q = watch.keep_current(watch.changes(watch.watch_tree(spark, str(root))), store, read, pysource.python_chunks, embed, str(tmp_path / "cp"), processingTime="1 second")
    try:
        until(lambda: [r.content for r in store.read().collect()] == ["def f():\n    return 22"])
        (root / "pkg" / "a.py").unlink()
        (root / "d.py").write_text("class D:\n    x = 1\n")
        until(lambda: [(r.path, r.kind) for r in store.read().collect()] == [("d.py", "class_header")])
    finally:
        q.stop()


def until(done, seconds=90):
    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.5)


def test_reports(spark):
    rows = spark.createDataFrame([("b", "localization", 1, 1.0, 10), ("a", "enumeration", 2, None, 20)], "id string, bucket string, gold_size int, recall double, retrieved_tokens int")
    text = reports.retrieval_report(rows, spark.createDataFrame([(0.5, 15.0)], "recall_at_k double, mean_tokens double"))
    assert text.index("| b |") < text.index("| a |") and "—" in text and "0.500" in text and reports.cell(True) == "✓"


def test_debounce_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "ts timestamp, path string, op string"
    (src / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:00:{s:02d}", "path": p, "op": "write"}) for s, p in ((0, "a"), (1, "b"), (1, "a"), (30, "c"))))
    (src / "2.json").write_text(json.dumps({"ts": "2024-01-02T00:00:00", "path": "z", "op": "chmod"}) + "\n" + json.dumps({"ts": "2024-01-02T00:00:00", "path": "z", "op": "write"}))
    stream = watch.debounce_stream(watch.changes(watch.watch_events(spark, str(src), schema).repartition(1), match=F.col("path") != "q"), "5 seconds", "1 minute")
    q = stream.writeStream.outputMode("append").format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.events, tuple(r.paths)) for r in spark.table("debounced").collect()}
    assert {(3, ("a", "b")), (1, ("c",))} <= got
    batch = watch.debounce(watch.changes(spark.read.schema(schema).json(str(src))), 5000)
    assert {(r.events, tuple(r.paths)) for r in batch.collect()} == {(3, ("a", "b")), (1, ("c",)), (1, ("z",))}


def test_store_follows_changes(spark, tmp_path):
    src, root = tmp_path / "feed", tmp_path / "repo"
    src.mkdir(), root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    store = ChunkStore(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([("gone.py", 1, 1, "function", "def g")], "path string, start_line int, end_line int, kind string, content string")
    embed = lambda rows: rows.withColumn("vec", fake_embedding(F.col("content"), 4))
    store.upsert(old, embed)
    (src / "1.json").write_text('{"path": "a.py"}\n{"path": "gone.py"}\n{"path": "x.txt"}')
    feed = spark.readStream.schema("path string").json(str(src))
    read = lambda paths: files.scan_sources(spark, str(root)).join(paths, "path", "left_semi")
    watch.keep_current(feed, store, read, lambda f: pysource.python_chunks(f), embed, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.path, r.kind) for r in store.read().collect()] == [("a.py", "function")]


def test_agent_loop():
    call = agent.Call
    model = agent.ScriptedModel([
        agent.Message("assistant", "look", [call("search_code", '{"query": "bug"}'), call("read_file", '{"path": "a.py", "start_line": 2}'), call("nope")]),
        agent.Message("assistant", "", [call("submit_answer", "{}")]),
        agent.Message("assistant", "", [call("read_file", '{"path": "../x"}'), call("commentary", '{"locations": [{"path": "a.py", "start": 1, "end": 2}]}')]),
    ])
    tools = [agent.SearchCode(lambda q: "a.py:1-2\nbody" if q == "bug" else ""), agent.ReadFile({"a.py": "x\ny\nz"}.get)]
    out, messages, ledger = agent.run("where", model, tools, system="be brief", budget=5, summarize=lambda t: t.split("\n")[0])
    assert out.answered and out.stop_reason == "submitted" and out.turns == 3 and out.locations == [("a.py", 1, 2)]
    assert any(m.content == "a.py:2-3\n2: y\n3: z" for m in messages) or out.summarized
    assert any("unknown tool" in m.content or m.content.startswith("[earlier") for m in messages) and out.summarized + out.dropped > 0
    buckets, _ = agent.ledger_totals(ledger, overhead=7)
    assert buckets["compression"] == 7 and buckets["retrieved_code"] > 0
    done, *_ = agent.run("q", agent.ScriptedModel([]), tools)
    assert done.stop_reason == "no_tool_call" and done.turns == 1
    loop = agent.run("q", agent.ScriptedModel(agent.Message("assistant", "", [call("search_code", "{}")]) for _ in range(20)), tools, max_turns=3)[0]
    assert loop.stop_reason == "max_turns" and loop.turns == 3


def test_clients():
    waits = []
    replies = iter([clients.Reply(429, {}, {"Retry-After": "2"}), clients.Reply(500, {}, {}), clients.Reply(200, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}, {})])
    e = clients.HttpEmbedder(lambda body: next(replies), "m", max_chars=2, pause=waits.append)
    assert e.embed(["héllo", "b"]) == [[1.0], [2.0]] and waits == [2.0, 2.0]
    with pytest.raises(clients.RefusedError):
        clients.retried(lambda: clients.Reply(401, {}, {}), waits.append)
    with pytest.raises(clients.ServiceError):
        clients.retried(lambda: clients.Reply(404, {}, {}), waits.append)
    tries = []
    with pytest.raises(clients.ServiceError):
        clients.retried(lambda: tries.append(1) or clients.Reply(400, {"error": "tool_use_failed"}, {}), waits.append)
    assert len(tries) == 4
    assert clients.wait_of(clients.Reply(429, {}, {"Retry-After": "Thu, 01 Jan 1970 00:00:30 GMT"}), 0, now=0) == 30 and clients.wait_of(None, 9) == 60
    assert [len(b) for b in clients.batches(["x" * 20] * 5, 128, 12)] == [2, 2, 1] and clients.batches(["y" * 99], 1, 1) == [["y" * 99]]
    assert clients.positive_numbers("B", env={"B": "3, -1,x,5"}) == (3, 5) and clients.positive_numbers("B", env={}) == (3000,)
    with pytest.raises(ValueError):
        clients.embedder_from_env(lambda p, k: None, "query", {"EMBED_PROVIDER": "other"})
    e = clients.embedder_from_env(lambda p, k: (p, k), "query", {"EMBED_PROVIDER": "openai", "OPENAI_API_KEY": "k"})
    assert e.post == ("openai", "k") and e.input_type is None and e.max_chars == clients.MAX_CHARS


def test_cuts_count_bytes():
    assert clients.cut("aé" * 3, 5) == "aéa…" and clients.cut("é", 1) == "…" and clients.cut("abc", 3) == "abc"
    long = clients.Reply(404, {"e": "é" * 5000}, {})
    for limit, send in ((200, lambda: clients.HttpEmbedder(lambda b: long, "m").embed(["x"])), (1500, lambda: clients.ChatClient(lambda b: long, "m").summarize("x", "y"))):
        with pytest.raises(clients.ServiceError) as e:
            send()
        kept = str(e.value).removeprefix("status 404: ")
        assert kept.endswith("…") and limit - 2 <= len(kept[:-1].encode()) <= limit
    told = clients.transcript([agent.Message("user", "find"), agent.Message("assistant", "x" * 9000, [agent.Call("search_code", "{}")])])
    assert told == "user: find\nassistant -> search_code {}: " + "x" * 1500 + "…"


def test_chat_and_guideline(tmp_path):
    sent = []
    body = {"choices": [{"message": {"content": None, "tool_calls": [{"id": "7", "function": {"name": "search_code", "arguments": '{"query": "x"}'}}]}}], "usage": {"prompt_tokens": 9, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 4}}}
    chat = clients.ChatClient(lambda b: sent.append(b) or clients.Reply(200, body, {}), "m")
    answer, usage = chat.generate("sys", [agent.Message("user", "q"), agent.Message("tool", "t", call_id="1")], [agent.SearchCode.spec])
    assert answer.calls == [agent.Call("search_code", '{"query": "x"}', "7")] and (usage.prompt, usage.completion, usage.cached) == (9, 2, 4)
    assert [m["role"] for m in sent[0]["messages"]] == ["system", "user", "tool"] and sent[0]["temperature"] == 0 and sent[0]["messages"][2]["tool_call_id"] == "1"
    assert clients.load_guideline() == clients.GUIDELINE
    (tmp_path / "g").write_text(" ")
    with pytest.raises(ValueError):
        clients.load_guideline(str(tmp_path / "g"))
    once = clients.refined("base", [("a", "b"), ("c", "d")], lambda s, f: "keep paths\nmore" if s == "a" else "none")
    assert once == f"base\n\n{clients.RULES_HEADER}\n- keep paths\n" and clients.refined(once, [("a", "b")], lambda s, f: "keep paths") == once
    assert clients.refined(once, [("a", "b")], lambda s, f: "keep names").count(clients.RULES_HEADER) == 1
