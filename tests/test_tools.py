from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwright.functions.stem import stem, stems
from siftwright.sources import logs
from siftwright.tools import Index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {
        "app.py": "from .core import run\n\ndef main():\n    run(1)\n",
        "core.py": "from .util import helper\n\ndef run(x):\n    return helper(x)\n\ndef unused_thing():\n    pass\n",
        "util.py": "from .core import run\n\ndef helper(x):\n    return eval('x')\n",
        "test_core.py": "def test_run():\n    run(2)\n",
    }.items():
        (root / name).write_text(text)
    return root, Index.build(spark, str(root), iterations=5)


def test_index(index):
    root, ix = index
    assert [r.name for r in ix.lookup("run").collect()][:1] == ["run"]
    assert {(r.path, r.kind) for r in ix.impact("run").collect()} >= {("app.py", "DIRECT"), ("test_core.py", "DIRECT")}
    assert {r.id for r in ix.references("helper").collect()} == {"core.py", "util.py"}
    assert {r.path for r in ix.search("helper").collect()} >= {"util.py"}
    assert "unused_thing" in {r.name for r in ix.dead_code().collect()}
    assert ix.security().where("pattern = 'eval_call'").count() == 1
    assert {tuple(r) for r in ix.tests().collect()} == {("core.py", "test_core.py")}
    assert ix.status(str(root)).first().fresh == 4
    assert ix.overview().count() == 4 and ix.god_nodes().count() > 0
    assert {r.change for r in ix.changed(ix.chunks).collect()} == {"same"}


def test_logs(spark, tmp_path):
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat" / "a.jsonl").write_text('{"conv_id": "1", "turn": 0, "role": "user", "text": "hi"}\nbroken\n')
    assert logs.chats(spark, str(tmp_path / "chat")).count() == 1
    (tmp_path / "log").write_text("abc\x1fme\x1f1700000000\x1ffeat: something new\x1e\nbad\x1e")
    assert [(r.sha, r.subject) for r in logs.git_log(spark, str(tmp_path / "log")).collect()] == [("abc", "feat: something new")]
    ev = spark.createDataFrame([("u", "1", "linux", "call", "t", "ok", 5, 1704067200), ("u", "1", "linux", "call", "t", "ok", 5, 1704153600)], logs.EVENT_SCHEMA)
    logs.write_telemetry(ev, str(tmp_path / "t"))
    assert logs.telemetry(spark, str(tmp_path / "t"), first="2024-01-02").count() == 1
    uses = logs.contract_uses(spark.createDataFrame([("web", "gql`query { user { id } }`")], "project string, text string"))
    defs = logs.contracts(spark.createDataFrame([("api", "type Query { user(id: ID): User }")], "project string, text string"))
    assert {r.symbol for r in uses.collect()} & {r.symbol for r in defs.collect()} == {"Query.user"}


def test_stems(spark):
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adoption": "adopt", "controll": "control", "sky": "sky", "été": "été"}
    assert {w: stem(w) for w in want} == want
    got = stems(spark.createDataFrame([(1, ["running", "cats"]), (2, None)], "id long, w array<string>"), "id", "w")
    assert {r.id: list(r.stems) for r in got.collect()} == {1: ["run", "cat"], 2: []}
    assert got.select(F.size("stems")).count() == 2
