"""Calls over imports in all their forms, on a small tree of files with hand-stated links."""

import pytest

from tracewell.operators import code_scan, imports

TREE = {
    "app/utils.py": "def load(x):\n    return x\n\ndef shared():\n    return 1\n",
    "other/utils.py": "def load(x):\n    return 2\n",
    "app/core/__init__.py": "from .engine import start as begin, stop\nfrom .extra import *\n",
    "app/core/engine.py": "def start():\n    return 1\n\ndef stop():\n    return 2\n",
    "app/core/extra.py": "def bonus():\n    return 1\n\ndef stop():\n    return 3\n",
    "other/engine.py": "def start():\n    return 5\n\ndef stop():\n    return 6\n",
    "app/loop_a.py": "from app.loop_b import ring\n",
    "app/loop_b.py": "from app.loop_a import ring\n",
    "app/one.py": "from app.utils import (\n    load,  # the first (of two)\n    shared as common,\n)\nfrom core import begin, \\\n    stop as halt\n\ndef go():\n    load(1)\n    common()\n    begin()\n    halt()\n    missing()\n",
    "app/two.py": "import app.utils as u\nimport other.utils\nfrom app import core\nfrom . import utils\nfrom .core import *\n\nclass Job:\n    def run(self):\n        u.load(1)\n        other.utils.load(2)\n        core.bonus()\n        utils.shared()\n        bonus()\n        stop()\n",
    "app/three.py": "\"\"\"from app.utils import load\"\"\"\n\ndef go3():\n    load(1)  # from nowhere\n    local()\n    begin_once()\n\ndef local():\n    return start()\n",
    "app/four.py": "from app.loop_a import ring\nfrom deep.tree.app.utils import load as fetch\nfrom nowhere.utils import load as lost\n\ndef go4():\n    ring()\n    fetch()\n    lost()\n    unique_name()\n",
    "lib/five.py": "def unique_name():\n    return 0\n",
}
LINKS = {
    ("one:go", "load", "utils:load", "imported", 1), ("one:go", "common", "utils:shared", "imported", 1), ("one:go", "begin", "engine:start", "imported", 1),
    ("one:go", "halt", None, "ambiguous", 2),
    ("two:Job.run", "u.load", "utils:load", "imported", 1), ("two:Job.run", "other.utils.load", "o-utils:load", "imported", 1),
    ("two:Job.run", "core.bonus", "extra:bonus", "imported", 1), ("two:Job.run", "utils.shared", "utils:shared", "imported", 1),
    ("two:Job.run", "bonus", "extra:bonus", "imported", 1), ("two:Job.run", "stop", None, "ambiguous", 2),
    ("three:go3", "load", None, "ambiguous", 2), ("three:go3", "local", "three:local", "own", 1), ("three:local", "start", None, "ambiguous", 2),
    ("four:go4", "fetch", "utils:load", "imported", 1), ("four:go4", "unique_name", "five:unique_name", "only", 1),
}
SHORT = {p: ("o-" if p.startswith("other") else "") + p.rsplit("/", 1)[-1][:-3] for p in TREE}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(TREE.items())], "file_id long, path string, text string")


def test_every_form_of_import(files):
    names = {str(i): SHORT[p] for i, p in enumerate(TREE)}
    short = lambda node: node and ":".join([names[node.split(":")[0]], node.split(":")[1]])
    got = {(short(r.caller), r.name, short(r.callee), r.how, r.n_candidates) for r in imports.call_links(code_scan.functions(files), files).collect()}
    assert got == LINKS


def test_targets_of_modules(files):
    ids = {p: i for i, p in enumerate(TREE)}
    rows = {(r.file_id, r.alias, r.original): r.target for r in imports.import_targets(files).collect()}
    assert rows[ids["app/two.py"], "u", None] == ids["app/utils.py"] and rows[ids["app/two.py"], "other.utils", None] == ids["other/utils.py"]
    assert rows[ids["app/two.py"], "utils", None] == ids["app/utils.py"] and rows[ids["app/two.py"], "core", None] == ids["app/core/__init__.py"]
    assert rows[ids["app/four.py"], "fetch", "load"] == ids["app/utils.py"]
    assert rows[ids["app/four.py"], "lost", "load"] is None


def test_no_files(files):
    none = files.limit(0)
    assert imports.call_links(code_scan.functions(none), none).count() == 0


def test_common_file_names_do_not_multiply(spark):
    """A thousand files of one name, each imported by its neighbour."""
    rows = [(2 * i, f"pkg{i}/utils.py", "def load():\n    return 1\n") for i in range(300)]
    rows += [(2 * i + 1, f"pkg{i}/main.py", f"from pkg{i}.utils import load\n\ndef main{i}():\n    load()\n") for i in range(300)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {(r.caller, r.callee) for r in imports.call_links(code_scan.functions(files), files).collect()}
    assert got == {(f"{2 * i + 1}:main{i}", f"{2 * i}:load") for i in range(300)}
