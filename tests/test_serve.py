"""Requests over streams and sockets, and the command line."""

import io
import json
import socket

import pytest

from quillon import formats
from quillon.__main__ import main
from quillon.rpc import Server
from quillon.serve import BUSY, Listener, parse_address, stdio

ASK = json.dumps({"id": 7, "cmd": "def", "args": {"name": "twice"}})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, index = tmp_path_factory.mktemp("source"), str(tmp_path_factory.mktemp("served"))
    (root / "m.py").write_text("def twice(x):\n    return helper(x)\n\n\ndef helper(x):\n    return x + x\n")
    assert main(["--index", index, "index", f"generic={root}"], spark) == 0
    return index


@pytest.fixture
def server(spark, folder):
    from quillon.sources.tree import Index

    return Server(Index(spark, folder))


def asked(connection, line):
    stream = connection.makefile("rw", encoding="utf-8")
    stream.write(line + "\n")
    stream.flush()
    return json.loads(stream.readline())


def test_addresses():
    assert parse_address("unix:/tmp/a:b") == "/tmp/a:b"
    assert parse_address("tcp:[::1]:80") == ("::1", 80)
    for bad in ("", "unix:", "tcp:80", "tcp:host:", "tcp:host:99999", "http:host:80"):
        with pytest.raises(ValueError):
            parse_address(bad)


def test_stdio(server):
    out = io.StringIO()
    stdio(server, io.StringIO(f"\n{ASK}\nnot json\n"), out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["id"] == 7 and [r["name"] for r in first["result"]] == ["twice"]
    assert second["error"]["code"] == -32700


def test_sockets(server, tmp_path):
    path = str(tmp_path / "s.sock")
    for address in ("tcp:127.0.0.1:0", f"unix:{path}"):
        with Listener(server, address) as listener, socket.socket(socket.AF_INET if address[0] == "t" else socket.AF_UNIX) as one:
            one.connect(listener.address)
            assert asked(one, ASK)["result"][0]["line"] == 1
            assert asked(one, "{}")["error"]["code"] == -32601
    assert not (tmp_path / "s.sock").exists()


def test_connections_above_the_limit_are_told(server):
    with Listener(server, "tcp:127.0.0.1:0", max_conns=1) as listener:
        with socket.create_connection(listener.address) as one:
            assert "result" in asked(one, ASK)
            with socket.create_connection(listener.address) as two:
                error = json.loads(two.makefile().readline())["error"]
                assert error["code"] == BUSY and error["data"] == {"max_conns": 1, "retryable": True}
            assert "result" in asked(one, ASK)


def test_commands(spark, folder, capsys, tmp_path):
    def run(*arguments):
        code = main(["--index", folder, *arguments], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert [r["name"] for r in run("def", "twice")[1]] == ["twice"]
    assert [r["name"] for r in run("callers", "helper", "--limit", "5")[1]] == ["helper"]
    assert len(run("grep", "RETURN", "-i")[1]) == 2
    assert run("stats")[1][0]["files"] == 1
    assert run("health") == (0, [{"healthy": True, "wrong": []}])
    assert run("outline", "no/such/file.py")[0] == 1
    assert main(["--index", folder, "def", "twice", "--md"], spark) == 0
    assert "### `twice`" in capsys.readouterr().out
    assert main(["--index", folder, "def", "twize"], spark) == 0
    assert "twice" in capsys.readouterr().err
    log = tmp_path / "log"
    assert main(["--index", folder, "--log", str(log), "def", "twice"], spark) == 0
    entry = json.loads(log.read_text())
    assert (entry["cmd"], entry["hits"], entry["shown"], entry["files_total"]) == ("def", 1, 1, 1)
    capsys.readouterr()
    assert run("modules", "kernel", "/none") == (1, [])  # no kernel tree
    assert run("modules", "cargo", "/none") == (0, [{"modules": 0}])
    version = run("compact")[1][0]["version"]
    assert run("index-diff", version) == (0, [])
    assert run("diff", str(tmp_path), "--since", "HEAD") == (0, [])
    assert run("tombstone", "m.py")[1] == [{"tombstones": 1}]
    assert run("def", "twice")[1] == []
    with pytest.raises(ValueError):
        main(["--index", folder, "refresh", "nosign"], spark)


def test_forms(spark, tmp_path, capsys):
    root, folder = tmp_path / "t", str(tmp_path / "i")
    root.mkdir()
    (root / "m.py").write_text("def twice(x):\n    return helper(x)\n\n\ndef helper(x):\n    return x + x\n")
    assert main(["--index", folder, "index", f"generic={root}"], spark) == 0
    capsys.readouterr()
    ask = lambda *args: (main(["--index", folder, *args], spark), capsys.readouterr().out)[1]
    assert ask("def", "twice", "--format", "text").endswith("m.py:1:5  (fn Python)  twice\n")
    assert ask("def", "twice", "--format", "lines").endswith("/m.py:1\n")
    assert json.loads(ask("def", "twice", "--format", "json"))["name"] == "twice"
    shown = ask("def", "helper", "--md")
    assert "### `helper`  (fn · python)" in shown and "```python\ndef helper(x):\n    return x + x" in shown
    assert "1 more left out by the budget of 40 bytes" in ask("prefix", "tw", "--md", "--budget", "40")
    assert ask("ref", "helper", "--format", "count") == '{"count": 1}\n'
    hit = json.loads(ask("grep", "return helper", "--fqn", "--limit", "1"))
    assert (hit["line"], hit["fqn"]) == (2, "twice")
    assert ask("grep", "return x", "--fqn", "--format", "text").strip().endswith("m.py:6:5:     return x + x  [helper]")
    assert json.loads(ask("grep", "helper", "--format", "count")) == {"hits": 2, "files": 1}
    assert [x.rsplit("/", 1)[1] for x in ask("grep", "helper", "--format", "lines").splitlines()] == ["m.py:2", "m.py:5"]
    outline = [json.loads(x) for x in ask("outline", "m.py", "--snippets", "2").splitlines()]
    assert outline[1]["snippet"] == "def helper(x):\n    return x + x"
    assert json.loads(ask("whereis", "m.py:2:5"))["fqn_live"] == "twice"
    for shell in ("bash", "zsh", "fish"):
        assert "callgraph" in ask("completions", shell)
    assert ".SH GREP" in ask("man")


def test_live_reads_see_the_files_as_they_are(spark, tmp_path, capsys):
    root, index = tmp_path / "t", str(tmp_path / "i")
    root.mkdir()
    (root / "a.py").write_text("def first():\n    pass\n")
    assert main(["--index", index, "index", f"generic={root}", "--no-refs"], spark) == 0
    (root / "a.py").write_text("# moved\ndef first():\n    return later()\n")
    capsys.readouterr()
    ask = lambda *args: (main(["--index", index, *args], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    assert ask("grep", "later") == [] and [r["line"] for r in ask("grep", "later", "--live")] == [3]
    assert ask("tldr", "a.py")[0]["first"] == "# moved"
    (root / "a.py").unlink()
    assert ask("grep", "later", "--live") == [] and ask("tldr", "a.py")[0]["first"] == "def first():"


def test_numbers_for_people():
    assert [formats.human_bytes(n) for n in (0, 1023, 1024, 1536, 5 * 1024**3, 3 * 1024**5)] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "5.0 GB", "3072.0 TB"]
    assert [formats.eta(s) for s in (0, 45, 59.6, 750, 7500, -1, float("inf"))] == ["0s", "45s", "1m00s", "12m30s", "2h05m", "—", "—"]
    assert formats.cut("é" * 150) == "é" * 100 + "…"
