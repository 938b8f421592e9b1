"""The service's contract and the command line."""

import json

import pytest

from lumenfold import cli
from lumenfold.service import Refused, Service
from lumenfold.streaming.limiter import RateLimiter

ROWS = [(0, "1:1", "Seek help through patience and prayer", "", "on patience"), (1, "1:2", "With hardship comes ease", "", ""), (2, "1:3", "The story of Musa", "", "x"), (3, "1:1", "Seek help through patience and prayer again", "", "y")]


@pytest.fixture(scope="module")
def service(spark):
    rows = spark.createDataFrame(ROWS, "row_idx long, ref string, text string, arabic string, commentary string").coalesce(1)
    vectors = spark.createDataFrame([(i, r[1], [1.0, float(i)]) for i, r in enumerate(ROWS)], "row_idx long, ref string, embedding array<float>")
    return Service("the Book", rows, vectors, lambda q: [0.0, 0.0], lambda s, u, max_tokens: u, limits={"ask": RateLimiter(6, 300), "explain": RateLimiter(1, 300)})


def test_ask(service):
    got = service.ask("paitence", client="a")
    assert got["found"] and got["searched"] == "patience" and got["results"][0]["ref"] == "1:1" and got["results"][0]["has_commentary"]
    assert not service.ask("paitence", exact=True, client="a")["found"]
    assert [r["ref"] for r in service.ask("moses", mode="all", client="a")["results"]] == ["1:3"]
    assert service.ask("zzzz", mode="strange", client="a")["found"] is False
    for bad in (("", 5), ("x" * 2001, 5), ("x", 0), ("x", 101)):
        with pytest.raises(Refused) as e:
            service.ask(*bad)
        assert e.value.status == 422


def test_limits_and_explaining(service):
    with pytest.raises(Refused) as e:
        service.explain("9:9")
    assert e.value.status == 404
    assert "x" in service.explain("1:3", "why", client="b")["explanation"]
    with pytest.raises(Refused) as e:
        service.explain("1:3", client="b")
    assert e.value.status == 429 and e.value.retry_after >= 1
    service.complete = None
    with pytest.raises(Refused) as e:
        service.explain("1:3", client="c")
    assert e.value.status == 503
    for error, status in ((TimeoutError(), 504), (OSError(), 502)):

        def fail(*a, error=error, **k):
            raise error

        service.complete = fail
        with pytest.raises(Refused) as e:
            service.explain("1:3", client=str(status))
        assert e.value.status == status


def test_facts(service):
    assert service.info()["semantic_available"] and service.ready()["passages"] == 4 and service.healthy()["status"] == "ok"
    assert service.commentary_of("1:2")["commentary"] == "" and service.commentary_of("1:1")["text"].endswith("again")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "create_session", lambda **k: spark)
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps({"ref": r[1], "text": r[2]}) for r in ROWS[:3]))
    assert cli.main(["patience", "--data", f"file://{path}"]) == 0
    assert "Sources: [1:1]" in capsys.readouterr().out
    assert cli.main(["patience", "--data", f"file://{path}", "--all"]) == 0
    assert "1 passages" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["x", "--data", "y", "--all", "--compose"])


def test_clients_shape_requests_and_put_replies_in_order():
    from lumenfold.sources import clients

    sent = []

    def post(url, headers, body, seconds):
        sent.append((url, headers, body, seconds))
        if "input" in body:
            return {"data": [{"index": i, "embedding": [i, len(t)]} for i, t in reversed(list(enumerate(body["input"])))]}
        return {"choices": [{"message": {"content": " yes "}}]} if body["messages"][0]["role"] == "system" else {"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}]}

    at = clients.Endpoint(post, "https://service/x", "m", {"key": "k"})
    assert clients.ChatCompletion(at)("be brief", "why") == "yes" and sent[-1][2]["messages"][1] == {"role": "user", "content": "why"} and sent[-1][3] == 60.0
    assert clients.BlockCompletion(at)("s", "p", max_tokens=1200) == "ab" and sent[-1][2]["system"] == "s" and sent[-1][2]["max_tokens"] == 1200
    assert clients.Embeddings(at)(["x", "yy", "zzz"]) == [[0.0, 1.0], [1.0, 2.0], [2.0, 3.0]]
    assert clients.Embeddings(at, "query").one("abcd") == [0.0, 4.0] and sent[-1][2]["input_type"] == "query" and sent[-1][3] == 30.0 and sent[-1][:2] == ("https://service/x", {"key": "k"})
    for bad in ({}, {"choices": []}, {"data": [{"index": 1, "embedding": [1]}]}):
        broken = clients.Endpoint(lambda *_, bad=bad: bad, "u", "m")
        with pytest.raises(clients.BadReply):
            clients.ChatCompletion(broken)("s", "p")
        with pytest.raises(clients.BadReply):
            clients.Embeddings(broken)(["x"])


def test_html_pages_and_stop_word_files(spark, tmp_path):
    from lumenfold.functions.text import stop_words_from
    from lumenfold.sources.passages import html_texts, read_documents

    (tmp_path / "a.html").write_text("<html><head><style>p{}</style><script>x<1</script></head><body><h1>One &amp; two</h1><p>a\n b<br>c</p></body>")
    assert html_texts((tmp_path / "a.html").read_bytes()) == ["One & two\na b\nc"]
    assert read_documents(spark, f"file://{tmp_path}/a.html", html_texts).first()["text"] == "One & two\na b\nc"
    (tmp_path / "stop.txt").write_text("The a\nOF the\n")
    assert stop_words_from(str(tmp_path / "stop.txt")) == ["a", "of", "the"]
