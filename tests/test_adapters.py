"""Wire formats of the model adapters, over a real local HTTP server and over a given `send`."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from notespark import adapters, ports
from notespark.operators import search


def lines(*said):
    return lambda url, body, headers: iter([x.encode() for x in said])


def test_vectors_come_back_in_the_order_of_the_texts():
    asked = []

    def send(url, body, headers):
        asked.append((url, len(body["input"]), headers))
        yield json.dumps({"data": [{"index": i, "embedding": [float(t), 0.0]} for i, t in reversed(list(enumerate(body["input"])))]}).encode()

    got = adapters.IndexedEmbedder("http://h/v1/", "m", 2, key="k", batch=2, send=send).embed(["1", "2", "3"])
    assert got == [[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]] and asked == [("http://h/v1/embeddings", n, {"Authorization": "Bearer k"}) for n in (2, 1)]
    assert adapters.IndexedEmbedder("http://h", "m", 2, send=send).embed([]) == []
    with pytest.raises(ValueError, match="dimensions"):
        adapters.IndexedEmbedder("http://h", "m", 3, send=send).embed(["1"])
    for bad in ("{}", "no", "[]", '{"data": []}'):
        with pytest.raises(adapters.ModelError):
            adapters.IndexedEmbedder("http://h", "m", 2, send=lines(bad)).embed(["1"])


def test_plain_vectors_and_the_older_shape():
    assert adapters.PlainEmbedder("h", "m", 1, lines('{"embeddings": [[1.0], [2.0]]}')).embed(["a", "b"]) == [[1.0], [2.0]]
    assert adapters.PlainEmbedder("h", "m", 1, lines('{"embedding": [1.0]}')).embed(["a"]) == [[1.0]] and adapters.PlainEmbedder("h", "m", 1).embed([]) == []
    for bad in ('{"embedding": [1.0]}', "{}", '{"embeddings": [[1.0]]}'):
        with pytest.raises(adapters.ModelError):
            adapters.PlainEmbedder("h", "m", 1, lines(bad)).embed(["a", "b"])


def test_chat_stream_and_usage():
    said = ['data: {"choices": [{"delta": {"content": "Hel"}}]}\n', ": ping\n", "data: {broken\n", "\n", 'data: {"choices": [{"delta": {}}]}\n', 'data: {"choices": [{"delta": {"content": "lo"}}]}\n']
    chat = adapters.StreamedChat("http://h", "m", send=lines(*said, 'data: {"choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}}\n', "data: [DONE]\n", 'data: {"choices": [{"delta": {"content": "late"}}]}\n'))
    assert "".join(chat.stream([{"role": "user", "content": "x"}])) == "Hello" and chat.usage == {"prompt": 3, "completion": 2, "total": 5}
    chat.send = lines(*said)
    assert "".join(chat.stream([])) == "Hello" and chat.usage is None
    chat.send = lines('{"choices": [{"message": {"content": "whole"}}], "usage": {"total_tokens": 7}}')
    assert list(chat.stream([])) == ["whole"] and chat.usage == {"prompt": None, "completion": None, "total": 7}


def test_over_http():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            ok = self.path == "/api/embed"
            out = json.dumps({"embeddings": [[float(len(t))] for t in body["input"]]} if ok else {"error": {"message": "no such model"}}).encode()
            self.send_response(200 if ok else 404)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert adapters.PlainEmbedder(base, "m", 1).embed(["a", "bcd"]) == [[1.0], [3.0]]
        with pytest.raises(adapters.ModelError, match="404.*no such model"):
            adapters.IndexedEmbedder(base, "m", 1).embed(["a"])
    finally:
        server.shutdown()


def test_adapter_in_spark(spark):
    def echo(url, body, headers):
        yield json.dumps({"embeddings": [[float(len(t))] for t in body["input"]]}).encode()

    rows = spark.createDataFrame([("a", "x"), ("b", "yy")], "id string, text string")
    made = ports.embed_rows(rows, adapters.PlainEmbedder("h", "m", 1, echo)).collect()
    assert {r.id: list(r.embedding) for r in made} == {"a": [1.0], "b": [2.0]}


@pytest.mark.parametrize("raw,want", [("", (32, None)), (" 40 ", (40, None)), ("0", (1, 1)), ("999", (256, 256)), ("12.7", (12, 12)), ("-3.5", (1, 1)), ("x", (32, "?")), ("nan", (32, "?")), ("inf", (32, "?")), ("1e2", (100, None))])
def test_coarse_k_of_a_setting(raw, want):
    value, warning = search.coarse_setting(raw)
    assert value == want[0] and (warning is None) == (want[1] is None) and (want[1] in (None, "?") or str(want[1]) in warning)
