"""Recordings with the types that tools write, refused files, and uploads of versions."""

import base64
import json

from pyspark.sql import functions as F

from pactlens.plans import flows
from pactlens.sources import traffic


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")



def har(*entries):
    return json.dumps({"log": {"entries": list(entries)}})


def entry(method="get", url="http://h/a", status=200, headers=(), query=(), **more):
    return {"request": {"method": method, "url": url, "headers": list(headers), "queryString": list(query), **more.get("request", {})}, "response": {"status": status, **more.get("response", {})}, **more.get("entry", {})}


def test_types_of_a_recording_count(spark):
    pair = lambda name, value: {"name": name, "value": value}
    content = har(
        entry(), entry(method=5), entry(method=None), entry(url=7), entry(status="200"), entry(status=200.0), entry(status=None), entry(status=True), entry(status=1 << 40),
        entry(headers=[pair("A", "x"), pair("a", 7), pair(7, "y"), pair("B", None), {"name": "C"}], query=[pair("Q", 7), pair("q", "v"), pair(None, "w"), {"name": "r"}]),
        entry(request={"postData": {"text": 7}}, response={"content": {"text": '{"a": 1}'}}, entry={"startedDateTime": 12}),
        entry(request={"postData": {"text": '"t"'}}, entry={"startedDateTime": "2024-01-02T03:04:05Z"}),
    )
    files = spark.createDataFrame([(content, 1), ("", 2), (None, 3), (" \n", 4), ('{"log": {}}', 5)], "content string, har int")
    got = traffic.har_calls(files, now(), keep=("har",)).collect()
    assert [g.status for g in got] == [200, 0, 0, 0, 1, 0, 200, 200, 200] and {g.har for g in got} == {1} and {g.method for g in got} == {"GET"}
    assert got[6].request_headers == {"a": "x"} and got[6].query == {"Q": "", "q": "v", "r": ""}
    assert got[7].request_body is None and got[7].response_body == '{"a": 1}' and str(got[7].ts) == "2024-05-01 00:00:00"
    assert got[8].request_body == '"t"' and str(got[8].ts) == "2024-01-02 03:04:05"


def test_types_of_an_rpc_log_count(spark):
    lines = [
        {"path": "", "method_path": "/a"}, {"path": None, "method_path": "/b", "method": ""}, {"path": 0, "method_path": "/c", "method": None, "status": "3"}, {"path": 7, "method_path": "/no"},
        {"method_path": 7}, {"path": "", "method_path": ""}, {}, [], {"path": "/d", "method": "x", "status": 3.0, "client": 7, "timestamp": 5, "request": None, "request_body": {"k": 1}, "response": "s"},
        {"path": "/e", "method": 7, "status": -2, "client": "me"},
    ]
    got = traffic.grpc_calls(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{",), ("",), (None,)], "value string"), now()).collect()
    assert [(g.method, g.url, g.status, g.client) for g in got] == [("POST", "/a", 0, None), ("POST", "/b", 0, None), ("POST", "/c", 0, None), ("POST", "", 0, None), ("X", "/d", 0, None), ("7", "/e", -2, "me")]
    assert got[4].request_body == '{"k":1}' and got[4].response_body == '"s"' and str(got[4].ts) == "2024-05-01 00:00:00"


def test_files_beyond_the_limit_are_refused(spark, tmp_path):
    (tmp_path / "small.har").write_text(har(entry()))
    (tmp_path / "large.har").write_text(har(*[entry()] * 20))
    got = {r.file.split("/")[-1]: r for r in traffic.read_har(spark, str(tmp_path), limit=400).collect()}
    assert got["small.har"].problem is None and got["large.har"].problem == "larger than 400 bytes" and got["large.har"].content is None
    assert traffic.har_calls(traffic.read_har(spark, str(tmp_path), limit=400), now()).count() == 1


UPLOAD = "service int, name string, kind string, spec string, ord int"


def outcomes(spark, versions, rows):
    known = spark.createDataFrame(versions, "service int, name string, kind string, version_hash string")
    return [r.outcome for r in flows.register_versions(known, spark.createDataFrame(rows, UPLOAD)).orderBy("ord").collect()]


def test_refused_uploads_create_nothing(spark):
    proto = base64.b64encode(b'{"a":1}').decode()
    # The same content under another kind: refused for its name, so the next name creates it.
    assert outcomes(spark, [(1, "n", "openapi", "x")], [(1, "n", "proto", proto, 0), (1, "m", "proto", proto, 1), (1, "z", "proto", proto, 2)]) == ["kind differs", "created", "known"]
    # Two kinds of one new name in one batch: the first one's holds.
    assert outcomes(spark, [], [(1, "n", "proto", proto, 0), (1, "n", "openapi", '{"b": 2}', 1), (1, "n", "proto", base64.b64encode(b"2").decode(), 2), (2, "n", "openapi", '{"b": 2}', 3)]) == ["created", "kind differs", "created", "created"]
    # Content decides before kind; null, broken and unknown ones are invalid.
    one = outcomes(spark, [], [(1, "n", "openapi", '{"a": 1}', 0), (1, "n", "openapi", '{ "a":1 }', 1), (1, "n", "openapi", None, 2), (1, "n", "proto", "*", 3), (1, "n", "other", "{}", 4)])
    assert one == ["created", "known", "invalid", "invalid", "invalid"]
    stored = flows.register_versions(spark.createDataFrame([], "service int, name string, kind string, version_hash string"), spark.createDataFrame([(1, "n", "openapi", '{"a": 1}', 0)], UPLOAD)).first().version_hash
    assert outcomes(spark, [(1, "n", "openapi", stored)], [(1, "q", "openapi", '{"a":1}', 0)]) == ["known"]
