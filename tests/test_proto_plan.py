"""Comparisons of descriptor sets: results of tricky pairs, and a plan that joins nothing."""

from google.protobuf import descriptor_pb2 as pb

from pactlens.operators import proto_diff


def plan(df, part="optimizedPlan") -> str:
    return getattr(df._jdf.queryExecution(), part)().toString()


def _set(*messages, methods=()):
    file = pb.FileDescriptorProto(name="x.proto", package="s")
    for name, fields in messages:
        m = file.message_type.add(name=name)
        for member, number, kind in fields:
            m.field.add(name=member, number=number, type=kind, label=1)
    service = file.service.add(name="S")
    for name, given in methods:
        service.method.add(name=name, input_type=given, output_type=".s.Out")
    return bytearray(pb.FileDescriptorSet(file=[file]).SerializeToString())


def test_diff_proto_without_joins(spark):
    before = _set(("M", [("a", 1, 3), ("b", 2, 9), ("c", 3, 9), ("gone", 7, 9), ("twice", 8, 9)]), ("Old", [("x", 1, 3)]), methods=[("Get", ".s.In"), ("Drop", ".s.In")])
    after = _set(("M", [("a", 1, 9), ("d", 2, 9), ("c", 5, 9), ("fresh", 6, 9), ("twice", 9, 9)]), ("New", [("x", 1, 3)]), methods=[("Get", ".s.Other"), ("Add", ".s.In")])
    rows = [(1, "before", before), (1, "after", after), (2, "before", before), (2, "after", bytearray(b"\xff\xff")), (3, "after", after)]
    changes = proto_diff.diff_proto(spark.createDataFrame(rows, "pair bigint, side string, descriptors binary"))
    assert "Join" not in plan(changes)
    got = sorted((r.pair, r.kind[6:], r.location, r.before if r.kind.endswith("number_changed") else None, r.after if r.kind.endswith("number_changed") else None) for r in changes.collect())
    one = [
        ("field.added", "/s.M/fresh", None, None), ("field.number_changed", "/s.M/c", "3", "5"), ("field.number_changed", "/s.M/twice", "8", "9"), ("field.removed", "/s.M/gone", None, None),
        ("field.renamed", "/s.M/b", None, None), ("field.type_changed", "/s.M/a", None, None), ("message.added", "/messages/s.New", None, None), ("message.removed", "/messages/s.Old", None, None),
        ("rpc.added", "/s.S/Add", None, None), ("rpc.removed", "/s.S/Drop", None, None), ("rpc.request_type_changed", "/s.S/Get", None, None),
    ]
    three = [("message.added", "/messages/s.M", None, None), ("message.added", "/messages/s.New", None, None), ("service.added", "/services/s.S", None, None)]
    assert got == [(1, *r) for r in one] + [(3, *r) for r in three]
