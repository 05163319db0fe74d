"""The newest records as state, through batches and restarts."""

import json
import random

import pytest

from cairn.streaming import retention

pytest.importorskip("google.protobuf")


def test_newest_stay_after_restarts(spark, tmp_path):
    rng, source = random.Random(8), tmp_path / "in"
    source.mkdir()
    state, held = str(tmp_path / "state"), {}
    for batch in range(4):
        rows = [{"kind": rng.choice("ab"), "id": f"i{rng.randint(0, 30)}", "seq": batch * 100 + n, "record": f"r{batch}-{n}"} for n in range(25)]
        rows += [{"kind": "a", "id": None, "seq": 1}, {"kind": None, "id": "x", "seq": 1}, {"kind": "a", "id": "late", "seq": -1, "record": "old"}]
        (source / f"{batch}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("kind string, id string, seq long, record string").json(str(source))
        retention.start(stream, state, 5, str(tmp_path / "changes"), once=True).awaitTermination(240)
        for r in rows:
            if r["id"] and r["kind"]:
                own = held.setdefault(r["kind"], {})
                own[r["id"]] = max(own.get(r["id"], (-1, "")), (r["seq"], r["record"]))
        held = {k: dict(sorted(v.items(), key=lambda x: (x[1][0], x[0]))[-5:]) for k, v in held.items()}
        got = {(r.kind, r.id): (r.seq, r.record) for r in retention.kept(spark, state).collect()}
        assert got == {(k, i): x for k, v in held.items() for i, x in v.items()}
    changes = spark.read.parquet(str(tmp_path / "changes"))
    assert changes.filter("NOT kept").count() > 0 and changes.select("batch").distinct().count() == 4
