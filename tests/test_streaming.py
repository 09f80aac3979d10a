"""Streams over small file drops."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quitanda.functions.events import product_of
from quitanda.sources.streams import decode_events, events_files, kafka_topic, keyed_messages
from quitanda.sources.versions import DayVersions
from quitanda.streaming import dead_letters, metrics, writers


def event(i, kind="PAGE_VIEW", at="2024-01-01T10:00:00", **kw):
    return {"_id": str(i), "event_type": kind, "timestamp": at, "user_id": "u", "session_id": "s", **kw}


@pytest.fixture()
def drop(tmp_path):
    folder = tmp_path / "eventos"
    folder.mkdir()

    def put(name, events):
        (folder / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")
        return str(folder)

    return put


def run(spark, metric, tmp_path, label, mode="complete"):
    out = str(tmp_path / label)
    writers.write_snapshot(metric, out, str(tmp_path / f"{label}-ckpt"), mode)
    return spark.read.parquet(out)


def test_counts_revenue_and_products(spark, drop, tmp_path):
    path = drop("a.jsonl", [
        event(1, "PURCHASE_COMPLETED", produto={"id": "P1"}, valor_total=10.5), event(2, "PURCHASE_COMPLETED"),
        event(3, "PRODUCT_VIEW", properties={"produto_id": "P1"}), event(4, properties={"produto_id": ""}, produto={"id": "P2"}),
        event(5), "{broken"])
    stream = metrics.with_event_time(events_files(spark, path))
    counts = {r.event_type: r.eventos for r in run(spark, metrics.stream_counts(stream), tmp_path, "n").collect()}
    assert counts == {"PURCHASE_COMPLETED": 2, "PRODUCT_VIEW": 1, "PAGE_VIEW": 2, "DESCONHECIDO": 1}
    product = product_of(F.col("properties.produto_id"), F.col("produto.id"))
    top = [(r.produto, r.qtd) for r in run(spark, metrics.stream_top(stream, product), tmp_path, "t").collect()]
    assert top == [("P1", 2), ("P2", 1)]
    day = run(spark, metrics.stream_revenue(stream.where("timestamp is not null")), tmp_path, "r").collect()
    assert [str(r.receita) for r in day] == ["10.50"]


def test_new_files_are_read_once(spark, drop, tmp_path):
    out, ckpt = str(tmp_path / "raw"), str(tmp_path / "ckpt")
    for name, ids in (("a.jsonl", [1, 2]), ("b.jsonl", [3])):
        path = drop(name, [event(i) for i in ids])
        writers.write_raw_events(events_files(spark, path), out, ckpt)
    got = spark.read.json(out)
    assert got.count() == 3 and {r.hora for r in got.select("hora").collect()} == {"20240101_10"}


def test_late_event_and_duplicate(spark, drop, tmp_path):
    out, ckpt = str(tmp_path / "d"), str(tmp_path / "d-ckpt")

    def go(name, events):
        path = drop(name, events)
        stream = metrics.with_event_time(events_files(spark, path), watermark="10 minutes")
        return writers.write_append(metrics.dedup_events(stream).select("_id"), out, ckpt)

    go("a.jsonl", [event(1), event(1), event(2, at="2024-01-01T11:00:00")])
    go("b.jsonl", [event(2, at="2024-01-01T11:00:01"), event(3, at="2024-01-01T11:05:00")])
    last = go("c.jsonl", [event(4, at="2024-01-01T10:00:00")])
    assert sorted(r._id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]
    dropped = [op["numRowsDroppedByWatermark"] for p in last.recentProgress for op in p["stateOperators"]]
    assert sum(dropped) == 1


def test_append_windows_wait_for_the_watermark(spark, drop, tmp_path):
    path = drop("a.jsonl", [event(1), event(2, at="2024-01-01T10:00:59"), event(3, at="2024-01-01T12:00:00")])
    stream = metrics.with_event_time(events_files(spark, path), watermark="1 minute")
    out = str(tmp_path / "w")
    writers.write_append(metrics.stream_minute(stream), out, str(tmp_path / "w-ckpt"))
    assert [r.eventos for r in spark.read.parquet(out).collect()] == [2]


def test_dead_letters(spark, drop, tmp_path):
    def msg(value, n):
        return json.dumps({"value": value, "tentativas": n})

    ok = json.dumps({"id_venda": "1", "cpf_cliente": "2", "valor_total": 3.0, "data_venda": "2024-01-01"})
    path = drop("m.json", [msg(ok, 0), msg("{ruim", 0), msg('{"id_venda": "1"}', 2)])
    stream = spark.readStream.schema("value string, tentativas int").json(path)
    paths = [str(tmp_path / x) for x in ("ok", "retry", "dlq")]
    writers.finish(stream.writeStream.option("checkpointLocation", str(tmp_path / "m-ckpt"))
                   .foreachBatch(dead_letters.route_dead_letters(*paths)))
    good, retry, dead = (spark.read.parquet(p) for p in paths)
    assert good.first().cpf_cliente == "2" and retry.first().tentativas == 1
    assert dead.first().erros == ["ausente:cpf_cliente", "ausente:valor_total", "ausente:data_venda"]
    assert dead_letters.redrive(dead).first().tentativas == 0


def test_messages_round_trip(spark, drop):
    e = spark.read.schema("_id string, user_id string, timestamp string").json(drop("a.jsonl", [event(1)]))
    sent = keyed_messages(e, F.col("user_id"))
    assert sent.first().key == "u"
    assert decode_events(sent).first()._id == "1"


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="kafka"):
        kafka_topic(spark, {"subscribe": "x"})


def minutes(day, n):
    return [event(f"{day}-{i}", at=f"2024-01-{day:02d}T10:{i:02d}:00") for i in range(n)]


def test_windows_by_day_leave_the_state(spark, drop, tmp_path):
    out, ckpt = str(tmp_path / "dias"), str(tmp_path / "dias-ckpt")
    totals, held = [], None
    for day in (1, 2, 3, 4):
        path = drop(f"d{day}.jsonl", minutes(day, 30) + ([event("late", at="2024-01-02T10:00:30"), event("more", at="2024-01-02T23:59:00")] if day == 3 else []))
        stream = metrics.with_event_time(events_files(spark, path), watermark="12 hours")
        query = writers.write_days(metrics.stream_minute(stream), out, ckpt, ["inicio"], "inicio")
        totals.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        if day == 2:
            held = DayVersions(spark, out).read()
            before = sorted(map(repr, held.collect()))
    table = DayVersions(spark, out)
    got = {str(r.inicio): r.eventos for r in table.read().collect()}
    assert len(got) == 4 * 30 + 1 and got["2024-01-02 23:59:00"] == 1 and got["2024-01-03 10:00:00"] == 1
    # the window of the late event had not been let go of: its watermark was that of the batch before
    assert got["2024-01-02 10:00:00"] == 2
    assert max(totals) <= 70 and totals[-1] < sum([30] * 4)
    assert sorted(map(repr, held.collect())) == before  # the version that was read is still there
    loads = table.days()
    assert len(set(loads.values())) == 3 and loads["2024-01-01"] != loads["2024-01-02"] == loads["2024-01-03"]


def test_day_versions(spark, rows, tmp_path):
    table = DayVersions(spark, str(tmp_path / "t"), keep=1)
    put = lambda load, *data: table.upsert(rows(list(data), "k string, dia date, v int"), ["k"], load)
    day = datetime.date(2024, 1, 1)
    other = datetime.date(2024, 1, 2)
    assert table.read() is None
    put("a", ("x", day, 1), (None, day, 2), ("y", other, 3))
    put("b", ("x", day, 5), ("z", day, 6))
    put("b", ("x", day, 99))  # made already
    put("c")
    put("d", (None, day, 7))
    put("e", ("x", day, 8))
    assert {(r.k, r.dia, r.v) for r in table.read().select("k", "dia", "v").collect()} == {("x", day, 8), (None, day, 7), ("z", day, 6), ("y", other, 3)}
    assert [r.v for r in table.read({"2024-01-02"}).collect()] == [3]
    assert sorted(p.name for p in (tmp_path / "t" / "dados").iterdir()) == ["carga=a", "carga=d", "carga=e"]  # b is in no kept list
