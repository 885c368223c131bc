"""Large files with separators inside records, read in byte ranges, against the readers of whole files."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tallymill.sources import files, records


@contextmanager
def ranges_of(spark, size):
    """Splits files into ranges of this many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def whole_csv(spark, path):
    return spark.read.options(header=True, multiLine=True, **files._CSV_OPTIONS).csv(path)


def notes(rng):
    parts = ["", "a, b", 'say ""hi""', "two\nlines", "\n\n", "plain", '5" pipe', "ünï", "x" * 90, "back\\slash"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(4)))


def csv_text(seed, ending="\n"):
    rng, lines = random.Random(seed), ["tenantId,metric,customerRef,quantity,ts,meta"]
    for k in range(40):
        note = notes(rng)
        # a quote that does not start its value is an ordinary character
        value = '"' + note.replace('5" pipe', "5 pipe") + '"' if rng.random() < 0.7 else f'{k}" pipe'
        lines.append(f't1,m{k % 3}, "c{k}",{k},2024-01-0{1 + k % 9}T00:00:00Z,{value}')
        if rng.random() < 0.05:
            lines.append("")
    return ending.join(lines) + (ending if seed % 2 else "")


@pytest.mark.parametrize("seed, size, ending", [(1, 300, "\n"), (2, 90, "\n"), (3, 700, "\r\n")])
def test_csv_rows_equal_those_of_whole_files(spark, tmp_path, seed, size, ending):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_bytes(csv_text(seed, ending).encode())
    want = whole_csv(spark, str(tmp_path)).collect()
    with ranges_of(spark, size):
        got = files._csv(spark, str(tmp_path), True)
        assert got.columns == want[0].__fields__
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
        n = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert n >= 6


def test_replay_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('customer,meter,qty,ts,meta\nc1,m,1,2024-01-01,"{""a"":\n1}"\nc2,m,2,2024-01-02,\n')
    with ranges_of(spark, 16):
        rows = files.read_replay_csv(spark, str(tmp_path), "t", line_breaks=True).orderBy("quantity").collect()
    assert [(r.customer_ref, json.loads(r.meta)) for r in rows] == [("c1", {"a": 1}), ("c2", {})]


def test_csv_of_headers_only_and_an_unended_quote(spark, tmp_path):
    (tmp_path / "h.csv").write_text("metric,quantity\n")
    assert files._csv(spark, str(tmp_path / "h.csv"), True).count() == 0
    (tmp_path / "q.csv").write_text('metric,quantity\nm,1\nn,"2\n\n3')
    with ranges_of(spark, 8):
        assert sorted(r.quantity for r in files._csv(spark, str(tmp_path / "q.csv"), True).collect()) == ["1", "2\n\n3"]


@pytest.mark.parametrize("seed, size, indent", [(1, 150, None), (2, 200, 2), (3, 1 << 20, None)])
def test_json_elements_equal_those_of_whole_files(spark, tmp_path, seed, size, indent):
    rng = random.Random(seed)
    odd = ["a,b", 'q"uote', "back\\", "[{", "}]", "ü,", "\n", "", "\\\"", "x" * 70]
    rows = [
        {"tenantId": "t", "metric": f"m{k}", "customerRef": rng.choice(odd), "quantity": str(k), "ts": "2024-01-01T00:00:00Z",
         "meta": json.dumps({"n": [1, {"z": rng.choice(odd)}]}), "extra": [k, [rng.choice(odd)]]}
        for k in range(16)
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(rows[:1]))
    (tmp_path / "c.json").write_text(" [ ] ")
    with ranges_of(spark, size):
        got = files.read_events_json(spark, str(tmp_path))
        found = sorted((r.metric, r.customer_ref, r.quantity, r.meta) for r in got.collect())
    blank = lambda x: x.strip(" ") or None
    want = [(r["metric"], blank(r["customerRef"]), float(r["quantity"]), r["meta"]) for r in rows + rows[:1]]
    assert [(m, c, float(q), x) for m, c, q, x in found] == sorted(want, key=lambda r: (r[0], r[1] or "")) or {
        (m, c, float(q), x) for m, c, q, x in found
    } == set(want)
    assert len(found) == 17


@pytest.mark.parametrize("text", ["no json", '[{"metric": 1}, {"metric": ]', '[{"metric": "a"} {"metric": "b"}]'])
def test_what_is_no_array_ends_the_read(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_events_json(spark, str(tmp_path)).collect()


def test_states_compose_like_one_scan(spark):
    rng = random.Random(9)
    folded, want = [], []
    for f in range(6):
        state, depth = False, 0
        for r in range(40):
            ends = rng.choice([(False, True), (True, False), (False, False), (True, True)])
            changes = rng.randrange(-2, 3), rng.randrange(-2, 3)
            folded.append((f, r, ends[0], changes[0], ends[1], changes[1]))
            want.append((f, r, state, depth))
            depth += changes[state]
            state = ends[state]
    table = spark.createDataFrame(folded, "file long, range long, after_out boolean, depth_out long, after_in boolean, depth_in long")
    assert sorted(map(tuple, records._starts(table).collect())) == want
    assert F
