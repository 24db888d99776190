"""Row and layer order, ranks, pages, exact quantiles, submissions with a time to live."""

import json
import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from netaudit.operators import aggregates as A
from netaudit.operators import ranks as N
from netaudit.schema import SHEETS
from netaudit.sources import readers as R
from netaudit.streaming import submissions as S


def test_numbers_of_groups_of_any_size(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), k) for k in range(2000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = sorted(((r.g or "", r.v, r.row_no, r.total) for r in N.numbered(df, ["g"], ["v"]).collect()))
    want = []
    for g in {g for g, _ in rows}:
        mine = sorted(v for x, v in rows if x == g)
        want += [(g or "", v, k, len(mine)) for k, v in enumerate(mine, 1)]
    assert got == sorted(want)
    assert [r.row_no for r in N.numbered(df, [], [F.desc("v")]).orderBy(F.desc("v")).limit(3).collect()] == [1, 2, 3]
    assert N.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_no_window_runs_over_a_group(spark):
    df = spark.range(1000).withColumn("g", F.lit(1))
    plan = N.numbered(df, ["g"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):]
    assert "Aggregate [_part" in window  # it reads one row a partition and group


def test_quantiles_are_exact(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.choice([None, rnd.uniform(-5, 5), 1.0])) for g in ("a", "b", None) for _ in range(501)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.quantile for r in N.quantile(df, ["g"], "v").collect()}
    for g in {g for g, _ in rows} - {"none"}:
        assert abs(got[g] - statistics.median([v for x, v in rows if x == g and v is not None])) < 1e-12
    assert "none" not in got
    p = 0.9
    assert abs(N.quantile(df, [], "v", p).first().quantile - df.agg(F.percentile("v", p)).first()[0]) < 1e-12
    assert {r.g: (r.n, r.median) for r in A.distance_stats(df, "v", ["g"]).where("g IN ('one', 'none')").collect()} == {"one": (1, 3.5), "none": (0, None)}
    assert A.distance_stats(df.limit(0), "v").first().n == 0


def test_features_keep_their_order_however_files_are_split(spark, tmp_path):
    for folder, name, n in (("b", "CABLE", 400), ("a", "SITE", 50), ("c", "CABLE", 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}.csv").write_text("CODE,a.b\n" + "".join(f"{name}-{folder}-{k},x\n" for k in range(n)))
    got = []
    for size in ("128m", "500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = R.read_csv_layers(spark, [str(tmp_path / x) for x in "cba"])
            got.append(sorted((r.layer_order, r.layer, r.feature_seq, r.feature_id, r.props["CODE"], r.props["a.b"]) for r in rows.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] == [(0, "SITE", k, str(k), f"SITE-a-{k}", "x") for k in range(50)] + [(1, "CABLE", k, str(k), f"CABLE-b-{k}", "x") for k in range(400)]


def test_json_items(spark, tmp_path):
    (tmp_path / "SITE.json").write_text(json.dumps([{"CODE": "A", "n": 3, "x": 1.5, "in": {"k": 1}}, "text", 7, {"CODE": None}]))
    (tmp_path / "ZPM.json").write_text(json.dumps({"CODE": "Z"}, indent=1))
    rows = sorted(((r.layer, r.feature_seq, r.props, r.prop_types) for r in R.read_json_layers(spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert rows[0][2] == {"CODE": "A", "n": "3", "x": "1.5", "in": '{"k":1}'} and rows[0][3]["n"] == "bigint" and rows[0][3]["x"] == "double"
    assert [r[2] for r in rows[1:]] == [{"value": "text"}, {"value": "7"}, {}, {"CODE": "Z"}]


def test_pages_of_sheets(spark):
    cells = [("p", "f", "s", k, row) for k, row in enumerate([["CODE", "a", "b", "c", "d"]] + [[f"C{k}", "Fibre" if k % 2 else "x", "", "", ""] for k in range(20)], 1)]
    cells += [("p", "f", "empty", 1, ["CODE", "a", "b", "c", "d"])]
    sheets = spark.createDataFrame(cells, SHEETS)
    got = [(r.row_no, r.record["CODE"], r.place, r.total) for r in R.sheet_pages(sheets, 2, 4, "fibre").orderBy("row_no").collect()]
    assert got == [(11, "C9", 5, 10), (13, "C11", 6, 10), (15, "C13", 7, 10), (17, "C15", 8, 10)]
    assert R.sheet_pages(sheets, 4, 4, "fibre").count() == 0 and R.sheet_pages(sheets, 1, 5000, names=["s"]).count() == 20


def test_submissions_within_the_time_to_live(spark, tmp_path):
    """Once a content, also over a restart; again when its time is over; other parameters are another submission."""
    import time

    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()

    def give(name, *rows):
        (source / name).write_text("".join(json.dumps({"at": a, "c": c}) + "\n" for a, c in rows))

    def run(ttl_ms, version="1", at=check):
        stream = spark.readStream.schema("at long, c string").json(str(source))
        S.audit_stream(S.dedupe_for(stream, "at", ["c"], ttl_ms, F.lit(version)), lambda b: b, out, at, once=True).awaitTermination(60)
        return sorted((r.at, r.c) for r in spark.read.parquet(out).collect())

    give("1.json", (3, "a"), (1, "a"), (2, "b"))
    assert run(3_600_000) == [(1, "a"), (2, "b")]
    give("2.json", (4, "a"), (5, "c"))
    assert run(3_600_000) == [(1, "a"), (2, "b"), (5, "c")]  # a restart: the state is that of the checkpoint
    short, out = str(tmp_path / "short"), str(tmp_path / "out2")
    assert len(run(500, at=short)) == 3
    time.sleep(1)
    give("3.json", (9, "a"))
    assert (9, "a") in run(500, at=short)


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"c": "a"}\n')
    stream = spark.readStream.schema("c string").json(str(tmp_path / "in"))
    for check in ("one", "two"):  # a lost checkpoint: batch 0 runs again
        S.audit_stream(stream, lambda b: b, str(tmp_path / "out"), str(tmp_path / check)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_a_table_of_submissions_by_the_hour(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=m), c) for m, c in [(0, "a"), (30, "a"), (59, "a"), (60, "a"), (119, "a"), (121, "a"), (5, "b"), (600, "b")]]
    got = S.dedupe_batch(spark.createDataFrame(rows, "at timestamp, c string").repartition(3), "at", ["c"], 1.0).collect()
    assert sorted((int((r.at - start).total_seconds() // 60), r.c) for r in got) == [(0, "a"), (5, "b"), (60, "a"), (121, "a"), (600, "b")]


def test_bills_of_several_files(spark):
    from netaudit.operators.lookup import bom_codes

    cells = [("p", "one", "BOM", k, r) for k, r in enumerate([["name", "Material Code", "a", "b", "c"], ["x", "1", "", "", ""]], 1)]
    cells += [("p", "two", "BOM", k, r) for k, r in enumerate([["title 2024", "", "", "", "", "", "", "", "", ""], ["编码", "name", "a", "b", "c", "d", "e", "f", "g", "h"], ["2", "y"] + [""] * 8, ["3", None] + [""] * 8], 1)]
    sheets = spark.createDataFrame(cells, SHEETS)
    assert {r.code for r in bom_codes(sheets).collect()} == {"1", "2", "3"}
    rows = {r.file: r for r in R.workbook_summary(sheets, 1).collect()}
    assert (rows["two"].n_rows, rows["two"].kind, [r[0] for r in rows["two"].first_rows]) == (2, "bom", ["2"]) and rows["one"].header[1] == "Material Code"


def test_samples_of_layers(spark):
    from tests.test_rules import features

    f = features(spark, [("A", {"CODE": str(k)}, None) for k in range(9)] + [("B", {"CODE": "b"}, None)]).repartition(3)
    assert sorted((r.layer, r.props["CODE"], r.place, r.total) for r in R.layer_sample(f, 2).collect()) == [("A", "0", 1, 9), ("A", "1", 2, 9), ("B", "b", 1, 1)]


def test_submissions_by_hours_take_no_rounds(spark):
    """A content that passes some hundred times, and ties; contents that are too large for a task give the same."""
    rnd, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(k, rnd.choice("abc"), start + timedelta(hours=rnd.randint(0, 1500))) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, c string, t timestamp").repartition(5)
    want, last = set(), {}
    for k, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if c not in last or t >= last[c] + timedelta(hours=12):
            want.add(k)
            last[c] = t
    assert {r.id for r in S.dedupe_batch(df, "t", ["c"], 12.0).collect()} == want and len(want) > 200
    few = df.where("t < timestamp'2024-01-03'")
    assert sorted(S.dedupe_batch(few, "t", ["c"], 12.0, most=3).collect()) == sorted(S.dedupe_batch(few, "t", ["c"], 12.0).collect())


def test_early_pages_are_found_by_a_limited_rank(spark):
    """No range sort of all records, and the same rows as a page beyond the limit takes; equal and short columns as in the records."""
    cells = [("p", "f", "s", k, row) for k, row in enumerate([["CODE", "a", "CODE", " "]] + [[f" C{k} ", "seven" if k % 3 else None, "hidden"][: 1 + k % 3] for k in range(1300)], 1)]
    sheets = spark.createDataFrame(cells, SHEETS).repartition(3)
    early = R.sheet_pages(sheets, 2, 400, "SEVEN")
    assert "WindowGroupLimit" in early._jdf.queryExecution().optimizedPlan().toString()
    want = [k for k in range(1300) if k % 3][400:800]
    assert [(r.record["CODE"], r.place, r.total) for r in early.orderBy("place").collect()] == [(f"C{k}", n, 866) for n, k in enumerate(want, 401)]
    assert R.sheet_pages(sheets, 1, 1000, "hidden").count() == 0
    assert [r.record["CODE"] for r in R.sheet_pages(sheets, 2, 700).orderBy("place").limit(2).collect()] == ["C700", "C701"]
