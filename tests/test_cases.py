import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import control
from corvane.operators import cases as C
from corvane.operators import merging, normalizing, planning
from corvane.sources import pages as P


def test_query_validation():
    q = C.CaseQuery(intent="x", sort="y", limit=1000, goal="z", case_key="42")
    assert (q.intent, q.sort, q.limit, q.goal, q.case_key) == ("search", "date_desc", 100, "lookup", 42)
    assert C.CaseQuery(limit=0).limit == 10 and C.CaseQuery(limit=-5).limit == 1
    assert C.CaseQuery(ranking_field="fatalities").goal == "rank" and C.CaseQuery(intent="count").goal == "count"
    for bad in ({"start_date": "1/2/2020"}, {"case_key": "x"}):
        with pytest.raises(ValueError):
            C.CaseQuery(**bad)


@pytest.fixture(scope="module")
def index(spark):
    cases = spark.createDataFrame(
        [(1, "ABC12AB123", dt.date(2020, 1, 1), "Reno", "NV", "Fatal", 2, 3), (2, "ABC12AB124", None, "Oslo", "NO", "Non-Fatal", None, None), (3, None, dt.date(2021, 1, 1), None, "NV", None, 1, 0)],
        "case_key long, case_number string, event_date date, city string, state string, severity string, fatalities int, total_injuries int",
    ).withColumns({c: F.lit(None).cast("string") for c in ("location", "country", "country_code", "event_type", "investigation_status", "narrative", "probable_cause", "airport", "runway")})
    parties = spark.createDataFrame([(1, 1, "Cessna", "172", "N1"), (1, 2, "Piper", "PA", "N2"), (3, 1, "Cessna", None, None)], "case_key long, sequence int, make string, model string, registration string")
    return cases, parties


def test_filters(index):
    cases, parties = index

    def keys(**q):
        return sorted(r.case_key for r in C.matching(cases, parties, C.CaseQuery(**q)).collect())

    assert keys(severity="fatal") == [1, 2, 3] and keys(severity="Non-Fatal") == [1, 2, 3]
    assert sorted(r.case_key for r in C.matching(cases, parties, C.CaseQuery(severity="non-fatal"), strict=True).collect()) == [2]
    assert keys(make="cess", model="PA") == [1] and keys(registration="n2", make="cessna") == [1] and keys(case_number="abc12ab124") == [2]
    assert keys(start_date="2020-06-01") == [3] and keys(location="ren") == [1] and keys(text="reno nv") == [1]


def test_orders(index):
    cases, _ = index
    order = lambda **q: [r.case_key for r in C.page(cases, C.CaseQuery(**q)).collect()]
    assert order(goal="rank", ranking_field="fatalities") == [1, 3, 2]
    assert order(goal="rank", ranking_field="fatalities", ranking_order="asc") == [2, 3, 1]
    assert order() == [3, 1, 2] and order(sort="date_asc") == [1, 3, 2]


def test_nested_and_context(index):
    cases, parties = index
    rows = {r.case_key: r for r in C.nested(cases, parties).withColumn("names", C.party_names()).collect()}
    assert rows[1].names == "Cessna 172; Piper PA" and rows[2].parties == [] and rows[3].names == "Cessna"
    said = {r.case_key: r.text for r in C.case_context(C.nested(cases, parties)).collect()}
    assert said[1].startswith("[Source: cases | Case: ABC12AB123]\nCase: ABC12AB123\nDate: 2020-01-01\nAircraft: Cessna 172; Piper PA") and said[3].startswith("[Source: cases | Case: 3]")


def test_refresh_and_stale(spark, index):
    cases, _ = index
    df = cases.withColumn("detail_fetched_at", F.lit(None).cast("timestamp"))
    assert df.where(C.needs_refresh(C.CaseQuery(requested_fields=["narrative"]))).count() == 3
    assert df.where(C.needs_refresh(C.CaseQuery(requested_fields=["date"]))).count() == 0 and df.where(C.needs_refresh(C.CaseQuery(needs_detail=True))).count() == 3
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    stale = lambda t: spark.range(1).select(C.is_stale(F.lit(t).cast("string"), now)).first()[0]
    assert stale(None) and stale("soon") and stale("2024-01-01 10:59:59") and not stale("2024-01-01 11:30:00")


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "b", None), (3, "c", 3)], "k int, s string, n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merging.overwrite(old, new, ["k"])) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
    assert rows(merging.fill(old, new, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert rows(merging.insert_new(old, new, ["k"])) == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    assert rows(merging.replace_children(old, new.where("k = 2"), "k")) == [(1, "a", 1), (2, "b", None)]
    assert rows(merging.merge_detail(old, new, "k")) == [(1, "a", 1), (2, "b", 2)]


def test_first_claims(spark):
    batch = spark.createDataFrame([("b", 1, 1, "n1"), ("b", 2, 2, "N1"), ("b", 3, 2, "n2"), ("b", 4, 3, None), ("b", 5, 3, "n9")], "batch string, o int, case_key long, case_number string")
    assert sorted(r.o for r in merging.first_claims(batch, ["batch"], "o").collect()) == [1, 3, 4]


def test_delete_run(spark):
    runs = spark.createDataFrame([("a", "completed"), ("b", "running")], "run_id string, status string")
    tables = {"runs": runs, "case_runs": spark.createDataFrame([(1, "a"), (2, "b")], "case_run_id long, run_id string"), "retrieved_items": spark.createDataFrame([(1, 1), (2, 1)], "case_run_id long, rank int")}
    out = merging.delete_run(tables, "a")
    assert out["runs"].count() == 1 and [r.case_run_id for r in out["retrieved_items"].collect()] == [2]
    assert merging.delete_run(tables, "x") is None
    with pytest.raises(ValueError):
        merging.delete_run(tables, "b")


RECORD = {"mkey": 7, "ntsbNumber": " ABC12AB123 ", "eventDate": "2020-05-06T00:00:00Z", "country": "ES", "totalFatal": "2", "aircrafts": [{"aircraftMake": "Cessna", "aircraftModel": "172"}, {}], "events": [{"eventTier2Name": "b"}, {"eventTier2Name": "b"}], "findings": [{"findingDescription": "f"}], "airports": [{"airportFacilityName": "X", "airportRunwayId": "9"}]}


def test_normalizing(spark):
    payloads = [json.dumps({"data": {"records": [RECORD, {"eventDate": "x"}]}, "pagination": {"next": "m2"}}), json.dumps(RECORD), "{bad", None, "[]"]
    raw = normalizing.records(spark.createDataFrame(list(enumerate(payloads)), "ordinal int, payload string"))
    typed = normalizing.cases(raw).cache()
    assert normalizing.accepted(typed).count() == 2 and normalizing.rejected(typed).count() == 1
    row = typed.where("ordinal = 0 and case_key = 7").first()
    assert (row.case_number, row.event_date, row.fatalities, row.country_code, row.airport, row.runway, row.marker, row.total_injuries) == ("ABC12AB123", dt.date(2020, 5, 6), 2, "ES", "X", "9", "m2", None)
    assert row.events == ["b"] and row.findings == ["f"] and len(row.parties) == 1
    assert [(r.sequence, r.make) for r in normalizing.children(typed.where("ordinal = 1"), "parties").collect()] == [(1, "Cessna")]
    assert normalizing.payload_hash({"b": 1, "a": 2}) == normalizing.payload_hash({"a": 2, "b": 1})
    assert normalizing.flatten({"id": 1, "x": {"id": 2}})["id"] == 1 and normalizing.flatten({"id": 1, "x": {"id": 2}}, deepest=True)["id"] == 2


def test_chosen_fields(spark):
    """Named fields are those of all fields, in trees of any nesting; what isn't named isn't looked for."""
    rng = random.Random(5)
    names = ["id", "mkey", "Country", "event", "events", "aircraft", "aircrafts", "airports", "runway", "eventTier2Name", "make", "totalSerious", "x", "data", "findings", "modifierName", "airportName"]

    def tree(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.4:
            return rng.choice([None, "", " a ", 3, 1.5, True, "ES"])
        if kind < 0.75:
            return {rng.choice(names): tree(depth + 1) for _ in range(rng.randint(0, 6))}
        return [tree(depth + 1) for _ in range(rng.randint(0, 4))]

    def members(x, depth=0):
        for k, v in x.items() if isinstance(x, dict) else ():
            yield depth, normalizing.key_form(k), v
            yield from members(v, depth + 1)
        for v in x if isinstance(x, list) else ():
            yield from members(v, depth)

    trees = [tree(0) for _ in range(400)]
    for t in trees:
        first, last = {}, {}
        for depth, k, v in members(t):
            last[k] = v
            if k not in first or depth < first[k][0]:
                first[k] = (depth, v)
        assert normalizing.flatten(t) == {k: v for k, (_, v) in first.items()} and normalizing.flatten(t, deepest=True) == last
        some = frozenset(("id", "event", "make"))
        assert normalizing.flatten(t, wanted=some) == {k: v for k, (_, v) in first.items() if k in some}
    payloads = spark.createDataFrame([(i, json.dumps({"records": [t, RECORD]})) for i, t in enumerate(trees)], "ordinal int, payload string")
    every = [r.asDict(recursive=True) for r in normalizing.records(payloads).collect()]
    for fields in (("case_key",), ("events", "parties", "marker"), ("runway", "findings", "hash"), ("country", "serious_injuries", "airports", "record")):
        raw = normalizing.records(payloads, fields=fields)
        assert raw.columns == [c for c in normalizing.records(payloads).columns if c in ("ordinal", *fields)]
        assert [r.asDict(recursive=True) for r in raw.collect()] == [{c: r[c] for c in raw.columns} for r in every]
    assert normalizing.cases(normalizing.records(payloads, fields=("case_key",))).dtypes == [("ordinal", "bigint"), ("case_key", "bigint")]
    with pytest.raises(ValueError):
        normalizing.records(payloads, fields=("no",))


def test_detail_texts(spark):
    trees = [{"weather": {"visibility": " 10  mi "}, "internalCorrelationToken": "t", "events": [{"name": "a"}]}, {"event": "x" * 1300}, {}, {"event": [str(i) for i in range(300)]}, None]
    rows = spark.createDataFrame([(i, json.dumps(t) if t is not None else "{bad") for i, t in enumerate(trees)], "case_key long, payload string")
    said = {r.case_key: r.text for r in normalizing.detail_texts(rows).collect()}
    assert said[0] == "Fields of the live record:\nweather.visibility: 10 mi\nevents[1].name: a"
    assert said[1].endswith("x...") and len(said[1]) < 1300 and said[2] == said[4] and "no fields" in said[2]
    lines = said[3].split("\n")
    assert len(lines) == 222 and lines[1] == "event[1]: 0" and lines[220] == "event[220]: 219" and "more fields" in lines[221]


def test_detail_texts_of_repeated_keys(spark):
    """Lines of one key's payloads are merged, null is a key, odd white space is cut; without repeated keys no line is exchanged."""
    rows = [(1, {"event": "b", "Prob_Cause": "\u00a0x\u2003\t y\x1c "}), (1, {"event": "a"}), (None, {"event": "n"}), (2, {"token": "t"}), (2, {"event": " \u3000"})]
    frame = spark.createDataFrame([(k, json.dumps(t)) for k, t in rows], "case_key long, payload string").repartition(3)
    head, none = "Fields of the live record:\n", "The live record has no fields that can be shown."
    said = {r.case_key: r.text for r in normalizing.detail_texts(frame).collect()}
    assert said == {1: f"{head}event: a\nevent: b\nProb_Cause: x y\x1c", None: f"{head}event: n", 2: none}
    said = normalizing.detail_texts(frame, lines=2).where("case_key = 1").first().text.split("\n")
    assert said[1:3] == ["event: a", "event: b"] and "more fields" in said[3]
    once = normalizing.detail_texts(spark.range(0, 50, 1, 16).selectExpr("id as case_key", "'{\"event\": 1}' as payload"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.distinct().count() == 50


def test_paged_source(spark, tmp_path):
    class Backend:
        def __init__(self):
            self.tries = 0

        def fetch(self, kind, params):
            self.tries += 1
            if params.get("start_date", "") > "2020-06-30":
                return 204, None, None
            if self.tries == 1:
                return 429, "0", None
            n = int(params["marker"] or 0)
            return 200, None, {"records": [{"mkey": n, "eventDate": params["start_date"]}], "nextMarker": str(n + 1) if n < 2 else None}

    spark.dataSource.register(P.source_of(Backend()))
    rows = spark.read.format("case_pages").option("start", "2020-01-01").option("end", "2020-12-31").load().collect()
    assert len(rows) == 3 * 3 and {r.page for r in rows} == {0, 1, 2}
    for end in ("2020-04-30", "2020-12-31", "2020-12-31"):  # the last finds nothing new
        stream = spark.readStream.format("case_pages").option("start", "2020-01-01").option("end", end).option("days", 30).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(str(tmp_path / "out")).collect()
    # windows of 30 days from January on, then from May on
    assert len(seen) == len({(r.window_start, r.page) for r in seen}) == 3 * (5 + 3) and min(r.window_start for r in seen) == dt.date(2020, 1, 1)
    assert P.windows(dt.date(2020, 1, 1), dt.date(2020, 4, 1)) == [(dt.date(2020, 1, 1), dt.date(2020, 3, 30)), (dt.date(2020, 3, 31), dt.date(2020, 4, 1))]
    day = dt.date(2020, 1, 20)
    assert P.next_window(dt.date(2020, 1, 10), None, day, True, day) == (dt.date(2020, 1, 3), day) and P.next_window(dt.date(2020, 1, 10), None, day, False, day) == (dt.date(2020, 1, 11), day)
    assert P.next_window(None, (day, day), day, True, day) == (day, day)

    class Refusing:
        def fetch(self, kind, params):
            return 401, None, None

    with pytest.raises(P.FatalAnswer):
        P.fetch(Refusing(), "one", {})


def test_control(spark):
    def route(t):
        return spark.createDataFrame([(t,)], "t string").select(control.route(F.col("t"))).first()[0]

    assert [route(t) for t in ("stall speed?", "fatal crash", "crash and stall speed", "pizza", "ABC12AB123?", "the airplane", None)] == ["documents", "accidents", "both", "abstain", "accidents", "documents", "abstain"]
    today = dt.date(2026, 8, 19)
    row = spark.range(1).select(control.valid_citations(F.array(F.lit("b"), F.lit("x"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("v"), control.output_error(F.lit("say You are an aviation technical assistant")).alias("l"), control.output_error(F.lit(" ")).alias("e"), control.abstained(F.lit(" I don't have that information in my sources. ")).alias("a")).first()
    assert row.v == ["b", "a"] and (row.l, row.e, row.a) == ("leak", "empty", True)
    assert spark.createDataFrame([("which country",)], "t string").select(control.wants_detail(F.concat("t", F.lit(" why"))), control.wants_detail(F.concat("t", F.lit(" why")), words=True)).first()[:] == (False, True)


def test_completed_plans(spark):
    said = ["accident with the most deaths in the past 10 years", "last 1 years", "mkey: 55", "abc12ab123", "why ABC12AB123, mkey 7", "nothing of it", None]
    rows = spark.createDataFrame([(i, q, "search", ["zzz"] if i == 4 else None) for i, q in enumerate(said)], "i int, question string, goal string, requested_fields array<string>")
    plan = {r.i: r for r in planning.completed(rows, F.lit("2024-02-29").cast("date")).collect()}
    assert (plan[0].goal, plan[0].limit, plan[0].start_date, plan[0].end_date, plan[0].ranking_field, plan[0].needs_detail) == ("rank", 1, "2014-02-28", "2024-02-29", "fatalities", True)
    assert plan[1].start_date == "2023-02-28" and plan[1].goal == "search" and plan[1].requested_fields is None
    assert (plan[2].case_key, plan[2].intent, plan[2].goal) == (55, "detail", "lookup") and plan[3].case_number == "ABC12AB123"
    assert (plan[4].case_key, plan[4].case_number, plan[4].needs_detail) == (7, "ABC12AB123", True) and plan[4].requested_fields[-1] == "zzz" and "runway" in plan[4].requested_fields
    assert all(plan[5][n] == (None if n != "goal" else "search") for n in planning.PLAN) and plan[6].goal == "search"


def test_deepest_members(spark):
    rows = spark.createDataFrame([(0, json.dumps({"mkey": 1, "country": "AA", "x": {"country": "BB"}}))], "ordinal int, payload string")
    assert [normalizing.records(rows, deepest=d).first().country for d in (False, True)] == ["AA", "BB"]


def test_index_status(spark, index):
    cases, _ = index
    r = C.index_status(cases.withColumn("synced_at", F.lit("2024-01-01").cast("timestamp"))).first()
    assert r.cases == 3 and r.first_event <= r.last_event and r.last_synced_at == dt.datetime(2024, 1, 1)


def test_substrings_by_trigrams(spark, tmp_path):
    """The rows that ilike finds, for short, odd and wildcard needles; only the buckets of a needle's trigrams are read."""
    from corvane.operators import trigrams

    texts = ["Alpha Beach", "beta", "\u00c9tion N\u00f6rd", "100% sure", "a_b c", None, "", "xAlPHa", "ab", "\U0001f600 smile \U0001f600", "back\\slash", "\u0130stanbul", "alpXha"]
    df = spark.createDataFrame([(i, t, t[::-1] if t else t) for i, t in enumerate(texts)] + [(None, "alpha", None)], "k int, a string, b string")
    path = str(tmp_path / "index")
    trigrams.postings(df, "k", ["a", "b"]).write.partitionBy("bucket").parquet(path)
    index = spark.read.parquet(path)
    for needle in ("alpha", "ALP", "al", "", "\u00e9TION", "lp%a", "a_b", "_", "%", "100\\%", "\U0001f600 s", "zzz", "ahpla", "\u0130st", "slash", "l_ha"):
        for fields in (["a"], ["a", "b"]):
            want = df.where("(" + " or ".join(f"coalesce({f} ilike :p, false)" for f in fields).replace(":p", "'%" + needle.replace("\\", "\\\\") + "%'") + ") and k is not null")
            got = trigrams.containing(df, index, "k", fields, needle).where("k is not null")
            assert sorted(r.k for r in got.collect()) == sorted(r.k for r in want.collect()), needle
    plan = trigrams.containing(df, index, "k", ["a"], "alpha")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[-1][:200] + plan.split("PartitionFilters: [")[1][:200]
    assert trigrams.literal_runs("a%b\\%c_d") == ["a", "b%c", "d"] and trigrams.literal_runs("%_") == []


def test_trigrams_of_many_rows(spark, tmp_path, monkeypatch):
    """One block holds many keys; frequent trigrams and rare ones, with null keys, find what ilike finds."""
    from corvane.operators import trigrams

    df = spark.range(3000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("k"), F.concat(F.lit("Customer#"), F.format_string("%05d", F.col("id") % 97), F.when(F.col("id") % 500 == 3, "\u00c7a et l\u00e0").otherwise("")).alias("a")).coalesce(1)
    path = str(tmp_path / "index")
    trigrams.postings(df, "k", ["a"]).write.options(**trigrams.PAGES).parquet(path)
    index = spark.read.parquet(path)
    held = index.where("gram = 'cus'").select(F.size("keys").alias("n")).collect()
    assert sum(r.n for r in held) == 3000 and len(held) < 20 and index.count() < 12000
    for most in (0, 2000, 1 << 16):
        monkeypatch.setattr(trigrams, "MOST_KEYS", most)
        for needle in ("customer#0001", "R#%5", "\u00e7A ET", "nothing", "omer#00096\u00c7"):
            got = trigrams.containing(df, index, "k", ["a"], needle)
            want = df.where(F.col("a").ilike(f"%{needle}%"))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (most, needle)
    monkeypatch.setattr(trigrams, "SLICE_CHARS", 10)
    assert [(p.start, p.stop) for p in trigrams._parts(np.array([5, 5, 5, 20, 0, 1]))] == [(0, 2), (2, 3), (3, 4), (4, 6)] and not list(trigrams._parts(np.array([], int)))
    assert trigrams.blocks(["", "ab", "abab\0", "bab"])[0] == ["ab\0", "aba", "bab"]
    assert "Join" not in trigrams.containing(df, index, "k", ["a"], "al")._jdf.queryExecution().toString()
