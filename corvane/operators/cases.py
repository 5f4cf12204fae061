"""Search over a structured case index: predicates, counting, ranking, nested assembly, rendering.

Tables: cases (one row per case_key), parties, events and findings (one row per case_key and
sequence). Predicates are built from a validated query on the driver, so that only set filters
reach the plan and all of them can be pushed to the scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import control, lexical

GOALS = ("lookup", "search", "count", "rank", "compare", "explain")
#: Fields that the text filter reads.
TEXT_FIELDS = ("case_number", "city", "location", "state", "country", "event_type", "severity", "investigation_status", "narrative", "probable_cause", "airport", "runway")
STALE_MINUTES = 60
DETAIL_FIELDS = ("probable_cause", "narrative", "events", "findings", "airport", "runway", "weather", "itinerary")


@dataclass
class CaseQuery:
    """A validated search. Unknown choices fall back; bad dates and keys raise ValueError."""

    intent: str = "search"
    case_number: str | None = None
    case_key: int | None = None
    registration: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    make: str | None = None
    model: str | None = None
    location: str | None = None
    state: str | None = None
    country: str | None = None
    severity: str | None = None
    event_type: str | None = None
    investigation_status: str | None = None
    text: str | None = None
    needs_detail: bool = False
    sort: str = "date_desc"
    limit: int = 10
    goal: str = "search"
    ranking_field: str | None = None
    ranking_order: str = "desc"
    requested_fields: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.goal = self._goal()
        for name, (default, *others) in CHOICES.items():
            if getattr(self, name) not in (default, *others):
                setattr(self, name, default)
        for name, read in READ.items():
            setattr(self, name, read(name, getattr(self, name)))

    def _goal(self) -> str:
        """The goal as given, or what the other settings tell where it is plain search or unknown."""
        known = self.goal in GOALS
        if known and self.goal != "search":
            return self.goal
        named = bool(self.intent == "detail" or self.case_number or self.case_key is not None)
        told = {"rank": bool(self.ranking_field), "lookup": named and not known, "count": self.intent == "count"}
        return next((g for g, holds in told.items() if holds), "search")


def _day(name: str, said) -> str | None:
    try:
        return dt.date.fromisoformat(str(said)).isoformat() if said else said
    except ValueError as error:
        raise ValueError(f"{name} is no date like 2024-01-31: {said}") from error


#: What a setting may be, the fallback first; and how others are read.
CHOICES = {
    "intent": ("search", "detail", "count"), "sort": ("date_desc", "date_asc"), "ranking_field": (None, "fatalities", "injuries", "date"), "ranking_order": ("desc", "asc"),
}
READ = {
    "limit": lambda _, n: clamp(int(n or 0), 1, 100, 10), "start_date": _day, "end_date": _day, "case_key": lambda _, k: None if k is None else int(k),
    "needs_detail": lambda _, x: bool(x), "requested_fields": lambda _, names: [str(n) for n in names or ()],
}


def _like(column: str, wanted: str) -> Column:
    """Case-insensitive substring; % and _ in what is wanted keep their meaning."""
    return F.col(column).ilike(f"%{wanted}%")


def severity_filter(wanted: str, strict: bool = False) -> Column:
    """Fatal also by number of deaths. "non-fatal" counts as fatal, as substrings go, unless strict."""
    fatal = "fatal" in wanted.lower() and not (strict and "non" in wanted.lower())
    if fatal:
        return _like("severity", "fatal") | (F.coalesce("fatalities", F.lit(0)) > 0)
    return _like("severity", wanted)


def predicates(query: CaseQuery, country_code: str | None = None, strict: bool = False) -> list[Column]:
    """The filters on cases that the query sets."""
    q, out = query, []
    if q.case_number:
        out.append(F.upper("case_number") == q.case_number.upper())
    if q.case_key is not None:
        out.append(F.col("case_key") == q.case_key)
    if q.start_date:
        out.append(F.col("event_date") >= F.lit(q.start_date).cast("date"))
    if q.end_date:
        out.append(F.col("event_date") <= F.lit(q.end_date).cast("date"))
    out += [_like(c, getattr(q, c)) for c in ("state", "event_type", "investigation_status") if getattr(q, c)]
    if q.location:
        out.append(_like("location", q.location) | _like("city", q.location))
    if q.country:
        out.append(F.col("country_code") == country_code if country_code else _like("country", q.country))
    if q.severity:
        out.append(severity_filter(q.severity, strict))
    if q.text:
        document = F.concat_ws(" ", *TEXT_FIELDS)
        out.append(lexical.matches_all(lexical.terms(document), lexical.query_terms(q.text)))
    return out


def matching(cases: DataFrame, parties: DataFrame | None, query: CaseQuery, country_code: str | None = None, strict: bool = False) -> DataFrame:
    """Cases that pass all filters. Registration, make and model are independent semi-joins: different parties may satisfy them."""
    for p in predicates(query, country_code, strict):
        cases = cases.where(p)
    wanted = [("registration", F.upper("registration").like(f"%{query.registration.upper()}%")) if query.registration else None]
    wanted += [(c, _like(c, getattr(query, c))) if getattr(query, c) else None for c in ("make", "model")]
    for _, condition in filter(None, wanted):
        cases = cases.join(parties.where(condition).select("case_key"), "case_key", "left_semi")
    return cases


def order_of(query: CaseQuery) -> list:
    """Rank by deaths or injuries (unknown last descending, first ascending), else by date; then key."""
    measure = {"fatalities": "fatalities", "injuries": "total_injuries"}.get(query.ranking_field)
    if query.goal == "rank" and measure:
        first = F.desc_nulls_last(measure) if query.ranking_order == "desc" else F.asc_nulls_first(measure)
        return [first, F.desc_nulls_last("event_date"), F.col("case_key")]
    down = query.ranking_order == "desc" if query.goal == "rank" and query.ranking_field == "date" else query.sort == "date_desc"
    return [F.desc_nulls_last("event_date") if down else F.asc_nulls_last("event_date"), F.col("case_key")]


def page(cases: DataFrame, query: CaseQuery) -> DataFrame:
    """The first `limit` cases in the query's order."""
    return cases.orderBy(*order_of(query)).limit(query.limit)


def nested(cases: DataFrame, parties: DataFrame, events: DataFrame | None = None, findings: DataFrame | None = None, extra_order: tuple[str, ...] = ()) -> DataFrame:
    """cases with arrays parties (structs), events and findings (texts), each by sequence, empty without children.

    Children are first narrowed to the cases at hand, then grouped; call it on a page.
    """
    keys = cases.select("case_key")
    fields = [c for c in parties.columns if c not in ("case_key", *extra_order)]

    def gathered(children: DataFrame, name: str, value: Column) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("sequence", *extra_order, value.alias("value")) if name == "parties" else F.struct("sequence", value.alias("value"))))
        grouped = children.join(keys, "case_key", "left_semi").groupBy("case_key").agg(items.alias(name))
        return grouped.select("case_key", F.transform(name, lambda x: x["value"]).alias(name))

    out = cases.join(gathered(parties, "parties", F.struct(*fields)), "case_key", "left")
    for children, name in ((events, "events"), (findings, "findings")):
        if children is not None:
            out = out.join(gathered(children, name, F.col("text")), "case_key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    kind = dict(out.dtypes)["parties"]
    return out.withColumn("parties", F.coalesce("parties", F.array().cast(kind)))


def party_names(parties: str | Column = "parties") -> Column:
    """Distinct "make model" names in sequence, joined by "; "."""
    names = F.transform(parties, lambda p: F.trim(F.concat_ws(" ", p["make"], p["model"])))
    return F.array_join(F.array_distinct(F.filter(names, lambda n: n != "")), "; ")


def with_detail_state(cases: DataFrame, details: DataFrame) -> DataFrame:
    """cases with detail_fetched_at and payload of the latest stored detail."""
    latest = details.groupBy("case_key").agg(F.max("fetched_at").alias("detail_fetched_at"), F.max_by("payload", "fetched_at").alias("payload"))
    return cases.join(latest, "case_key", "left")


def last_sync(*sources: DataFrame) -> DataFrame:
    """One row: the latest of the sources' single timestamp columns."""
    rows = sources[0].toDF("at")
    for s in sources[1:]:
        rows = rows.unionByName(s.toDF("at"))
    return rows.agg(F.max("at").alias("last_synced_at"))


def index_status(cases: DataFrame, synced: str = "synced_at") -> DataFrame:
    """One row: number of cases, first and last event date, and when the index was last synchronised."""
    return cases.agg(F.count("*").alias("cases"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"), F.max(synced).alias("last_synced_at"))


def is_stale(synced: Column, now: Column, minutes: int = STALE_MINUTES) -> Column:
    """Unknown, unreadable or older than so many minutes."""
    at = synced.cast("string").try_cast("timestamp")
    return F.coalesce(F.unix_seconds(now) - F.unix_seconds(at) > 60 * minutes, F.lit(True))


def truncated(goal: Column, total: Column, returned: Column) -> Column:
    return ~goal.isin("rank", "compare") & (total > returned)


#: Label and source of each line of a rendered case, in order (fixed values).
LINES = (
    ("Date", "event_date"), ("Aircraft", "names"), ("Registration", "registrations"), ("Location", "location"), ("City", "city"), ("State", "state"),
    ("Country", "country_shown"), ("Event time", "event_time"), ("Event type", "event_type"), ("Severity", "severity"), ("Fatalities", "fatalities"),
    ("Serious injuries", "serious_injuries"), ("Minor injuries", "minor_injuries"), ("Total injuries", "total_injuries"),
    ("Investigation status", "investigation_status"), ("Airport", "airport"), ("Runway", "runway"), ("Narrative", "narrative"),
    ("Probable cause", "probable_cause"), ("Events", "events_shown"), ("Findings", "findings_shown"), ("Source updated", "source_updated_at"),
    ("Indexed at", "synced_at"), ("Detail fetched at", "detail_fetched_at"),
)


def case_context(rows: DataFrame, source: str = "cases") -> DataFrame:
    """(case_key, text): labelled lines of each nested case, present fields only, under a header line."""
    have = set(rows.columns)
    made = {"country_shown": F.coalesce(*[F.col(c) for c in ("country_code", "country") if c in have]) if {"country_code", "country"} & have else None}
    if "parties" in have:
        made["names"] = party_names()
        fields = rows.schema["parties"].dataType.elementType.names
        if "registration" in fields:
            made["registrations"] = F.array_join(F.filter(F.transform("parties", lambda p: p["registration"]), lambda r: F.coalesce(r, F.lit("")) != ""), "; ")
    for name in ("events", "findings"):
        if name in have:
            made[f"{name}_shown"] = F.array_join(name, "; ")
    who = F.coalesce(F.nullif(F.col("case_number"), F.lit("")), F.col("case_key").cast("string"))
    lines = [F.concat(F.lit("Case: "), who)]
    for label, name in LINES:
        value = made.get(name) if name in made else F.col(name) if name in have else None
        if value is not None:
            text = value.cast("string")
            lines.append(F.when(text.isNotNull() & (text != ""), F.concat(F.lit(f"{label}: "), text)))
    header = F.concat(F.lit(f"[Source: {source} | Case: "), who, F.lit("]"))
    return rows.select("case_key", F.concat_ws("\n", header, *lines).alias("text"))


def context_items(texts: DataFrame, query: CaseQuery, total: int, synced: str | None) -> DataFrame:
    """(ordinal, text): rendered cases, preceded by a line about the index for counts, ranks and comparisons."""
    rows = texts.select(F.lit(1).alias("ordinal"), "text")
    spark = texts.sparkSession
    if query.goal == "count" or query.intent == "count":
        said = f"Index metadata: {total} matching cases were found. Last sync: {synced or 'unknown'}."
    elif query.goal in ("rank", "compare"):
        field_ = query.ranking_field or "date" if query.goal == "rank" else "date"
        said = f"Index metadata: cases selected from {total} matching cases by {field_}, order {query.ranking_order}. Last sync: {synced or 'unknown'}."
    else:
        return rows
    return spark.createDataFrame([(0, said)], "ordinal int, text string").unionByName(rows)


def needs_refresh(query: CaseQuery) -> Column:
    """Whether a selected case's detail must be fetched: forced, or never fetched and a requested field is empty."""
    if query.needs_detail:
        return F.lit(True)
    wanted = set(query.requested_fields) & set(DETAIL_FIELDS)
    checks = [F.lit(True) for c in ("weather", "itinerary") if c in wanted]
    checks += [F.coalesce(F.col(c), F.lit("")) == "" for c in ("probable_cause", "narrative", "airport", "runway") if c in wanted]
    checks += [F.coalesce(F.size(c), F.lit(0)) <= 0 for c in ("events", "findings") if c in wanted]
    any_empty = F.lit(False)
    for c in checks:
        any_empty = any_empty | c
    return F.col("detail_fetched_at").isNull() & any_empty


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """A requested number within its limits: documents 1 to 10, cases up to 10, details up to 3."""
    return min(high, max(low, int(value or default)))


def shaped_evidence(rows: DataFrame, prefix: str, order: list, partition: list[str]) -> DataFrame:
    """rows with evidence_id, numbered in order within each question."""
    place = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("evidence_id", control.evidence_id(prefix, place))


def detail_requests(evidence: DataFrame, question: str = "question", most: int = 3, words: bool = False) -> DataFrame:
    """(question_id, ordinal, identifier): the first distinct cases of each question for which live detail may be fetched.

    evidence: question_id, question, ordinal, case_number, case_key, record_id, text. Questions that
    ask for counts or ranks, or for no detail, get none.
    """
    who = F.coalesce(F.nullif(F.col("case_number"), F.lit("")), F.col("case_key").cast("string"), F.col("record_id"))
    rows = evidence.withColumn("identifier", who).where(control.wants_detail(F.col(question), words=words) & control.may_fetch(F.col("identifier"), F.col("text")))
    first = rows.groupBy("question_id", "identifier").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("ordinal", "identifier"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("question_id", "ordinal", "identifier")
