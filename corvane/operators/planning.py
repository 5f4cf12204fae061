"""Plans of case searches, completed by what their questions plainly ask for.

One projection over a table of questions: each setting of a plan has a list of conditions with
values, the first that holds wins, and without one the plan's own setting stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import control, values

#: What asks for the deadliest case, for past years, for a case by its key, and for a whole
#: case; and the fields that are then requested.
DEADLIEST = r"(?:most|more|highest|greatest|max(?:imum)?|largest|más|mayor|máximo).{0,40}(?:death|fatal|victim|casualt|muert|fallecid|víctim)"
PAST_YEARS = r"(?:past|last|últimos|ultimos|últimas|ultimas)\s+(\d+)\s+(?:years?|años)"
DECADE = ("last decade", "última década", "ultima decada")
KEY = r"(?U)\bmkey\s*[:#]?\s*(\d+)\b"
WHOLE_CASE = (
    r"\b(?:complete|full|detailed?)\b.{0,40}\b(?:summary|context|details?|report|case|accident|incident)\b",
    r"\b(?:summary|context|details?|report)\b.{0,40}\b(?:complete|full|detailed?)\b",
    r"\b(?:everything|all)\b.{0,40}\b(?:important|details?|information|context)\b",
    r"\b(?:tell|explain|detail|summari[sz]e)\b.{0,40}\b(?:everything|important|details?|accident|incident|case)\b",
    r"\b(?:resumen|detalle|detallame|detállame|explicame|explícame)\b.{0,40}\b(?:completo|todo|importante|accidente|incidente|caso)\b",
    r"\b(?:todo|toda|todos|todas)\b.{0,40}\b(?:importante|informaci[oó]n|contexto|detalles?)\b",
    r"\b(?:causa|causas|caus[óo]|why|cause|probable cause|findings?|hallazgos?)\b",
)
RANK_FIELDS = ("case", "date", "aircraft", "location", "fatalities", "probable_cause", "findings", "events", "narrative")
FULL_FIELDS = (
    "case", "date", "aircraft", "registration", "location", "country", "severity", "injuries", "fatalities", "narrative",
    "probable_cause", "findings", "events", "airport", "runway", "weather", "itinerary",
)
#: Settings of a plan.
PLAN = {
    "intent": "string", "goal": "string", "ranking_field": "string", "ranking_order": "string", "needs_detail": "boolean", "limit": "int", "start_date": "string",
    "end_date": "string", "case_number": "string", "case_key": "long", "requested_fields": "array<string>",
}


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))


def completed(plans: DataFrame, today: Column, question: str = "question") -> DataFrame:
    """plans (any columns, some of PLAN among them) with all settings of PLAN, completed; today is a date."""
    plans = plans.withColumns({n: F.lit(None).cast(t) for n, t in PLAN.items() if n not in plans.columns})
    text = F.lower(F.col(question))
    deadliest = _says(text, DEADLIEST)
    years = F.when(control.has_any(text, DECADE), 10).otherwise(F.regexp_extract(text, PAST_YEARS, 1).try_cast("int"))
    since = values.years_before(today, years).cast("string")
    number = F.nullif(F.upper(F.regexp_extract(question, control.CASE_NUMBER, 0)), F.lit(""))
    key = F.regexp_extract(text, KEY, 1).try_cast("long")
    whole = F.coalesce(F.col("needs_detail"), F.lit(False)) | deadliest | _says(text, "(?U)" + "|".join(f"(?:{p})" for p in WHOLE_CASE))
    named, dated = number.isNotNull() | key.isNotNull(), F.coalesce(years > 0, F.lit(False))
    fields = lambda some: F.array(*map(F.lit, some))
    none = F.array().cast("array<string>")
    asked = F.concat(F.coalesce("requested_fields", none), F.when(deadliest, fields(RANK_FIELDS)).otherwise(none), fields(FULL_FIELDS))
    rules = {
        "intent": [(named, F.lit("detail"))],
        "goal": [(named, F.lit("lookup")), (deadliest, F.lit("rank"))],
        "ranking_field": [(deadliest, F.lit("fatalities"))],
        "ranking_order": [(deadliest, F.lit("desc"))],
        "limit": [(deadliest, F.lit(1))],
        "start_date": [(dated, since)],
        "end_date": [(dated, today.cast("string"))],
        "case_number": [(number.isNotNull(), number)],
        "case_key": [(key.isNotNull(), key)],
        "needs_detail": [(whole, F.lit(True))],
        "requested_fields": [(whole, F.array_sort(F.array_distinct(asked)))],
    }
    return plans.withColumns({n: F.coalesce(*(F.when(c, v) for c, v in found), F.col(n)) for n, found in rules.items()})
