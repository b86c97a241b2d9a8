"""Extraction by a language model as tables: prompts and answer schemas by task, a client with one more try after a bad
answer, a transport that replays, and what becomes of an answer. The transport is a plug; none is built in."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.govern import GuardError, unverified

#: The fields of each task's answer, as the columns that from_json reads.
SCHEMAS = {
    "project_extraction": (
        "projects array<struct<name:string,archetype_guess:string,location_text:string,announcer_name:string,is_public:boolean,scale_value:double,scale_unit:string,capex_inr_cr:double,stated_jobs:double,"
        "stated_completion_text:string,commitment_form_evidence:string,quoted_by:string,is_reannouncement:boolean,confidence:double,needs_location:boolean>>, document_type string, notes string"
    ),
    "commitment_hardness": "commitment_form string, evidence_quote string, modifiers array<string>, modifier_evidence map<string,string>, confidence double, ambiguity_note string",
    "entity_resolution": "matched_id string, match_type string, reasoning string, confidence double, suggested_new_record struct<name:string,aliases:array<string>>",
    "delivery_record": (
        "projects array<struct<name:string,announced_date:string,announced_capex_inr_cr:double,stated_completion:string,outcome:string,outcome_evidence:string,actual_completion:string,slip_months:double>>, "
        "total_announced_inr_cr double, total_deployed_inr_cr double, deployed_source string, coverage_note string, confidence double"
    ),
    "clearance_filing": (
        "proposal_number string, project_name string, proponent_name string, category string, latitude double, longitude double, land_area_ha double, capacity_value double, capacity_unit string, capex_inr_cr double, "
        "clearance_status string, status_date string, employment_direct double, employment_indirect double, confidence double, coord_source string, coord_all array<array<double>>"
    ),
    "change_monitoring": "is_material_change boolean, change_type string, proposed_updates map<string,string>, evidence_quote string, requires_human_review boolean, confidence double",
}
#: Fields that an answer must have.
REQUIRED = {
    "project_extraction": ("projects", "document_type"), "commitment_hardness": ("commitment_form", "evidence_quote", "confidence"), "entity_resolution": ("match_type", "reasoning", "confidence"),
    "delivery_record": ("projects", "total_announced_inr_cr", "deployed_source", "coverage_note", "confidence"), "clearance_filing": ("project_name", "proponent_name", "clearance_status", "confidence"),
    "change_monitoring": ("is_material_change", "evidence_quote", "requires_human_review", "confidence"),
}
#: What each task asks, and the variables of its text.
PROMPTS = {
    "project_extraction": ("List every infrastructure or investment project that the text announces. Archetypes: {archetypes}. Report what is said; leave out what is not. Published {pub_date} at {url}.\n\n{text}", ("archetypes", "pub_date", "url", "text")),
    "commitment_hardness": ("Which form of commitment does the text show for {project} by {announcer}, with the words that show it? Modifiers: {modifiers}\n\n{text}", ("project", "announcer", "modifiers", "text")),
    "entity_resolution": ("Which of these records is meant by {mentioned}? Answer null where that is not clear. Sentence: {sentence}\nRecords: {candidates}", ("mentioned", "sentence", "candidates")),
    "delivery_record": ("What became of what {name} announced? Announcements:\n{announcements}\n\nReports:\n{reports}", ("name", "announcements", "reports")),
    "clearance_filing": ("Read the clearance filing.\n\n{text}", ("text",)),
    "change_monitoring": ("Does the text of {doc_date} change anything material about this project? {project}\n\n{text}", ("doc_date", "project", "text")),
    "narrative": ("Write section {section} for {audience} in at most {n} words. Put [field.path] after every figure, a path into this result: {result}", ("section", "audience", "n", "result")),
}
SYSTEM = "Answer with one JSON object and nothing else. Never guess."
_FENCE = re.compile(r"^\s*```[a-z]*\s*|\s*```\s*$")


class ExtractionError(ValueError):
    """A task or a variable that is not known."""


def render(task: str, **variables: object) -> str:
    """The text of a task; a variable too few or too many raises."""
    if task not in PROMPTS:
        raise ExtractionError(f"no task {task}")
    text, names = PROMPTS[task]
    if set(names) != set(variables):
        raise ExtractionError(f"{task} takes {names}")
    return text.format(**variables)


def prompt_hash(task: str, model: str) -> str:
    """Version of a task's text and schema, and the model that answers."""
    return hashlib.sha256(json.dumps([PROMPTS[task][0], SCHEMAS.get(task), SYSTEM, model]).encode()).hexdigest()[:16]


@dataclass
class ReplayTransport:
    """Gives recorded answers in order, and keeps what was asked."""

    answers: list[str]
    calls: list[dict] = field(default_factory=list)

    def __call__(self, system: str, user: str, model: str) -> str:
        if not self.answers:
            raise AssertionError("no recorded answer is left")
        said = self.answers.pop(0)
        self.calls.append({"system": system, "user": user, "model": model, "answer": said})
        return said


def problem(task: str, said: str) -> str | None:
    """What is wrong with an answer, or None."""
    try:
        got = json.loads(_FENCE.sub("", said))
    except json.JSONDecodeError as e:
        return f"no JSON: {e}"
    if not isinstance(got, dict):
        return "no object"
    lost = [x for x in REQUIRED[task] if got.get(x) is None]
    if lost:
        return f"missing {lost}"
    sure = [got["confidence"]] if "confidence" in got else [x.get("confidence") for x in got["projects"] if isinstance(x, dict)] if task == "project_extraction" else []
    return next((f"confidence {x!r} is not between 0 and 1" for x in sure if not isinstance(x, (int, float)) or isinstance(x, bool) or not 0 <= x <= 1), None)


def ask(transport: Callable[[str, str, str], str], task: str, model: str, retries: int = 1, **variables: object) -> dict:
    """(task, prompt, model, answer, attempts, status, error): a bad answer is asked for again with what is wrong."""
    user, said, error = render(task, **variables), "", None
    for attempt in range(retries + 1):
        more = "" if error is None else f"\n\nThis is try {attempt + 1}, since the reply is not valid: {error}\nPlease send one JSON object that has the fields asked for, and no text beside it."
        said = transport(SYSTEM, user + more, model)
        error = problem(task, said)
        if error is None:
            break
    return {"task": task, "prompt": prompt_hash(task, model), "model": model, "answer": said, "attempts": attempt + 1, "status": "parsed" if error is None else "parse_failed", "error": error}


OUTCOME = "task string, prompt string, model string, answer string, attempts long, status string, error string"


def ask_all(docs: DataFrame, task: str, model: str, variables: list[str], make: Callable[[], Callable[[str, str, str], str]], retries: int = 1) -> DataFrame:
    """docs with the outcome of each row, asked for where the row is; make opens a transport in each task."""
    names = [x.split()[0] for x in OUTCOME.split(", ")]

    def run(batches):
        transport = make()
        for part in batches:
            got = [ask(transport, task, model, retries, **row) for row in part[variables].to_dict("records")]
            yield part.assign(**{n: [g[n] for g in got] for n in names})

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(run, f"{have}, {OUTCOME}")


def parsed(outcomes: DataFrame, task: str) -> DataFrame:
    """Outcomes with got, the answer by the task's schema; null where it failed."""
    bare = F.regexp_replace("answer", _FENCE.pattern, "")
    return outcomes.withColumn("got", F.when(F.col("status") == "parsed", F.from_json(bare, SCHEMAS[task])))


def confident_match(got: Column, threshold: float) -> Column:
    """A match that needs no reviewer: one record is named, and surely."""
    return F.coalesce(got["matched_id"].isNotNull() & (got["match_type"] != "none") & (got["confidence"] > threshold), F.lit(False))


def routed(outcomes: DataFrame, task: str, threshold: float) -> DataFrame:
    """Outcomes with confidence and decision: a failed answer never applies, a sure update applies, all else waits.

    Columns is_new and is_stage_change are read where there are such; new projects and changes of stage always wait.
    """
    rows = parsed(outcomes, task)
    least = lambda: F.array_min(F.transform("got.projects", lambda x: x["confidence"]))
    sure = least() if task == "project_extraction" else F.col("got.confidence")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in rows.columns else F.lit(False)
    rows = rows.withColumn("confidence", sure)
    waits = flag("is_new") | flag("is_stage_change") | F.coalesce(F.col("confidence") < threshold, F.lit(True))
    return rows.withColumn("decision", F.when(F.col("status") != "parsed", "parse_failed").when(waits, "pending").otherwise("auto_applied"))


def narrative(transport: Callable[[str, str, str], str], model: str, result: dict, section: str, audience: str, n: int) -> str:
    """A section's text, whose figures all refer to the result; anything else raises."""
    said = transport("", render("narrative", section=section, audience=audience, n=n, result=json.dumps(result, sort_keys=True)), model)
    bad = unverified(said, result)
    if bad:
        raise GuardError(f"unverified references {bad}")
    return said


def recorded(spark: SparkSession, outcomes: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(o[x.split()[0]] for x in OUTCOME.split(", ")) for o in outcomes], OUTCOME)
