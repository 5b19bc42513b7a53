"""Model calls behind a protocol. A provider answers (stage, request) with JSON; requests and answers are rows. Answers are written by the
request's hash before anything reads them, and those already written are not asked for again (pipeline.Run.ask).

`Offline` answers by plain rules, deterministically, for tests and dry runs; `Replay` answers from recorded rows; `Hosted` asks a model
over HTTP. Other providers only have to implement __call__ and be picklable."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schemas

#: Names in the answers of each stage.
FUNCTIONS = ("setup", "claim", "definition", "evidence", "turning_point", "consequence", "objection", "interpretation", "conclusion", "transition", "supporting")
FORMS = ("argumentative", "historical_investigative_narrative", "biography_memoir", "technical_explanatory", "case_based_policy_business", "mixed")
KINDS = ("central_question", "essential_term", "major_proposition", "supporting_argument", "evidence", "qualification", "objection", "response", "conclusion", "context")
RELATIONS = ("defines", "supports", "qualifies", "objects_to", "responds_to", "concludes_from")
RUBRIC = ("unity", "term", "proposition", "support", "objection", "conclusion", "dependency", "necessity", "importance", "turning", "density", "readability", "redundancy", "detail", "context")

#: Answers' schemas by stage.
SCHEMAS = {
    "overview": "form string, central_question string, thesis string, overview string, priorities array<struct<section_id: string, priority: string>>",
    "analysis": "role string, contribution string, terms array<string>, propositions array<string>",
    "map": "problem string, unity string, requirements array<struct<requirement_id: string, kind: string, description: string, importance: string, claims: array<string>, sections: array<string>, must: boolean>>, "
    "relations array<struct<source: string, target: string, relation: string>>, path array<string>",
    "nominate": "blocks array<struct<paragraph_ids: array<string>, block_function: string, covers: array<string>, terms: array<string>, supports: array<string>, requires: array<string>, reason: string, importance: string, themes: array<string>, redundancy_risk: string>>",
    "score": f"scores array<struct<block_id: string, {', '.join(f'{r}: int' for r in RUBRIC)}, redundant_with: array<string>, rationale: string>>",
    "review": "assessment string, remove_ids array<string>, add_ids array<string>, missing array<string>, unsupported array<string>, undefined array<string>, notes array<struct<before_id: string, note: string>>",
    "bridge": "bridges array<struct<before_id: string, after_id: string, kind: string, text: string, necessary: boolean, grounding_blocks: array<string>, grounding_requirements: array<string>>>",
    "check": "checks array<struct<before_id: string, after_id: string, grounded: boolean, new_claim: boolean, impersonates: boolean, wordy: boolean, approved_text: string, reason: string>>",
}

#: Rules for single fields of the answers: the words they may be, or their bounds.
LEVELS, WEIGHTS = ("high", "medium", "low"), ("essential", "important", "contextual")
RULES: dict[str, dict[str, tuple]] = {
    "overview": {"form": FORMS, "priorities.priority": LEVELS},
    "map": {"requirements.kind": KINDS, "requirements.importance": WEIGHTS, "relations.relation": RELATIONS},
    "nominate": {"blocks.block_function": FUNCTIONS, "blocks.redundancy_risk": LEVELS},
    "score": {f"scores.{r}": (0, 3 if r in ("readability", "context") else 5) for r in RUBRIC},
}

#: What each stage asks of a model, in short; a provider for a hosted model sends it with the request.
INSTRUCTIONS = {
    "overview": "Name the kind of nonfiction, its governing question and thesis, and rate the sections' priority. Return metadata only.",
    "analysis": "Say what this part of the book does in its argument: terms, propositions, support. Do not quote.",
    "map": "Join the analyses into requirements (with ids), their relations and the shortest complete reading path.",
    "nominate": "Nominate passages by paragraph id that meet the section's requirements, about as many words as asked for.",
    "score": "Rate each passage on the rubric's scales and name passages it repeats.",
    "review": "Review the selection: removals, additions, requirements left out, notes on continuity.",
    "bridge": "Write a brief bridge only where a gap needs one, grounded in the passages on either side.",
    "check": "Check each bridge: grounded, no new claim, not in the author's voice, not wordy; return the approved text.",
}


#: What to look for in a book of each form; unknown forms count as mixed.
GUIDANCE = {
    "argumentative": "Follow the claim: what is asserted, on which grounds, and against which objections.",
    "historical_investigative_narrative": "Follow events and evidence: turning points, causes, consequences, and how the author knows.",
    "biography_memoir": "Follow a life: formative scenes, changes of course, and what the person made of them.",
    "technical_explanatory": "Follow the explanation: terms before their use, mechanisms step by step, limits of validity.",
    "case_based_policy_business": "Follow the cases: the problem, what was tried, what came of it, and the lesson drawn.",
    "mixed": "Follow whichever thread the section serves, and keep the joints between threads.",
}


def guidance(form: Column) -> Column:
    out = F.lit(GUIDANCE["mixed"])
    for name, words in GUIDANCE.items():
        out = F.when(form == name, words).otherwise(out)
    return out


class Provider(Protocol):
    def __call__(self, stage: str, request: dict[str, Any]) -> str: ...


class Replay:
    """Answers recorded as {hash of the request: answer}."""

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = answers

    def __call__(self, stage: str, request: dict[str, Any]) -> str:
        import hashlib

        return self.answers[hashlib.sha256(json.dumps([stage, request], sort_keys=True, ensure_ascii=False).encode()).hexdigest()]


class Hosted:
    """Asks a model over HTTP: POST {model, instructions, input, schema} to an endpoint that answers with the stage's JSON, bare or in a field
    `output`. The key comes from the environment variable that key_variable names, on the executors, if it is set there."""

    def __init__(self, model: str, endpoint: str, key_variable: str = "LAPIDARY_KEY", seconds: float = 120.0) -> None:
        self.model, self.endpoint, self.key_variable, self.seconds = model, endpoint, key_variable, seconds

    def __call__(self, stage: str, request: dict[str, Any]) -> str:
        import os
        import urllib.request

        body = {"model": self.model, "instructions": INSTRUCTIONS[stage], "input": request, "schema": SCHEMAS[stage]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[self.key_variable]}"} if self.key_variable in os.environ else {})
        asked = urllib.request.Request(self.endpoint, json.dumps(body, ensure_ascii=False).encode(), headers)
        with urllib.request.urlopen(asked, timeout=self.seconds) as answer:
            found = json.loads(answer.read())
        found = found.get("output", found) if isinstance(found, dict) else found
        return found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)


class Offline:
    """Plain rules instead of a model."""

    def __call__(self, stage: str, request: dict[str, Any]) -> str:
        return json.dumps(getattr(self, f"_{stage}")(request), ensure_ascii=False)

    @staticmethod
    def _overview(r: dict) -> dict:
        s = r["sections"]
        return {"form": "mixed", "central_question": r["title"], "thesis": "", "overview": f"{len(s)} sections", "priorities": [{"section_id": x["section_id"], "priority": "high" if x["kind"] in ("front", "ending") else "medium"} for x in s]}

    @staticmethod
    def _analysis(r: dict) -> dict:
        return {"role": "development", "contribution": f"{r['section_id']}: {len(r['paragraphs'])} paragraphs", "terms": [], "propositions": [r["section_id"]]}

    @staticmethod
    def _map(r: dict) -> dict:
        ids = list(dict.fromkeys(a["section_id"] for a in r["analyses"]))
        main = [{"requirement_id": f"P-{s}", "kind": "major_proposition", "description": f"what {s} says", "importance": "essential", "claims": [s], "sections": [s], "must": i in (0, len(ids) - 1)} for i, s in enumerate(ids)]
        support = [{"requirement_id": f"S-{s}", "kind": "supporting_argument", "description": f"support in {s}", "importance": "important", "claims": [s], "sections": [s], "must": False} for s in ids]
        return {"problem": r["title"], "unity": f"{len(ids)} sections", "requirements": main + support, "relations": [], "path": [f"P-{s}" for s in ids]}

    @staticmethod
    def _nominate(r: dict) -> dict:
        used, blocks = 0, []
        for i, p in enumerate(r["paragraphs"]):
            if used >= r["words"] or i % 4 == 3:
                continue
            tags = [t for t in r["requirements"] if t.startswith("P-" if i % 2 == 0 else "S-")]
            blocks.append({"paragraph_ids": [p["paragraph_id"]], "block_function": FUNCTIONS[i % len(FUNCTIONS)], "covers": tags, "terms": [], "supports": [], "requires": [], "reason": "by position", "importance": "major", "themes": [], "redundancy_risk": "low"})
            used += p["word_count"]
        return {"blocks": blocks}

    @staticmethod
    def _score(r: dict) -> dict:
        scores = []
        for b in r["blocks"]:
            n = b["word_count"]
            scores.append({"block_id": b["block_id"]} | {k: (n + i) % 4 for i, k in enumerate(RUBRIC[:12])} | {"redundancy": 0, "detail": 0, "context": 0, "redundant_with": [], "rationale": ""})
        return {"scores": scores}

    @staticmethod
    def _review(r: dict) -> dict:
        return {"assessment": f"{len(r['chosen'])} passages kept", "remove_ids": [], "add_ids": [a["block_id"] for a in r["alternatives"][:1]], "missing": [], "unsupported": [], "undefined": [], "notes": []}

    @staticmethod
    def _bridge(r: dict) -> dict:
        return {"bridges": [{"before_id": p["before_id"], "after_id": p["after_id"], "kind": "continuity", "text": "The text goes on.", "necessary": i % 3 == 0, "grounding_blocks": [p["after_id"]], "grounding_requirements": []} for i, p in enumerate(r["pairs"])]}

    @staticmethod
    def _check(r: dict) -> dict:
        return {"checks": [{"before_id": b["before_id"], "after_id": b["after_id"], "grounded": True, "new_claim": False, "impersonates": False, "wordy": False, "approved_text": b["text"], "reason": ""} for b in r["bridges"]]}


def request_hash(stage: str, request: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(stage), request), 256)


def answers(requests: DataFrame, stage: str, provider: Callable[[str, dict], str], retries: int, known: DataFrame | None = None) -> DataFrame:
    """requests (book_id, seq, request: JSON) to (hash, answer, error), one row a request text. Requests whose hash is known (hash, answer) are not
    asked. Failed or unparsable answers are tried again after min(2**n, 10) seconds; the last error is kept, not raised."""
    rows = requests.select(request_hash(stage, F.col("request")).alias("hash"), "request").dropDuplicates(["hash"])
    if known is not None:
        rows = rows.join(known.where("answer IS NOT NULL").select("hash"), "hash", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                answer, error = None, None
                for n in range(1, retries + 1):
                    try:
                        answer = provider(stage, json.loads(r.request))
                        json.loads(answer)
                        error = None
                        break
                    except Exception as e:
                        answer, error = None, f"{type(e).__name__}: {e}"
                        if n < retries:
                            time.sleep(min(2**n, 10))
                out.append((r.hash, answer, error))
            yield pd.DataFrame(out, columns=["hash", "answer", "error"])

    return rows.repartition("hash").mapInPandas(ask, "hash string, answer string, error string")


def answered(requests: DataFrame, stage: str, known: DataFrame) -> DataFrame:
    """(book_id, seq, answer) of the requests that known (hash, answer) answers."""
    once = known.where("answer IS NOT NULL").groupBy("hash").agg(F.min("answer").alias("answer"))
    return requests.withColumn("hash", request_hash(stage, F.col("request"))).join(once, "hash").select("book_id", "seq", "answer")


def parsed(found: DataFrame, stage: str) -> DataFrame:
    """(book_id, seq, a: struct) of the answers that fit the stage's schema."""
    return found.select("book_id", "seq", F.from_json("answer", SCHEMAS[stage]).alias("a")).where("a IS NOT NULL")


def schema_faults(found: DataFrame, stage: str) -> DataFrame:
    """(book_id, seq, path, fault) of the answers: what the stage's schema and rules do not allow, at any depth."""
    return schemas.checked(found.select("book_id", "seq", "answer"), SCHEMAS[stage], RULES.get(stage))


def sound_scores(scores: DataFrame) -> DataFrame:
    """Scores within the rubric's bounds: 0 to 5, readability and context 0 to 3."""
    ok = F.lit(True)
    for r in RUBRIC:
        ok = ok & F.col(r).between(0, 3 if r in ("readability", "context") else 5)
    return scores.where(ok)
