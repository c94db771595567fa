"""Backends: profiles, requests, captured responses, and an optional HTTP connector.

A backend is a profile: a request template with placeholders, the path of the records in a response,
and a map of their fields. Responses are a table (run_id, question_id, status, body); capturing them
and scoring them are separate, so any number of runs is parsed in one plan.
"""

from __future__ import annotations

import copy
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import document_key

#: Seconds before the first, second and third retry.
BACKOFF = (0.5, 1.0, 2.0)


class ProfileError(ValueError):
    """A profile that can't be used."""


class RetrievalError(RuntimeError):
    """The backend says that it failed."""


class AuthError(RetrievalError):
    """The backend refuses the credentials; a run ends at once."""


class ResponseSchemaError(RetrievalError):
    """A response of another shape than the profile's."""


@dataclass
class Profile:
    name: str
    url_template: str
    request_template: dict
    records_path: str
    field_map: dict[str, str]
    auth: str = "none"
    success_path: str | None = None
    message_path: str | None = None
    supports_top_k: bool = True
    #: Fields of a record that must be a JSON object or array where they are given.
    shapes: dict[str, str] = field(default_factory=dict)
    source_sha256: str = ""
    extra: dict = field(default_factory=dict)


#: The record fields of the two response families, from which the built-in profiles are made.
SEGMENTS = {"document_name": "segment.document.name", "document_id": "segment.document_id", "chunk_id": "segment.id", "content": "segment.content", "relevance_score": "score", "server_top": "segment.position"}
FLAT = {"document_name": "documentName", "document_id": "documentId", "chunk_id": "chunkId", "content": "content", "relevance_score": "relevanceScore", "server_top": "top"}
#: A folder of further profiles, found by name as <name>.json.
PROFILE_DIR = "RETRIEVAL_PROFILE_DIR"


def _builtin() -> dict[str, dict]:
    model = {"search_method": "hybrid_search", "reranking_enable": False, "top_k": "{top_k}", "score_threshold_enabled": False, "score_threshold": None}
    shape = {"request_template": {"query": "{query}", "retrieval_model": model}, "records_path": "records", "field_map": SEGMENTS, "shapes": {"segment": "object", "child_chunks": "array"}}
    dataset = shape | {"url_template": "{base_url}/datasets/{dataset_id}/retrieve", "auth": "bearer"}
    console = shape | {"url_template": "{base_url}/datasets/{dataset_id}/hit-testing", "auth": "cookie"}
    flat = {"url_template": "{base_url}/retrieval/{dataset_id}", "request_template": {"query": "{query}", "datasetId": "{dataset_id}"}, "records_path": "content", "field_map": FLAT, "auth": "cookie", "success_path": "success", "message_path": "responseMessage", "supports_top_k": False}
    return {"segments-api": dataset, "segments-console": console, "segments-parentchild": dataset, "flat-content": flat}


def load_profile(name_or_path: str) -> Profile:
    """A built-in profile by name, one of the folder in RETRIEVAL_PROFILE_DIR, or one from a JSON file; its hash is kept."""
    known = _builtin()
    own = os.path.join(os.environ.get(PROFILE_DIR, ""), f"{name_or_path}.json")
    path = next((x for x in (name_or_path, own) if os.path.isfile(x)), None)
    if name_or_path in known:
        raw = json.dumps(known[name_or_path], sort_keys=True).encode()
        data = known[name_or_path] | {"name": name_or_path}
    elif path:
        with open(path, "rb") as f:
            raw = f.read()
        data = json.loads(raw)
    else:
        raise ProfileError(f"no such profile: {name_or_path}")
    missing = [k for k in ("name", "url_template", "request_template", "records_path", "field_map") if k not in data]
    if missing:
        raise ProfileError(f"{name_or_path}: missing {', '.join(missing)}")
    names = set(Profile.__dataclass_fields__)
    return Profile(**{k: v for k, v in data.items() if k in names and k != "source_sha256"}, source_sha256=hashlib.sha256(raw).hexdigest(), extra={k: v for k, v in data.items() if k not in names})


def build_request(profile: Profile, query: str, dataset_id: str, top_k: int) -> dict:
    """The template with its placeholders filled; a value that is a placeholder alone keeps the type. The template isn't changed."""
    values = {"query": query, "dataset_id": dataset_id, "top_k": top_k}

    def filled(x):  # noqa: ANN001, ANN202
        if isinstance(x, dict):
            return {k: filled(v) for k, v in x.items()}
        if isinstance(x, list):
            return [filled(v) for v in x]
        if isinstance(x, str):
            for k, v in values.items():
                if x == f"{{{k}}}":
                    return v
            for k, v in values.items():
                x = x.replace(f"{{{k}}}", str(v))
        return x

    return filled(copy.deepcopy(profile.request_template))


def segment_request(query: str, top_k: int, graph: bool = False, score_threshold_enabled: bool = False, score_threshold: float | None = None, search_method: str = "hybrid_search") -> dict:
    """A request to the segments' family. coverage_search is always reranked, and takes neither graph search nor a reranking mode or weights."""
    if search_method == "coverage_search" and graph:
        raise ValueError("coverage_search can't be used with graph search")
    if score_threshold is not None:
        score_threshold_enabled = True
    covered = search_method == "coverage_search"
    model = {
        "search_method": search_method,
        "reranking_enable": covered,
        "reranking_mode": None if covered else "weighted_score",
        "weights": None if covered else {"vector_setting": {"vector_weight": 0.7}, "keyword_setting": {"keyword_weight": 0.3}},
        "graph_search": None if covered else {"enable": graph},
        "top_k": top_k,
        "score_threshold_enabled": score_threshold_enabled,
        "score_threshold": score_threshold,
    }
    return {"query": query, "retrieval_model": model}


def build_headers(auth: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """Headers with credentials from the environment, which are never stored."""
    env = os.environ if env is None else env
    if auth == "none":
        return {}
    wanted = {"bearer": ("RETRIEVAL_API_KEY",), "cookie": ("RETRIEVAL_COOKIE", "RETRIEVAL_XSRF_TOKEN")}.get(auth)
    if wanted is None:
        raise ProfileError(f"unknown auth: {auth}")
    if lost := [k for k in wanted if not env.get(k)]:
        raise AuthError(f"not set: {', '.join(lost)}")
    if auth == "bearer":
        return {"Authorization": f"Bearer {env[wanted[0]]}"}
    return {"Cookie": env[wanted[0]], "X-XSRF-TOKEN": env[wanted[1]]}


def parsed(responses: DataFrame, profile: Profile) -> DataFrame:
    """The chunks of captured responses (run_id, question_id, body): rank is the response order, missing fields are empty.

    Bodies are taken apart as JSON text by the profile's paths, so that any profile has one plan.
    """
    path = "$." + profile.records_path
    each = responses.withColumn("__r", F.from_json(F.get_json_object("body", path), "array<string>")).select("*", F.posexplode("__r").alias("pos", "__record"))
    at = lambda name: F.get_json_object("__record", "$." + profile.field_map[name]) if name in profile.field_map else F.lit(None).cast("string")
    text = lambda name: F.coalesce(at(name), F.lit("")).alias(name)
    name = text("document_name")
    children = F.from_json(F.get_json_object("__record", "$.child_chunks"), "array<struct<id:string,position:int,score:double>>")
    return each.select(
        "run_id", "question_id", (F.col("pos") + 1).alias("rank"), (F.col("pos") + 1).alias("original_index"), F.coalesce(at("server_top").cast("int"), F.col("pos") + 1).alias("server_top"),
        at("relevance_score").cast("double").alias("score"), name, document_key(F.coalesce(at("document_name"), F.lit(""))).alias("document_key"), text("document_id"), text("chunk_id"), text("content"), children.alias("child_chunks"),
    )


def faults(responses: DataFrame, profile: Profile) -> DataFrame:
    """run_id, question_id, fault and message of responses that failed: of another shape (message: the field), or by their own word."""
    records = F.get_json_object("body", "$." + profile.records_path)
    ok = F.get_json_object("body", "$." + profile.success_path) if profile.success_path else F.lit("true")
    said = F.get_json_object("body", "$." + profile.message_path) if profile.message_path else F.lit(None).cast("string")
    begins = {"object": "{", "array": "["}
    listed = F.from_json(records, "array<string>")
    lacks = lambda name, shape: F.exists(listed, lambda r: ~F.coalesce(F.get_json_object(r, f"$.{name}"), F.lit(begins[shape])).startswith(begins[shape]))
    wrong = F.coalesce(*(F.when(lacks(n, k), n) for n, k in profile.shapes.items()), F.lit(None).cast("string"))
    schema = (
        F.when(F.col("body").isNull() | ~F.trim("body").startswith("{"), "body")
        .when(ok.isNull(), profile.success_path or "")
        .when((ok != "false") & (records.isNull() | ~F.trim(records).startswith("[")), profile.records_path)
        .when(ok != "false", wrong)
    )
    fault = F.when(schema.isNotNull(), "schema_error").when(ok == "false", "retrieval_error")
    return responses.select("run_id", "question_id", fault.alias("fault"), F.when(fault == "retrieval_error", said).otherwise(schema).alias("message")).where("fault is not null")


def checked(responses: DataFrame, profile: Profile) -> DataFrame:
    """responses (run_id, question_id, status, body) with the fault as the status of those that say ok but failed, and message."""
    bad = faults(responses.where("status = 'ok'"), profile)
    got = responses.drop("message").join(bad, ["run_id", "question_id"], "left")
    return got.withColumn("status", F.coalesce("fault", "status")).drop("fault")


def run_statuses(responses: DataFrame) -> DataFrame:
    """run_id and run_status: aborted_auth for a run in which the credentials were refused, else completed."""
    return responses.groupBy("run_id").agg(F.when(F.bool_or(F.col("status").isin("auth_error", "not_sent")), "aborted_auth").otherwise("completed").alias("run_status"))


def posted(send: Callable[[str, dict], tuple[int, str]], url: str, payload: dict, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON object of a POST. Network errors, 429 and 5xx are tried again; other 4xx aren't, and 401 and 403 end the run."""
    for attempt in range(retries + 1):
        try:
            status, body = send(url, payload)
        except OSError as e:
            if attempt == retries:
                raise RetrievalError(str(e)) from e
        else:
            if status in (401, 403):
                raise AuthError(f"HTTP {status}")
            if status < 400:
                try:
                    got = json.loads(body)
                except ValueError as e:
                    raise ResponseSchemaError("not JSON") from e
                if not isinstance(got, dict):
                    raise ResponseSchemaError("not a JSON object")
                return got
            if status != 429 and status < 500 or attempt == retries:
                raise RetrievalError(f"HTTP {status}")
        sleep(BACKOFF[min(attempt, len(BACKOFF) - 1)])
    raise RetrievalError("no attempt")


def captured(questions: DataFrame, profile: Profile, base_url: str, dataset_id: str, top_k: int, send: Callable[[str, dict], tuple[int, str]], run_id: str) -> DataFrame:
    """run_id, question_id, status, body, latency_ms of one request for each question; send must be importable on executors.

    Refused credentials are a status (auth_error), not an exception: what was answered before is kept,
    a task posts nothing more after it (not_sent), and Spark doesn't try the task again, which would
    post its questions twice. Write the table once, then read run_statuses().
    """
    url = profile.url_template.replace("{base_url}", base_url).replace("{dataset_id}", dataset_id)

    def work(batches: Iterator) -> Iterator:
        refused = False
        for pdf in batches:
            rows = []
            for q, text in zip(pdf["question_id"], pdf["question"], strict=True):
                began, body = time.time(), None
                if refused:
                    status = "not_sent"
                else:
                    try:
                        status, body = "ok", json.dumps(posted(send, url, build_request(profile, text, dataset_id, top_k)))
                    except AuthError as e:
                        refused, status, body = True, "auth_error", json.dumps({"error": str(e)})
                    except ResponseSchemaError as e:
                        status, body = "schema_error", json.dumps({"error": str(e)})
                    except RetrievalError as e:
                        status, body = "request_error", json.dumps({"error": str(e)})
                rows.append((run_id, q, status, body, (time.time() - began) * 1000))
            yield type(pdf)(rows, columns=["run_id", "question_id", "status", "body", "latency_ms"])

    return questions.select(F.col("question_id").cast("string").alias("question_id"), "question").mapInPandas(work, "run_id string, question_id string, status string, body string, latency_ms double")
