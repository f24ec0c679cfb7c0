"""Embedding, reranking and model-list services.

A transport is any callable (method, url, headers, body) -> (status, payload); tests and offline runs inject their own. Calls run inside tasks, a batch
of rows at a time, and nothing is sent anywhere unless a transport that does so is passed in.
"""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoflow.functions.text import suggested_tags

Transport = Callable[[str, str, dict, dict | None], tuple[int, object]]
DEFAULT_TIMEOUT_S = 60
CALLS_KEPT = 4
# Words by which services say that a batch is too large, that calls come too often, that a request is bad.
BATCH_WORDS = "batch|limit|exceed|too many|max(imum)?|数量|上限|超出"
RATE_WORDS = "rate ?limit|too many requests|限流|频率|tpm|rpm|qps"
CLIENT_WORDS = "bad request|invalid request"
# How the names of models tell what they are for.
EMBED_MODELS, RERANK_MODELS = "embed|bge|gte|(?<![A-Za-z0-9_])e5(?![A-Za-z0-9_])|e5-", "rerank"


class ServiceError(RuntimeError):
    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


class Aborted(RuntimeError):
    """The caller gave up; nothing is retried."""


def normal_base_url(value: str | None) -> str:
    """The address without trailing slashes, with /v1 unless it names a version or ends in /openai; '' for blank."""
    raw = (value or "").strip().rstrip("/")
    if not raw or re.search(r"/v1(?:beta)?(?:/|\Z)", raw, re.I) or re.search(r"/openai\Z", raw, re.I):
        return raw
    return f"{raw}/v1"


def base_url_column(value: Column) -> Column:
    raw = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "/+\\z", "")
    return F.when((raw == "") | raw.rlike("(?i)/v1(?:beta)?(?:/|\\z)") | raw.rlike("(?i)/openai\\z"), raw).otherwise(F.concat(raw, F.lit("/v1")))


def embedding_url(base: str | None) -> str:
    normal = normal_base_url(base)
    return f"{normal}/embeddings" if normal else ""


def api_error(payload: object, status: int) -> str:
    """The message of an error payload."""
    if payload is None:
        return f"API Error: {status}"
    if isinstance(payload, str):
        return payload
    error = payload.get("error") if isinstance(payload, dict) else None
    for found in (error.get("message") if isinstance(error, dict) else None, payload.get("message"), payload.get("msg")):
        if found:
            return found
    return f"{payload['code']}: " if payload.get("code") else f"API Error: {status}"


def is_batch_limit(error: object) -> bool:
    return re.search(BATCH_WORDS, str(error).lower()) is not None


def is_rate_limit(error: object) -> bool:
    return getattr(error, "status", None) == 429 or re.search(RATE_WORDS, str(error).lower()) is not None


def is_client_error(error: object) -> bool:
    status = getattr(error, "status", None) or 0
    return 400 <= status < 500 or re.search(r"(?:^|\D)4\d\d(?:\D|$)", str(error)) is not None or re.search(CLIENT_WORDS, str(error).lower()) is not None


def normal_embedding(value: object) -> list[float]:
    """The finite numbers of a vector, which may be wrapped as {values: [...]}."""
    raw = value.get("values") if isinstance(value, dict) else value
    out = []
    for x in raw if isinstance(raw, (list, tuple, np.ndarray)) else []:
        try:
            number = float(x)
        except (TypeError, ValueError):
            continue
        if math.isfinite(number):
            out.append(number)
    return out


@dataclass(frozen=True)
class EmbeddingService:
    transport: Transport
    base_url: str
    model: str
    api_key: str | None = None
    dimensions: int | None = None

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """One vector per text, in order; an error if a text is blank or the answer is incomplete or of unequal dimensions."""
        values = [(t or "").strip() for t in texts]
        if not values or not all(values):
            raise ValueError("texts to embed must not be empty")
        base = normal_base_url(self.base_url)
        if not base or not self.model.strip():
            raise ValueError("base URL and model are required")
        body: dict = {"model": self.model.strip(), "input": values}
        if self.dimensions:
            body["dimensions"] = round(self.dimensions)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key is not None else {})
        status, payload = self.transport("POST", f"{base}/embeddings", headers, body)
        if not 200 <= status < 300:
            raise ServiceError(api_error(payload, status), status)
        rows = payload.get("data") if isinstance(payload, dict) and isinstance(payload.get("data"), list) else []
        vectors = [normal_embedding(r.get("embedding")) for r in sorted(rows, key=lambda r: r.get("index") or 0)]
        if len(vectors) != len(values) or not all(vectors):
            raise ServiceError("the answer's vectors are incomplete")
        sizes = {len(v) for v in vectors}
        if len(sizes) > 1 or self.dimensions and sizes != {round(self.dimensions)}:
            raise ServiceError(f"unexpected dimensions: {sorted(sizes)}")
        return vectors


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic vectors from the texts' character n-grams, for tests and offline runs."""

    dims: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        rows = [np.frombuffer(f"\u0002{t}\u0003".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) for t in texts]
        out = []
        for cp in rows:
            with np.errstate(over="ignore"):
                gram = (cp[:-2] * np.uint64(961) + cp[1:-1] * np.uint64(31) + cp[2:] if len(cp) > 2 else cp) * np.uint64(0x9E3779B97F4A7C15)
            place, sign = (gram >> np.uint64(40)) % np.uint64(self.dims), np.where(gram >> np.uint64(63), 1.0, -1.0)
            out.append(np.bincount(place.astype(np.int64), sign, self.dims).tolist())
        return out


def embed_adaptive(texts: Sequence[str], service, batch_size: int = 8, sleep: Callable[[float], None] = time.sleep, progress: Callable[[int, int], None] | None = None) -> list[list[float]]:
    """Vectors of all texts that aren't blank, in batches that shrink when the service refuses them as too large.

    Only a client error that names a limit halves the batch, and that isn't a failure; what a server says of its own limits is waited out.
    Being limited in rate is tried up to eight times, other errors three times.
    """
    values = [t for t in ((t or "").strip() for t in texts) if t]
    size = max(1, min(16, round(batch_size or 8)))
    out: list[list[float]] = []
    failures = 0
    while len(out) < len(values):
        batch = values[len(out) : len(out) + size]
        try:
            out += service.embed(batch)
            failures = 0
            if progress:
                progress(len(out), len(values))
        except Aborted:
            raise
        except Exception as error:
            limited = is_rate_limit(error)
            if not limited and is_client_error(error) and is_batch_limit(error) and size > 1:
                size //= 2
                continue
            failures += 1
            if failures >= (8 if limited else 3):
                raise
            sleep(min(20.0, (2.0 if limited else 0.5) * 2 ** (failures - 1)))
    return out


def embed_rows(rows: DataFrame, text: str, service, out: str = "embedding", batch_size: int = 8) -> DataFrame:
    """The rows with ``out``, the vector of ``text``; null for blank texts. A column of that name is replaced.

    A task hands on its rows every ``CALLS_KEPT`` calls, so that what is downstream doesn't wait for a whole Arrow batch; write the result where it is read again.
    """
    names = [c for c in rows.columns if c != out]
    schema = rows.select(*names).schema.add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = CALLS_KEPT * max(1, min(16, round(batch_size or 8)))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            texts = batch.column(names.index(text)).to_pylist()
            filled = [i for i, t in enumerate(texts) if (t or "").strip()]
            vectors: list = [None] * len(texts)
            for i, vector in zip(filled, embed_adaptive([texts[i] for i in filled], service, batch_size)):
                vectors[i] = vector
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*names, out])

    return rows.select(*names).mapInArrow(run, schema)


@dataclass(frozen=True)
class RerankService:
    transport: Transport
    url: str
    model: str
    api_key: str | None = None
    flavour: str = "jina"
    top_n: int | None = None

    def request(self, query: str, documents: Sequence[str]) -> dict:
        if self.flavour == "dashscope":
            return {"model": self.model, "input": {"query": query, "documents": list(documents)}, "parameters": {"top_n": self.top_n or len(documents), "return_documents": False}}
        return {"model": self.model, "query": query, "documents": list(documents), "top_n": self.top_n or len(documents)}

    def rerank(self, query: str, documents: Sequence[str]) -> list[tuple[int, float]]:
        """(index, relevance) of the answer's rows that are well formed."""
        values = [d or "" for d in documents]
        if not (query or "").strip() or not values:
            return []
        if not self.url.strip():
            raise ValueError("no rerank URL")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key is not None else {})
        status, payload = self.transport("POST", self.url.strip(), headers, self.request(query, values))
        if not 200 <= status < 300:
            raise ServiceError(api_error(payload, status), status)
        body = payload if isinstance(payload, dict) else {}
        rows = (body.get("output") or {}).get("results") if self.flavour == "dashscope" else body.get("results")
        if not isinstance(rows, list):
            raise ServiceError("the answer has no results")
        out = []
        for row in rows:
            try:
                index, score = float(row.get("index")), float(row.get("relevance_score"))
            except (AttributeError, TypeError, ValueError):
                continue
            if index.is_integer() and math.isfinite(score):
                out.append((int(index), score))
        return out


def rerank_rows(ranked: DataFrame, service, text: str | None = None, query: str = "query_text") -> DataFrame:
    """query_id, index, relevance_score of a service for the ranked rows of every query; queries whose call fails have no rows.

    The documents are the column ``text``, by default a record's summary or, where it has none, its paragraph. A query's rows are as few
    as were ranked, so each is one group.
    """
    parts = [F.nullif(text or "summary", F.lit("")), *(["paragraph"] if text is None and "paragraph" in ranked.columns else []), F.lit("")]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["rank", "query_id", query, "_text"]).to_pylist(), key=lambda r: r["rank"])
        try:
            found = service.rerank(rows[0][query] or "", [r["_text"] for r in rows])
        except Aborted:
            raise
        except Exception:
            found = []
        return pa.table({"query_id": pa.array([rows[0]["query_id"]] * len(found), pa.int64()), "index": pa.array([i for i, _ in found], pa.int32()), "relevance_score": pa.array([s for _, s in found], pa.float64())})

    return ranked.select("query_id", "rank", query, F.coalesce(*parts).alias("_text")).groupBy("query_id").applyInArrow(run, "query_id long, index int, relevance_score double")


def suggest_tags(samples: DataFrame, ask: Callable[[str], str | None], known: Sequence[str] = ()) -> DataFrame:
    """conv_id, tags: the tag names that a model's reply to every conversation's sample names and the list doesn't hold yet.

    ``ask`` is called once per sample inside the tasks; null and blank samples, and calls that fail, give no tags.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for sample in batch.column("sample").to_pylist():
                try:
                    replies.append(ask(sample) if (sample or "").strip() else None)
                except Aborted:
                    raise
                except Exception:
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(replies, pa.string())], ["conv_id", "reply"])

    return samples.select("conv_id", "sample").mapInArrow(run, "conv_id long, reply string").select("conv_id", suggested_tags(F.col("reply"), known).alias("tags"))


def model_catalog(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Distinct model ids of model-list answers in JSON, sorted, with what they are good for: model, embeds, reranks."""
    schema = "data array<struct<id:string,name:string>>, models array<struct<id:string,name:string>>"
    rows = payloads.select(F.from_json(column, schema).alias("p")).select(F.explode(F.coalesce("p.data", "p.models")).alias("m"))
    ids = rows.select(F.coalesce(F.nullif("m.id", F.lit("")), F.nullif("m.name", F.lit(""))).alias("model")).where("model is not null").distinct()
    return ids.select("model", F.col("model").rlike(f"(?i){EMBED_MODELS}").alias("embeds"), F.col("model").rlike(f"(?i){RERANK_MODELS}").alias("reranks")).orderBy("model")


def models_for(catalog: DataFrame, use: str) -> DataFrame:
    """The models for ``use`` (embeds or reranks), or all where none is."""
    some = catalog.where(use)
    return catalog if some.isEmpty() else some


def error_column(payload: Column, status: Column) -> Column:
    """The message of error payloads in JSON; text that isn't a JSON object is the message itself."""
    get = lambda path: F.nullif(F.get_json_object(payload, path), F.lit(""))
    plain = F.when(~F.ltrim(payload).startswith("{"), payload)
    code = F.when(get("$.code").isNotNull(), F.concat(get("$.code"), F.lit(": ")))
    return F.coalesce(plain, get("$.error.message"), get("$.message"), get("$.msg"), code, F.concat(F.lit("API Error: "), status.cast("string")))


def http_transport(timeout: float = DEFAULT_TIMEOUT_S) -> Transport:
    """A transport over the network, for those who have services to call."""
    from urllib import error, request

    def call(method: str, url: str, headers: dict, body: dict | None) -> tuple[int, object]:
        data = json.dumps(body).encode() if body is not None else None
        try:
            with request.urlopen(request.Request(url, data, headers, method=method), timeout=timeout) as answer:
                return answer.status, json.loads(answer.read() or b"null")
        except error.HTTPError as failure:
            try:
                return failure.code, json.loads(failure.read() or b"null")
            except ValueError:
                return failure.code, None

    return call
