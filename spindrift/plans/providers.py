"""Models behind interfaces, called in batches from Spark tasks; deterministic ones for tests."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Model(Protocol):
    def complete(self, prompt: str, phase: str) -> str: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


#: Words whose slots a batch of texts remembers.
WORDS_HELD = 1 << 16


class HashEmbedder:
    """Words hashed to signed slots, unit length: no model, but similar texts are near. A word is hashed once as long as it is remembered."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        slots: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(texts):
            row = [0] * self.size
            for w, n in Counter(t.lower().split()).items():
                at = slots.get(w)
                if at is None:
                    if len(slots) >= WORDS_HELD:
                        slots.clear()
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    at = slots[w] = h % self.size, 1 if h >> 63 else -1
                row[at[0]] += at[1] * n
            out[i] = row
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


class WordModel:
    """Finds every capitalised word as an entity and relates neighbours: no model, but graphs of it can be checked by hand."""

    def complete(self, prompt: str, phase: str) -> str:
        body = prompt.split("\n\n")[2 if phase == "extraction" else 2 if phase == "query_keywords" else -1 :]
        if phase == "query_keywords":
            words = " ".join(body).split()
            return json.dumps({"low_level": [w for w in words if w[0].isupper()], "high_level": [w for w in words if not w[0].isupper()]})
        if phase != "extraction":
            return "NOTHING" if phase == "gleaning" else json.dumps({"score": 1.0, "justification": phase})
        blocks = re.findall(r'\[DOC \d+ id="(.*?)"\]\n(.*?)\n\[/DOC', "\n\n".join(body), re.S)
        found = [{"doc_id": i} | self._found(t) for i, t in blocks]
        return json.dumps({"documents": found} if blocks else self._found(" ".join(body)))

    @staticmethod
    def _found(text: str) -> dict:
        words = text.split()
        names = [w for w in words if w[0].isupper()]
        return {
            "entities": [{"name": n, "type": "concept", "description": f"about {n}"} for n in names],
            "relations": [{"source": a, "target": b, "relation": "next to", "description": ""} for a, b in zip(names, names[1:], strict=False)],
            "high_level_keywords": [w for w in words if not w[0].isupper()],
        }


class LetterEmbedder:
    """Shares of the letters a to z in a lower-cased text: no model, and any database can compute the same."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            low = t.lower()
            counts = [float(low.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]
            norm = sum(x * x for x in counts) ** 0.5
            out.append([x / norm for x in counts] if norm else counts)
        return out


class LengthModel:
    """Repeats the question, and judges by the length of the prompt, in tenths; refuses to judge lengths that end in 0."""

    def complete(self, prompt: str, phase: str) -> str:
        if phase != "judge":
            return prompt.split("QUESTION: ")[-1].split("\n")[0]
        n = len(prompt) % 11
        return json.dumps({"score": n / 10, "justification": phase}) if n else "no opinion"


class CaseModel:
    """Answers of several kinds, by the number at the prompt's end: 1 no JSON, 2 JSON after other words, else JSON alone."""

    def complete(self, prompt: str, phase: str) -> str:
        words = ["a", "x" * 81, "same", "SAME", *(f"theme{i}" for i in range(12))]
        whole = json.dumps({"entities": [{"name": "Thing"}], "relations": [], "high_level_keywords": words})
        return {"1": "nothing to say", "2": f"Here it is: {whole}"}.get(prompt[-1], whole)


class BrokenEmbedder:
    def embed(self, texts: list[str]) -> list[list[float]]:
        raise ValueError("out of order")


class LengthReranker:
    """Longer texts are better; without a question there is no answer."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        if not query:
            raise ValueError("no question")
        return [float(len(t)) for t in texts]


class EchoModel:
    """Answers with the digest of its prompt as a judge's score."""

    def complete(self, prompt: str, phase: str) -> str:
        n = hashlib.blake2b(prompt.encode(), digest_size=1).digest()[0]
        return f'{{"score": {n / 255:.3f}, "justification": "{phase}"}}'


class OverlapReranker:
    def scores(self, query: str, texts: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(t.lower().split())) / max(1, len(q)) for t in texts]


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


@dataclass
class HttpEmbedder:
    """The embeddings endpoint that most model servers share; texts go in batches, rows come back by their index."""

    url: str
    model: str
    batch: int = 50
    timeout: float = 120.0
    attempts: int = 3

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list = []
        for i in range(0, len(texts), self.batch):
            some = texts[i : i + self.batch]
            for n in range(self.attempts):
                try:
                    rows = _post(f"{self.url}/embeddings", {"model": self.model, "input": some}, self.timeout)["data"]
                    break
                except (OSError, ValueError, KeyError):
                    if n + 1 == self.attempts:
                        raise
                    time.sleep(2**n)
            if len(rows) != len(some):
                raise ValueError(f"{len(rows)} embeddings for {len(some)} texts")
            out += [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
        return out


@dataclass
class HttpModel:
    """The chat endpoint; an answer that is all reasoning is asked for again with twice the tokens, up to ``most_tokens``."""

    url: str
    model: str
    temperature: float = 0.1
    tokens: int = 4096  # of one document; ``scaled`` asks for more
    most_tokens: int = 32_768
    timeout: float = 120.0

    def scaled(self, factor: int) -> HttpModel:
        """The same model with room for ``factor`` answers, three at most."""
        return replace(self, tokens=self.tokens * min(factor, 3))

    def complete(self, prompt: str, phase: str) -> str:
        tokens = self.tokens
        while True:
            body = {"model": self.model, "temperature": self.temperature, "max_tokens": tokens, "messages": [{"role": "user", "content": prompt}]}
            text = _post(f"{self.url}/chat/completions", body, self.timeout)["choices"][0]["message"].get("content") or ""
            kept = re.sub(r"(?s)<think>.*?(</think>|$)", "", text).strip()
            if kept:
                return kept
            if tokens >= self.most_tokens:
                raise ValueError("the answer holds no text but reasoning")
            tokens = min(2 * tokens, self.most_tokens)


@dataclass
class HttpReranker:
    url: str
    model: str
    timeout: float = 120.0

    def scores(self, query: str, texts: list[str]) -> list[float]:
        body = {"model": self.model, "query": {"text": query}, "passages": [{"text": t} for t in texts]}
        found = {r["index"]: r["logit"] for r in _post(f"{self.url}/ranking", body, self.timeout)["rankings"]}
        return [found.get(i, 0.0) for i in range(len(texts))]


#: Calls of a model at once, over all tasks.
CONCURRENCY = 32
CALL = "answer string, error string, queue_ms double, llm_ms double, total_ms double, retries int"


def spelled(error: BaseException) -> str:
    return f"{type(error).__name__}: {str(error) or repr(error)}"


def embed_column(rows: DataFrame, text: str, embedder: Embedder, out: str = "vector", error: str | None = None) -> DataFrame:
    """``rows`` with the embedding of a text column, a batch at a time. A failing call fails the plan, or is told in the column ``error``, if that is named."""

    @F.pandas_udf("struct<vector:array<double>,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            try:
                yield pd.DataFrame({"vector": list(embedder.embed(texts.fillna("").tolist())), "error": None}, index=texts.index)
            except Exception as e:
                if error is None:
                    raise
                yield pd.DataFrame({"vector": None, "error": spelled(e)}, index=texts.index)

    told = rows.withColumn("_e", run.asNondeterministic()(F.col(text))).withColumn(out, F.col("_e.vector"))
    return (told.withColumn(error, F.col("_e.error")) if error else told).drop("_e")


def complete_column(rows: DataFrame, prompt: str, model: Model, phase: str, parallel: int | None = None, attempts: int = 4, backoff: float = 1.0, timeout: float | None = None, scale: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``CALL``: ``parallel`` calls a task, each tried again with growing pauses. A null prompt is not sent.

    Without ``parallel`` the tasks that run at once share ``CONCURRENCY`` calls. queue_ms is the wait for a free place, llm_ms the
    time at the model, total_ms both; null where a call did not come so far. With ``timeout`` (seconds from submission, waiting included) a call that
    is not back by then has the error ``timeout``. ``scale`` names a column with the number of answers that a prompt asks for.
    """
    places = parallel or max(1, CONCURRENCY // rows.sparkSession.sparkContext.defaultParallelism)

    def one(text: str | None, factor: int, sent: float) -> tuple:
        if text is None:
            return None, None, None, None, None, 0
        began, asked = time.monotonic(), model.scaled(factor) if factor > 1 and hasattr(model, "scaled") else model
        queued = (began - sent) * 1e3
        for i in range(attempts):
            try:
                answer, error = asked.complete(text, phase), None
                break
            except Exception as e:  # the answer of a failed call is its error
                answer, error = None, spelled(e)
                if i + 1 < attempts:
                    time.sleep(backoff * 2**i)
        now = time.monotonic()
        return answer, error, queued, (now - began) * 1e3, (now - sent) * 1e3, i

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(places)
        try:
            for p in parts:
                sent = time.monotonic()
                factors = p[scale] if scale else [1] * len(p)
                calls = [pool.submit(one, t, int(n), sent) for t, n in zip(p[prompt].astype(object).where(p[prompt].notna(), None), factors, strict=True)]
                end = None if timeout is None else sent + timeout
                found = []
                for c in calls:
                    try:
                        found.append(c.result(None if end is None else max(0.0, end - time.monotonic())))
                    except TimeoutError:
                        c.cancel()
                        found.append((None, "timeout", None, None, timeout * 1e3, 0))
                yield p.assign(**{n: pd.Series([x[i] for x in found], index=p.index, dtype=kind) for i, (n, kind) in enumerate(_CALL.items())})
        finally:
            pool.shutdown(wait=timeout is None, cancel_futures=True)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + CALL
    return rows.mapInPandas(run, schema)


_CALL = {"answer": object, "error": object, "queue_ms": "Float64", "llm_ms": "Float64", "total_ms": "Float64", "retries": "int32"}


def rerank_scores(rows: DataFrame, reranker: Reranker, query: str = "query_text", text: str = "content") -> DataFrame:
    """query_id, id, rerank_score, rerank_error of (query_id, rank, id, query, text) rows: one request a query, with the texts that were fetched for it."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", F.col(text).alias("text"))))
    kind = dict(rows.dtypes)["id"]
    asked = rows.groupBy("query_id").agg(F.first(query, ignorenulls=True).alias("q"), listed.alias("texts")).select("query_id", "q", F.transform("texts", lambda x: x["id"]).alias("ids"), F.transform("texts", lambda x: x["text"]).alias("texts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            scores, errors = [], []
            for q, texts in zip(p["q"], p["texts"], strict=True):
                try:
                    scores.append([float(x) for x in reranker.scores(q or "", [x or "" for x in texts])])
                    errors.append(None)
                except Exception as e:  # the list then stays in its order
                    scores.append([])
                    errors.append(spelled(e))
            yield pd.DataFrame({"query_id": p["query_id"], "ids": p["ids"], "scores": scores, "rerank_error": errors})

    told = asked.mapInPandas(run, f"query_id {dict(rows.dtypes)['query_id']}, ids array<{kind}>, scores array<double>, rerank_error string")
    each = told.select("query_id", "rerank_error", F.posexplode("ids").alias("at", "id"), "scores")
    return each.select("query_id", "id", F.get("scores", F.col("at")).alias("rerank_score"), "rerank_error")
