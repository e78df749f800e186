"""Metadata from an external model: request, retries, bounded analysis loop.

The transport is injected: any callable (url, headers, body bytes, timeout) to (status, body
bytes). Calls run in ``mapInArrow``, a bounded number at a time in each task and at a pace that
all tasks together keep to. Without a ``ReplyStore`` each row gets a reply or an error beside
its own columns, and a task that is run again asks again. With one, each different prompt is
asked once: its reply is stored by the digest of model, schema and prompt as soon as it comes,
so a task, job or run that starts over asks only for what isn't there.
"""

from __future__ import annotations

import base64
import hashlib
import json
import logging
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.decode import KEYS, OPTIONAL_TEXTS
from ..functions.text import PROMPT_HEAD, PROMPT_TAIL
from ..scratch import opened, remove_path, write_whole
from ..workers import importable, pieces

#: Fixed values of the protocol.
BODY_BYTES = 1 << 20
ATTEMPTS = 3
REFUSAL_MARKS = ("json_schema", "response_format")
DATE_PATTERN, DECIMAL_PATTERN, CURRENCY_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^-?[0-9]+(\.[0-9]+)?$", "^[A-Z]{3}$"

SYSTEM = "Read the document and fill in the JSON object of the given schema, and nothing else. State only what the document says; what it does not say is null."
TRANSCRIBE_SYSTEM = "Transcribe images of documents: the text only, in reading order, without comments."
TRANSCRIBE_USER = "Write out all text in this image exactly."

log = logging.getLogger(__name__)


class ModelError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


# ---------------------------------------------------------------- classification


def retryable(status: int) -> bool:
    """Worth another try: no answer (0), 429, and server errors but for 501."""
    return status in (0, 429) or (500 <= status <= 599 and status != 501)


def retryable_column(status: Column) -> Column:
    return status.isin(0, 429) | (status.between(500, 599) & (status != 501))


def backoff_ceiling(attempt: int, base: float = 1.0) -> float:
    return base * 2**attempt


def backoff_column(attempt: Column, base: float = 1.0) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def refuses_schema(status: int, body: str) -> bool:
    """Whether a failure says that the endpoint doesn't take constrained output at all."""
    return status in (404, 501) or (status == 400 and any(m in body.lower() for m in REFUSAL_MARKS))


def refuses_schema_column(status: Column, body: Column) -> Column:
    named = F.lit(False)
    for mark in REFUSAL_MARKS:
        named = named | F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit(mark))
    return status.isin(404, 501) | ((status == 400) & named)


# ---------------------------------------------------------------- requests


def response_schema(types: Sequence[str]) -> dict:
    """The schema a reply must keep: every key required, no other, types from the vocabulary."""
    maybe = {"type": ["string", "null"]}
    properties = {k: dict(maybe) for k in OPTIONAL_TEXTS}
    properties["document_date"] |= {"pattern": DATE_PATTERN}
    properties["due_date"] |= {"pattern": DATE_PATTERN}
    properties["amount"] |= {"pattern": DECIMAL_PATTERN}
    properties["currency"] |= {"pattern": CURRENCY_PATTERN}
    properties |= {k: {"type": "string"} for k in ("title", "filename")}
    properties["type"] = {"type": "string", "enum": list(types)}
    properties["tags"] = {"type": "array", "items": {"type": "string"}}
    body = {"type": "object", "additionalProperties": False, "required": sorted(KEYS), "properties": properties}
    return {"name": "document_metadata", "strict": True, "schema": body}


def user_prompt(text: Column, types: Sequence[str], fallback: str, tags: Sequence[str]) -> Column:
    """The document's text and the vocabularies."""
    told = f"\n\n----\nValues of type: {', '.join(types)}."
    if fallback:
        told += f" When none fits, take {fallback}."
    told += f"\nValues of tags: {', '.join(tags)}. There may be none." if tags else "\nTags are any words in lower case. There may be none."
    told += "\nThe filename is a few words joined by hyphens, without date or extension.\n"
    return F.concat(F.lit("Document:\n\n"), F.coalesce(text, F.lit("")), F.lit(told))


def request_body(model: str, system: str, user: str, images: Sequence[tuple[str, bytes]] = (), schema: dict | None = None) -> dict:
    messages = [{"role": "system", "content": system}] if system else []
    if images:
        parts = [{"type": "text", "text": user}] if user else []
        parts += [{"type": "image_url", "image_url": {"url": f"data:{m};base64,{base64.b64encode(d).decode()}"}} for m, d in images]
        messages.append({"role": "user", "content": parts})
    else:
        messages.append({"role": "user", "content": user})
    body = {"model": model, "messages": messages}
    if schema is not None:
        body["response_format"] = {"type": "json_schema", "json_schema": schema}
    return body


def traced(role: str, prompt: str) -> list[str]:
    """A prompt's lines for a debug log, each under its role; the middle of a long one left out."""
    n, shown = len(prompt), PROMPT_HEAD + PROMPT_TAIL
    if n > shown:
        prompt = f"{prompt[:PROMPT_HEAD]}\n… (elided {n - shown} of {n} runes) …\n{prompt[-PROMPT_TAIL:]}"
    return [f"  {role:<6}| {line}" for line in prompt.split("\n")] if prompt else []


def http_transport(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as got:
            return got.status, got.read(BODY_BYTES)
    except urllib.error.HTTPError as e:
        return e.code, e.read(BODY_BYTES)


class Pace:
    """At most ``rate`` starts a second, by all threads of a process that share it."""

    def __init__(self, rate: float):
        self.gap, self.next, self.lock = 1 / rate, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            begin = max(now, self.next)
            self.next = begin + self.gap
        time.sleep(begin - now)


_paces: dict[tuple[str, float], Pace] = {}
_paces_lock = threading.Lock()


def pace_of(endpoint: str, rate: float) -> Pace:
    """This process's pace for an endpoint."""
    with _paces_lock:
        return _paces.setdefault((endpoint, rate), Pace(rate))


@dataclass(frozen=True)
class Client:
    base_url: str
    model: str
    api_key: str = field(default="", repr=False)
    timeout: float = 120.0
    retries: int = ATTEMPTS
    backoff: float = 1.0
    transport: Callable[[str, dict, bytes, float], tuple[int, bytes]] = http_transport
    #: Requests that this client starts a second, 0 for any number.
    rate: float = 0.0

    def __post_init__(self):
        if not self.base_url or not self.model:
            raise ModelError("not-configured", "base_url and model are both needed")

    def complete(self, system: str, user: str, images: Sequence[tuple[str, bytes]] = (), schema: dict | None = None) -> str:
        """The content of the first choice, after as many tries as failures allow."""
        url = self.base_url.rstrip("/") + "/chat/completions"
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        if log.isEnabledFor(logging.DEBUG):
            log.debug("prompt for %s at %s, %d characters, %d images", self.model, self.base_url, len(user), len(images))
            for line in [*traced("system", system), *traced("user", user)]:
                log.debug("%s", line)
        body = json.dumps(request_body(self.model, system, user, images, schema), ensure_ascii=False).encode()
        problem = ""
        for attempt in range(max(self.retries, 1)):
            if attempt:
                time.sleep(random.random() * backoff_ceiling(attempt - 1, self.backoff))
            if self.rate > 0:
                pace_of(self.base_url, self.rate).wait()
            try:
                status, raw = self.transport(url, headers, body, self.timeout)
            except (OSError, TimeoutError) as e:
                status, raw = 0, str(e).encode()
            said = raw[:BODY_BYTES].decode("utf-8", "replace")
            if status == 200:
                return self._content(url, said)
            problem = f"{url}: HTTP {status}: {said.strip()[:512]}" if status else f"{url}: {said}"
            if not retryable(status):
                if schema is not None and refuses_schema(status, said):
                    raise ModelError("schema-unsupported", f"{self.base_url} does not honour schemas for model {self.model}: {problem}")
                raise ModelError("transport", problem)
        raise ModelError("transport", f"giving up after {max(self.retries, 1)} attempts: {problem}")

    @staticmethod
    def _content(url: str, said: str) -> str:
        try:
            choices = json.loads(said).get("choices") or []
            if choices:
                return choices[0]["message"].get("content") or ""
        except (ValueError, AttributeError, KeyError, TypeError) as e:
            raise ModelError("transport", f"{url}: the response is not as expected: {e}") from e
        raise ModelError("transport", f"{url}: the response has no choices")

    def transcribe(self, media: str, data: bytes) -> str:
        return self.complete(TRANSCRIBE_SYSTEM, TRANSCRIBE_USER, [(media, data)])


# ---------------------------------------------------------------- analysis


def _strict(raw: str, types: Sequence[str], tags: Sequence[str]) -> str | None:
    """None if a reply is good, 'malformed', or 'rejected: …': the check between attempts. The
    verdict that counts is made from the reply in ``functions.decode``."""
    try:
        got = json.loads(raw, object_pairs_hook=lambda pairs: {k.lower(): v for k, v in pairs})
    except ValueError:
        return "malformed"
    if not isinstance(got, dict) or set(got) - set(KEYS):
        return "malformed"
    if any(v is not None and not isinstance(v, str) for k, v in got.items() if k != "tags"):
        return "malformed"
    labels = got.get("tags")
    if not isinstance(labels, list) or any(t is not None and not isinstance(t, str) for t in labels):
        return "malformed"
    if any(not (got.get(k) or "").strip() for k in ("title", "type", "filename")):
        return "malformed"
    if types and got["type"].strip() not in types:
        return f"rejected: type {got['type'].strip()}"
    if tags:
        for tag in labels:
            if (tag or "").strip() and tag.strip().lower() not in tags:
                return f"rejected: tag {tag.strip().lower()}"
    return None


def analysed(client: Client, prompt: str, types: Sequence[str], tags: Sequence[str], attempts: int = ATTEMPTS) -> str:
    """A reply that keeps the schema and the vocabularies, within ``attempts`` askings."""
    faults = []
    for _ in range(attempts if attempts > 0 else ATTEMPTS):
        raw = client.complete(SYSTEM, prompt, schema=response_schema(types))
        fault = _strict(raw, types, tags)
        if fault is None:
            return raw
        faults.append(fault)
    if all(f == "malformed" for f in faults):
        raise ModelError("schema-unsupported", f"{len(faults)} of {len(faults)} replies did not conform to the schema")
    raise ModelError("rejected", f"no usable metadata after {len(faults)} attempts: {faults[-1]}")


_ADDED = ("reply", "reply_error_kind", "reply_error_msg")
#: Requests of a task that are under way at a time.
WINDOW = 8


@dataclass(frozen=True)
class ReplyStore:
    """Replies by key in a folder that the driver and all executors share: a small file each as
    they come, and tables of those that ``compact`` has gathered. Failures are not kept, so
    they are asked for again. The same prompt is asked twice only if two attempts of one
    task run at once."""

    folder: str

    def key(self, client: Client, types: Sequence[str], prompt: Column) -> Column:
        """What a reply depends on: model, schema and the whole prompt."""
        fixed = json.dumps([client.base_url, client.model, SYSTEM, response_schema(types)], sort_keys=True)
        return F.sha2(F.concat(F.lit(hashlib.sha256(fixed.encode()).hexdigest()), prompt).cast("binary"), 256)

    def _file(self, key: str):
        fs, root = opened(self.folder)
        return fs, f"{root}/new/{key[:2]}/{key}.json"

    def get(self, key: str) -> str | None:
        fs, path = self._file(key)
        try:
            with fs.open_input_stream(path) as f:
                return json.loads(f.read())["reply"]
        except FileNotFoundError:
            return None

    def put(self, key: str, reply: str) -> None:
        fs, path = self._file(key)
        write_whole(fs, path, json.dumps({"key": key, "reply": reply}).encode())

    def gathered(self, spark) -> DataFrame | None:
        """(key, reply) of all compacted tables."""
        fs, root = opened(self.folder)
        from pyarrow.fs import FileSelector

        runs = [x.base_name for x in fs.get_file_info(FileSelector(f"{root}/runs", allow_not_found=True)) if fs.get_file_info(f"{x.path}/_SUCCESS").is_file]
        return spark.read.schema("key string, reply string").parquet(*[f"{self.folder}/runs/{x}" for x in runs]) if runs else None

    def compact(self, spark) -> None:
        """Gather the small files into one more table and remove them, while nothing is asked."""
        fs, root = opened(self.folder)
        if fs.get_file_info(f"{root}/new").type.name == "NotFound":
            return
        files = spark.read.schema("key string, reply string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{self.folder}/new")
        files.dropDuplicates(["key"]).write.parquet(f"{self.folder}/runs/{time.time_ns()}")
        remove_path(spark, f"{self.folder}/new")


def with_replies(
    docs: DataFrame,
    text: Column,
    client: Client,
    types: Sequence[str],
    fallback: str,
    tags: Sequence[str],
    attempts: int = ATTEMPTS,
    store: ReplyStore | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """Add reply, reply_error_kind and reply_error_msg. Rows whose ``text`` is null aren't asked
    about and get nulls.

    Without a store all rows pass through the task that asks, so nothing is joined. With one,
    ``docs`` are read twice, for their prompts and to be joined to the replies, so they
    should be a stored table. A rate of the client is dealt over the tasks that run at once."""
    importable(docs.sparkSession)
    if client.rate > 0:
        client = Client(**{**client.__dict__, "rate": client.rate / max(1, docs.sparkSession.sparkContext.defaultParallelism)})
    prompted = docs.withColumn("_prompt", F.when(text.isNotNull(), user_prompt(text, types, fallback, tags)))

    def answer(prompt: str | None, key: str | None = None) -> tuple:
        if prompt is None:
            return None, None, None
        try:
            reply = store.get(key) if key else None
            if reply is None:
                reply = analysed(client, prompt, types, tags, attempts)
                if key:
                    store.put(key, reply)
            return reply, None, None
        except ModelError as e:
            return None, e.kind, str(e)

    def asked(rows: DataFrame) -> DataFrame:
        """``rows`` with what is told of _prompt in its place, which is their last column."""
        keyed = "_key" in rows.columns

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(max(1, window)) as pool:
                for batch in pieces(batches, "_prompt"):
                    given = [batch.column("_prompt").to_pylist(), *([batch.column("_key").to_pylist()] if keyed else [])]
                    told = list(pool.map(answer, *given))
                    own = [batch.column(k) for k in range(batch.num_columns - 1)]
                    new = [pa.array([t[k] for t in told], pa.string()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(own + new, names=[*batch.schema.names[:-1], *_ADDED])

        return rows.mapInArrow(ask, StructType([*rows.schema.fields[:-1], *[StructField(k, StringType()) for k in _ADDED]]))

    if store is None:
        return asked(prompted)
    keyed = prompted.withColumn("_key", store.key(client, types, F.col("_prompt")))
    wanted = keyed.where("_key IS NOT NULL").select("_key", "_prompt").dropDuplicates(["_key"])
    known = store.gathered(docs.sparkSession)
    if known is None:
        told = asked(wanted)
    else:
        known = known.select(F.col("key").alias("_key"), "reply")
        told = asked(wanted.join(known, "_key", "left_anti")).unionByName(known.join(wanted.select("_key"), "_key", "left_semi"), allowMissingColumns=True)
    return keyed.drop("_prompt").join(told, "_key", "left").drop("_key")
